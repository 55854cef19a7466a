"""Numeric kernels over decoded grey frames and vectors, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fan_out_rois(frames: DataFrame, rois: dict[str, tuple[int, int, int, int]]) -> DataFrame:
    """(video_id, frame_number, roi, w, h, gray): all crops of each frame in one scan.

    frames(video_id, frame_index, w, h, gray).  Frame numbers count from 1.  A
    rectangle is clamped to the image; one that leaves nothing gives no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.gray is None:
                    continue
                img = np.frombuffer(r.gray, np.uint8).reshape(r.h, r.w)
                for name, (x1, y1, x2, y2) in rois.items():
                    part = img[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)]
                    if part.size:
                        out.append((r.video_id, r.frame_index + 1, name, part.shape[1], part.shape[0], part.tobytes()))
            yield pd.DataFrame(out, columns=["video_id", "frame_number", "roi", "w", "h", "gray"])

    return frames.select("video_id", "frame_index", "w", "h", "gray").mapInPandas(run, "video_id string, frame_number int, roi string, w int, h int, gray binary")


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    """Rows moved by some places, the edge value repeated."""
    at = np.clip(np.arange(x.shape[1]) - by, 0, x.shape[1] - 1)
    return x[:, at]


def centred(x: np.ndarray) -> np.ndarray:
    z = x - x.mean(axis=1, keepdims=True)
    n = np.linalg.norm(z, axis=1, keepdims=True)
    return np.divide(z, n, out=np.zeros_like(z), where=n > 0)


def shrunk(x: np.ndarray, n: int) -> np.ndarray:
    """Rows brought to n places by means over equal shares of them, if they have more."""
    if x.shape[1] <= n:
        return x
    total = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x, axis=1)], axis=1)
    edge = np.linspace(0, x.shape[1], n + 1)
    whole = np.minimum(edge.astype(np.int64), x.shape[1] - 1)
    upto = total[:, whole] + (edge - whole) * x[:, whole]
    return np.diff(upto, axis=1) * n / x.shape[1]


def template_match(df: DataFrame, vec: str, templates: np.ndarray, shift: int = 0, step: int = 1, crop: int | None = None, out: str = "score") -> DataFrame:
    """Adds the best normalised correlation of each vector with the templates, moved by up to ``shift`` places.

    Within 0 and 1; null for a null vector.  ``crop`` compares the middle places
    only.  Templates (few, of one length) go with the task; longer ones are shrunk
    to the vectors' length, shorter ones don't match.
    """
    shifts = [0, *[s * d for d in range(step, shift + 1, step) for s in (1, -1)]]

    def cut(x):
        lo = (x.shape[1] - crop) // 2 if crop and crop < x.shape[1] else 0
        return x[:, lo : lo + crop] if crop else x

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        got = np.full(len(s), np.nan)
        lens = s.map(lambda v: -1 if v is None else len(v)).to_numpy()
        for n in np.unique(lens[lens > 0]):
            at = np.flatnonzero(lens == n)
            x = centred(cut(np.array(s.iloc[at].tolist(), np.float64)))
            t = shrunk(templates.astype(np.float64), n)
            best = np.max([x @ centred(cut(shifted(t, d))).T for d in shifts], axis=(0, 2)) if t.shape[1] == n else np.zeros(len(at))
            got[at] = np.clip(best, 0, 1)
        return pd.Series(got).where(~np.isnan(got), None)

    return df.withColumn(out, score(vec))


def enlarged(x: np.ndarray, scale: int) -> np.ndarray:
    """An image with each side ``scale`` times as long, linear between pixel centres."""
    for axis in (0, 1):
        n = x.shape[axis]
        at = np.clip((np.arange(n * scale) + 0.5) / scale - 0.5, 0, n - 1)
        low = np.minimum(at.astype(np.int64), max(0, n - 2))
        part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        x = x.take(low, axis) * (1 - part) + x.take(np.minimum(low + 1, n - 1), axis) * part
    return x


def smoothed(x: np.ndarray, rounds: int) -> np.ndarray:
    """Binomial means over three by three pixels, edges repeated."""
    for _ in range(rounds):
        p = np.pad(x, 1, mode="edge")
        p = (p[:-2] + 2 * p[1:-1] + p[2:]) / 4
        x = (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]) / 4
    return x


def text_mask(img: np.ndarray, window: int = 31, offset: float = 10.0, scale: int = 2, smooth: int = 1, dark: bool = True) -> np.ndarray:
    """Places darker (or brighter) than their surroundings by ``offset``: a local threshold over box means.

    The image is enlarged and smoothed first, so the mask has ``scale`` times its sides.
    """
    x = smoothed(enlarged(img.astype(np.float64), max(1, scale)), smooth)
    pad = window // 2
    p = np.pad(x, pad + 1, mode="edge")
    c = p.cumsum(axis=0).cumsum(axis=1)
    h, w = x.shape
    box = c[window : window + h, window : window + w] - c[:h, window : window + w] - c[window : window + h, :w] + c[:h, :w]
    mean = box / window**2
    return x <= mean - offset if dark else x > mean + offset


def components(mask: np.ndarray) -> np.ndarray:
    """(area, left, top, right, bottom) of the eight-connected components, ends included, in two passes over runs.

    The first finds the runs of each row and unites those that touch a run of the row
    above, side by side or cornerwise; the second adds up what each root has.
    """
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    row, start = np.nonzero(np.diff(padded, axis=1) == 1)
    end = np.nonzero(np.diff(padded, axis=1) == -1)[1]  # runs are [start, end)
    n = len(row)
    wide = w + 2
    above = (row - 1) * wide
    lo = np.searchsorted(row * wide + end, above + start)
    hi = np.searchsorted(row * wide + start, above + end, side="right")
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for b, (x, y) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
        for a in range(x, y):
            i, j = find(a), find(b)
            root[max(i, j)] = min(i, j)
    of = np.array([find(i) for i in range(n)], np.int64)
    _, own = np.unique(of, return_inverse=True)
    out = np.zeros((own.max() + 1 if n else 0, 5), np.int64)
    out[:, 1:3], out[:, 3:] = max(h, w), -1
    np.add.at(out[:, 0], own, end - start)
    np.minimum.at(out[:, 1], own, start)
    np.minimum.at(out[:, 2], own, row)
    np.maximum.at(out[:, 3], own, end - 1)
    np.maximum.at(out[:, 4], own, row)
    return out


#: The least and largest area, least width and height, and range of width to height of a component, by mode.
SHAPES = {
    "text": {"min_area": 8, "max_area": 2500, "min_width": 2, "min_height": 4, "min_ratio": 0.1, "max_ratio": 10.0},
    "marker": {"min_area": 25, "max_area": 6000, "min_width": 4, "min_height": 4, "min_ratio": 0.0, "max_ratio": float("inf")},
}


def frame_stats(img: np.ndarray, cfg: dict) -> tuple:
    """(presence, components, x_min, x_max, x_span, y_span, largest) of the text-like mask.

    cfg: window, offset, scale, smooth and dark as for :func:`text_mask`; ``mode`` and any
    of its SHAPES.  Components of another shape are left out of the mask.  Presence is
    the mask's part of the image, extents are parts of its sides, and ``largest`` is the
    largest component's part of the mask.
    """
    found = text_mask(img, *(cfg.get(c, v) for c, v in (("window", 31), ("offset", 10.0), ("scale", 2), ("smooth", 1), ("dark", True))))
    h, w = found.shape
    lim = SHAPES[cfg.get("mode", "text")] | cfg
    c = components(found)
    wide, high = c[:, 3] - c[:, 1] + 1, c[:, 4] - c[:, 2] + 1
    ratio = wide / np.maximum(high, 1)
    keep = (c[:, 0] >= lim["min_area"]) & (c[:, 0] <= lim["max_area"]) & (wide >= lim["min_width"]) & (high >= lim["min_height"]) & (ratio >= lim["min_ratio"]) & (ratio <= lim["max_ratio"])
    c = c[keep]
    if not len(c):
        return 0.0, 0, 0.0, 0.0, 0.0, 0.0, 0.0
    left, top, right, bottom = int(c[:, 1].min()), int(c[:, 2].min()), int(c[:, 3].max()), int(c[:, 4].max())
    total = int(c[:, 0].sum())
    return total / (h * w), len(c), left / w, right / w, (right - left + 1) / w, (bottom - top + 1) / h, int(c[:, 0].max()) / total


def frame_features(frames: DataFrame, cfg: dict | None = None) -> DataFrame:
    """(video_id, frame_index, presence, components, extents, largest) of decoded grey frames; nulls stay null.

    The columns are what :func:`spanline.functions.scalars.presence_decision` takes.
    """
    names = ["presence", "components", "x_min", "x_max", "x_span", "y_span", "largest"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                stats = (None,) * 7 if r.gray is None else frame_stats(np.frombuffer(r.gray, np.uint8).reshape(r.h, r.w), cfg or {})
                out.append((r.video_id, r.frame_index, *stats))
            yield pd.DataFrame(out, columns=["video_id", "frame_index", *names]).astype({"components": "Int64"})

    return frames.select("video_id", "frame_index", "w", "h", "gray").mapInPandas(run, "video_id string, frame_index int, presence double, components long, x_min double, x_max double, x_span double, y_span double, largest double")


def area_resized(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """An image brought to h by w pixels by means over equal shares of its sides."""
    return shrunk(shrunk(x, w).T, h).T


def moved(img: np.ndarray, by: int, axis: int) -> np.ndarray:
    """An image moved along an axis, its edge repeated."""
    n = img.shape[axis]
    return img.take(np.clip(np.arange(n) - by, 0, n - 1), axis)


def best_correlation(img: np.ndarray, template: np.ndarray) -> float:
    """The largest normalised cross-correlation of a template slid over an image, from -1 to 1.

    All places at once: products by the fast Fourier transform, the norms of the
    image's windows from integral images.  Even windows correlate with nothing; a
    template larger than the image is shrunk, its sides alike, to fit.
    """
    ih, iw = img.shape
    th, tw = template.shape
    if th > ih or tw > iw:
        ratio = min(ih / th, iw / tw)
        template = area_resized(template, max(1, int(th * ratio)), max(1, int(tw * ratio)))
        th, tw = template.shape
    t = template - template.mean()
    norm = np.sqrt((t * t).sum())
    if not norm > 1e-9:
        return 0.0
    x = img - img.mean()  # keeps the sums small
    shape = (ih + th - 1, iw + tw - 1)
    product = np.fft.irfft2(np.fft.rfft2(x, shape) * np.fft.rfft2(t[::-1, ::-1], shape), shape)[th - 1 : ih, tw - 1 : iw]

    def windows(a: np.ndarray) -> np.ndarray:
        c = np.pad(a.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
        return c[th:, tw:] - c[:-th, tw:] - c[th:, :-tw] + c[:-th, :-tw]

    spread = np.maximum(windows(x * x) - windows(x) ** 2 / (th * tw), 0)
    flat = spread <= 1e-9 * (x * x).sum()
    return float(np.divide(product, norm * np.sqrt(spread), out=np.zeros_like(product), where=~flat).max())


def match_images(frames: DataFrame, templates: list[np.ndarray], shift: int = 0, step: int = 1, axis: str = "vertical", crop_width: int | None = None, out: str = "score") -> DataFrame:
    """Adds the best correlation of each grey frame with any of the templates, slid over it; within 0 and 1.

    frames(..., w, h, gray).  The frame is also tried moved by up to ``shift`` pixels in
    steps of ``step`` along the axis, its edge repeated; ``crop_width`` looks at the
    middle columns only.  Templates, a few grey images, go with the task.  A null frame
    has a null score.
    """
    tried = [0, *[s * d for d in range(step, shift + 1, step) for s in (-1, 1)]]
    along = 0 if axis == "vertical" else 1
    grey = [np.asarray(t, np.float64) for t in templates]

    def score(pixels: bytes, w: int, h: int) -> float | None:
        if pixels is None:
            return None
        img = np.frombuffer(pixels, np.uint8).reshape(h, w).astype(np.float64)
        if crop_width and crop_width < w:
            lo = (w - crop_width) // 2
            img = img[:, lo : lo + crop_width]
        best = max((best_correlation(moved(img, d, along), t) for d in tried for t in grey), default=0.0)
        return min(1.0, max(0.0, best))

    @F.pandas_udf("double")
    def scores(pixels: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([score(*x) for x in zip(pixels, w, h, strict=True)], dtype="float64").astype(object).where(pixels.notna(), None)

    return frames.withColumn(out, scores("gray", "w", "h"))
