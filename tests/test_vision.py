"""Frame kernels against pixel-by-pixel brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanline.operators import vision
from spanline.plans import io_queries

DATA = "/root/testdata/sf0.001"


def flood(mask):
    """Sorted (area, left, top, right, bottom) of eight-connected components, by filling."""
    seen, out = set(), []
    h, w = mask.shape
    for y in range(h):
        for x in range(w):
            if mask[y, x] and (y, x) not in seen:
                todo, own = [(y, x)], []
                seen.add((y, x))
                while todo:
                    a, b = todo.pop()
                    own.append((a, b))
                    for c in range(max(0, a - 1), min(h, a + 2)):
                        for d in range(max(0, b - 1), min(w, b + 2)):
                            if mask[c, d] and (c, d) not in seen:
                                seen.add((c, d))
                                todo.append((c, d))
                ys, xs = zip(*own)
                out.append((len(own), min(xs), min(ys), max(xs), max(ys)))
    return sorted(out)


def test_components():
    rng = np.random.default_rng(0)
    for h, w, share in ((1, 1, 0.5), (1, 30, 0.5), (30, 1, 0.5), (12, 17, 0.0), (12, 17, 1.0), (20, 20, 0.3), (40, 25, 0.45), (25, 40, 0.6)):
        for _ in range(10):
            mask = rng.random((h, w)) < share
            assert sorted(map(tuple, vision.components(mask).tolist())) == flood(mask)
    corner = np.eye(5, dtype=bool) | np.eye(5, dtype=bool)[::-1]
    assert len(vision.components(corner)) == 1


def slow_mask(img, window, offset, scale):
    """Enlarged, smoothed and compared with the mean around, pixel by pixel."""
    h, w = img.shape
    at = lambda i, n: min(max((i + 0.5) / scale - 0.5, 0), n - 1)
    big = np.zeros((h * scale, w * scale))
    for y in range(h * scale):
        for x in range(w * scale):
            fy, fx = at(y, h), at(x, w)
            a, b = min(int(fy), h - 1), min(int(fx), w - 1)
            c, d = min(a + 1, h - 1), min(b + 1, w - 1)
            big[y, x] = (img[a, b] * (1 - fx + b) + img[a, d] * (fx - b)) * (1 - fy + a) + (img[c, b] * (1 - fx + b) + img[c, d] * (fx - b)) * (fy - a)
    px = lambda m, y, x: m[min(max(y, 0), m.shape[0] - 1), min(max(x, 0), m.shape[1] - 1)]
    soft = np.array([[sum(px(big, y + i, x + j) * (2 - abs(i)) * (2 - abs(j)) for i in (-1, 0, 1) for j in (-1, 0, 1)) / 16 for x in range(w * scale)] for y in range(h * scale)])
    half = window // 2
    mean = np.array([[np.mean([px(soft, y + i, x + j) for i in range(-half, half + 1) for j in range(-half, half + 1)]) for x in range(w * scale)] for y in range(h * scale)])
    return soft - (mean - offset)


def test_features_of_all_frames(spark):
    """Every frame of the query, by the definitions: masks, filling, shapes and ratios."""
    cfg = io_queries.FEATURES
    got = {(r.video_id, r.frame_index): r for r in io_queries.QUERIES["h4_frame_features"](spark, DATA).collect()}
    frames = io_queries.grey(spark, DATA).collect()
    some = 0
    for r in frames:
        level = slow_mask(np.frombuffer(bytes(r.gray), np.uint8).reshape(r.h, r.w).astype(float), cfg["window"], cfg["offset"], 2)
        if (abs(level) < 1e-6).any():
            continue  # a tie that rounding decides
        kept = [c for c in flood(level <= 0) if cfg["min_area"] <= c[0] <= cfg["max_area"] and 0.1 <= (c[3] - c[1] + 1) / (c[4] - c[2] + 1) <= 10]
        h, w = level.shape
        total = sum(c[0] for c in kept)
        want = (0.0, 0, 0.0, 0.0, 0.0, 0.0, 0.0)
        if kept:
            left, top, right, bottom = min(c[1] for c in kept), min(c[2] for c in kept), max(c[3] for c in kept), max(c[4] for c in kept)
            want = (total / (h * w), len(kept), left / w, right / w, (right - left + 1) / w, (bottom - top + 1) / h, max(c[0] for c in kept) / total)
            some += 1
        assert tuple(got[r.video_id, r.frame_index])[2:] == pytest.approx(want), (r.video_id, r.frame_index)
    assert some > 0.5 * len(frames)


def test_shapes():
    img = np.full((40, 60), 200, np.uint8)
    img[10:20, 10:14] = 30  # a stroke
    img[30:32, 5:55] = 30  # a long line, too flat for text
    stats = vision.frame_stats(img, {"scale": 1, "smooth": 0, "window": 21, "offset": 10.0})
    assert stats[1] == 1 and stats[2] == 10 / 60 and stats[3] == 13 / 60 and stats[6] == 1.0


def slow_correlation(img, t):
    best = -1.0
    th, tw = t.shape
    for y in range(img.shape[0] - th + 1):
        for x in range(img.shape[1] - tw + 1):
            w = img[y : y + th, x : x + tw]
            a, b = w - w.mean(), t - t.mean()
            n = np.sqrt((a * a).sum() * (b * b).sum())
            best = max(best, (a * b).sum() / n if n > 1e-9 else 0.0)
    return best


def test_correlation():
    rng = np.random.default_rng(1)
    for ih, iw, th, tw in ((8, 8, 3, 3), (20, 31, 7, 5), (5, 5, 5, 5), (9, 4, 1, 4), (30, 30, 29, 2)):
        img, t = rng.integers(0, 256, (ih, iw)).astype(float), rng.integers(0, 256, (th, tw)).astype(float)
        assert vision.best_correlation(img, t) == pytest.approx(slow_correlation(img, t), abs=1e-9)
        img[: ih // 2] = 77.0  # even windows
        assert vision.best_correlation(img, t) == pytest.approx(slow_correlation(img, t), abs=1e-9)
    assert vision.best_correlation(np.full((6, 6), 9.0), t) == 0 and vision.best_correlation(img, np.ones((2, 2))) == 0
    big = rng.integers(0, 256, (12, 12)).astype(float)
    assert vision.best_correlation(vision.area_resized(big, 6, 6), big) == pytest.approx(1.0)
    found = np.zeros((20, 20))
    found[4:9, 7:12] = big[:5, :5]
    assert vision.best_correlation(found, big[:5, :5]) == pytest.approx(1.0)


def test_match_images(spark):
    img = np.zeros((6, 7), np.uint8)
    img[1:4, 2:5] = [[9, 200, 9], [200, 9, 200], [9, 200, 9]]
    rows = [("v", 1, 7, 6, img.tobytes()), ("v", 2, 7, 6, None), ("v", 3, 7, 6, bytes(42))]
    f = spark.createDataFrame(rows, "video_id string, frame_index int, w int, h int, gray binary").withColumn("_x", F.lit(1))
    got = {r.frame_index: r.score for r in vision.match_images(f, [img[1:4, 2:5]], 1, 1, "vertical").collect()}
    assert got == {1: pytest.approx(1.0), 2: None, 3: 0.0}
    assert {r.frame_index: r.score for r in vision.match_images(f, [img[1:4, 2:5]], crop_width=2).collect()}[1] < 1
    assert vision.moved(img, 2, 1)[1].tolist() == [0, 0, 0, 0, 9, 200, 9] and vision.moved(img, -2, 0)[4].tolist() == img[5].tolist()
