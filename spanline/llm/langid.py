"""Language identification with a byte convolutional network, trained and applied in numpy.

Text is lower-cased (A-Z), mapped to a reduced byte alphabet and cut into windows
of fixed length.  Filters of several widths run over each window, are
max-pooled, and feed a softmax; a text's probabilities are the mean over all of
its windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanline.llm import textkit as tk
from spanline.llm.common import SENT, broadcast_if, cut

WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 12
WINDOW = 256
LETTER = re.compile(r"[^\W\d_]")

#: The reduced alphabet: 0 pads; a-z; one symbol each for white space, digits and other ASCII; 64 trailing and 64 leading bytes of UTF-8.
ALPHABET = np.array(
    [
        (b - 96) if 97 <= b <= 122 else 27 if (b == 32 or 9 <= b <= 13) else 28 if 48 <= b <= 57 else 30 + (b & 63) if 128 <= b < 192 else 94 + (b & 31) if b >= 192 else 29
        for b in range(256)
    ],
    dtype=np.uint8,
)
SYMBOLS = 126


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, row) of all windows of a slice; the last window of each text is padded with 0.

    Text is dealt evenly to its windows, so that the last isn't a few bytes.
    """
    sym = ALPHABET[tk.LOWER[data]]
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    lo = offsets[row] + size[row] * k // n[row]
    hi = offsets[row] + size[row] * (k + 1) // n[row]
    at = lo[:, None] + np.arange(WINDOW)
    out = sym[np.minimum(at, max(len(sym) - 1, 0))] if len(row) else np.zeros((0, WINDOW), np.uint8)
    out[at >= hi[:, None]] = 0
    return out, row


class Network:
    """Embedding, filters of several widths, max pooling, softmax."""

    def __init__(self, langs: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"emb": rng.normal(0, 0.5, (SYMBOLS, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w, EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.p["bias"] = np.zeros(len(langs), np.float32)

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Filter responses as tables: a pair of symbols at a time, and a single one for odd widths."""
        out = {}
        for w in WIDTHS:
            one = [self.p["emb"] @ self.p[f"f{w}"][j] for j in range(w)]
            parts = [(one[j][:, None] + one[j + 1][None]).reshape(-1, FILTERS) for j in range(0, w - 1, 2)]
            out[w] = [np.ascontiguousarray(x, np.float32) for x in (*parts, *([one[-1]] if w % 2 else []))]
        return out

    def pooled(self, x: np.ndarray, tables) -> np.ndarray:
        """Max-pooled filter responses of windows x, from the tables of :meth:`tables`."""
        pair = x[:, :-1].astype(np.int32) * SYMBOLS + x[:, 1:]
        feats = []
        for w in WIDTHS:
            n = WINDOW - w + 1
            acc = None
            for i, t in enumerate(tables[w]):
                got = t.take(pair[:, 2 * i : 2 * i + n] if len(t) > SYMBOLS else x[:, 2 * i : 2 * i + n], axis=0)
                acc = got if acc is None else np.add(acc, got, out=acc)
            feats.append(np.maximum(acc.max(axis=1) + self.p[f"b{w}"], 0))
        return np.concatenate(feats, axis=1)

    def predict(self, x: np.ndarray, tables, chunk: int = 128) -> np.ndarray:
        out = np.empty((len(x), len(self.langs)), np.float32)
        for i in range(0, len(x), chunk):
            z = self.pooled(x[i : i + chunk], tables) @ self.p["out"] + self.p["bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[i : i + chunk] = z / z.sum(axis=1, keepdims=True)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n = len(x)
        e = self.p["emb"][x]
        feats, at = [], {}
        for w in WIDTHS:
            m = WINDOW - w + 1
            z = sum(e[:, j : j + m] @ self.p[f"f{w}"][j] for j in range(w))
            at[w] = z.argmax(axis=1)
            feats.append(np.take_along_axis(z, at[w][:, None], axis=1)[:, 0] + self.p[f"b{w}"])
        pre = np.concatenate(feats, axis=1)
        h = np.maximum(pre, 0)
        z = h @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(n), y] -= 1
        d /= n
        g = {"out": h.T @ d, "bias": d.sum(axis=0), "emb": np.zeros_like(self.p["emb"])}
        dh = (d @ self.p["out"].T) * (pre > 0)
        for i, w in enumerate(WIDTHS):
            dz = dh[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"b{w}"] = dz.sum(axis=0)
            g[f"f{w}"] = np.zeros_like(self.p[f"f{w}"])
            for j in range(w):  # only where a filter's maximum stands does anything flow back
                sym = x[np.arange(n)[:, None], at[w] + j]
                g[f"f{w}"][j] = np.einsum("nfe,nf->ef", self.p["emb"][sym], dz)
                np.add.at(g["emb"], sym.ravel(), (dz[:, :, None] * self.p[f"f{w}"][j].T[None]).reshape(-1, EMBED))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.01, seed: int = 1) -> None:
        """Adam over shuffled batches, classes drawn equally often."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        members = [np.flatnonzero(y == c) for c in range(len(self.langs))]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(c, -(-batch // len(members))) for c in members if len(c)])
            for k, g in self.gradients(x[pick], y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
                self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)


def ranked(chosen: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of each language with the smallest draws."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "body"))
    return chosen.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def train(docs: DataFrame, per_lang: int = 150, text_chars: int = 4000, steps: int = 600, seed: int = 0) -> Network | None:
    """A network fitted on a bounded sample of labelled rows: None if there are none.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out.  Of the others, the
    sample has about 2 * ``per_lang`` rows of each language, no more, those with the
    smallest hashes of doc_id, and ``text_chars`` characters from the middle of
    each: the only bounds on what is learned from.  Every language is learned.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).select("doc_id", "lang", "text")
    counts = cut(rows.groupBy("lang").count(), "languages")
    langs = sorted(r["lang"] for r in counts.select("lang").collect())  # one row a class, as the network has them
    if not langs:
        return None
    draw = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("draw")
    mid = F.greatest(F.lit(1), ((F.length("text") - text_chars) / 2).cast("int"))
    # Chosen by label and id first, so that texts are cut and moved for few rows only.
    chosen = rows.join(broadcast_if(counts, len(langs), SENT), "lang").where(draw * F.col("count") < 2 * per_lang).select("lang", F.substr(F.col("text"), mid, F.lit(text_chars)).alias("body"), draw)
    sample = ranked(chosen, 2 * per_lang).orderBy("draw", "lang", "body").toArrow()
    xs, ys = [], []
    lang = [langs.index(v) for v in sample.column("lang").to_pylist()]
    for row, data, offs in tk.slices(sample.column("body")):
        x, r = windows(data, offs)
        xs.append(x)
        ys.append(np.asarray(lang, np.int64)[row + r])
    x, y = (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64))
    if not len(x):
        return None
    net = Network(langs, seed)
    net.fit(x, y, steps if len(langs) > 1 else 1, seed=seed + 1)
    return net


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added, over whole texts.

    ``und`` with score 0 where the text is null or has no letter, or where no
    network could be trained.  Columns of these names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    src = docs.select(*keep, F.col(text).cast("string").alias("__langid_body")) if text in keep else docs
    out_schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tables = own.tables() if own else None
        for b in batches:
            col = b.column(b.num_columns - 1)
            texts = col.to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            for row, data, offs in tk.slices(col) if own else ():
                x, r = windows(data, offs)
                p = own.predict(x, tables)
                total = np.zeros((len(offs) - 1, len(own.langs)))
                np.add.at(total, r, p)
                n = np.bincount(r, minlength=len(offs) - 1)
                for i in np.flatnonzero(n).tolist():
                    if LETTER.search(texts[row + i]):
                        mean = total[i] / n[i]
                        k = int(mean.argmax())
                        langs[row + i], scores[row + i] = own.langs[k], float(min(mean[k], 1.0))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return src.mapInArrow(run, out_schema)


def held_out(doc_id="doc_id"):
    """Whether a row is held out: crc32 of its doc_id as text, mod 5, is 0; null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def accepted(docs: DataFrame, net: Network | None, least: float = 0.0) -> DataFrame:
    """Rows whose language is identified (not ``und``), with score ``least`` or more; columns as they were."""
    return predict(docs, net).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*docs.columns)
