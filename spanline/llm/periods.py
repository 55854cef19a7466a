"""Runs of repeated words: longest common extensions over a difference cover drive a harmonic grid.

A run of period q that is four periods long covers four neighbouring multiples of q
with equal words, so for every q only those grid points are followed: two longest
common extensions, of the words to the right and to the left, give the run's ends.
That is n / 1 + n / 2 + ... grid points for n words.

An extension of two positions compares a few words until both stand on the cover (for
any two positions that happens within ``COVER`` words), and takes the rest from the
smallest common prefix between their places in the sorted order of the sampled suffixes,
which a sparse table has.  Only the sampled suffixes are sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanline.llm import textkit as tk

#: A perfect difference set; any two residues differ by the difference of two of these.
COVER, RESIDUES = 31, (1, 5, 11, 24, 25, 27)
#: Grid points looked at at once.
BLOCK = 1 << 20
#: Periods that a run must hold, and its least length in words.
TIMES, LEAST = 4, 6


def shifts() -> np.ndarray:
    """[a, b]: the least d with a + d and b + d both residues of the cover."""
    member = np.isin(np.arange(COVER), RESIDUES)
    at = np.arange(COVER)
    both = member[(at[:, None, None] + at) % COVER] & member[(at[None, :, None] + at) % COVER]
    return both.argmax(axis=2)


SHIFT = shifts()


class Extensions:
    """Longest common extensions to the right of positions in the same row of ``code`` (numbers from 1).

    ``stop`` is, for each position, the end of its row.  Positions count from the start of ``code``.
    """

    def __init__(self, code: np.ndarray, first: np.ndarray):
        self.code, n = code, len(code)
        row = tk.row_of(first)
        self.stop = first[row + 1] if n else row
        local = np.arange(n) - first[row]
        sampled = np.flatnonzero(np.isin(local % COVER, RESIDUES))
        self.local = local
        self.place = np.full(n + 1, -1, np.int64)  # of sampled positions among these
        self.place[sampled] = np.arange(len(sampled))
        self.sampled = sampled
        self.levels: list[np.ndarray] = []
        if not len(sampled):
            self.rank, self.table = np.zeros(0, np.int64), [np.zeros(0, np.int64)]
            return
        # COVER words of each, rows first, and nothing beyond a row's end; then doubled until all differ.
        at = sampled[:, None] + np.arange(COVER)
        words = np.where(at < self.stop[sampled][:, None], code[np.minimum(at, n - 1)], 0)
        keys = np.concatenate([row[sampled][:, None], words], axis=1).astype(">u4")
        self.words = words
        rank = np.unique(np.ascontiguousarray(keys).view(f"V{4 * keys.shape[1]}").ravel(), return_inverse=True)[1].ravel()
        reach = COVER
        while True:
            self.levels.append(rank)
            if rank.max() == len(rank) - 1:
                break
            ahead = sampled + reach
            inside = ahead < self.stop[sampled]
            then = np.where(inside, rank[self.place[np.where(inside, ahead, 0)]] + 1, 0)
            rank = np.unique(rank * (len(rank) + 1) + then, return_inverse=True)[1].ravel()
            reach *= 2
        self.rank = rank
        self.table = [self.between(np.argsort(rank))]
        while 2 << (len(self.table) - 1) <= len(rank):
            t, w = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-w], t[w:]))

    def between(self, order: np.ndarray) -> np.ndarray:
        """Common prefixes of neighbours in the order, from the ranks by 31, 62, ... words, longest first."""
        a, b = order[:-1], order[1:]
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        alive = np.ones(len(a), bool)  # neither has come to its row's end
        for k in range(len(self.levels) - 1, -1, -1):
            reach = COVER << k
            same = np.flatnonzero(alive & (self.levels[k][a] == self.levels[k][b]))
            out[same] += reach
            for x in (a, b):
                ahead = self.sampled[x[same]] + reach
                inside = ahead < self.stop[self.sampled[x[same]]]
                alive[same] &= inside
                x[same] = np.where(inside, self.place[np.where(inside, ahead, 0)], x[same])
        left = np.flatnonzero(alive)
        x, y = self.words[a[left]], self.words[b[left]]
        out[left] += ((x == y) & (x > 0)).cumprod(axis=1).sum(axis=1)
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i on and from j on; i < j in one row, j may be its end."""
        out = np.zeros(len(i), np.int64)
        end = self.stop[i]
        d = SHIFT[self.local[i] % COVER, (self.local[i] + j - i) % COVER]
        live = np.flatnonzero(j < end)
        while len(live):  # to the cover, word by word
            walk = live[(out[live] < d[live]) & (j[live] + out[live] < end[live])]
            live = walk[self.code[i[walk] + out[walk]] == self.code[j[walk] + out[walk]]]
            out[live] += 1
        far = np.flatnonzero((out == d) & (j + out < end))
        a, b = self.rank[self.place[i[far] + out[far]]], self.rank[self.place[j[far] + out[far]]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)  # never equal: positions of one row differ
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for level in np.unique(k):
            some = np.flatnonzero(k == level)
            t = self.table[level]
            out[far[some]] += np.minimum(t[lo[some]], t[hi[some] - (1 << int(level))])
        return out


def grid(first: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) of all grid points with three more after them, of the given rows, in blocks."""
    size = np.diff(first)[rows]
    top = size // TIMES
    row = np.repeat(rows, top)
    q = np.arange(top.sum()) - np.repeat(np.cumsum(top) - top, top) + 1
    points = -(-np.repeat(size, top) // q) - (TIMES - 1)
    points = np.maximum(points, 0)
    edge = np.cumsum(points)
    lo = 0
    while lo < len(q):
        hi = max(lo + 1, int(np.searchsorted(edge, (edge[lo - 1] if lo else 0) + BLOCK, side="right")))
        n = points[lo:hi]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        period = np.repeat(q[lo:hi], n)
        yield first[np.repeat(row[lo:hi], n)] + k * period, period
        lo = hi


def runs_in(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(row, start, end, period) of all runs, sorted; starts and ends count within the row."""
    found = []
    n = len(code)
    for at, q in grid(first, np.arange(len(first) - 1)):
        some = np.arange(len(at))
        for k in range(1, TIMES):
            far = at[some] + k * q[some]
            some = some[(far < n) & (code[at[some]] == code[np.minimum(far, n - 1)])]
        found.append(np.stack([at[some], q[some]]))
    found = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    row = np.searchsorted(first, found[0], side="right") - 1
    inside = found[0] + (TIMES - 1) * found[1] < first[row + 1]
    found, row = found[:, inside], row[inside]
    if not len(row):
        return np.zeros((0, 4), np.int64)
    # Only rows with such points are sorted.
    own, new = np.unique(row, return_inverse=True)
    size = np.diff(first)[own]
    base = np.append(0, np.cumsum(size))
    part = code[np.repeat(first[own] - base[:-1], size) + np.arange(base[-1])]
    i = found[0] - first[row] + base[new]
    q = found[1]
    ends = base[new + 1]
    right = Extensions(part, base)(i, i + q)
    # To the left: the rows read backwards.
    mirror = np.repeat(base[:-1] + base[1:] - 1, size) - np.arange(base[-1])
    back = Extensions(part[mirror], base)
    x, y = base[new] + ends - 1 - (i + q) + 1, base[new] + ends - 1 - i + 1  # the words before i + q, and before i
    left = back(x, y)
    start, end = i - left, i + q + right
    keep = end - start >= np.maximum(LEAST, TIMES * q)
    out = np.stack([own[new], start - base[new], end - base[new], q], axis=1)[keep]
    out = out[np.lexsort((out[:, 3], out[:, 2], out[:, 1], out[:, 0]))]
    # Of one stretch the smallest period; multiples of it show the same stretch.
    return out[np.append(True, (out[1:, :3] != out[:-1, :3]).any(axis=1))] if len(out) else out


def codes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers from 1 for words, equal for equal words: hashes bring them together, bytes tell them apart."""
    h = tk.span_hash(tk.prefix_hash(data), starts, ends)
    _, lead, code = np.unique(h, return_index=True, return_inverse=True)
    code = code.ravel()
    text = data.tobytes()
    size, size0 = ends - starts, (ends - starts)[lead][code]
    ok = (size == size0).all()
    if ok:  # byte by byte against the first word of the hash
        shift = np.repeat(starts[lead][code] - starts, size)
        at = np.arange(size.sum()) + np.repeat(starts - np.cumsum(size) + size, size)
        ok = (data[at] == data[at + shift]).all()
    if not ok:
        held: dict[bytes, int] = {}
        code = np.array([held.setdefault(text[x:y], len(held)) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return code.astype(np.int64) + 1


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, runs and the collapsed text for each row of (doc_id, text)."""
    for b in batches:
        for lo, data, offs in tk.slices(b.column(1)):
            starts, ends, first = tk.words(data, offs, tk.SPACED)
            runs = runs_in(codes_of(data, starts, ends), first)
            base = first[runs[:, 0]]
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, base + runs[:, 1] + runs[:, 3], 1)
            np.add.at(edge, base + runs[:, 2], -1)
            keep = np.cumsum(edge[:-1]) == 0
            size = (ends - starts)[keep]
            end = np.cumsum(size + 1)
            out = np.full(int(end[-1]) if len(end) else 0, 32, np.uint8)
            shift = np.repeat(starts[keep] - (end - size - 1), size)
            at = np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)
            out[at] = data[at + shift]
            text = out.tobytes()
            byte = np.append(0, end)[np.append(0, np.cumsum(keep))[first]]
            texts = [text[x : y - 1] if y > x else b"" for x, y in zip(byte[:-1].tolist(), byte[1:].tolist(), strict=True)]
            cuts = pa.array(np.searchsorted(runs[:, 0], np.arange(len(offs))).astype(np.int32))
            by = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
            items = pa.StructArray.from_arrays([pa.array(by[:, 1]), pa.array(by[:, 2] - by[:, 1]), pa.array(by[:, 3])], fields=list(RUNS.value_type))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, len(offs) - 1), pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(cuts, items), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed for every row.

    A run is a stretch of words with smallest period q, of four periods and six words
    at least, that no neighbouring word extends.  ``collapsed`` has each run's first
    period only, words joined by one blank; words are compared letter by letter.

    Nulls: a null or empty text has no words; a null doc_id stays.  Each row is judged
    alone, repeated rows alike.  No rows give no rows; extra columns are ignored.
    Nothing is exchanged.  A text is held as a whole, its grid points in blocks.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(
        run_rows, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (smallest start, then period, of several) and hashes of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    rows = found.withColumn("_best", best)
    length, period = F.col("_best.length"), -F.col("_best.period")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.before")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a repetition put into the texts of every tenth crc32 of doc_id: from word a on, p words over and over.

    Texts of other rows, null ids and texts without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    value = F.col(text).cast("string")
    words = F.regexp_extract_all(value, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def again(w: F.Column) -> F.Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.element_at(w, (a + F.pmod(i - a, p) + 1).cast("int")))), " ")

    new = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, again(w)).otherwise(value))[0]
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, new).otherwise(value).alias("text"))
