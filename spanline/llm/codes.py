"""Vector code compression: product codes by Lloyd rounds that look at active entries only.

Vectors become whole numbers, so distances are exact and every run gives the same
codes.  A round keeps, for each part of each vector, its entry and its exact distance.
A part whose entry has not moved since is compared with the entries that have: no
other can have come nearer.  Parts whose entry has moved are compared with all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanline.llm.common import SENT, cut, drop_scratch, hot_keys, hub_join

#: Vectors compared at once.
ROWS = 4096


def limit_of(dim: int) -> int:
    """Whole numbers are kept within +-this, so that squared distances of ``dim`` components fit a long."""
    return 1 << ((62 - max(1, dim).bit_length()) // 2 - 1)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to those of book, exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < 1 << 53:  # whole numbers that doubles hold
        a, b = x.astype(np.float64), book.astype(np.float64)
        out = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
        return out.astype(np.int64)
    out = np.zeros((len(x), len(book)), np.int64)
    for d in range(x.shape[1]):
        out += (x[:, d, None] - book[None, :, d]) ** 2
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance) of each row, the lower entry of equally near ones."""
    d = distances(x, book)
    entry = d.argmin(axis=1)
    return entry, d[np.arange(len(x)), entry]


def renew(x: np.ndarray, entry: np.ndarray, dist: np.ndarray, book: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, distance, distances computed) after the entries ``moved`` have changed to those of ``book``.

    ``entry`` and ``dist`` are those of the book before.
    """
    entry, dist = entry.copy(), dist.copy()
    active = np.flatnonzero(moved)
    if not len(active):
        return entry, dist, 0
    lost = moved[entry]
    again, still = np.flatnonzero(lost), np.flatnonzero(~lost)
    work = len(again) * len(book) + len(still) * len(active)
    if len(again):
        entry[again], dist[again] = nearest(x[again], book)
    if len(still):
        k, d = nearest(x[still], book[active])
        k = active[k]
        wins = (d < dist[still]) | ((d == dist[still]) & (k < entry[still]))
        entry[still[wins]], dist[still[wins]] = k[wins], d[wins]
    return entry, dist, work


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose lists all have ``width`` items."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel(), kind))


def assign_rows(batches: Iterator[pa.RecordBatch], books: np.ndarray, moved: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows with entries and distances by the ``books`` (parts x entries x width); ``moved`` is None in the first pass."""
    parts, _, width = books.shape
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            x = matrix(b.column("q"), parts * width).reshape(-1, parts, width)
            entry, dist = (matrix(b.column(c), parts) if moved is not None else np.zeros((len(x), parts), np.int64) for c in ("entry", "dist"))
            for p in range(parts):
                if moved is None:
                    entry[:, p], dist[:, p] = nearest(x[:, p], books[p])
                else:
                    entry[:, p], dist[:, p], _ = renew(x[:, p], entry[:, p], dist[:, p], books[p], moved[p])
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), b.column("q"), lists(entry, pa.int16()), lists(dist, pa.int64())], names=["vec_id", "label", "q", "entry", "dist"]
            )


def sum_rows(batches: Iterator[pa.RecordBatch], parts: int, entries: int, width: int) -> Iterator[pa.RecordBatch]:
    """What a task's vectors add to each entry: a row per part and entry that is used."""
    n = np.zeros(parts * entries, np.int64)
    total = np.zeros((parts * entries, width), np.int64)
    for b in batches:
        x = matrix(b.column("q"), parts * width).reshape(-1, width)
        cell = (matrix(b.column("entry"), parts) + np.arange(parts) * entries).ravel()
        n += np.bincount(cell, minlength=len(n))
        order = np.argsort(cell, kind="stable")
        used, first = np.unique(cell[order], return_index=True)
        if len(used):
            total[used] += np.add.reduceat(x[order], first, axis=0)
    used = np.flatnonzero(n)
    cell, at = np.repeat(used, width), np.tile(np.arange(width), len(used))
    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(at), pa.array(np.repeat(n[used], width)), pa.array(total[used].ravel())], names=["cell", "at", "n", "total"])


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, key: str = "vec_id", vector: str = "embedding", group: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector of finite components.

    A component x is floor(scale * x); vectors are cut into ``parts`` equal parts,
    whose codebooks start as the parts of the ``entries`` smallest keys.  Each of
    ``rounds`` rounds assigns every part to its nearest entry, lower first, and
    moves each entry to the floor of its parts' mean; then parts are assigned again.
    ``code`` has two hex digits a part (four beyond 256 entries); ``label_error`` sums
    ``error`` over a label.

    Passes carry entry and distance of each part along in the shared folder; the driver
    and tasks hold the codebooks, whose size does not follow the rows.

    Rows whose vector is null or has null or non-finite components are left out.
    Shorter vectors (empty ones too), and lengths that ``parts`` does not divide, are
    filled up with zeros, which adds nothing to distances.  Components are held within
    ``limit_of(length)``, 2**26 at 64 components; a label's sum beyond a long is null.
    Equal keys count each, in the order of their vectors; a null key is the largest;
    null labels are one label.  Fewer rows than ``entries`` give smaller codebooks, none
    no rows.  Extra columns are ignored.
    """
    v = F.col(vector)
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.where(v.isNotNull() & finite).select(F.col(key).alias("vec_id"), F.col(group).alias("label"), F.col(vector).alias("v"))
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    length = 0 if longest is None else max(1, -(-longest // parts)) * parts
    most = limit_of(length)
    whole = F.transform("v", lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(most))), F.lit(float(most)))).cast("long"))
    filled = F.slice(F.concat(whole, F.array_repeat(F.lit(0).cast("long"), length)), 1, length) if length else whole
    rows = rows.select("vec_id", "label", filled.alias("q"))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).select("q").collect()
    books = np.array([r.q for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy() if first else np.zeros((parts, 1, 1), np.int64)
    n_entries, width = books.shape[1:]
    columns = "vec_id {}, label {}, q array<long>, entry array<short>, dist array<long>".format(*(vectors.schema[c].dataType.simpleString() for c in (key, group)))
    state, moved = rows, None
    for turn in range(rounds + 1):
        done = state.mapInArrow(lambda it, b=books, m=moved: assign_rows(it, b, m), columns)
        if turn == rounds:
            break
        old, state = (state if turn else None), cut(done, "codes")
        if old is not None:
            drop_scratch(old)
        sums = state.select("q", "entry").mapInArrow(lambda it: sum_rows(it, parts, n_entries, width), "cell long, at long, n long, total long")
        got = sums.groupBy("cell", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()  # parts x entries x width at most
        new = books.reshape(parts * n_entries, width).copy()
        if got.num_rows:
            cell, at, n, total = (got.column(c).to_numpy() for c in ("cell", "at", "n", "total"))
            new[cell, at] = total // n
        new = new.reshape(books.shape)
        moved, books = (new != books).any(axis=2), new
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    digits = "%02x" if n_entries <= 256 else "%04x"
    code = F.array_join(F.transform("entry", lambda e: F.format_string(digits, e.cast("int"))), "")
    error = F.aggregate("dist", F.lit(0).cast("long"), lambda a, d: a + d)
    coded = cut(done.select("vec_id", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("_label"), code.alias("code"), error.alias("error")), "coded")
    per = cut(coded.groupBy("_label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("_n")), "labels")
    sums = per.select("_label", "label_error")
    n_labels = per.count()
    both = coded.join(F.broadcast(sums), "_label") if n_labels <= SENT else hub_join(coded, sums, "_label", hot_keys(per, ["_label"], "_n"))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
