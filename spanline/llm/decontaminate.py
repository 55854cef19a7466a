"""Benchmark decontamination by winnowing.

Both sides are cut into words; of the K-word hashes in every run of
``window - K + 1`` starts the leftmost smallest is a fingerprint, so every shared span
of ``window`` words has a fingerprint in common.  Fingerprints, of which a text has
one for some five words, are joined with those of the benchmark, and each hit is
extended word by word to both sides, as far as a window reaches; a span of ``window``
words or more is hit.  Before the join a bitmap of the benchmark's fingerprints drops
most of what has no partner: its size is fixed, it loses nothing, and a benchmark too
large for it only makes the join larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanline.llm import textkit as tk
from spanline.llm.common import SENT, broadcast_if, cut, hot_keys, hub_join
from spanline.llm.passages import sliding_argmin

K = 5
#: Bits of a bitmap, as a power of two: 4 MB each, and as much through the driver.
BITS = 25
#: Benchmark fingerprints with their surroundings (200 bytes each) up to which they are sent to the documents.
CONTEXTS = SENT // 8


def prints_in(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, fingerprint) of the grams that stand for the windows of ``size`` words; the size is part of the hash."""
    k = min(K, size)
    grams = tk.gram_hashes(h, k)
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.unique(sliding_argmin(grams, size - k + 1)[row[:n] == row[size - 1 :]])
    return at, tk.mix(grams[at] + np.full(1, size, np.uint64) * tk.MIX1)


def around(h: np.ndarray, first: np.ndarray, row: np.ndarray, at: np.ndarray, size: int, reach: int) -> np.ndarray:
    """The words around grams: ``reach`` to the left, nearest first, the gram, ``reach`` to the right; 0 outside of the row."""
    k = min(K, size)
    place = np.concatenate([-1 - np.arange(reach), np.arange(K), k + np.arange(reach)])
    pos = at[:, None] + place
    inside = (pos >= first[row[at]][:, None]) & (pos < first[row[at] + 1][:, None])
    inside[:, reach + k : reach + K] = False
    return np.where(inside, np.maximum(h[np.clip(pos, 0, len(h) - 1)], np.uint64(1)), np.uint64(0))


def word_lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).view(np.int64).ravel()))


def item_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(item, size, print, words): the fingerprints of each item; an item of fewer words than a window is one window."""
    for b in batches:
        for lo, data, offs in tk.slices(b.column(1)):
            h, first = tk.word_hashes(data, offs, tk.ALNUM)
            row, n = tk.row_of(first), np.diff(first)
            for size in np.unique(np.minimum(n[n > 0], window)).tolist():
                at, prints = prints_in(h, row, size)
                own = n[row[at]] == size if size < window else np.ones(len(at), bool)
                at, prints = at[own], prints[own]
                words = around(h, first, row, at, size, max(0, window - K))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + row[at])), pa.array(np.full(len(at), size)), pa.array(prints.view(np.int64)), word_lists(words)], names=["item", "size", "print", "words"])


def bitmap(wins: DataFrame, column: str) -> np.ndarray:
    """The low BITS bits of all values of a column, as a map; at most 2 ** BITS / 64 rows pass through the driver."""
    low = F.col(column).bitwiseAND(F.lit((1 << BITS) - 1))
    rows = wins.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros((1 << BITS) // 64, np.uint64)
    if rows.num_rows:
        out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def in_map(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    low = x & np.uint64(64 * len(bits) - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1


SCANNED = "doc_id {}, body long, n_words long, hits array<struct<pos:long,size:long,print:long,words:array<long>>>"


def scan_rows(batches: Iterator[pa.RecordBatch], window: int, sizes: list[int], prints: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per document its words, and its fingerprints that the bitmap lets through."""
    reach = max(0, window - K)
    for batch in batches:
        n_words, hits = [], []
        for _, data, offs in tk.slices(batch.column(2)):
            h, first = tk.word_hashes(data, offs, tk.ALNUM)
            row = tk.row_of(first)
            cols, words = [], []
            for size in sizes:
                at, low = prints_in(h, row, size)
                some = in_map(prints, low)
                at, low = at[some], low[some]
                cols.append(np.stack([row[at], at - first[row[at]], np.full(len(at), size), low.view(np.int64)]))
                words.append(around(h, first, row, at, size, reach))
            cols = np.concatenate(cols, axis=1) if cols else np.zeros((4, 0), np.int64)
            words = np.concatenate(words) if words else np.zeros((0, 2 * reach + K), np.uint64)
            by = np.argsort(cols[0], kind="stable")
            cols, words = cols[:, by], words[by]
            ends = np.searchsorted(cols[0], np.arange(len(offs))).astype(np.int32)
            parts = pa.StructArray.from_arrays([*(pa.array(c) for c in cols[1:]), word_lists(words)], names=["pos", "size", "print", "words"])
            n_words.append(np.diff(first))
            hits.append(pa.ListArray.from_arrays(pa.array(ends), parts))
        if n_words:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(n_words), pa.int64()), pa.concat_arrays(hits)], names=["doc_id", "body", "n_words", "hits"])


def equal_words(a: Column, b: Column, start: int, n: int) -> Column:
    """How many of n words from ``start`` on (from 1) agree before the first that doesn't; 0 agrees with nothing."""
    if n <= 0:
        return F.lit(0)
    same = F.zip_with(F.slice(a, start, n), F.slice(b, start, n), lambda x, y: (x == y) & (x != 0))
    at = F.array_position(same, False)
    return F.when(at == 0, n).otherwise(at - 1)


def extended(hits: DataFrame, window: int) -> DataFrame:
    """Rows of (pos, size, words, item_words) whose gram extends to a window or more, with ``start`` and ``end`` of the span."""
    reach = max(0, window - K)
    k = F.least(F.col("size"), F.lit(K))
    count = lambda start, n: equal_words(F.col("words"), F.col("item_words"), start, n)
    rows = hits.withColumns({"_left": count(1, reach), "_gram": count(1 + reach, K), "_right": count(1 + reach + K, reach)})
    rows = rows.where((F.col("_gram") >= k) & (F.col("_left") + k + F.col("_right") >= F.col("size")))
    return rows.withColumn("start", F.col("pos") - F.col("_left")).withColumn("end", F.col("pos") + k + F.col("_right"))


def united(spans: DataFrame, by: str) -> DataFrame:
    """(by, start, end): overlapping or touching spans of the rows (by, start, end) put together."""
    w = Window.partitionBy(by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("_new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    runs = fresh.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def find(docs: DataFrame, bench: DataFrame, window: int = 13, text: str = "text") -> DataFrame:
    """doc_id, body (a hash of the text), n_words, n_hit, runs, items for every row.

    ``runs`` are the hit words as [start, end); ``items`` the sorted ids, as strings,
    of the items with an occurring window.  Words are compared by 64-bit hashes.

    Nulls: a null or empty text, and an item without words, have no windows; a
    null item_id counts as the string "null".  An item of fewer words than
    ``window`` is one window.  Repeated documents, and documents of one doc_id with
    other texts, are judged each in its own row; repeated items count once.  Empty
    tables: no rows, or documents without hits.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col(text).cast("string").alias("body")).where("body is not null")
    wins = cut(items.mapInArrow(lambda it: item_rows(it, window), "item string, size long, print long, words array<long>").distinct(), "prints")
    sizes = sorted(r[0] for r in wins.select("size").distinct().collect())  # ``window`` rows at most
    maps = spark.sparkContext.broadcast(bitmap(wins, "print"))
    value = F.col(text).cast("string")
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select("doc_id", F.xxhash64(value).alias("body"), value.alias("_text"))
    seen = src.mapInArrow(lambda it: scan_rows(it, window, sizes, maps.value), SCANNED.format(kind))
    seen = cut(seen.withColumn("_row", F.monotonically_increasing_id()), "scanned")
    on = ["size", "print"]
    hits = seen.select("_row", F.explode("hits").alias("h")).select("_row", "h.*")
    contexts = wins.select(*on, F.col("words").alias("item_words")).distinct()
    n_contexts = contexts.count()
    if n_contexts <= CONTEXTS:
        met = hits.join(F.broadcast(contexts), on)
    else:  # a passage that very many documents share is joined where they are
        met = hub_join(hits, contexts, on, hot_keys(hits.groupBy(*on).agg(F.count("*").alias("times")), on, "times"))
    spans = cut(extended(met, window).select("_row", "start", "end", *on, "item_words"), "spans")
    run = F.struct("start", "end")
    runs = united(spans.select("_row", "start", "end").distinct(), "_row").groupBy("_row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(run)).alias("runs"))
    named = wins.withColumnRenamed("words", "item_words")
    which = [*on, "item_words"]
    named = spans.select("_row", *which).distinct().join(broadcast_if(named, wins.count(), CONTEXTS), which).groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    some = runs.withColumn("runs", F.transform("runs", lambda r: F.array(r["start"], r["end"]))).join(named, "_row")
    none = {"n_hit": F.lit(0).cast("long"), "runs": F.array().cast("array<array<long>>"), "items": F.array().cast("array<string>")}
    return seen.select("_row", "doc_id", "body", "n_words").join(some, "_row", "left").select("doc_id", "body", "n_words", *[F.coalesce(c, v).alias(c) for c, v in none.items()])


def judge(found: DataFrame, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a ``share``-th of the words or more are hit), body."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
        "body",
    )


def keep_clean(docs: DataFrame, bench: DataFrame, share: int = 20, text: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated rows, all columns kept.

    A row goes by its own text, whatever its doc_id, null included, and whatever
    other rows share it.
    """
    bad = judge(find(docs, bench, text=text, **options), share).where("contaminated").select(F.col("doc_id").alias("__of"), F.col("body").alias("__in")).distinct()
    bad = cut(bad, "contaminated")
    bad = broadcast_if(bad, bad.count(), SENT)
    own = F.xxhash64(docs[text].cast("string"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__of"]) & (own == bad["__in"]), "left_anti")
