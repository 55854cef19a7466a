"""MinHash near-duplicates by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanline.llm import textkit as tk
from spanline.llm.buckets import linked
from spanline.llm.common import SENT, broadcast_if, components, cut

SHINGLE = 5
BANDS, ROWS = 30, 6


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct k-word shingles of every row of a slice; fewer words are one shingle."""
    h, first = tk.word_hashes(data, offsets, tk.SPACED)
    n = np.diff(first)
    grams = tk.gram_hashes(h, k)
    row = tk.row_of(first)
    keep = row[: len(grams)] == row[k - 1 :] if len(grams) else np.zeros(0, bool)
    rows, sets = [row[: len(grams)][keep]], [grams[keep]]
    for size in range(1, k):
        at = np.flatnonzero(n == size)
        if len(at):
            g = np.zeros(len(at), np.uint64)
            for j in range(size):
                g = g * tk.MULT + h[first[at] + j]
            rows.append(at)
            sets.append(tk.mix(g + np.uint64(size)))
    row, g = np.concatenate(rows), np.concatenate(sets)
    order = np.lexsort((g, row))
    row, g = row[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
    row, g = row[new], g[new]
    return g, np.searchsorted(row, np.arange(len(offsets)))


def sketch(g: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Fast similarity sketches of the sets, one row each.

    In round i < width every element draws a random bin and a value i + u; in
    round width + j all elements go to bin j.  A bin keeps its smallest value, and
    a set is done once all of its bins are filled: after 2 * width rounds at the
    latest, and after about width * ln(width) / size with high probability.  Two
    sketches agree in a coordinate with probability equal to the Jaccard
    similarity, with Chernoff-type concentration over the coordinates.
    """
    n = len(first) - 1
    size = np.diff(first)
    out = np.full(n * width, tk.NONE)
    todo = np.flatnonzero(size)
    value_bits, round_shift = np.uint64(48), np.uint64(48)
    for i in range(2 * width):
        if not len(todo):
            break
        lens = size[todo]
        row = np.repeat(todo, lens)
        el = g[np.repeat(first[todo] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())]
        h = tk.mix(el ^ tk.mix(np.full(1, i + 1, np.uint64) * tk.MULT))
        bins = (h % np.uint64(width)).astype(np.int64) if i < width else np.full(len(h), i - width, np.int64)
        value = (np.uint64(i) << round_shift) | (tk.mix(h) >> (np.uint64(64) - value_bits))
        np.minimum.at(out, row * width + bins, value)
        todo = todo[(out.reshape(n, width)[todo] == tk.NONE).any(axis=1)]
    return out.reshape(n, width)


def band_keys(sk: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None], len(sk), axis=0)
    for j in range(rows):
        key = tk.mix(key * tk.MULT + sk[:, j::rows][:, :bands])
    return key


# --- candidate search ------------------------------------------------------

#: Coordinates of a sketch; the first BANDS * ROWS make the bands, one bit of each estimates the similarity.
COORDS = 1024


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The share of equal coordinates, estimated from the share of equal bits."""
    return 1 - 2 * np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int32) / COORDS


def likeness(least: float, ratio: float):
    """A score for pairs: their estimated similarity, -1 below ``least`` or where sizes rule it out."""

    def score(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        share = agreement(x, y)
        return np.where((share >= least) & (np.minimum(n, m) >= ratio * np.maximum(n, m) - 1e-9), share, -1.0)

    return score


def sketch_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, body, hi, lo, n, sketch, keys): the class (128-bit digest of the set), one bit of each coordinate, the bands."""
    for b in batches:
        sizes, sets, bits, bands = [], [], [], []
        for _, data, offs in tk.slices(b.column(2)):
            g, first = shingle_sets(data, offs, k)
            sizes.append(np.diff(first))
            sets.append(digests(g, first))
            sk = sketch(g, first, COORDS)
            bits.append(np.packbits((sk & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64))
            bands.append(band_keys(sk[:, : BANDS * ROWS], BANDS, ROWS).view(np.int64))
        if not sizes:
            continue
        hi, lo = np.concatenate(sets).view(np.int64).T
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in (hi, lo, np.concatenate(sizes))), matrix(np.concatenate(bits)), matrix(np.concatenate(bands))],
            names=["doc_id", "body", "hi", "lo", "n", "sketch", "keys"],
        )


def matrix(rows: np.ndarray) -> pa.Array:
    ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1)))


def digests(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits for each set, as two numbers: sums of independently mixed elements, with the set's size."""
    sums = []
    for salt in (tk.MIX1, tk.MIX2):
        c = np.zeros(len(g) + 1, np.uint64)
        np.cumsum(tk.mix(g + salt), out=c[1:])
        sums.append(tk.mix(c[first[1:]] - c[first[:-1]] + np.diff(first).astype(np.uint64) * tk.MIX2))
    return np.stack(sums, axis=1)


def set_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = []
        for _, data, offs in tk.slices(b.column(1)):
            g, first = shingle_sets(data, offs, k)
            sets += [g[first[i] : first[i + 1]].tobytes() for i in range(len(offs) - 1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["id", "body"])


def alike(num: int, den: int):
    """Whether two sets of sorted hashes have den * intersection >= num * union."""

    def same(p: bytes, q: bytes) -> bool:
        x, y = (np.frombuffer(v, np.uint64) for v in (p, q))
        both = np.concatenate([x, y])
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return den * common >= num * (len(x) + len(y) - common)

    return same


def elements(num: int, den: int):
    """A set's elements, and how many of them: similar sets have num / den of each in common."""

    def parts(p: bytes) -> tuple[np.ndarray, int]:
        x = np.frombuffer(p, np.uint64)
        return x, len(x) + -num * len(x) // den + 1

    return parts


def with_body(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, body, _text): rows are told apart by their id and a hash of their text."""
    value = F.col(text).cast("string")
    return docs.select("doc_id", F.xxhash64(value).alias("body"), value.alias("_text"))


def sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, body): the full sets of the given classes, made anew from their first texts."""
    want = cut(ids.join(classes.select("id", "rep"), "id"), "ids")
    sent = broadcast_if(want, want.count(), SENT).withColumnRenamed("id", "_id")
    here = docs["doc_id"].eqNullSafe(sent["rep.doc_id"]) & (docs["body"] == sent["rep.body"])
    need = docs.join(sent, here).select(F.col("_id").alias("id"), "_text")
    return need.mapInArrow(lambda it: set_rows(it, k), "id long, body binary").dropDuplicates(["id"])


def members(docs: DataFrame, num: int, den: int, k: int = SHINGLE, text: str = "text") -> DataFrame:
    """(doc_id, body, n_shingles, first): ``first`` is the smallest (doc_id, body) of the row's group, null for empty sets."""
    least, ratio = num / den - 8 * 2 * ((1 + num / den) / 2 * (1 - num / den) / 2 / COORDS) ** 0.5, num / den
    docs = with_body(docs, text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = docs.mapInArrow(lambda it: sketch_rows(it, k), f"doc_id {kind}, body long, hi long, lo long, n long, sketch array<long>, keys array<long>")
    sets = cut(sets, "sketches")
    # Null ids come after all others.
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")
    classes = sets.where("n > 0").groupBy("hi", "lo").agg(F.min(rep).alias("rep"), *[F.first(c).alias(c) for c in ("n", "sketch", "keys")])
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    links = linked(classes.select("id", "n", "sketch", "keys"), lambda ids: sets_of(docs, classes, ids, k), alike(num, den), likeness(least, ratio), elements(num, den))
    comps = components(links)
    of = classes.select("hi", "lo", "id", "rep").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    low = of.groupBy("component").agg(F.min("rep").alias("first"))
    of = of.join(low, "component").select("hi", "lo", "first")
    return sets.select("doc_id", "body", F.col("n").alias("n_shingles"), "hi", "lo").join(of, ["hi", "lo"], "left").drop("hi", "lo")


def groups(docs: DataFrame, num: int = 80, den: int = 100, k: int = SHINGLE, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Documents are linked when den * |A & B| >= num * |A | B| for their sets of
    k-word shingles (white space parts words, A-Z lower-cased; fewer than k words
    are one shingle).  Texts of equal sets are one class from the start, so copies
    never make pairs.  Candidates are classes that share a band and whose
    one-bit estimate over COORDS coordinates is within eight standard deviations of
    the threshold; all links that count are confirmed on full sets.  Of a dense
    band each member is first tried against some pivots; then the candidate pairs
    that lie in two components and share one of their rarest shingles, as all links
    do, are tried, so that no dense group is expanded.

    Nulls: a text without words, or null, has an empty set and is linked with
    nothing, and is kept.  component_id is the smallest doc_id reachable, so rows
    of equal doc_id share their texts' components; a null doc_id comes after all
    others.  Of repeated rows (equal doc_id and text) each gets the same result.
    Extra columns are ignored.  No rows give no rows.
    """
    out = members(docs, num, den, k, text)
    component = F.when(F.col("first").isNotNull(), F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, num: int = 80, den: int = 100, text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group, the one of the smallest (doc_id, hash of the text), null ids last.

    All columns are kept.  Rows of equal doc_id and other texts are told apart; of
    repeated rows (equal doc_id and text) one stays.  Texts without words stay all.
    """
    found = members(docs, num, den, text=text, **options)
    later = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("body") == F.col("first.body")))
    gone = cut(found.where("first IS NOT NULL").where(later).select(F.col("doc_id").alias("__of"), F.col("body").alias("__in")).distinct(), "gone")
    gone = broadcast_if(gone, gone.count(), SENT)
    own = F.xxhash64(docs[text].cast("string"))
    stay = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__of"]) & (own == gone["__in"]), "left_anti")
    # Repeats of one row share id and text: told apart by a number of their own, the first stays.
    again = found.where("first IS NOT NULL").groupBy("doc_id", "body").count().where("count > 1")
    again = cut(again.select(F.col("doc_id").alias("__of"), F.col("body").alias("__in")), "again")
    n_again = again.count()
    if not n_again:
        return stay
    again = broadcast_if(again, n_again, SENT)
    same = stay["doc_id"].eqNullSafe(again["__of"]) & (F.xxhash64(stay[text].cast("string")) == again["__in"])
    some = stay.join(again, same, "left_semi")
    one = some.withColumn("__own", F.xxhash64(F.col(text).cast("string"))).dropDuplicates(["doc_id", "__own"]).drop("__own")
    return stay.join(again, same, "left_anti").unionByName(one)
