"""Repeated passages of words by super-k-mer partitioning.

Every window of ``WINDOW`` words has a minimiser, its leftmost smallest ``GRAM``-word
hash, and equal windows have equal minimisers.  Consecutive windows that share a
minimiser are one super-k-mer: they travel as one packed string to the minimiser's
bucket, where their windows are sorted and counted.

Minimisers that occur once in the whole corpus can hold no repeated window; they are
counted first, and their super-k-mers stay at home.  Windows of very frequent
minimisers travel one by one to buckets of their own hash, so that no bucket
grows with a common passage and all the contexts it stands in.  Strings that a task
meets more than once travel once, with the places they stand at.

Hashes only bring windows together: windows count as equal when their bytes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanline.llm import textkit as tk
from spanline.llm.common import SENT, cut, drop_scratch, hot_keys, hub_join

WINDOW, GRAM = 35, 12
#: Places of a minimiser from which its windows travel one by one, or a share of 1 / SENT of all places.
FREQUENT = 5000
#: Bytes of packed strings, and of their places, that are sorted at once, and whole buckets at least.
CHUNK, PLACE = 8 << 20, 32


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost minimum of every w consecutive items, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    pos, span = np.arange(len(x)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(x[a] <= x[b], a, b)  # a stands left of b, or is b

    while span * 2 <= w:
        pos = better(pos[:-span], pos[span:])
        span *= 2
    return better(pos[:n], pos[w - span : w - span + n])


class Packed:
    """The super-k-mers of a slice: ``at`` the minimiser's word, windows ``first`` to ``last``, words counted through the slice."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, window: int, gram: int):
        self.starts, self.ends, self.of_row = tk.words(data, offs, tk.SPACED)
        hashes = tk.span_hash(tk.prefix_hash(data), self.starts, self.ends)
        grams = tk.gram_hashes(hashes, gram)
        at = sliding_argmin(grams, window - gram + 1)
        row = tk.row_of(self.of_row)
        n = len(at)
        use = row[:n] == row[window - 1 : window - 1 + n] if n else np.zeros(0, bool)
        w = np.flatnonzero(use)
        head = np.append(True, (at[w][1:] != at[w][:-1]) | (w[1:] != w[:-1] + 1)) if len(w) else np.zeros(0, bool)
        self.first = w[head]
        self.last = w[np.append(np.flatnonzero(head)[1:] - 1, len(w) - 1)] if len(w) else w
        self.at, self.row = at[self.first], row[self.first]
        self.hash = grams[self.at]

    def place(self) -> np.ndarray:
        """The minimiser's word within its document."""
        return self.at - self.of_row[self.row]


def respaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one blank after each, and where they start and end there."""
    size = ends - starts
    new = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(new[-1], 32, np.uint8)
    shift = np.repeat(new[:-1] - starts, size)
    place = np.arange(len(shift)) + np.repeat(np.arange(len(size)), size)
    out[place] = data[place - shift]
    return out.tobytes(), new[:-1], new[:-1] + size


def place_rows(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(ref, h, at): the minimisers of every document, which a hash stands for."""
    for b in batches:
        for lo, data, offs in tk.slices(b.column(1)):
            p = Packed(data, offs, window, gram)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + p.row)), pa.array(p.hash.view(np.int64)), pa.array(p.place())], names=["ref", "h", "at"])


def packed_rows(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(h, words, places): the super-k-mers asked for by (place, frequent), each string once a slice with all its places."""
    for b in batches:
        wanted = b.column(3)
        for lo, data, offs in tk.slices(b.column(2)):
            p = Packed(data, offs, window, gram)
            asked = wanted.slice(lo, len(offs) - 1)
            row = np.repeat(np.arange(len(offs) - 1), asked.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = asked.flatten()
            want = (row.astype(np.int64) << 33) | (flat.field(0).to_numpy(zero_copy_only=False) << 1) | flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
            own = (p.row.astype(np.int64) << 33) | (p.place() << 1)
            often = np.isin(own | 1, want)
            some = np.isin(own, want)
            # Frequent minimisers: a string for each window, under the window's hash.
            n = (p.last - p.first + 1)[often]
            each = np.repeat(p.first[often] - np.cumsum(n) + n, n) + np.arange(n.sum())
            first, last = np.concatenate([p.first[some], each]), np.concatenate([p.last[some], each])
            text, s, e = respaced(data, p.starts, p.ends)
            lo_byte, hi_byte = (s[first], e[last + window - 1]) if len(first) else (first, first)
            strings = [text[x:y] for x, y in zip(lo_byte.tolist(), hi_byte.tolist(), strict=True)]
            key = p.hash[some]
            if len(each):
                own_hash = tk.span_hash(tk.prefix_hash(np.frombuffer(text, np.uint8)), lo_byte[len(key) :], hi_byte[len(key) :])
                key = np.concatenate([key, own_hash])
            held: dict[bytes, int] = {}
            rank = np.array([held.setdefault(x, len(held)) for x in strings], np.int64)
            by = np.argsort(rank, kind="stable")
            lead = by[np.flatnonzero(np.append(True, rank[by][1:] != rank[by][:-1]))] if len(by) else by
            ends = np.append(0, np.cumsum(np.bincount(rank, minlength=len(held)))).astype(np.int32)
            doc = np.concatenate([p.row[some], np.repeat(p.row[often], n)])
            start, rows = (first - p.of_row[doc])[by], pa.array(lo + doc[by])
            places = pa.StructArray.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(start)], names=["doc_id", "body", "start"])
            yield pa.RecordBatch.from_arrays([pa.array(key[lead].view(np.int64)), pa.array(list(held), pa.binary()), pa.ListArray.from_arrays(pa.array(ends), places)], names=["h", "words", "places"])


def window_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """A hash for every start of ``window`` words, from rolling sums of word hashes."""
    h = tk.span_hash(tk.prefix_hash(data), starts, ends)
    up, down = tk.powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    n = max(0, len(h) - window + 1)
    return tk.mix((sums[window : window + n] - sums[:n]) * down[:n])


def repeated(strings: list[bytes], times: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, window) of all windows in ``strings`` that occur more than once, a string counting as often as ``times`` says."""
    text = b"".join(strings)
    data = np.frombuffer(text, np.uint8)
    offs = np.append(0, np.cumsum([len(s) for s in strings]))
    starts, ends, of_row = tk.words(data, offs, tk.SPACED)
    row = tk.row_of(of_row)
    h = window_hashes(data, starts, ends, window)
    at = np.flatnonzero(row[: len(h)] == row[window - 1 : window - 1 + len(h)])
    order = at[np.argsort(h[at], kind="stable")]
    head = np.append(True, h[order][1:] != h[order][:-1]) if len(order) else np.zeros(0, bool)
    run = np.cumsum(head) - 1
    count = np.bincount(run, weights=times[row[order]]) if len(order) else np.zeros(0)
    lead = order[np.flatnonzero(head)][run]
    hit = count[run] > 1
    # Windows with their run's first one: stretches of both that go on together are compared byte by byte, once.
    w, first = order[hit & ~head], lead[hit & ~head]
    by = np.argsort(w)
    w, first = w[by], first[by]
    if len(w):
        fresh = np.append(True, (w[1:] != w[:-1] + 1) | (first[1:] != first[:-1] + 1) | (row[w[1:]] != row[w[:-1]]) | (row[first[1:]] != row[first[:-1]]))
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:] - 1, len(w) - 1)
        a, b = starts[w[begin]].tolist(), ends[w[end] + window - 1].tolist()
        c, d = starts[first[begin]].tolist(), ends[first[end] + window - 1].tolist()
        if not all(text[i:j] == text[k:m] for i, j, k, m in zip(a, b, c, d, strict=True)):
            return by_text(text, starts, ends, row, of_row, at, times, window)
    found = np.sort(order[hit])
    return row[found], found - of_row[row[found]]


def by_text(text, starts, ends, row, of_row, at, times, window) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`repeated`, by the windows' own bytes: for chunks in which hashes of different windows agree."""
    count: dict[bytes, int] = {}
    own = [text[i:j] for i, j in zip(starts[at].tolist(), ends[at + window - 1].tolist(), strict=True)]
    for x, n in zip(own, times[row[at]].tolist(), strict=True):
        count[x] = count.get(x, 0) + n
    found = at[np.array([count[x] > 1 for x in own], bool)]
    return row[found], found - of_row[row[found]]


def span_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, body, lo, hi): words of repeated windows, from buckets that come sorted by ``h``; whole buckets are sorted together."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for b in batches:
        h = b.column(0).to_numpy()
        places = b.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        bytes_at = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False) + PLACE * places)
        lo = 0
        for edge in (*np.flatnonzero(np.append(h[:1] != (last if held else h[:1]), h[1:] != h[:-1])).tolist(), len(h)):
            if edge > lo:
                held.append(b.slice(lo, edge - lo))
                size += int(bytes_at[edge - 1] - (bytes_at[lo - 1] if lo else 0))
                lo = edge
            if size >= CHUNK and edge < len(h):
                yield from spans_in(held, window)
                held, size = [], 0
        if len(h):
            last = h[-1]
    if held:
        yield from spans_in(held, window)


def spans_in(held: list[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(held).combine_chunks()
    places = t.column("places").chunk(0)
    n = places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row, at = repeated(t.column("words").to_pylist(), n, window)
    if not len(row):
        return
    head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)))
    tail = np.append(head[1:] - 1, len(row) - 1)
    row, lo, hi = row[head], at[head], at[tail] + window
    # Every run at every place of its string.
    flat, begin = places.flatten(), np.append(0, np.cumsum(n))
    k = n[row]
    each = np.repeat(begin[row] - np.cumsum(k) + k, k) + np.arange(k.sum())
    some = flat.take(pa.array(each))
    start = some.field(2).to_numpy(zero_copy_only=False)
    yield pa.RecordBatch.from_arrays([some.field(0), some.field(1), pa.array(start + np.repeat(lo, k)), pa.array(start + np.repeat(hi, k))], names=["doc_id", "body", "lo", "hi"])


def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, removed ([start, end) in words) and the other words, joined by one blank."""
    for b in batches:
        spans = b.column(3)
        for lo, data, offs in tk.slices(b.column(2)):
            starts, ends, of_row = tk.words(data, offs, tk.SPACED)
            own = spans.slice(lo, len(offs) - 1)
            row = np.repeat(np.arange(len(offs) - 1), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = own.flatten()
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, of_row[row] + flat.field(0).to_numpy(zero_copy_only=False), 1)
            np.add.at(edge, of_row[row] + flat.field(1).to_numpy(zero_copy_only=False), -1)
            gone = np.cumsum(edge[:-1]) > 0
            text, _, new_ends = respaced(data, starts[~gone], ends[~gone])
            kept_of = np.append(0, np.cumsum(~gone))[of_row]
            byte = np.append(0, new_ends + 1)[kept_of]
            texts = [text[x : y - 1] if y > x else b"" for x, y in zip(byte[:-1].tolist(), byte[1:].tolist(), strict=True)]
            words = tk.row_of(of_row)
            starts_run = gone & np.append(True, ~gone[:-1] | (words[1:] != words[:-1]))[: len(gone)]
            ends_run = gone & np.append(~gone[1:] | (words[1:] != words[:-1]), True)[: len(gone)]
            x, y = np.flatnonzero(starts_run), np.flatnonzero(ends_run) + 1
            of = words[x]
            runs = pa.StructArray.from_arrays([pa.array(x - of_row[of]), pa.array(y - of_row[of])], names=["start", "end"])
            cuts = pa.array(np.searchsorted(of, np.arange(len(offs))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, len(offs) - 1), pa.array(np.diff(of_row), pa.int64()), pa.ListArray.from_arrays(cuts, runs), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "removed", "kept"],
            )


def deduplicate(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_words, removed (runs of words, [start, end)), kept (the other words joined by one blank) for every row.

    A word is removed if a window of ``window`` words covers it whose words also stand,
    in their order and letter by letter, anywhere else, in the same document too.
    White space parts words and is otherwise alike.

    Nulls: a null text has no words; a null doc_id is an id.  Each row is a document:
    repeated rows repeat each other's windows, whatever their ids, and lose them all.
    Texts shorter than a window keep their words.  No rows give no rows; extra columns
    are ignored.  A text is held in memory as a whole.
    """
    value = F.col(text).cast("string")
    src = docs.select("doc_id", F.xxhash64(value).alias("body"), value.alias("_text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    of = f"doc_id {kind}, body long"
    ref = F.xxhash64("doc_id", "body")
    asked, used = asked_places(src.select(ref.alias("ref"), "_text"), window, gram, frequent)
    for table in used:
        drop_scratch(table, now=table is used[-1])
    same = lambda side: src["doc_id"].eqNullSafe(side["_of"]) & (src["body"] == side["_in"])
    packed = src.join(asked, ref == F.col("ref")).select("doc_id", "body", "_text", "asked").mapInArrow(
        lambda it: packed_rows(it, window, gram), f"h long, words binary, places array<struct<doc_id:{kind},body:long,start:long>>"
    )
    spans = cut(packed.repartition("h").sortWithinPartitions("h").mapInArrow(lambda it: span_rows(it, window), f"{of}, lo long, hi long"), "spans")
    del packed
    drop_scratch(asked, now=True)
    found = spans.groupBy("doc_id", "body").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")).select(F.col("doc_id").alias("_of"), F.col("body").alias("_in"), "spans")
    both = src.join(found, same(found), "left").select("doc_id", "body", "_text", "spans")
    return both.mapInArrow(kept_rows, f"doc_id {kind}, n_words long, removed array<struct<start:long,end:long>>, kept string")


def asked_places(src: DataFrame, window: int, gram: int, frequent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(ref, asked): for each document, by a hash, the places of minimisers that occur again, and whether they are frequent.

    Documents whose hashes agree are asked for each other's places too, which only
    makes more travel.  Also the tables that are no longer needed.
    """
    places = cut(src.where("_text is not null").mapInArrow(lambda it: place_rows(it, window, gram), "ref long, h long, at long"), "minimisers")
    again = cut(places.groupBy("h").agg(F.count("*").alias("times")).where("times > 1"), "repeated")
    least = max(frequent, places.count() // SENT)
    hubs = hot_keys(again, ["h"], "times", least)
    asked = hub_join(places, again, "h", hubs).select("ref", F.struct("at", (F.col("times") >= least).alias("often")).alias("at"))
    return cut(asked.groupBy("ref").agg(F.collect_set("at").alias("asked")), "asked"), [places, again]
