"""Exact repeated passages by suffix grouping.

``suffix_order`` sorts suffixes in linear time by grouping: suffixes are put into
groups of equal Lyndon prefix, in descending order and along previous-smaller
pointers, and each group's order is then emitted from the smaller suffixes that
follow its members, without renaming or recursion.

Around it, the corpus is cut down to what needs sorting.  Every ``LENGTH``-byte
string has an anchor, its smallest ``GRAM``-byte hash, and equal strings have
equal anchors, so only the surroundings of anchors whose gram occurs again are
compared: equal surroundings by their hashes, different ones by sorting the
suffixes of the surroundings that share a gram.  Grams of a large part of all
documents are found on a bounded sample and compared string by string instead,
summed up per task, so that they never meet in one task.  (The sample only picks
the route; the result does not depend on it.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanline.llm import textkit as tk
from spanline.llm.common import buckets_for, cut

LENGTH, GRAM = 100, 32
#: Consecutive gram starts of one string.
STARTS = LENGTH - GRAM + 1
#: Bytes of surroundings before and after an anchor, in symbols of eight bytes.
BEFORE, AFTER, SYMBOL = 72, 104, 8
WHOLE = (BEFORE + AFTER) // SYMBOL
#: Symbols that any string of LENGTH bytes covers wholly; the other bytes stand at its ends.
INNER = (LENGTH - SYMBOL + 1) // SYMBOL
#: Surroundings sorted at once.
CHUNK = 2000
#: Bytes of text for each bucket; a bucket is held in memory as a whole.
BUCKET_BYTES = 16 << 20
#: Documents are dealt to buckets by their number's rest by this.
PRIME = (1 << 31) - 1
ANCHOR = np.dtype([("h", "u8"), ("c", "u8"), ("doc", "i8"), ("pos", "i4"), ("left", "u1"), ("right", "u1")])
EXACT = np.dtype([("h", "u8"), ("doc", "i8"), ("pos", "i4")])
SPAN = np.dtype([("doc", "i8"), ("lo", "i4"), ("hi", "i4")])
WANTED = np.dtype([("h", "u8"), ("doc", "i8"), ("pos", "i4")])
AROUND = np.dtype([("h", "u8"), ("doc", "i8"), ("pos", "i4"), ("lo", "u1"), ("hi", "u1"), ("sym", "u8", (WHOLE,))])


# --- suffix sorting ---------------------------------------------------------


def suffix_order(s: list[int]) -> list[int]:
    """The suffixes of ``s`` in ascending order; s ends with a symbol smaller than all others."""
    n = len(s)
    if n < 2:
        return list(range(n))
    groups, prev = lyndon_groups(s)
    return emit_order(groups, prev, n)


def lyndon_groups(s: list[int]) -> tuple[list[int], list[int]]:
    """(start of each suffix's group in the order, previous smaller suffix of each, -1 for none).

    Groups are taken in descending order.  A member's pointer is the nearest
    position to its left that lies in a smaller group, which a list of the
    positions not yet taken holds.  Positions that are pointed at get a longer
    Lyndon prefix, once for each pointer, and move to new groups just above their
    old one, those with more pointers above those with fewer.
    """
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place, start, size = [0] * n, [0] * n, [0] * n
    at = 0
    for i in range(n):
        if i and s[order[i]] != s[order[i - 1]]:
            at = i
        place[order[i]] = i
        start[order[i]] = at
        size[at] += 1
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    prev = [-1] * n
    end = n
    while end > 0:
        lo = start[order[end - 1]]
        hits: dict[int, int] = {}
        for i in order[lo:end] if end - lo == 1 else sorted(order[lo:end]):
            # All members leave the list; members to the left have left already.
            p, q = left[i], right[i]
            prev[i] = p
            if p >= 0:
                right[p] = q
                hits[p] = hits.get(p, 0) + 1
            if q < n:
                left[q] = p
        end = lo
        if not hits:
            continue
        if len(hits) == 1:
            layers = [list(hits)]
        else:
            by_count: dict[int, list[int]] = {}
            for j, c in hits.items():
                by_count.setdefault(c, []).append(j)
            layers = [by_count[c] for c in sorted(by_count, reverse=True)]
        for layer in layers:
            # From each old group its members of this layer go to the group's end, and are a group there.
            olds: dict[int, int] = {}
            for j in layer:
                g = start[j]
                olds[g] = olds.get(g, 0) + 1
                last = g + size[g] - olds[g]
                k, other = place[j], order[last]
                order[k], order[last] = other, j
                place[other], place[j] = k, last
            for g, moved in olds.items():
                size[g] -= moved
                if size[g]:
                    new = g + size[g]
                    size[new] = moved
                    for k in range(new, new + moved):
                        start[order[k]] = new
                else:
                    size[g] = moved
    return start, prev


def emit_order(start: list[int], prev: list[int], n: int) -> list[int]:
    """Fill the order from the smallest suffix on.

    The suffix before the one just emitted, and the chain of previous smaller
    suffixes from there, have it as their next smaller one: they come next in
    their groups, until the chain meets one that has its place.
    """
    order, filled, fill = [-1] * n, [False] * n, list(range(n))
    order[0], filled[n - 1] = n - 1, True
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not filled[j]:
            g = start[j]
            order[fill[g]] = j
            fill[g] += 1
            filled[j] = True
            j = prev[j]
    return order


# --- anchors ----------------------------------------------------------------


def sliding_max(x: np.ndarray, w: int) -> np.ndarray:
    """out[i]: the largest of the w items that end at i."""
    cur, span = np.concatenate([np.zeros(w - 1, x.dtype), x]), 1
    full = cur
    while span * 2 <= w:
        cur = np.maximum(cur[:-span], cur[span:])
        span *= 2
    n = len(full) - w + 1
    return np.maximum(cur[:n], cur[w - span : w - span + n])


class Anchors:
    """The anchors of a slice: positions, hashes, and how far their strings reach."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.prefix = tk.prefix_hash(data)
        n = len(data) - GRAM + 1
        z = np.zeros(0, np.int64)
        self.pos = self.row = self.first = self.last = z
        if n < STARTS:
            return
        _, down = tk.powers(n)
        h = (self.prefix[GRAM:] - self.prefix[:-GRAM]) * down
        low = tk.sliding_min(h, STARTS)
        size = np.diff(offs)
        ok = np.zeros(len(data) + 1, np.int8)
        rows = np.flatnonzero(size >= LENGTH)
        np.add.at(ok, offs[rows], 1)
        np.add.at(ok, offs[rows + 1] - LENGTH + 1, -1)
        inside = np.cumsum(ok[: len(low)], dtype=np.int8) > 0
        low = np.where(inside, low, 0)
        best = sliding_max(np.concatenate([low, np.zeros(n - len(low), np.uint64)]), STARTS)
        self.pos = np.flatnonzero((best == h) & (best != 0))
        self.row = np.searchsorted(offs, self.pos, side="right") - 1
        self.first = np.maximum(offs[self.row], self.pos - STARTS + 1)
        self.last = np.minimum(self.pos, offs[self.row + 1] - LENGTH)

    def grams(self) -> np.ndarray:
        return tk.span_hash(self.prefix, self.pos, self.pos + GRAM)

    def contexts(self) -> np.ndarray:
        return tk.mix(tk.span_hash(self.prefix, self.first, self.last + LENGTH) + (self.pos - self.first).astype(np.uint64) * tk.MULT)


def hot_grams(docs: DataFrame, total: int, sample_docs: int, share: float) -> np.ndarray:
    """Grams of ``share`` or more of a sample of about ``sample_docs`` documents: 70 / share of them at most per kilobyte of text."""
    some = docs.where(F.pmod(F.xxhash64("_doc"), F.lit(1 << 30)) < int(min(1.0, sample_docs / max(1, total)) * (1 << 30)))

    def run(batches):
        for b in batches:
            for _, data, offs in tk.slices(b.column(1)):
                a = Anchors(data, offs)
                pair = np.unique(np.stack([a.grams(), a.row.astype(np.uint64)]), axis=1)[0] if len(a.pos) else np.zeros(0, np.uint64)
                h, n = np.unique(pair, return_counts=True)
                some = n > 1 if len(offs) > 100 else n > 0
                yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(n[some])], names=["h", "n"])

    found = some.select("_doc", "_text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") >= max(50.0, share * min(sample_docs, total))).select("h").limit(1 << 20).toArrow()
    return np.sort(rows.column("h").to_numpy().view(np.uint64)) if rows.num_rows else np.zeros(0, np.uint64)


def doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    """As :func:`bucket_of`, for arrays."""
    return np.mod(np.mod(doc, PRIME), n)


def bucket_of(doc: str, n: int) -> F.Column:
    return F.pmod(F.pmod(F.col(doc), F.lit(PRIME)), F.lit(n))


def deal(kind: int, rows: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """One packed row for each bucket that occurs."""
    if not len(rows):
        return
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for lo, hi in zip(edge, np.append(edge[1:], len(rows)), strict=True):
        yield int(bucket[lo]), kind, rows[lo:hi].tobytes()


PACKED = "bucket long, kind int, packed binary"


def packed_batch(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "kind", "packed"])


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, bytes]]]:
    """(bucket, kind to packed rows) from batches sorted by bucket."""
    held, got = None, {}
    for b in batches:
        for bucket, kind, packed in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
            if bucket != held:
                if got:
                    yield held, {k: b"".join(v) for k, v in got.items()}
                held, got = bucket, {}
            got.setdefault(kind, []).append(packed)
    if got:
        yield held, {k: b"".join(v) for k, v in got.items()}


def earlier(key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which entries have an equal key at a smaller (doc, pos)."""
    order = np.lexsort((pos, doc, key))
    k, d, p = key[order], doc[order], pos[order]
    head = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))
    out = np.zeros(len(k), bool)
    out[order] = (d != d[lead]) | (p != p[lead])
    return out


def anchor_rows(batches: Iterator[pa.RecordBatch], hot: np.ndarray, n_buckets: int, n_docs: int) -> Iterator[pa.RecordBatch]:
    """Packed anchors by gram (0), strings of hot grams (1), and spans known to be repeated by document (2)."""
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for at, data, offs in tk.slices(b.column(1)):
            a = Anchors(data, offs)
            if not len(a.pos):
                continue
            h, doc = a.grams(), ids[at + a.row]
            base = offs[a.row]
            is_hot = np.isin(h, hot) if len(hot) else np.zeros(len(h), bool)
            cold = np.flatnonzero(~is_hot)
            rows = np.zeros(len(cold), ANCHOR)
            rows["h"], rows["c"], rows["doc"], rows["pos"] = h[cold], a.contexts()[cold], doc[cold], (a.pos - base)[cold]
            rows["left"], rows["right"] = (a.pos - a.first)[cold], (a.last + LENGTH - a.pos)[cold]
            # Copies within the slice: the first speaks for them.
            later = earlier(tk.mix(rows["h"] ^ tk.mix(rows["c"])), rows["doc"], rows["pos"])
            spans = [spans_of(rows[later])]
            rows = rows[~later]
            out = list(deal(0, rows, (rows["h"] % np.uint64(n_buckets)).astype(np.int64)))
            warm = np.flatnonzero(is_hot)
            if len(warm):
                lens = (a.last - a.first + 1)[warm]
                start = np.repeat(a.first[warm] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
                start, once = np.unique(start, return_index=True)
                ex = np.zeros(len(start), EXACT)
                ex["h"] = tk.span_hash(a.prefix, start, start + LENGTH)
                ex["doc"] = np.repeat(doc[warm], lens)[once]
                ex["pos"] = start - np.repeat(base[warm], lens)[once]
                later = earlier(ex["h"], ex["doc"], ex["pos"])
                spans.append(exact_spans(ex[later]))
                ex = ex[~later]
                out += deal(1, ex, (ex["h"] % np.uint64(n_buckets)).astype(np.int64))
            spans = np.concatenate(spans)
            out += deal(2, spans, doc_bucket(spans["doc"], n_buckets))
            yield packed_batch(out)


def spans_of(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), SPAN)
    out["doc"], out["lo"], out["hi"] = a["doc"], a["pos"] - a["left"], a["pos"] + a["right"]
    return out


def exact_spans(e: np.ndarray) -> np.ndarray:
    """LENGTH bytes from each start, runs of starts put together."""
    out = np.zeros(len(e), SPAN)
    out["doc"], out["lo"], out["hi"] = e["doc"], e["pos"], e["pos"] + LENGTH
    return united(out)


def united(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching spans of a document put together, sorted."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["hi"], spans["lo"], spans["doc"]))]
    # Running maxima that start anew in each document.
    rank = np.cumsum(np.append(0, spans["doc"][1:] != spans["doc"][:-1])).astype(np.int64) << 32
    reach = np.maximum.accumulate(rank + spans["hi"])
    head = np.append(True, rank[1:] + spans["lo"][1:] > reach[:-1])
    out = spans[head]
    out["hi"] = np.maximum.reduceat(rank + spans["hi"], np.flatnonzero(head)) - rank[head]
    return out


def gram_rows(batches: Iterator[pa.RecordBatch], n_docs: int) -> Iterator[pa.RecordBatch]:
    """From buckets of grams, by document: spans that are repeated (2), and anchors whose surroundings need sorting (3)."""
    for _, got in by_bucket(batches):
        spans = [np.frombuffer(got.get(2, b""), SPAN)]
        e = np.frombuffer(got.get(1, b""), EXACT)
        if len(e):
            spans.append(exact_spans(e[earlier(e["h"], e["doc"], e["pos"])]))
        a = np.frombuffer(got.get(0, b""), ANCHOR)
        wanted = np.zeros(0, WANTED)
        if len(a):
            by = np.argsort(a["h"], kind="stable")
            h = a["h"][by]
            again = np.append(False, h[1:] == h[:-1])
            again[:-1] |= again[1:]
            a = a[by[again]]
            a = a[np.lexsort((a["pos"], a["doc"], a["c"], a["h"]))]
        if len(a):
            new_h = np.append(True, a["h"][1:] != a["h"][:-1])
            new_c = new_h | np.append(True, a["c"][1:] != a["c"][:-1])
            spans.append(spans_of(a[~new_c]))
            kinds = np.add.reduceat(new_c.astype(np.int64), np.flatnonzero(new_h))
            rep = a[new_c & np.repeat(kinds > 1, np.diff(np.append(np.flatnonzero(new_h), len(a))))]
            wanted = np.zeros(len(rep), WANTED)
            for f in WANTED.names:
                wanted[f] = rep[f]
        spans = np.concatenate(spans)
        yield packed_batch([*deal(2, spans, doc_bucket(spans["doc"], n_docs)), *deal(3, wanted, doc_bucket(wanted["doc"], n_docs))])


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[int, bytes], pa.RecordBatch]]:
    """(packed rows of the bucket, documents): packed rows of a bucket come before its documents."""
    held, got = None, {}
    for b in batches:
        bucket, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
        for lo, hi in zip(e := np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | ((kind[1:] < 9) != (kind[:-1] < 9)))), np.append(e[1:], len(bucket)), strict=True):
            if bucket[lo] != held:
                held, got = bucket[lo], {}
            part = b.slice(lo, hi - lo)
            if kind[lo] < 9:
                for k, packed in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    got.setdefault(k, []).append(packed)
            else:
                got = {k: [b"".join(v)] for k, v in got.items()}
                yield {k: v[0] for k, v in got.items()}, part


def around_rows(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """The surroundings that are asked for, packed by gram (4)."""
    for got, docs in merged(batches):
        want = np.frombuffer(got.get(3, b""), WANTED)
        if not len(want):
            continue
        want = want[np.lexsort((want["pos"], want["doc"]))]
        ids = docs.column(3).to_numpy(zero_copy_only=False)
        for at, data, offs in tk.slices(docs.column(4)):
            own = ids[at : at + len(offs) - 1]
            lo, hi = np.searchsorted(want["doc"], own, "left"), np.searchsorted(want["doc"], own, "right")
            n = hi - lo
            if not n.sum():
                continue
            w = want[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            row = np.repeat(np.arange(len(own)), n)
            pos = offs[row] + w["pos"]
            inside = pos + GRAM <= offs[row + 1]
            w, row, pos = w[inside], row[inside], pos[inside]
            byte = pos[:, None] + np.arange(-BEFORE, AFTER)
            raw = data[np.clip(byte, 0, len(data) - 1)]
            out = np.zeros(len(w), AROUND)
            for f in WANTED.names:
                out[f] = w[f]
            out["lo"] = np.maximum(BEFORE - STARTS + 1, offs[row] - pos + BEFORE)
            out["hi"] = np.minimum(pos, offs[row + 1] - LENGTH) - pos + BEFORE
            out["sym"] = np.ascontiguousarray(raw).view(">u8")
            yield packed_batch(deal(4, out, (out["h"] % np.uint64(n_buckets)).astype(np.int64)))


def around_spans(batches: Iterator[pa.RecordBatch], n_docs: int) -> Iterator[pa.RecordBatch]:
    """Repeated spans (2) by document, from surroundings that share a gram."""
    for _, got in by_bucket(batches):
        a = np.frombuffer(got[4], AROUND)
        a = a[np.argsort(a["h"], kind="stable")]
        edge = np.flatnonzero(np.append(True, a["h"][1:] != a["h"][:-1]))
        lo = 0
        while lo < len(a):  # whole grams, about CHUNK surroundings
            k = np.searchsorted(edge, lo + CHUNK, side="right") - 1
            hi = int(edge[k]) if edge[k] > lo else int(edge[k + 1]) if k + 1 < len(edge) else len(a)
            if len(a) - lo <= CHUNK:
                hi = len(a)
            spans = repeated_in(a[lo:hi])
            yield packed_batch(deal(2, spans, doc_bucket(spans["doc"], n_docs)))
            lo = hi


def repeated_in(a: np.ndarray) -> np.ndarray:
    """Spans of the strings of LENGTH bytes in the surroundings ``a`` that occur in them at a smaller (doc, pos) too."""
    n = len(a)
    symbols, rank = np.unique(a["sym"], return_inverse=True)
    text = np.ones((n, WHOLE + 1), np.int64)  # 1 parts the surroundings, 0 ends them all
    text[:, :WHOLE] = rank.reshape(n, WHOLE) + 2
    flat = np.append(text.ravel(), 0)
    order = np.array(suffix_order(flat.tolist()))
    # Neighbours that agree in INNER symbols are of one class.
    padded = np.concatenate([flat, np.full(INNER, -1)])
    same = np.ones(len(order) - 1, bool)
    for j in range(INNER):
        x = padded[order + j]
        same &= x[1:] == x[:-1]
    cls = np.zeros(len(flat), np.int64)
    cls[order] = np.cumsum(np.append(0, ~same))
    cls = cls[:-1].reshape(n, WHOLE + 1)
    raw = a["sym"].astype(">u8").view(np.uint8).reshape(n, BEFORE + AFTER)
    keys, docs, starts, rows = [], [], [], []
    for s in range(BEFORE - STARTS + 1, BEFORE + 1):
        use = np.flatnonzero((a["lo"] <= s) & (s <= a["hi"]))
        j = -(-s // SYMBOL)
        ends = np.concatenate([raw[use, s : j * SYMBOL], raw[use, (j + INNER) * SYMBOL : s + LENGTH]], axis=1)
        key = cls[use, j].astype(np.uint64) * tk.MULT + np.uint64(j * SYMBOL - s)
        ends = np.concatenate([ends, np.zeros((len(use), -ends.shape[1] % 8), np.uint8)], axis=1)
        for part in np.ascontiguousarray(ends).view("<u8").T:
            key = tk.mix(key) * tk.MULT + part
        keys.append(tk.mix(key))
        docs.append(a["doc"][use])
        starts.append(a["pos"][use] - BEFORE + s)
    out = np.zeros(sum(map(len, keys)), EXACT)
    out["h"], out["doc"], out["pos"] = (np.concatenate(x) for x in (keys, docs, starts))
    return exact_spans(out[earlier(out["h"], out["doc"], out["pos"])])


def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got, docs in merged(batches):
        spans = united(np.frombuffer(got.get(2, b""), SPAN))
        ids = docs.column(3).to_numpy(zero_copy_only=False)
        lo, hi = np.searchsorted(spans["doc"], ids, "left"), np.searchsorted(spans["doc"], ids, "right")
        texts, kept, runs = docs.column(4).to_pylist(), [], []
        for i, t in enumerate(texts):
            t = t or b""
            own = [(int(x), int(min(y, len(t)))) for x, y in zip(spans["lo"][lo[i] : hi[i]], spans["hi"][lo[i] : hi[i]], strict=True) if x < len(t)]
            edges = [0, *(e for r in own for e in r), len(t)]
            kept.append(b"".join(t[x:y] for x, y in zip(edges[0::2], edges[1::2], strict=True)))
            runs.append([list(r) for r in own])
        yield pa.RecordBatch.from_arrays(
            [docs.column(5), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"]
        )


def numbered(docs: DataFrame) -> DataFrame:
    """Adds ``_doc``, a long in the order of (doc_id, hash of the text), null first; rows with both equal share it.

    Whole numbers that are unique are taken as they are, which one count of ids
    tells; else ids are sorted, without their texts, and joined back.
    """
    whole = docs.schema["doc_id"].dataType.typeName() in ("long", "integer", "short", "byte")
    if whole and not docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    docs = docs.withColumn("_body", F.xxhash64("_text"))
    keys = docs.select("doc_id", "_body").distinct().orderBy(F.asc_nulls_first("doc_id"), "_body")
    keys = cut(keys.select(F.col("doc_id").alias("_of"), F.col("_body").alias("_in"), F.monotonically_increasing_id().alias("_doc")), "numbers")
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["_of"]) & (docs["_body"] == keys["_in"])).select("doc_id", "_text", "_doc")


def deduplicate(docs: DataFrame, text: str = "text", sample_docs: int = 20_000, hot_share: float = 0.01) -> DataFrame:
    """doc_id, n_bytes, removed (runs of bytes, [start, end)), kept (the other bytes) for every document.

    A byte is removed if a string of LENGTH bytes covers it that also starts
    earlier: in a document of smaller doc_id, or before in the same one.  Strings
    are judged on the input and never cross documents.

    Nulls: a null text is empty; a null doc_id is the smallest.  Rows of equal
    doc_id and other texts are documents of their own, in the order of their
    texts' hashes; those of equal doc_id and text are one document, and lose the
    same bytes.  doc_id may be of any type that sorts.  No rows give no rows; extra
    columns are ignored.  A text is held in memory as a whole.
    """
    spark = docs.sparkSession
    src = numbered(docs.select("doc_id", F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "utf-8").alias("_text")))
    total, size = src.agg(F.count("*"), F.sum(F.octet_length("_text"))).first()
    parts = buckets_for(spark)
    n = max(parts, -(-(size or 0) // BUCKET_BYTES))
    # Buckets are dealt to partitions one by one, so that all are about equally full.
    dealt = lambda df: df.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int"))
    hot = spark.sparkContext.broadcast(hot_grams(src, total, sample_docs, hot_share))
    anchors = src.select("_doc", "_text").mapInArrow(lambda it: anchor_rows(it, hot.value, n, n), PACKED)
    found = dealt(anchors).sortWithinPartitions("bucket").mapInArrow(lambda it: gram_rows(it, n), PACKED)
    found = cut(found, "found")
    nothing = [F.lit(None).cast("long").alias("_doc"), F.lit(None).cast("binary").alias("_text"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id")]
    texts = src.select(bucket_of("_doc", n).alias("bucket"), F.lit(9).alias("kind"), F.lit(None).cast("binary").alias("packed"), "_doc", "_text", "doc_id")

    def with_texts(packed: DataFrame) -> DataFrame:
        both = texts.unionByName(packed.select("bucket", "kind", "packed", *nothing))
        return dealt(both).sortWithinPartitions("bucket", "kind")

    around = with_texts(found.where("kind = 3")).mapInArrow(lambda it: around_rows(it, n), PACKED)
    more = dealt(around).sortWithinPartitions("bucket").mapInArrow(lambda it: around_spans(it, n), PACKED)
    more = cut(more, "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = found.where("kind = 2").unionByName(more)
    return with_texts(spans).mapInArrow(kept_rows, f"doc_id {kind}, n_bytes long, removed array<array<long>>, kept binary")
