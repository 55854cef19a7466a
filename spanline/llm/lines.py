"""Fuzzy line deduplication: SimHash in pigeonhole blocks, edit similarity, connected groups.

A SimHash gives each bit the sign of a weighted sum over a line's words, each adding
or taking away its weight by a random bit of its own.  With equal weights, lines of edit
similarity 0.8 differ in a fifth of all bits, and no block long enough to tell lines
apart agrees.  Here a word has another weight in each of BLOCKS blocks of 16 bits:
u ** -8 for a random u from 0 to 1, so that mostly few words decide a block, and the
blocks of two lines agree as a whole nearly as often as their words do (2/3 or more).
Words of up to SHORT bytes, which say little, have a u four times as large.

In nine lines of ten a block's heaviest word weighs more than all others together:
then all 16 sums have the signs of its bits.  For the others they are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanline.llm import textkit as tk
from spanline.llm.buckets import linked
from spanline.llm.common import SENT, broadcast_if, components, cut, drop_scratch, hot_keys, hub_join

#: Blocks of a SimHash, of 16 bits each, and how many of them make the key of a table:
#: of two lines that differ in fewer blocks than there are tables (7 of 24), a table's blocks all agree.
BLOCKS, EACH = 24, 3
TABLES = BLOCKS // EACH
#: Numbers of 64 bits for the parities of a line's words.
PARITIES = 4
#: Bytes of the words that have little weight.
SHORT = 3
#: The power of the weights' tail, 2 ** DOUBLED.
DOUBLED = 3
#: The largest size that a mark tells.
MOST = (1 << 16) - 1
#: Above it three times a number is out of range, and all words are near.
FAR = np.uint64((1 << 64) // 3 - 1)
#: Occurrences of a line from which they are joined apart from the others.
COMMON = 50_000


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of all lines, as splitting at line feeds gives them."""
    feeds = np.flatnonzero(data == 0x0A)
    rows = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, feeds, side="right") - 1])
    starts = np.concatenate([offsets[:-1], feeds + 1])
    order = np.lexsort((starts, rows))
    starts, row = starts[order], rows[order]
    if not len(row):
        return starts, starts, row
    last = np.append(row[1:] != row[:-1], True)
    ends = np.where(last, offsets[row + 1], np.append(starts[1:] - 1, 0))
    return starts, ends, row


def line_words(data: np.ndarray, offsets: np.ndarray):
    """Lines with their words: (row, number in the row, hashes, first word of each line)."""
    row, number, h, first, _ = sized_words(data, offsets)
    return row, number, h, first


def sized_words(data: np.ndarray, offsets: np.ndarray):
    """As :func:`line_words`, and the words' lengths in bytes."""
    starts, ends, row = line_bounds(data, offsets)
    low = tk.lower(data)
    begin, end, first = tk.words(low, np.append(starts, len(data)), tk.ALNUM)
    h = tk.span_hash(tk.prefix_hash(low), begin, end)
    head = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    number = np.arange(len(row)) - np.repeat(head, np.diff(np.append(head, len(row))))
    return row, number, h, first, end - begin


def simhashes(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The SimHash of each line, one row of TABLES keys: three blocks of 16 bits with the table's number above.

    After them come PARITIES numbers: which of 256 classes of words a line has an
    odd number of.  Putting in or taking out a word flips one bit and a changed
    word at most two.
    """
    out, parity = np.zeros((TABLES, len(first) - 1), np.uint64), np.zeros((len(first) - 1, PARITIES), np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        begin, n = first[:-1][some], np.diff(first)[some]
        bit = np.uint64(1) << ((h >> np.uint64(56)) & np.uint64(63))
        for i in range(PARITIES):
            parity[some, i] = np.bitwise_xor.reduceat(np.where(h >> np.uint64(62) == np.uint64(i), bit, np.uint64(0)), begin)
        odd = tk.mix(np.arange(1, BLOCKS + 1, dtype=np.uint64) * tk.MULT) | np.uint64(1)
        lift = np.where(size > SHORT, np.uint64(2), np.uint64(0))
        drawn = np.empty_like(h)
        for i in range(BLOCKS):
            np.right_shift(np.multiply(h, odd[i], out=drawn), lift, out=drawn)
            out[i // EACH, some] |= signs(drawn, begin, n) << np.uint64(16 * (i % EACH))
    return np.concatenate([out.T | (np.arange(TABLES, dtype=np.uint64) << np.uint64(16 * EACH))[None], parity], axis=1)


def signs(drawn: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """16 bits for each line: whether the sums of its words' weights, with the signs of their bits, are above 0.

    ``drawn`` are the words' random numbers, of which weights and bits are functions;
    ``begin`` and ``size`` say which words are a line's.  Words are weighed against the
    line's heaviest; those of a 6000th of its weight or less are left out.
    """
    least = np.minimum.reduceat(drawn, begin)
    near = np.flatnonzero(drawn <= np.repeat(np.minimum(least, FAR) * np.uint64(3), size))
    start = np.searchsorted(near, begin)
    line = np.repeat(np.arange(len(begin)), np.diff(np.append(start, len(near))))
    weight = (least.astype(np.float64) + 1)[line] / (drawn[near].astype(np.float64) + 1)
    for _ in range(DOUBLED):
        weight *= weight
    out = tk.mix(least) & np.uint64(0xFFFF)  # the heaviest word's bits
    open_ = np.flatnonzero(np.add.reduceat(weight, start) >= 2)
    if len(open_):
        n = np.diff(np.append(start, len(near)))[open_]
        at = np.repeat(start[open_] - np.cumsum(n) + n, n) + np.arange(n.sum())
        bits, own = tk.mix(drawn[near[at]]), weight[at]
        shown = np.unpackbits(bits.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
        total = np.add.reduceat((shown * 2.0 - 1.0) * own[:, None], np.cumsum(n) - n, axis=0)
        block = np.packbits(total > 0, axis=1, bitorder="little").view("<u2")[:, 0].astype(np.uint64)
        out[open_] = block
    return out


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The share of blocks in which SimHashes agree."""
    apart = x ^ y
    out = np.zeros(apart.shape[:-1], np.int32)
    for t in range(TABLES):
        for j in range(EACH):
            out += (apart[..., t] >> np.uint64(16 * j)) & np.uint64(0xFFFF) == 0
    return out / BLOCKS


class likeness:  # noqa: N801
    """A score for pairs: their agreement, -1 where sizes or parities rule the similarity out."""

    def __init__(self, similarity: float):
        self.similarity = similarity

    def __call__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        n, m = np.broadcast_arrays(n, m)
        out = np.full(n.shape, -1.0)
        x, y = np.broadcast_arrays(x, y)
        live = np.unravel_index(self.near(n.ravel(), m.ravel(), lambda at, t: (v[np.unravel_index(at, n.shape)][:, t] for v in (x, y))), n.shape)
        out[live] = agreement(x[live], y[live])
        return out

    def may(self, sk: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the score of rows ``p`` with rows ``q`` is 0 or more."""
        out = np.zeros(len(p), bool)
        out[self.near(n[p], n[q], lambda at, t: (sk[p[at], t], sk[q[at], t]))] = True
        return out

    def marks(self, sk: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A number for each row: its size, MOST at most, above the parities of 48 classes of words, 256 folded."""
        fold = np.bitwise_xor.reduce(sk[:, TABLES:], axis=1)
        fold = (fold ^ (fold >> np.uint64(48))) & np.uint64((1 << 48) - 1)
        return np.minimum(n, MOST).astype(np.uint64) << np.uint64(48) | fold

    def meets(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether rows with these marks may be similar; a word flips one parity here too, so no pair that ``may`` be is left out."""
        n, m = ((v >> np.uint64(48)).astype(np.int64) for v in (x, y))
        small, large = np.minimum(n, m), np.maximum(n, m)
        most = 2 * edits(large, self.similarity) - large + small
        return (small >= self.similarity * large - 1e-9) & ((large == MOST) | (np.bitwise_count((x ^ y) << np.uint64(16)) <= most))

    def near(self, n: np.ndarray, m: np.ndarray, columns) -> np.ndarray:
        """The pairs that sizes and parities, asked for by ``columns`` in turn, don't rule out."""
        small, large = np.minimum(n, m), np.maximum(n, m)
        live = np.flatnonzero(small >= self.similarity * large - 1e-9)
        most = (2 * edits(large[live], self.similarity) - large[live] + small[live]).astype(np.int64)
        apart = np.zeros(len(live), np.int64)
        for t in range(TABLES, TABLES + PARITIES):
            x, y = columns(live, t)
            apart += np.bitwise_count(x ^ y)
            ok = apart <= most
            live, most, apart = live[ok], most[ok], apart[ok]
        return live


def digests(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits for each line's sequence of words, as two 64-bit numbers; the first is the line's ``id``."""
    pos = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    up, _ = tk.powers(int(pos.max()) + 2 if len(pos) else 2)
    sums = []
    for salt in (tk.MIX1, tk.MIX2):
        c = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(tk.mix(h + salt) * up[pos], out=c[1:])
        sums.append(tk.mix(c[first[1:]] - c[first[:-1]] + np.diff(first).astype(np.uint64) * tk.MIX2))
    return np.stack(sums, axis=1)


def edits(n, similarity: float):
    """The edits that a pair may need whose longer line has ``n`` words."""
    return np.floor((1 - similarity) * n + 1e-9).astype(np.int64)


ROW = "doc_id {}, body long"
#: Columns that hardly repeat.
HASHES = ("hi", "lo", "sketch")


def line_rows(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(doc_id, body, line, hi, lo, n, sketch) of lines with words; lines that no edit may change have no SimHash."""
    for b in batches:
        for at, data, offs in tk.slices(b.column(2)):
            row, number, h, first, size = sized_words(data, offs)
            use = np.flatnonzero(np.diff(first))
            n, dig = np.diff(first)[use], digests(h, first)[use].view(np.int64)
            fuzzy = edits(np.floor(n / similarity + 1e-9), similarity) > 0
            # Of a line's occurrences in the slice the first has the SimHash.
            once = np.zeros(len(use), bool)
            once[np.unique(dig[:, 0] ^ dig[:, 1], return_index=True)[1]] = True
            sketch, ends = first_sketches(h, first, size, use, fuzzy & once)
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(i).take(pa.array(at + row[use])) for i in (0, 1)),
                    *(pa.array(x, pa.int64()) for x in (number[use], dig[:, 0], dig[:, 1], n)),
                    pa.BinaryArray.from_buffers(pa.binary(), len(use), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(sketch))]),
                ],
                names=["doc_id", "body", "line", "hi", "lo", "n", "sketch"],
            )


def first_sketches(h, first, size, use, wanted) -> tuple[np.ndarray, np.ndarray]:
    """(SimHashes of the wanted lines, the bytes where each line's begin and end among them)."""
    at = use[wanted]
    n = np.diff(first)[at]
    words = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
    sketch = simhashes(h[words], np.append(0, np.cumsum(n)), size[words]).view(np.int64)
    return sketch, np.concatenate([[0], np.cumsum(wanted) * (TABLES + PARITIES) * 8]).astype(np.int32)


def pick_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes of the lines asked for: (lines as (line, id), text) to (id, body)."""
    for b in batches:
        want = b.column(0)
        asked = want.flatten()
        line, ids = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("line", "id"))
        of = np.repeat(np.arange(b.num_rows), want.value_lengths().to_numpy(zero_copy_only=False))
        for at, data, offs in tk.slices(b.column(1)):
            here = slice(*np.searchsorted(of, (at, at + len(offs) - 1)).tolist())
            starts, ends, row = line_bounds(data, offs)
            k = np.searchsorted(row, of[here] - at) + line[here]
            # Only these lines' bytes are parted into words.
            size = ends[k] - starts[k]
            bounds = np.append(0, np.cumsum(size + 1))
            low = np.full(bounds[-1], 0x0A, np.uint8)
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            low[np.repeat(bounds[:-1], size) + inner] = tk.lower(data[np.repeat(starts[k], size) + inner])
            begin, end, first = tk.words(low, bounds, tk.ALNUM)
            h = (tk.span_hash(tk.prefix_hash(low), begin, end) >> np.uint64(32)).astype(np.uint32)
            body = [h[x:y].tobytes() for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[here], pa.int64()), pa.array(body, pa.binary())], names=["id", "body"])


def within(x: np.ndarray, y: np.ndarray, most: int) -> bool:
    """Whether the edit distance of two word sequences is at most ``most``.

    Equal ends are cut off; long lines are first tried for a few edits; the rest is
    compared bit-parallel (Myers 1999): a column of the table is two bit vectors of
    its steps up and down.
    """
    if abs(len(x) - len(y)) > most:
        return False
    n = min(len(x), len(y))
    diff = np.flatnonzero(x[:n] != y[:n])
    head = int(diff[0]) if len(diff) else n
    x, y = x[head:], y[head:]
    n = min(len(x), len(y))
    diff = np.flatnonzero(x[::-1][:n] != y[::-1][:n])
    tail = int(diff[0]) if len(diff) else n
    a, b = x[: len(x) - tail].tolist(), y[: len(y) - tail].tolist()
    if max(len(a), len(b)) <= most:
        return True
    if not a or not b:
        return False
    if min(len(a), len(b)) >= LONG and few_edits(x[: len(a)], y[: len(b)], min(most, 8)):
        return True
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for w in b:
        eq = where.get(w, 0)
        xv, xh = eq | down, (((eq & up) + up) ^ up) | eq
        right, left = down | (full & ~(xh | up)), up & xh
        score += bool(right & top) - bool(left & top)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | (full & ~(xv | right)), right & xv
    return score <= most


#: Words from which lines are first tried for a few edits.
LONG = 2000


def few_edits(x: np.ndarray, y: np.ndarray, most: int) -> bool:
    """Whether the edit distance is at most ``most``, by the furthest reach on each diagonal: words compared grow with most squared."""

    def run(i: int, j: int) -> int:
        """Where equal words from (i, j) on end, in x; looked at in growing steps."""
        step, end = 64, min(len(x) - i, len(y) - j)
        done = 0
        while done < end:
            upto = min(end, done + step)
            apart = np.flatnonzero(x[i + done : i + upto] != y[j + done : j + upto])
            if len(apart):
                return i + done + int(apart[0])
            done, step = upto, step * 4
        return i + end

    goal = len(y) - len(x)
    reach = {0: run(0, 0)}
    for _ in range(most):
        if reach.get(goal, -1) >= len(x):
            break
        grown = {}
        for d in range(min(reach) - 1, max(reach) + 2):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)  # changed, put in, taken out
            i = min(i, len(x), len(y) - d)
            if i >= 0 and i + d >= 0:
                grown[d] = run(i, i + d)
        reach = grown
    return reach.get(goal, -1) >= len(x)


#: Words of the longest lines that are compared many pairs at once, how many pairs that takes, and bytes of one such step.
MANY, LEAST, STEP = 512, 40, 1 << 20
#: Words of the pairs of which those in common are counted at once.
BAGS = 1 << 17


class alike:  # noqa: N801
    """Whether two lines' word hashes are within the edit similarity."""

    def __init__(self, similarity: float):
        self.similarity = similarity

    def __call__(self, p: bytes, q: bytes) -> bool:
        x, y = (np.frombuffer(v, np.uint32) for v in (p, q))
        return within(x, y, int(edits(max(len(x), len(y)), self.similarity)))

    def many(self, p: list[bytes], q: list[bytes]) -> np.ndarray:
        """The same for pairs of lines."""
        n, m = (np.fromiter(map(len, v), np.int64, len(v)) // 4 for v in (p, q))
        most = edits(np.maximum(n, m), self.similarity)
        out = np.zeros(len(n), bool)
        near = (np.abs(n - m) <= most) & (np.minimum(n, m) > 0)
        # Lines that lack words put in or taken out need no table.
        even = np.flatnonzero(near & (n == m))
        if len(even):
            x, y = (np.frombuffer(b"".join([v[i] for i in even.tolist()]), np.uint32) for v in (p, q))
            out[even] = np.add.reduceat(x != y, np.cumsum(n[even]) - n[even], dtype=np.int64) <= most[even]
        near &= ~out
        # Most of the others lack too many words of each other, or stand in another order.
        tried = np.flatnonzero(near & (np.maximum(n, m) <= MANY))
        near[tried] = False
        for rows in np.split(tried, np.flatnonzero(np.diff(np.cumsum(n[tried] + m[tried]) // BAGS)) + 1):
            for size in (1, 2):
                rows = rows[in_common(p, q, rows, size) >= np.maximum(n, m)[rows] - size + 1 - size * most[rows]]
            near[rows] = True
        wide = np.where(near & (np.maximum(n, m) <= MANY), -(-n // 64), 0)
        wide[np.bincount(wide)[wide] < LEAST] = 0
        for k in np.flatnonzero((wide == 0) & ~out & (near | (np.minimum(n, m) == 0))).tolist():
            out[k] = self(p[k], q[k])
        for w in np.unique(wide[wide > 0]).tolist():
            rows = np.flatnonzero(wide == w)
            rows = rows[np.argsort(-m[rows], kind="stable")]
            size = max(1, STEP // (w * 256))
            for at in range(0, len(rows), size):
                k = rows[at : at + size]
                x, y = (np.frombuffer(b"".join([v[i] for i in k.tolist()]), np.uint32) for v in (p, q))
                out[k] = within_many(x, n[k], y, m[k], most[k], w)
        return out


def in_common(p: list[bytes], q: list[bytes], rows: np.ndarray, size: int) -> np.ndarray:
    """How many runs of ``size`` words, 1 or 2, the lines of each pair share, repeated ones counted.

    An edit changes ``size`` runs of a line at most (Ukkonen 1992).  Runs of equal hash count as equal.
    """
    sides = []
    for side, v in enumerate((p, q)):
        some = [v[k] for k in rows.tolist()]
        pair = np.repeat(np.arange(len(rows), dtype=np.uint64), np.fromiter(map(len, some), np.int64, len(some)) // 4)
        x = np.frombuffer(b"".join(some), np.uint32)
        if size == 2:
            same = pair[1:] == pair[:-1]
            x, pair = (x[:-1] * np.uint32(0x9E3779B1) + x[1:])[same], pair[1:][same]
        sides.append(pair << np.uint64(33) | x.astype(np.uint64) << np.uint64(1) | np.uint64(side))
    both = np.sort(np.concatenate(sides))
    if not len(both):
        return np.zeros(len(rows), np.int64)
    run = both >> np.uint64(1)
    start = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    right = np.add.reduceat((both & np.uint64(1)).astype(np.int64), start)
    common = np.minimum(right, np.diff(np.append(start, len(both))) - right)
    return np.bincount((run[start] >> np.uint64(32)).astype(np.int64), common, len(rows)).astype(np.int64)


def within_many(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, most: np.ndarray, wide: int) -> np.ndarray:
    """:func:`within` for many pairs of word sequences, one after the other in ``x`` and ``y``.

    ``n`` and ``m`` are their lengths, none 0, n at most 64 * wide, m descending.  As in
    :func:`within`, a column of the table is two bit vectors; here of 64-bit words, of which
    those of all pairs are worked out together.  Pairs that can't end within ``most`` are dropped.
    """
    out = np.zeros(len(n), bool)
    pair, x_at, y_at = np.arange(len(n)), np.cumsum(n) - n, np.cumsum(m) - m
    x = x[np.minimum(x_at[:, None] + np.arange(64 * wide), len(x) - 1)]  # bits above a line's last have no effect
    top, shift = (n - 1) // 64, ((n - 1) % 64).astype(np.uint64)
    up, down, score = np.full((len(n), wide), tk.NONE), np.zeros((len(n), wide), np.uint64), n.copy()
    one = np.uint64(1)
    for j in range(int(m[0])):
        k = int(np.searchsorted(-m, -j, side="left"))  # whose lines are longer than j
        if k < len(m):
            out[pair[k:]] = score[k:] <= most[k:]
            pair, x, y_at, top, shift, up, down, score, m, most = (v[:k] for v in (pair, x, y_at, top, shift, up, down, score, m, most))
        if j % 4 == 0:
            keep = np.flatnonzero(score - (m - j) <= most)
            if 4 * len(keep) < 3 * k:
                pair, x, y_at, top, shift, up, down, score, m, most = (v[keep] for v in (pair, x, y_at, top, shift, up, down, score, m, most))
        if not len(m):
            return out
        eq = np.packbits(x == y[y_at + j][:, None], axis=1, bitorder="little").view(np.uint64)
        xv, both = eq | down, eq & up
        total = both + up
        carry = np.zeros(len(m), bool)
        for w in range(wide - 1):
            carry = (total[:, w] < both[:, w]) | (carry & (total[:, w] == both[:, w]))
            total[:, w + 1] += carry
        xh = (total ^ up) | eq
        right, left = down | ~(xh | up), up & xh
        row = np.arange(len(m))
        score = score + ((right[row, top] >> shift) & one).astype(np.int64) - ((left[row, top] >> shift) & one).astype(np.int64)
        r, s = right << one, left << one
        r[:, 0] |= one
        if wide > 1:
            r[:, 1:] |= right[:, :-1] >> np.uint64(63)
            s[:, 1:] |= left[:, :-1] >> np.uint64(63)
        up, down = s | ~(xv | r), r & xv
    out[pair] = score <= most
    return out


def numbered(similarity: float):
    """A line's words, repeated ones told apart, and how many of them: lines within the edit similarity have all but the edits in common."""

    def parts(p: bytes) -> tuple[np.ndarray, int]:
        x = np.sort(np.frombuffer(p, np.uint32)).astype(np.uint64)
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        again = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
        return tk.mix(x + (again.astype(np.uint64) << np.uint64(32))), int(edits(len(x), similarity)) + 1

    return parts


def same_row(docs: DataFrame, side: DataFrame) -> F.Column:
    return docs["_doc"].eqNullSafe(side["doc_id"]) & (docs["_body"] == side["body"])


def words_of(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, body): the word hashes of the given classes, read from their first occurrences, once for each text."""
    at = ids.join(classes.select("id", "at"), "id")
    want = cut(at.groupBy("at.doc_id", "at.body").agg(F.collect_list(F.struct("at.line", "id")).alias("want")), "ids")
    sent = broadcast_if(want, want.agg(F.sum(F.size("want"))).first()[0], SENT)
    return docs.join(sent, same_row(docs, sent)).select("want", "_text").mapInArrow(pick_rows, "id long, body binary")


def with_body(docs: DataFrame, text: str) -> DataFrame:
    """(_doc, _body, _text): rows are told apart by their id and a hash of their text."""
    value = F.col(text).cast("string")
    return docs.select(F.col("doc_id").alias("_doc"), F.xxhash64(value).alias("_body"), value.alias("_text")).where("_text is not null")


def repeated(docs: DataFrame, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """(doc_id, body, line) of the lines to remove: all but the first occurrence in each connected group.

    Lines are normalised to their words of letters and digits in lower case; those
    without words are always kept.  Lines of equal words are one class, however
    short; classes are linked when the edit distance of their words is at most
    1 - similarity of the longer one, and their SimHashes share the blocks of a
    table: always if at most 7 of 24 blocks differ, and with a probability of 0.94
    at the very threshold where words are distinct and of one weight.  First is the smallest (doc_id, body, line), ``body``
    being the text's xxhash64 and ``line`` counted from 0.

    Nulls: a null text has no lines; null doc_ids sort first.  Rows of equal doc_id
    and text are one row and lose the same lines; rows of equal doc_id and other
    texts are told apart.  Lines may be of any length.  Other columns are ignored.
    No rows give no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = with_body(docs, text)
    lines = cut(texts.mapInArrow(lambda it: line_rows(it, similarity), ROW.format(kind) + ", line long, hi long, lo long, n long, sketch binary"), "lines", HASHES)
    at = F.struct("doc_id", "body", "line")
    classes = lines.groupBy("hi", "lo").agg(F.min(at).alias("at"), F.count("*").alias("times"), F.first("n").alias("n"), F.max("sketch").alias("sketch"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "classes", HASHES)
    fuzzy = classes.where(F.length("sketch") > 0).select("id", "n", "sketch", F.substring("sketch", 1, 8 * TABLES).alias("keys"))
    links = linked(fuzzy, lambda ids: words_of(texts, classes, ids), alike(similarity), likeness(similarity), numbered(similarity))
    comps = components(links).withColumnRenamed("node", "id")
    of = classes.select("hi", "lo", "id", "at", "times").join(comps, "id", "left")
    # What is linked with nothing and occurs once stays, and needs no more work.
    of = cut(of.where("component IS NOT NULL OR times > 1").withColumn("component", F.coalesce("component", "id")), "groups", HASHES[:2])
    low = of.groupBy("component").agg(F.min("at").alias("keep"), F.sum("times").alias("total")).where("total > 1")
    of = cut(of.join(low, "component").select("hi", "lo", "keep", "times"), "keepers")
    on = ["hi", "lo"]
    # A line of very many occurrences is joined where they are.
    found = hub_join(lines.select(*on, "doc_id", "body", "line"), of.select(*on, "keep").hint("merge"), on, hot_keys(of, on, "times", COMMON))
    return found.where(~at.eqNullSafe(F.col("keep"))).select("doc_id", "body", "line").distinct()


def dedup(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and n_lines, n_removed added; see :func:`repeated`."""
    gone = repeated(docs, text=text, **options).groupBy("doc_id", "body").agg(F.collect_set("line").alias("__lines_gone"))
    gone = cut(gone.withColumnRenamed("doc_id", "__lines_of").withColumnRenamed("body", "__lines_in"), "gone")
    # Much of a corpus repeats: texts and lines meet by one exchange at every size.
    gone = gone.hint("merge")
    parts = F.split(F.col(text), "\n", -1)
    kept = F.filter(parts, lambda _, i: ~F.array_contains("__lines_gone", i.cast("long")))
    own = F.xxhash64(docs[text].cast("string"))
    out = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__lines_of"]) & (own == gone["__lines_in"]), "left")
    return out.select(
        *[c for c in docs.columns if c not in (text, "n_lines", "n_removed")],
        F.when(F.col("__lines_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text),
        F.coalesce(1 + F.octet_length(text) - F.octet_length(F.replace(F.col(text).cast("string"), F.lit("\n"), F.lit(""))), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("__lines_gone").isNull(), 0).otherwise(F.size("__lines_gone")).cast("long").alias("n_removed"),
    )
