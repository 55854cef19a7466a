"""Links between similar items that share a hash key, in work that follows the members of a key.

Classes (equal items, counted once) have a long ``id``, a size ``n``, long
``keys`` of which similar classes share at least one, and a ``sketch`` of longs (both
arrays, or their bytes): from two sketches and sizes a score tells whether a pair may be similar,
and how near it seems.  Keys with few such pairs have them all verified.  Of the
others, first each member is tried against some pivots, which joins a dense group to
one component; then members of different components are dealt by the rarest parts of
their bodies, so many that similar ones share one (prefix filtering), and all their
pairs are verified where they meet, which gives fewer links than members and misses none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanline.llm import textkit as tk
from spanline.llm.common import SENT, broadcast_if, buckets_for, components, cut, drop_scratch

#: Members of a key that meet in one group, on either side; larger keys are dealt to several groups.
BLOCK = 2000
#: Members up to which all pairs of a group are estimated at once.
SMALL = 1000
#: Candidate pairs for each member of a key up to which all of them are verified at once.
FEW = 8
#: Members that all others of a dense group are tried against first.
PIVOTS = 32
#: Pairs of a group that are verified at once.
TRIED = 1000
#: One class in so many is drawn to find the keys to be salted.
DRAWN = 64

#: Slots of the table of how often parts occur, which puts rare ones first; any order finds the same links.
SLOTS = 1 << 16

#: A body's parts, told apart, and how many of them: of two similar bodies, the first so many in any common order share one.
Parts = Callable[[bytes], tuple[np.ndarray, int]]
#: (sketches, sketches, sizes, sizes) to scores, below 0 for what can't be similar.
Score = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


#: Classes whose keys make one bucket of a packed exchange, and keys packed at once.
PACKED, HELD = 50_000, 1 << 19


def longs(column: pa.Array) -> np.ndarray:
    """Arrays of equally many longs, or their bytes, as the rows of a matrix of unsigned numbers."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
        flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(np.uint64) if len(column) else np.zeros(0, np.uint64)
    else:
        flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


class Salts:
    """How many salts each of the hot keys has; other keys have none."""

    def __init__(self, hot: list[tuple[int, int]]):
        self.keys = np.array(sorted(k for k, _ in hot), np.int64)
        self.many = np.array([m for _, m in sorted(hot)], np.uint64)

    def of(self, key: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The salts of members ``i``: from 1 for hot keys, else 0."""
        out = np.zeros(len(key), np.int32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            x = np.flatnonzero(self.keys[at] == key)
            out[x] = 1 + tk.mix(i[x].view(np.uint64) * tk.MULT + key[x].view(np.uint64)) % self.many[at[x]]
        return out


def shared(classes: DataFrame, score: Score | None = None) -> DataFrame:
    """(key, salt, id) of the keys that two classes or more have, in one exchange.

    A score may have ``marks``, a number for each class, and tell by ``meets`` of two
    of them whether the classes may be similar.  Marks then travel along, and members of
    keys that are never dense come out only if a mark of their company allows it.

    Keys and ids travel packed, as many in a row as a task has for one of the buckets
    that they are dealt to.  Keys of which a hash sample of the classes suggests more than
    BLOCK members are dealt to several groups by salts; the sample decides on nothing
    else.  There is one such key in 2 * BLOCK rows at most.
    """
    drawn = classes.where(F.pmod(F.xxhash64("id"), F.lit(DRAWN)) == 0).select("keys").mapInArrow(key_rows, "key long").groupBy("key").agg(F.count("*").alias("drawn"))
    hot = drawn.where(F.col("drawn") * DRAWN > 2 * BLOCK).select("key", F.ceil(F.col("drawn") * DRAWN / BLOCK).alias("salts"))
    salts = Salts([(r.key, r.salts) for r in hot.collect()])
    n = max(buckets_for(classes.sparkSession), -(-classes.count() // PACKED))
    asked = ("id", "keys", "n", "sketch") if hasattr(score, "marks") else ("id", "keys")
    packed = classes.select(*asked).mapInArrow(lambda it: packed_rows(it, n, salts, score), "bucket int, packed binary")
    packed = packed.repartition(n, "bucket").sortWithinPartitions("bucket")
    return cut(packed.mapInArrow(lambda it: shared_rows(it, salts, score), "key long, salt int, id long"), "shared")


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(longs(b.column(0)).reshape(-1).view(np.int64))], names=["key"])


def packed_rows(batches: Iterator[pa.RecordBatch], n: int, salts: Salts, score: Score | None = None) -> Iterator[pa.RecordBatch]:
    """(bucket, packed) of (id, keys) or (id, keys, n, sketch): the keys, ids and marks that go to a bucket, as the bytes of two or three longs each."""
    held: list[np.ndarray] = []
    for b in chain(batches, [None]):
        if b is not None and b.num_rows:
            keys = longs(b.column(1)).view(np.int64)
            own = [b.column(0).to_numpy(zero_copy_only=False)]
            if b.num_columns > 2:
                own.append(score.marks(longs(b.column(3)), b.column(2).to_numpy(zero_copy_only=False)).view(np.int64))
            held.append(np.stack([keys.reshape(-1), *(np.repeat(x, keys.shape[1]) for x in own)], axis=1))
        if not held or (b is not None and sum(map(len, held)) < HELD):
            continue
        both, held = np.concatenate(held), []
        salt = salts.of(both[:, 0].copy(), both[:, 1].copy())
        bucket = (tk.mix(both[:, 0].view(np.uint64) * tk.MULT + salt.astype(np.uint64)) % np.uint64(n)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        both, bucket = both[order], bucket[order]
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(start, len(both)).astype(np.int64) * both.shape[1] * 8
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(both)])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[start]), packed.cast(pa.binary())], names=["bucket", "packed"])


def shared_rows(batches: Iterator[pa.RecordBatch], salts: Salts, score: Score | None = None) -> Iterator[pa.RecordBatch]:
    """(key, salt, id) of packed rows sorted by bucket: those that have company, and all of salted keys."""
    width = 3 if hasattr(score, "marks") else 2
    last, held = -1, []
    for bucket, packed in chain((x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), [(None, b"")]):
        if bucket != last and held:
            key, i, *mark = (x.copy() for x in np.frombuffer(b"".join(held), np.int64).reshape(-1, width).T)
            held = []
            salt = salts.of(key, i)
            order = np.lexsort((salt, key)) if salt.any() else np.argsort(key)
            key, salt, i = key[order], salt[order], i[order]
            same = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])
            take = np.flatnonzero(np.append(False, same) | np.append(same, False) | (salt > 0))
            if mark:
                take = take[paired(key[take], salt[take], mark[0][order[take]].view(np.uint64), score)]
            yield pa.RecordBatch.from_arrays([pa.array(x[take]) for x in (key, salt, i)], names=["key", "salt", "id"])
        last = bucket
        held.append(packed)


def paired(key: np.ndarray, salt: np.ndarray, mark: np.ndarray, score: Score) -> np.ndarray:
    """Which members of sorted keys some other one may be similar to, by their marks; all of salted keys, and of those large enough to be dense."""
    start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    end = np.repeat(start + size, size)
    out = np.repeat(size > 2 * FEW + 1, size) | (salt > 0)
    live, step = np.flatnonzero(~out), 1
    while len(live := live[live + step < end[live]]):
        x = live[score.meets(mark[live], mark[live + step])]
        out[x] = out[x + step] = True
        step += 1
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted rows, cut only where the first ``by`` columns change; the last is an array."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [longs(c) if i == b.num_columns - 1 else c.to_numpy(zero_copy_only=False) for i, c in enumerate(b.columns)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:by]], axis=0)) + 1
        if held and any(h[-1] != c[0] for h, c in zip(held[-1][:by], cols[:by], strict=True)):
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        if len(new):
            yield [np.concatenate(x) for x in zip(*held, [c[: new[-1]] for c in cols], strict=True)]
            held, cols = [], [c[new[-1] :] for c in cols]
        held.append(cols)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def pair_batch(a: np.ndarray, b: np.ndarray, hard: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    pad = len(hard)
    return pa.RecordBatch.from_arrays(
        [*(pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(pad, pa.int64())]) for x in both), pa.concat_arrays([pa.nulls(both.shape[1], pa.int64()), pa.array(hard, pa.int64())])],
        names=["a", "b", "hard"],
    )


def first_rows(batches: Iterator[pa.RecordBatch], score: Score) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b), and the ``hard`` keys of which some pairs are left: dense ones give pairs with pivots only, salted ones none between salts.

    One pass for each distance within a group compares all small groups at once.
    """
    for key, salt, i, n, sk in whole_groups(batches, 2):
        new = np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))
        start, run = np.flatnonzero(new), np.cumsum(new) - 1
        size = np.diff(np.append(start, len(key)))
        end = (start + size)[run]
        pairs = np.where(size > SMALL, FEW * size + 1, 0)
        found, live, step = [], np.arange(len(key)), 1
        while True:
            live = live[(live + step < end[live]) & (pairs <= FEW * size)[run[live]]]
            if not len(live):
                break
            x = live[may(score, sk, n, live, live + step)]
            pairs += np.bincount(run[x], minlength=len(start))
            found.append(np.stack([x, x + step]))
            step += 1
        hard = pairs > FEW * size
        x, y = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        x, y = [x[~hard[run[x]]]], [y[~hard[run[y]]]]
        for g in np.flatnonzero(hard):
            rows = np.arange(start[g], start[g] + size[g])
            pivot = rows[np.unique(np.linspace(0, size[g] - 1, PIVOTS).astype(np.int64))]
            e = score(sk[rows][:, None], sk[pivot][None], n[rows][:, None], n[pivot][None])
            e = np.where(rows[:, None] != pivot[None], e, -1.0)
            ok = e >= 0
            hub = int(ok.sum(axis=0).argmax())
            for take, to in ((ok.any(axis=1), pivot[e.argmax(axis=1)]), (ok[:, hub], np.full(len(rows), pivot[hub]))):
                x.append(rows[take])
                y.append(to[take])
        yield pair_batch(i[np.concatenate(x)], i[np.concatenate(y)], np.unique(key[start[hard | (salt[start] > 0)]]))


def may(score: Score, sk: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether rows ``p`` may be similar to rows ``q``; a score that can tell without being worked out has a ``may`` of its own."""
    own = getattr(score, "may", None)
    return own(sk, n, p, q) if own else score(sk[p], sk[q], n[p], n[q]) >= 0


def agreed(same: Callable[[bytes, bytes], bool], p: list, q: list) -> np.ndarray:
    """Which of the bodies ``p`` and ``q`` are similar; ``same`` may have a ``many`` that tells it for all at once."""
    many = getattr(same, "many", None)
    return many(p, q) if many else np.fromiter(map(same, p, q), bool, len(p))


def slots(tokens: np.ndarray) -> np.ndarray:
    return (tk.mix(tokens) % np.uint64(SLOTS)).astype(np.int64)


def count_rows(batches: Iterator[pa.RecordBatch], parts: Parts) -> Iterator[pa.RecordBatch]:
    """(slot, times): how many parts of the bodies (id, body) fall into each slot."""
    times = np.zeros(SLOTS, np.int64)
    for b in batches:
        if b.num_rows:
            times += np.bincount(slots(np.concatenate([parts(body.as_buffer())[0] for body in b.column(1)])), minlength=SLOTS)
    some = np.flatnonzero(times)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(times[some])], names=["slot", "times"])


def rare_rows(batches: Iterator[pa.RecordBatch], parts: Parts, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(sub, id, comp) of (id, comp, body): the rarest parts of each body, as many as similar ones share one of."""
    for b in batches:
        subs = []
        for body in b.column(2):
            tokens, most = parts(body.as_buffer())
            subs.append(tokens[np.lexsort((tokens, times[slots(tokens)]))[:most]].view(np.int64))
        if subs:
            at = pa.array(np.repeat(np.arange(len(subs)), [len(x) for x in subs]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(subs)), b.column(0).take(at), b.column(1).take(at)], names=["sub", "id", "comp"])


class Sets:
    """Disjoint sets of numbers below n."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i


def cross_rows(batches: Iterator[pa.RecordBatch], score: Score, same: Callable[[bytes, bytes], bool]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) between components within groups (sub, x, y), of side x with side y.

    Each pair that may be similar is verified here, unless links found before it
    have joined the two already: a group gives fewer links than it has members.
    """
    for sub, x, y, own, i, comp, n, body, sk in whole_groups(batches, 3):
        start = np.flatnonzero(np.append(True, (sub[1:] != sub[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        size = np.diff(np.append(start, len(sub)))
        end = np.repeat(start + size, size)
        of = np.unique(comp, return_inverse=True)[1].tolist()
        sets = Sets(max(of) + 1)
        u, v = [], []

        wait: list[np.ndarray] = []

        def verify(p: np.ndarray, q: np.ndarray, least: int = TRIED) -> None:
            """Pairs wait until there are enough to be verified at once."""
            wait.append(np.stack([p, q]))
            if sum(x.shape[1] for x in wait) < least:
                return
            pairs = np.concatenate(wait, axis=1).T
            wait.clear()
            for at in range(0, len(pairs), TRIED):
                some = [(a, b) for a, b in pairs[at : at + TRIED].tolist() if sets.find(of[a]) != sets.find(of[b])]
                if not some:
                    continue
                left, right = zip(*some, strict=True)
                for k in np.flatnonzero(agreed(same, body[list(left)].tolist(), body[list(right)].tolist())).tolist():
                    s, t = sets.find(of[left[k]]), sets.find(of[right[k]])
                    if s != t:
                        sets.up[max(s, t)] = min(s, t)
                        u.append(i[left[k]])
                        v.append(i[right[k]])

        live, step = np.flatnonzero(np.repeat(size <= SMALL, size)), 1
        while len(live := live[live + step < end[live]]):  # all small groups at once, one pass for each distance
            p = live[(comp[live] != comp[live + step]) & ((x[live] == y[live]) | (own[live] != own[live + step]))]
            p = p[may(score, sk, n, p, p + step)]
            verify(p, p + step)
            step += 1
        for g in np.flatnonzero(size > SMALL):
            rows = np.arange(start[g], start[g] + size[g])
            left, right = (rows[own[rows] == side[start[g]]] for side in (x, y))
            width = max(1, (1 << 20) // max(1, len(right) * sk.shape[1]))
            for at in range(0, len(left), width):
                p = left[at : at + width]
                ok = comp[p][:, None] != comp[right][None]
                if x[start[g]] == y[start[g]]:
                    ok &= p[:, None] < right[None]
                a, b = np.nonzero(ok)
                a, b = p[a], right[b]
                near = may(score, sk, n, a, b)
                verify(a[near], b[near])
        verify(np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def check_rows(batches: Iterator[pa.RecordBatch], same: Callable[[bytes, bytes], bool]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = agreed(same, b.column(2).to_pylist(), b.column(3).to_pylist())
        yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))


LINKS = "u long, v long"


def verified(pairs: DataFrame, bodies: Callable[[DataFrame], DataFrame], same: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The true ones of the pairs (a, b), as (u, v)."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    body = cut(bodies(broadcast_if(ids, ids.count(), SENT)), "bodies")
    side = lambda c: body.select(F.col("id").alias(c), F.col("body").alias(f"body_{c}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "body_a", "body_b")
    out = cut(full.select(F.col("a").alias("u"), F.col("b").alias("v"), "body_a", "body_b").mapInArrow(lambda it: check_rows(it, same), LINKS), "links")
    for used in (ids, body):
        drop_scratch(used)
    return out


def first_pairs(meet: DataFrame, classes: DataFrame, score: Score) -> DataFrame:
    rows = meet.join(classes.select("id", "n", "sketch"), "id").select("key", "salt", "id", "n", "sketch")
    rows = rows.repartition("key", "salt").sortWithinPartitions("key", "salt")
    return rows.mapInArrow(lambda it: first_rows(it, score), "a long, b long, hard long").distinct()


def rest_links(meet: DataFrame, hard: DataFrame, classes: DataFrame, comps: DataFrame, bodies, score: Score, same, parts: Parts) -> DataFrame:
    """Links of different components among the members of hard keys: all that there are.

    Similar bodies share one of their rarest parts, by which they are dealt.  The
    largest component of a part is compared with the rest of it only, so that one
    dense group and a few others cost as much as there are members.
    """
    comps = comps.select(F.col("node").alias("id"), "component")
    mem = cut(meet.select("key", "id").join(hard, "key").join(comps, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp")), "members")
    mixed = mem.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    ids = cut(mem.join(mixed, "key").select("id", "comp").distinct(), "ids")
    n_ids = ids.count()
    body = cut(bodies(broadcast_if(ids.select("id"), n_ids, SENT)), "bodies")
    counted = body.mapInArrow(lambda it: count_rows(it, parts), "slot long, times long").groupBy("slot").agg(F.sum("times").alias("times"))
    times = np.zeros(SLOTS, np.int64)
    for slot, n in counted.collect():  # SLOTS at most
        times[slot] = n
    rows = cut(body.join(ids, "id").select("id", "comp", "body").mapInArrow(lambda it: rare_rows(it, parts, times), "sub long, id long, comp long"), "finer")
    per = rows.groupBy("sub", "comp").agg(F.count("*").alias("members"))
    top = per.groupBy("sub").agg(F.max("members").alias("top"), F.max_by("comp", "members").alias("top_comp"), F.sum("members").alias("all")).where("all > top")
    tops, rests = F.ceil(F.col("top") / BLOCK), F.ceil((F.col("all") - F.col("top")) / BLOCK)
    dealt = rows.join(top, "sub").withColumn("tops", tops).withColumn("rests", rests).withColumn("is_top", F.col("comp") == F.col("top_comp"))
    deal = F.xxhash64("id", "sub")
    dealt = dealt.withColumn("own", F.when(F.col("is_top"), -1 - F.pmod(deal, F.col("tops"))).otherwise(F.pmod(deal, F.col("rests"))))
    others = F.sequence(F.when(F.col("is_top"), F.lit(0).cast("long")).otherwise(-F.col("tops")), F.col("rests") - 1)
    dealt = dealt.select("sub", "own", "id", "comp", F.explode(others).alias("other"))
    dealt = cut(dealt.select("sub", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "comp"), "dealt")
    full = classes.select("id", "n", "sketch").join(broadcast_if(ids.select("id"), n_ids, SENT), "id").join(body, "id")
    full = dealt.join(full, "id").select("sub", "x", "y", "own", "id", "comp", "n", "body", "sketch")
    full = full.repartition("sub", "x", "y").sortWithinPartitions("sub", "x", "y")
    out = cut(full.mapInArrow(lambda it: cross_rows(it, score, same), LINKS).distinct(), "links")
    for used in (mem, ids, body, rows, dealt):
        drop_scratch(used)
    return out


def linked(classes: DataFrame, bodies: Callable[[DataFrame], DataFrame], same: Callable[[bytes, bytes], bool], score: Score, parts: Parts) -> DataFrame:
    """(u, v): links of which the components are those of all links between classes that share a key.

    ``bodies`` gives (id, body) for a table of ids; two classes are linked if
    ``same`` holds for their bodies.  ``score`` is asked before; ``parts`` are what
    the members of dense and of salted keys meet by.
    """
    meet = shared(classes, score)
    first = cut(first_pairs(meet, classes, score), "pairs")
    links = verified(first.where("hard IS NULL").select("a", "b"), bodies, same)
    hard = cut(first.where("hard IS NOT NULL").select(F.col("hard").alias("key")).distinct(), "hard")
    n_hard = hard.count()
    if n_hard:
        comps = cut(components(links), "components")
        stars = comps.select(F.col("node").alias("u"), F.col("component").alias("v")).where("u <> v")
        rest = rest_links(meet, broadcast_if(hard, n_hard, SENT), classes, comps, bodies, score, same, parts)
        links = cut(stars.unionByName(rest), "links")  # what is joined already needs no more links than members
        drop_scratch(comps)
    for used in (meet, first, hard):
        drop_scratch(used)
    return links
