"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanline.llm.buckets import longs
from spanline.llm.common import buckets_for, components, cut

#: Share of vectors turned to the threshold that must meet, which sets the number of tables.
MEET = 0.9998
#: Turned vectors that the tables are tried on.
TURNED = 10_000
#: Rotations, of 64 bits each.
ROTATIONS = 4
#: Bits in which candidates may differ at least, in the first code and in all of them.
RADIUS, WIDE = 20, 60
#: Most tables of either kind; where they don't do, their parts are made narrower.
TABLES = 96
#: Codes that meet in one cell; larger cells are dealt as pairs of blocks.
CELL = 1 << 19
#: Codes of a cell up to which all pairs are tried, of many cells or of one at once.
SMALL, TRIED = 512, 1 << 14
#: The same of codes that have a candidate each, of which dense groups would meet in table after table.
RETRIED = 1 << 16
#: Components of vectors that meet in one cell, and of those that are compared at once.
HELD, COMPARED = 1 << 22, 1 << 20
#: Pairs that are gathered before more is asked of them.
AT_ONCE = 1 << 16
#: Rows for each partition of an exchange of cells.
ROWS = 100_000


class Codes:
    """Rotations learned by iterative quantisation, the codes they give, and the tables over these.

    Each rotation is learned from another start.  A table is a part (rotation, mask)
    of a code, in which near vectors agree.  ``cells`` are the few, narrow ones by
    which labels too large for a task are dealt, ``tables`` those that are looked up
    within a cell: their parts are as wide as the largest cell asks for, so that what
    meets by chance doesn't follow its size.  Of sample vectors, turned to the
    threshold at random or towards each other, a share of MEET meets itself in one of
    each; parts of no bits, in which all meet, are the last resort.
    """

    def __init__(self, sample: np.ndarray, least: float, largest: int, seed: int = 0):
        unit = scaled(sample)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        self.dim, self.seed = sample.shape[1], seed
        self.bits = min(64, self.dim)
        self.mean = unit.mean(axis=0)
        _, vec = np.linalg.eigh((unit - self.mean).T @ (unit - self.mean) / len(unit))
        self.base = vec[:, ::-1][:, : self.bits]
        self.maps, self.middles, self.random = [], [], {}
        for r in range(ROTATIONS):
            self._learn(unit, seed + r)
        rng = np.random.default_rng(seed)
        some = unit[np.arange(TURNED) % len(unit)]
        turn = rng.normal(size=some.shape)
        turn[::2] = unit[rng.integers(0, len(unit), len(turn[::2]))]
        turn -= (turn * some).sum(axis=1, keepdims=True) * some
        length = np.linalg.norm(turn, axis=1, keepdims=True)
        turned = least * some + np.sqrt(1 - least * least) * turn / np.maximum(length, 1e-12)
        turned = np.where(length > 1e-6, turned, some)
        diff = self(some) ^ self(turned)
        flips = np.bitwise_count(diff)
        self.limits = max(RADIUS, reach(flips[:, 0])), max(WIDE, reach(flips.sum(axis=1)))
        everyone = np.ones(len(diff), bool)
        self.cells, dealt = self._tables(diff, everyone, (max(largest - 1, 0) // CELL).bit_length(), (1 + MEET) / 2)
        self.tables, _ = self._tables(diff, dealt, max(min(largest, CELL).bit_length() - 4, 0), MEET)

    def _learn(self, unit: np.ndarray, seed: int, rounds: int = 30) -> None:
        v = (unit - self.mean) @ self.base
        rot, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.bits, self.bits)))
        for _ in range(rounds):  # the rotation that brings the projections nearest to their signs
            u, _, w = np.linalg.svd(np.where(v @ rot >= 0, 1.0, -1.0).T @ v)
            rot = (u @ w).T
        self.maps.append(self.base @ rot)
        self.middles.append(np.median(v @ rot, axis=0))  # balanced: each bit splits the sample in half

    def _tables(self, diff: np.ndarray, among: np.ndarray, width: int, enough: float) -> tuple[list[tuple[int, np.uint64]], np.ndarray]:
        """Tables of so many bits drawn at random, and which of the differences they miss no more of than asked for."""
        rng = np.random.default_rng(self.seed)
        width = min(width, self.bits)
        while True:
            tables, spare, met = [], [np.zeros(0, np.int64)] * ROTATIONS, np.zeros(len(diff), bool)
            while (met & among).mean() < min(enough, among.mean()) and len(tables) < (TABLES if width else 1):
                r = len(tables) % ROTATIONS
                if len(spare[r]) < width:
                    spare[r] = rng.permutation(self.bits)
                own, spare[r] = spare[r][:width], spare[r][width:]
                tables.append((r, np.uint64(sum(1 << (63 - int(b)) for b in own))))
                met |= diff[:, r] & tables[-1][1] == 0
            if (met & among).mean() >= min(enough, among.mean()):
                return tables, met & among
            width -= 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """One column of codes for each rotation; vectors of other lengths have codes of random planes."""
        d = x.shape[1]
        if d != self.dim and d not in self.random:
            planes = np.random.default_rng([self.seed, d]).normal(size=(ROTATIONS, d, 64))
            self.random[d] = [np.linalg.qr(p)[0] if d >= 64 else p for p in planes]
        x = scaled(x)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        codes = []
        for r in range(ROTATIONS):
            out = np.zeros((len(unit), 64), np.uint8)
            if d == self.dim:
                out[:, : self.bits] = (unit - self.mean) @ self.maps[r] > self.middles[r]
            else:
                out[:] = unit @ self.random[d][r] > 0
            codes.append(np.packbits(out, axis=1).view(">u8").astype(np.uint64).ravel())
        return np.stack(codes, axis=1)


def scaled(x: np.ndarray) -> np.ndarray:
    return x / np.abs(x).max(axis=1, keepdims=True)


def reach(flips: np.ndarray) -> int:
    """Bits that next to no pair at the threshold exceeds."""
    return int(max(flips.max(), np.ceil(flips.mean() + 5 * flips.std())))


def valid(vector: str) -> F.Column:
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(v, lambda x: x != 0)


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows, cut only where the first column changes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cell = b.column(0).to_numpy()
        other = np.flatnonzero(cell != cell[-1])
        at = int(other[-1]) + 1 if len(other) else 0
        if at:
            yield pa.Table.from_batches([*held, b.slice(0, at)])
            held = []
        elif held and held[-1].column(0)[-1].as_py() != cell[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def runs(key: np.ndarray, one: np.ndarray, done: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, bits): pairs of places with equal, sorted keys, and the bits in which their codes ``one`` differ.

    One pass for each distance compares all runs at once.  Of pairs of ``done`` places,
    which come last in their runs, there are none.
    """
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
    size = np.diff(np.append(start, len(key)))
    end = np.repeat(start + size, size)
    live, step = np.arange(len(key)) if done is None else np.flatnonzero(~done), 1
    while len(live := live[live + step < end[live]]):
        yield live, live + step, np.bitwise_count(one[live] ^ one[live + step])
        step += 1


def everything(one: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As :func:`runs`, of all places."""
    places = np.arange(len(one))
    for step in range(1, len(one)):
        yield places[:-step], places[step:], np.bitwise_count(one[:-step] ^ one[step:])


def gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Many at once, the pairs that differ in no more bits than ``limit``."""
    held, many = [], 0
    for x, y, bits in pairs:
        at = np.flatnonzero(bits <= limit)
        if len(at):
            held.append((x[at], y[at]))
            many += len(at)
        if many >= AT_ONCE:
            yield tuple(np.concatenate(z) for z in zip(*held, strict=True))
            held, many = [], 0
    if held:
        yield tuple(np.concatenate(z) for z in zip(*held, strict=True))


def meeting(own: Codes, place: np.ndarray, side: np.ndarray, t: np.ndarray, codes: np.ndarray, marked: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, sorted by place, that may be near, from the first cell and table where they meet only.

    Where rows are just to be ``marked``, by who asks, pairs may come from any table, and
    none of rows marked in an earlier one.
    """
    code = [np.ascontiguousarray(c) for c in codes.T]

    def kept(x: np.ndarray, y: np.ndarray, tables: list[tuple[int, np.uint64]]) -> tuple[np.ndarray, np.ndarray]:
        ok = (side[x] == 0) | (side[x] != side[y])
        x, y = x[ok], y[ok]
        for i, (r, mask) in enumerate([*own.cells[:-1], *tables]):
            ok = (code[r][x] ^ code[r][y]) & mask != 0
            if i < len(own.cells) - 1:
                ok |= t[x] <= i
            x, y = x[ok], y[ok]
        ok = sum(np.bitwise_count(c[x] ^ c[y]).astype(np.int64) for c in code) <= own.limits[1]
        return x[ok], y[ok]

    start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    size = np.diff(np.append(start, len(place)))
    few = np.flatnonzero(np.repeat(size <= SMALL, size))
    for x, y in gathered(runs(place[few], code[0][few]), own.limits[0]):
        yield kept(few[x], few[y], [])
    for lo, n in zip(start[size > SMALL], size[size > SMALL], strict=True):
        if n <= (RETRIED if marked is None else TRIED):
            for x, y in gathered(everything(code[0][lo : lo + n]), own.limits[0]):
                yield kept(lo + x, lo + y, [])
            continue
        for i, (r, mask) in enumerate(own.tables):
            key = code[r][lo : lo + n] & mask
            if marked is not None:  # they come last in their runs, by the lowest bit that the table leaves
                key |= marked[lo : lo + n] * np.uint64(~int(mask) & int(mask) + 1)
            order = np.argsort(key)
            rows = lo + order
            done = None if marked is None else marked[rows]
            for x, y in gathered(runs(key[order] & mask, code[0][rows], done), own.limits[0]):
                yield kept(rows[x], rows[y], own.tables[:i] if marked is None else [])


def dealt(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with the place where they are compared, and their side there, in the order of places.

    Cells of more than twice ``most`` rows are parted into blocks, of which any two meet;
    rows of other sides are compared then.
    """
    many = rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 2 * most)
    many = cut(many.select("cell", F.ceil(F.col("n") / most).cast("int").alias("blocks")), "large")
    if many.isEmpty():
        placed = rows.withColumn("place", F.col("cell")).withColumn("side", F.lit(0))
    else:
        own, other = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.col("other")
        placed = rows.join(F.broadcast(many), "cell", "left").withColumn("own", own)
        placed = placed.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
        placed = placed.withColumn("place", F.when(other < 0, F.col("cell")).otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))))
        placed = placed.withColumn("side", F.when((other < 0) | (F.col("own") == other), 0).when(F.col("own") < other, 1).otherwise(2))
    n = max(buckets_for(rows.sparkSession), -(-rows.count() // ROWS))
    return placed.repartition(n, "place").sortWithinPartitions("place")


def candidates(vectors: DataFrame, least: float, sample_rows: int, key: str, vector: str, group: str):
    """(classes, placed, codes): classes of equal (group, vector), those that may be near another, placed where they meet, and the broadcast :class:`Codes`.

    Codes alone are compared first, so that vectors travel only where they are needed.
    """
    rows = vectors.where(F.col(group).isNotNull() & valid(vector)).select(
        F.col(key).alias("key"), F.col(group).cast("string").alias("label"), F.transform(vector, lambda x: x.cast("double") + F.lit(0.0)).alias("vec")
    )
    classes = rows.groupBy("label", "vec").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    cls = F.concat(F.hex(F.xxhash64("label", "vec")), F.hex(F.xxhash64(F.lit(7), "vec", "label")))
    classes = cut(classes.withColumn("cls", cls).withColumn("id", F.monotonically_increasing_id()), "classes")
    size = classes.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return classes, None, None
    # Hashes so small that some four times as many are below: each task sorts its own, and all of them meet in one.
    bound = min((1 << 63) - 1, int((1 << 64) * 4 * sample_rows / size["count"]) - (1 << 63))
    hashed = classes.where(F.size("vec") == size["d"]).select("vec", "cls", F.xxhash64("cls").alias("h")).where(F.col("h") <= bound)
    drawn = hashed.orderBy("h", "cls").limit(sample_rows).select("vec").toArrow()
    sample = np.array(drawn.column("vec").to_pylist(), dtype=np.float64)
    largest, longest = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).agg(F.max("n"), F.max("d")).first()
    fitted = Codes(sample, least, largest)
    codes = classes.sparkSession.sparkContext.broadcast(fitted)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codes.value
        for b in batches:
            out = np.zeros((b.num_rows, ROTATIONS), np.uint64)
            lens = b.column(2).value_lengths().to_numpy()
            for d in np.unique(lens):
                at = np.flatnonzero(lens == d)
                out[at] = own(b.column(2).take(pa.array(at)).flatten().to_numpy().reshape(len(at), d))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lens.astype(np.int32)), lists(out)], names=["id", "label", "d", "codes"])

    coded = cut(classes.select("id", "label", "vec").mapInArrow(encode, "id long, label string, d int, codes array<long>"), "codes")
    cells = F.array(*[F.xxhash64("label", "d", F.lit(t), F.get("codes", F.lit(r)).bitwiseAND(F.lit(int(mask.view(np.int64))))) for t, (r, mask) in enumerate(fitted.cells)])
    probes = coded.select("id", "codes", F.posexplode(cells).alias("t", "cell"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches):
            place, side, t = (rows.column(c).to_numpy() for c in ("place", "side", "t"))
            code, marked = longs(rows.column("codes").combine_chunks()), np.zeros(rows.num_rows, bool)
            for x, y in meeting(codes.value, place, side, t, code, marked):
                marked[x] = marked[y] = True
            yield from rows.select(["cell", "id", "t", "codes"]).filter(pa.array(marked)).to_batches()

    found = dealt(probes, CELL).select("place", "side", "t", "cell", "id", "codes").mapInArrow(near, "cell long, id long, t int, codes array<long>")
    found = cut(found.dropDuplicates(["cell", "id"]), "near")
    placed = dealt(found.join(classes.select("id", F.xxhash64(F.lit(7), "label").alias("tag"), "copies", "vec"), "id"), max(SMALL, HELD // longest))
    return classes, placed.select("place", "side", "t", "id", "codes", "tag", "copies", "vec"), codes


def lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix of unsigned numbers as arrays of longs."""
    ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()))


def reranked(own: Codes, rows: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, cosine) of the rows that are near, each pair once."""
    place, side, t, tag = (rows.column(c).to_numpy() for c in ("place", "side", "t", "tag"))
    vec = rows.column("vec").combine_chunks()
    lens, at, own_rows = vec.value_lengths().to_numpy(), np.zeros(len(vec), np.int64), {}
    for d in np.unique(lens):
        of = np.flatnonzero(lens == d)
        x = scaled(vec.take(pa.array(of)).flatten().to_numpy().reshape(len(of), d))
        at[of], own_rows[d] = np.arange(len(of)), (x, (x * x).sum(axis=1))
    for x, y in meeting(own, place, side, t, longs(rows.column("codes").combine_chunks())):
        for d, (v, norm) in own_rows.items():
            same = np.flatnonzero((lens[x] == d) & (lens[y] == d) & (tag[x] == tag[y]))
            for part in np.array_split(same, -(-len(same) * int(d) // COMPARED) or 1):
                p, q = at[x[part]], at[y[part]]
                cosine = (v[p] * v[q]).sum(axis=1) / np.sqrt(norm[p] * norm[q])
                ok = cosine >= least
                yield x[part[ok]], y[part[ok]], cosine[ok]


def linked(vectors: DataFrame, least: float = 0.93, sample_rows: int = 20_000, key: str = "vec_id", vector: str = "embedding", group: str = "label"):
    """(classes, links): classes of equal (group, vector), and links (u, v, cosine) between their ids.

    Rotations are fitted on at most ``sample_rows`` vectors of the most frequent
    length, those whose classes have the smallest hashes; every vector is indexed.
    Vectors of other lengths are compared by the same tables over signs of their
    projections on random directions.
    """
    classes, placed, codes = candidates(vectors, least, sample_rows, key, vector, group)
    if placed is None:
        return classes, classes.sparkSession.createDataFrame([], "u long, v long, cosine double")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches):
            i = rows.column("id").to_numpy()
            for x, y, cosine in reranked(codes.value, rows, least):
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in (np.minimum(i[x], i[y]), np.maximum(i[x], i[y]), cosine)], names=["u", "v", "cosine"])

    return classes, placed.mapInArrow(links, "u long, v long, cosine double")


def summed(vectors: DataFrame, least: float = 0.93, sample_rows: int = 20_000, key: str = "vec_id", vector: str = "embedding", group: str = "label"):
    """(classes, sums): as :func:`linked`, but sums (u, v, others) of the links that a class u has in one place.

    ``others`` counts the rows of the classes linked with u, and v is one that can be
    reached, so a dense group gives as many rows as members and not as links.
    """
    classes, placed, codes = candidates(vectors, least, sample_rows, key, vector, group)
    if placed is None:
        return classes, classes.sparkSession.createDataFrame([], "u long, v long, others long")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches):
            i, copies = rows.column("id").to_numpy(), rows.column("copies").to_numpy()
            others, root = np.zeros(len(i), np.int64), np.arange(len(i))
            for x, y, _ in reranked(codes.value, rows, least):
                np.add.at(others, x, copies[y])
                np.add.at(others, y, copies[x])
                root = joined(root, x, y)
            u = np.flatnonzero(others)
            yield pa.RecordBatch.from_arrays([pa.array(z) for z in (i[u], i[root[u]], others[u])], names=["u", "v", "others"])

    return classes, placed.mapInArrow(sums, "u long, v long, others long")


def joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first row that each row is joined to, directly or not, after ``x`` have been linked with ``y``."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def groups(vectors: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", group: str = "label", **options) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors are compared within equal, non-null labels by cosine in double
    precision.  Those that are null, zero, or hold null or non-finite components
    link with nothing.  Equal vectors of one label are a class: n_links counts its
    other copies and the members of all linked classes, and component_id is the
    smallest key reachable, without expanding copies to pairs.  Repeated keys get
    the result of each row's own vector.  No rows give no rows; extra columns are
    ignored.
    """
    classes, sums = summed(vectors, least, key=key, vector=vector, group=group, **options)
    sums = cut(sums, "sums")
    counts = sums.groupBy("u").agg(F.sum("others").alias("others"))
    comps = components(sums.select("u", "v"))
    of = (
        classes.select("id", "cls", "rep", "copies")
        .join(counts.withColumnRenamed("u", "id"), "id", "left")
        .join(comps.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    low = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = of.join(low, "component").select("cls", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    vec = F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))
    label = F.col(group).cast("string")
    cls = F.concat(F.hex(F.xxhash64(label, vec)), F.hex(F.xxhash64(F.lit(7), vec, label)))
    rows = vectors.select(F.col(key).alias("vec_id"), F.when(F.col(group).isNotNull() & valid(vector), cls).alias("cls"))
    out = rows.join(of, "cls", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
