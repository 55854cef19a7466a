"""Line deduplication against a brute force on edit similarity alone, and its edge cases."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa

from spanline.llm import buckets, lines

DATA = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(line):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), line.encode()))


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def near_pairs(keys, similarity=0.8):
    """All pairs of word sequences within the edit similarity.

    A pair within k edits shares all but k words, so one of the k + 1 rarest of each.
    """
    number = {w: i for i, (w, _) in enumerate(sorted(Counter(w for k in keys for w in set(k)).items(), key=lambda x: (x[1], x[0])))}
    coded = [np.array([number[w] for w in k], np.uint64) for k in keys]
    at = {}
    for i, k in enumerate(coded):
        most = int((1 - similarity) * (len(k) / similarity) + 1e-9)
        for w in np.unique(k)[: most + 1].tolist():
            at.setdefault(w, []).append(i)
    tried, out = set(), []
    for group in at.values():
        for a in range(len(group)):
            for b in range(a):
                pair = (group[b], group[a])
                x, y = coded[pair[0]], coded[pair[1]]
                long = max(len(x), len(y))
                most = int((1 - similarity) * long + 1e-9)
                if pair in tried or long - min(len(x), len(y)) > most:
                    continue
                tried.add(pair)
                if lines.within(x, y, most):
                    out.append(pair)
    return out


def brute(rows, similarity=0.8):
    """{(doc_id, line)} to remove, from (doc_id, text)."""
    occ = {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            w = tuple(words_of(line))
            if w:
                occ.setdefault(w, []).append((d, i))
    keys = list(occ)
    up = list(range(len(keys)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in near_pairs(keys, similarity):
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    groups = {}
    for i, w in enumerate(keys):
        groups.setdefault(find(i), []).extend(occ[w])
    return {o for g in groups.values() for o in sorted(g)[1:]}


def removed(spark, rows):
    got = lines.repeated(spark.createDataFrame(rows, "doc_id long, text string"))
    return {(r.doc_id, r.line) for r in got.collect()}


def test_recall_on_documents(spark):
    """Nothing is removed that brute force keeps, and at least 0.98 of what it removes."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got, want = removed(spark, rows), brute(rows)
    assert got <= want and len(got) >= 0.98 * len(want)


def test_recall_at_the_threshold(spark):
    """Pairs with as many substituted words as are allowed: the least likely to meet."""
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(400):
        base = [f"v{w}" for w in rng.integers(0, 3000, rng.integers(5, 60))]
        new = list(base)
        for at in rng.choice(len(base), len(base) // 5, replace=False):
            new[at] = f"u{rng.integers(0, 3000)}"
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(new))]
    got, want = removed(spark, rows), brute(rows)
    assert len(want) >= 390 and got <= want and len(got) >= 0.9 * len(want)


def dense_rows():
    """Lines near to many others but not to all, and lines in a word each."""
    long = [f"word{i}" for i in range(80)]
    rows = []
    for i in range(260):
        new = list(long)
        for j in range(8):
            new[(i * 7 + j * 11) % 80] = f"x{i % 13}-{j}"
        rows.append((9000 + i, " ".join(new)))
    rows += [(20_000 + i, " ".join(["all", "of", "these", "words", "are", "shared", "by", "many", "lines", f"n{i}"])) for i in range(200)]
    return rows


def test_dense_groups(spark, monkeypatch):
    """Hard keys: pivots first, then finer keys; groups of more than a block are dealt to several."""
    rows = dense_rows()
    want = brute(rows)
    for block in (2000, 60):
        monkeypatch.setattr(buckets, "BLOCK", block)
        got = removed(spark, rows)
        assert got <= want and len(got) >= 0.98 * len(want)


def test_edges(spark):
    same = "one two three four five six"
    rows = [
        (1, None, "a"),
        (2, "", "b"),
        (3, same + "\n" + same, "c"),
        (4, "short line\nshort line\n\n\n--", "d"),
        (5, same.upper() + "!\n\nown", "e"),
        (5, same.upper() + "!\n\nown", "e"),
        (5, "another text\nof the same id", "e"),
        (None, "x " * 100_000, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed string")
    got = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup(docs).collect() if r.doc_id}
    assert got == {(1, None, 0, 0), (2, "", 1, 0), (3, same, 2, 1), (4, "short line\n\n\n--", 5, 1), (5, "\nown", 3, 1), (5, "another text\nof the same id", 2, 0)}
    assert lines.dedup(docs).count() == len(rows)
    assert lines.dedup(docs.limit(0)).count() == 0
    clash = docs.selectExpr("doc_id", "text", "1 as line", "2 as body", "3 as hi", "4 as id", "5 as keep")
    assert lines.dedup(clash).select("line", "body", "hi", "id", "keep").distinct().count() == 1


def test_common_lines_are_joined_apart(spark, monkeypatch):
    rows = [(i, f"the same line\nown line {i} {i + 1} {i + 2} {i * 7}") for i in range(50)]
    want = removed(spark, rows)
    monkeypatch.setattr(lines, "COMMON", 10)
    assert removed(spark, rows) == want and (7, 0) in want


def test_edit_band():
    rng = np.random.default_rng(0)
    for _ in range(500):
        x, y = (rng.integers(0, 4, rng.integers(0, 12)).astype(np.uint64) for _ in range(2))
        for most in range(6):
            assert lines.within(x, y, most) == (distance(list(x), list(y)) <= most)


def test_pigeonholes():
    """SimHashes that differ in at most seven blocks share a table's key."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = rng.integers(0, 1 << 48, lines.TABLES).astype(np.uint64)
        y = x.copy()
        for b in rng.choice(lines.BLOCKS, lines.TABLES - 1, replace=False):
            y[b // lines.EACH] ^= np.uint64(1 + rng.integers(0, 65535)) << np.uint64(16 * (b % lines.EACH))
        assert (x == y).any()
        assert lines.agreement(x[None], y[None])[0] == (lines.BLOCKS - lines.TABLES + 1) / lines.BLOCKS


def test_first_pairs_of_a_dense_key_are_few():
    m = 300
    width = lines.TABLES + lines.PARITIES
    sketch = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * width), pa.array(np.zeros(width * m, np.int64)))
    zero = pa.array(np.zeros(m, np.int64))
    batch = pa.RecordBatch.from_arrays([zero, zero, pa.array(np.arange(m)), pa.array(np.full(m, 10)), sketch], names=["key", "salt", "id", "n", "sketch"])
    out = pa.Table.from_batches(buckets.first_rows(iter([batch.slice(0, 100), batch.slice(100)]), lines.likeness(0.8)))
    assert out.column("hard").drop_null().to_pylist() == [0]
    assert m - 1 <= out.num_rows - 1 <= 2 * m


def test_simhash_bits_are_signs_of_weighted_sums():
    rng = np.random.default_rng(2)
    drawn = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)
    size = rng.integers(1, 40, 100)
    begin = np.cumsum(size) - size
    drawn = drawn[: size.sum()]
    got = lines.signs(drawn, begin, size)
    open_ = 0
    for k, (lo, n) in enumerate(zip(begin, size)):
        own = [int(x) for x in drawn[lo : lo + n]]
        weight = [((x + 1) / 2**64) ** -8.0 for x in own]
        bits = [int(x) for x in lines.tk.mix(drawn[lo : lo + n])]
        weight = [w if x <= 3 * min(own) else 0.0 for w, x in zip(weight, own)]
        sums = [sum(w if b >> j & 1 else -w for w, b in zip(weight, bits)) for j in range(16)]
        assert int(got[k]) == sum((s > 0) << j for j, s in enumerate(sums))
        open_ += max(weight) * 2 <= sum(weight)
    assert 0 < open_ < 25


def test_few_edits_of_long_lines():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = rng.integers(0, 3, rng.integers(1, 30)).astype(np.uint32)
        y = list(x)
        for _ in range(rng.integers(0, 5)):
            at = int(rng.integers(0, len(y) + 1))
            if rng.random() < 0.5 and y:
                y.pop(min(at, len(y) - 1))
            else:
                y.insert(at, np.uint32(rng.integers(0, 3)))
        y = np.array(y, np.uint32)
        for most in (0, 1, 3, 6):
            assert lines.few_edits(x, y, most) == (distance(list(x), list(y)) <= most)
    long = rng.integers(0, 1000, 80_000).astype(np.uint32)
    other = long.copy()
    other[[0, -1]] += 1
    assert lines.within(long, other, 16_000)


def test_work_in_dense_keys_follows_their_members(spark, monkeypatch):
    """Lines of six common and four own words, none linked: rows dealt for each line stay as many."""
    dealt = {}
    real = buckets.cut
    for m in (2000, 8000):
        common = ["all", "these", "words", "stand", "everywhere", "here"]
        rows = [(i, " ".join([*common, *(f"own{i}x{j}" for j in range(4))])) for i in range(m)]
        seen = []

        def counting(df, name):
            out = real(df, name)
            if name == "dealt":
                seen.append(out.count())
            return out

        monkeypatch.setattr(buckets, "cut", counting)
        assert not removed(spark, rows)
        dealt[m] = sum(seen) / m
    assert dealt[8000] < 2 * dealt[2000] + 10, dealt


def test_many_lines_are_compared_as_one_by_one():
    """Lines of one and of several machine words, with carries between them, and those too long or too few for it."""
    rng = np.random.default_rng(6)
    p, q = [], []
    for k in range(3000):
        x = rng.integers(0, (3, 1000)[k % 2], rng.integers(0, 60 if k % 3 else 300)).astype(np.uint32)
        y = list(x)
        for _ in range(rng.integers(0, len(x) // 4 + 2)):
            at = int(rng.integers(0, len(y) + 1))
            if rng.random() < 0.4:
                y[at : at + 1] = []
            else:
                y[at : at + int(rng.integers(0, 2))] = [rng.integers(0, 1000)]
        p.append(x.tobytes())
        q.append(np.array(y, np.uint32).tobytes())
    p += [np.arange(700, dtype=np.uint32).tobytes()] * 2
    q += [np.arange(100, 760, dtype=np.uint32).tobytes(), np.arange(200, 900, dtype=np.uint32).tobytes()]
    same = lines.alike(0.8)
    want = [same(x, y) for x, y in zip(p, q)]
    assert same.many(p, q).tolist() == want and 500 < sum(want) < 2900
    assert same.many(p[:5], q[:5]).tolist() == want[:5] and same.many([], []).tolist() == []


def test_packed_keys_meet(spark, monkeypatch):
    """Keys travel packed, a row for each bucket of a task, and those of two or more classes come out with all their members."""
    rng = np.random.default_rng(7)
    keys = rng.integers(-(1 << 62), 1 << 62, 900)[rng.integers(0, 900, (500, 4))]
    keys[:200, 0] = 5  # salted
    rows = [(i, k.tolist()) for i, k in enumerate(keys)]
    classes = spark.createDataFrame(rows, "id long, keys array<long>")
    monkeypatch.setattr(buckets, "DRAWN", 1)
    monkeypatch.setattr(buckets, "BLOCK", 50)
    salts = buckets.Salts([(5, 4)])
    packed = list(buckets.packed_rows(iter(classes.toArrow().to_batches()), 3, salts))
    assert sum(b.num_rows for b in packed) <= 3 * len(packed)
    got = [tuple(r) for r in buckets.shared(classes).collect()]
    members = Counter(k for _, ks in rows for k in ks)
    want = sorted((k, i) for i, ks in rows for k in ks if members[k] > 1)
    assert sorted((k, i) for k, _, i in got) == want
    assert {s for k, s, _ in got if k == 5} == {1, 2, 3, 4} and {s for k, s, _ in got if k != 5} == {0}


def test_lines_in_another_order_need_no_table(monkeypatch):
    """Pairs that lack words of each other, or have them in another order, are told apart before they are compared word by word."""
    rng = np.random.default_rng(8)
    tried = []
    real = lines.within_many
    monkeypatch.setattr(lines, "within_many", lambda x, n, *rest: tried.append(len(n)) or real(x, n, *rest))
    monkeypatch.setattr(lines, "BAGS", 5000, raising=False)
    base = [rng.integers(0, 1 << 32, 150).astype(np.uint32) for _ in range(200)]
    p = [x.tobytes() for x in base]
    near = [np.append(x[5:], x[:8]).tobytes() for x in base]
    far = [np.append(rng.permutation(x), x[:1]).tobytes() for x in base]
    other = [np.append(x[:60], rng.integers(0, 1 << 32, 95)).astype(np.uint32).tobytes() for x in base]
    got = lines.alike(0.8).many(p * 3, near + far + other)
    assert got.tolist() == [True] * 200 + [False] * 400
    assert sum(tried) == 200


def test_company_that_cannot_be_similar_is_left_out():
    """Members of a small key come out only if sizes and parities of their company allow a link; no pair that may be one is lost."""
    rng = np.random.default_rng(9)
    size = rng.integers(5, 40, 400)
    first = np.append(0, np.cumsum(size))
    h = rng.integers(0, 1 << 63, first[-1]).astype(np.uint64) * np.uint64(2)
    for k in range(0, 400, 4):  # every fourth line is near the next one
        n = min(size[k], size[k + 1])
        h[first[k + 1] : first[k + 1] + n] = h[first[k] : first[k] + n]
    sk, score = lines.simhashes(h, first, np.full(len(h), 9)), lines.likeness(0.8)
    a, b = np.triu_indices(400, 1)
    mark = score.marks(sk, size)
    meets, may = score.meets(mark[a], mark[b]), score.may(sk, size, a, b)
    assert may.sum() > 10 and meets[may].all() and meets.sum() < len(a) / 20
    key = np.repeat(np.arange(100), 4)
    want = {x for i, j in zip(a[meets], b[meets]) if key[i] == key[j] for x in (int(i), int(j))}
    got = buckets.paired(key, np.zeros(400, np.int32), mark, score)
    assert set(np.flatnonzero(got).tolist()) == want and 0 < len(want) < 300
    assert buckets.paired(np.zeros(400, np.int64), np.zeros(400, np.int32), mark, score).all()
    long = np.array([70_000, 90_000, 65_535, 1000])
    mark = score.marks(sk[:4], long)
    assert score.meets(mark[:2], mark[[1, 2]]).all() and not score.meets(mark[:1], mark[3:]).any()
