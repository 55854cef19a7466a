"""Vector codes against full scans in plain integers."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from spanline.llm import codes
from tests.llm.test_edges import crowded


def brute(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label), sorted; every part is compared with every entry, in Python's integers."""
    x = [[int(np.floor(256 * float(c))) for c in v] for _, v, _ in rows]
    w = len(x[0]) // parts
    x = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in x]
    book = [[v[p] for v in x[:entries]] for p in range(parts)]
    for turn in range(rounds + 1):
        got = [[min((sum((a - b) ** 2 for a, b in zip(v[p], e)), k) for k, e in enumerate(book[p])) for p in range(parts)] for v in x]
        if turn < rounds:
            for p in range(parts):
                for k in range(len(book[p])):
                    own = [v[p] for v, g in zip(x, got) if g[p][1] == k]
                    if own:
                        book[p][k] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(c) for b in book for e in b for c in e).encode()).hexdigest()
    err = [sum(d for d, _ in g) for g in got]
    per = {}
    for (_, _, label), e in zip(rows, err):
        per[label] = per.get(label, 0) + e
    return [(i, "".join(f"{k:02x}" for _, k in g), e, per[label], digest) for (i, _, label), g, e in zip(rows, got, err)]


def run(spark, rows):
    return sorted(map(tuple, codes.compress(crowded(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))).collect()))


def test_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 32)) * 0.2
    x = np.concatenate([base, base[rng.integers(0, 40, 160)] + rng.normal(size=(160, 32)) * 0.02, np.repeat(base[:1], 20, axis=0)])
    rows = [(i * 3, v.tolist(), [None, 1, 2][i % 3]) for i, v in enumerate(x)]
    bad = [(1, None, 1), (2, [float("nan")] * 32, 1), (4, [float("inf")] * 32, 1), (5, [None] * 32, None)]
    assert run(spark, rows[::-1] + bad) == brute(rows)
    assert run(spark, rows[:5]) == brute(rows[:5])  # fewer vectors than entries
    large = [(i, (v * 1000).tolist(), 1) for i, _, v in [(r[0], 0, np.array(r[1])) for r in rows[:90]]]
    assert run(spark, large) == brute(large)  # too large for doubles


def test_edges(spark):
    assert codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    rows = [(1, [], 1), (2, [0.5] * 3, None), (2, [0.5] * 3, None), (None, [1e300] * 20, 1), (3, [-1e300] * 20, 1)]
    got = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 5 and all(r.error == 0 and len(r.code) == 32 for r in got)
    whole = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*[(F.col("id") * i % 7).cast("float") for i in range(16)]).alias("embedding"), F.lit("x").alias("label"))
    assert len({r.code for r in codes.compress(whole).collect()}) > 3


def test_active_entries_do_less_and_decide_the_same():
    rng = np.random.default_rng(1)
    for most in (4, 30, 1 << 27):
        x, book = rng.integers(-most, most, (500, 4)), rng.integers(-most, most, (64, 4))
        entry, dist = codes.nearest(x, book)
        new = book.copy()
        new[rng.choice(64, 9, replace=False)] += 1
        moved = (new != book).any(axis=1)
        k, d, work = codes.renew(x, entry, dist, new, moved)
        want = codes.nearest(x, new)
        assert (k == want[0]).all() and (d == want[1]).all() and work < 0.5 * 500 * 64
        assert codes.renew(x, entry, dist, book, np.zeros(64, bool))[2] == 0
