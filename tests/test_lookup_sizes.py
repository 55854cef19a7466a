"""Name resolution and interval joins against comparing all pairs."""

import random

from pyspark.sql import functions as F

from spanline.operators import intervals, lookup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_names_match_as_when_all_are_compared(spark):
    keys = ["abcd", "abcde", "xy", "q", "longername", "other", "mnop", "mnoq", "éclair"]
    names = ["abxd", "abxde", "hasxyinit", "gerna", "qqq", "othr", "motherx", "mnor", "eclair", "noneof1t", "", None, "b", "abcd"]
    dim = spark.createDataFrame([(k,) for k in keys], "brand string")
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for most in (1, 2):
        got = {r.name: (r.match, r.ambiguous) for r in lookup.resolve_dimension(df, "name", dim, "brand", most).collect()}
        for n in names:
            best = (9, 9)
            hits = set()
            for k in keys if n else []:
                score = (0, 0) if n == k else (2, 0) if n in k or k in n else (3, edits(n, k)) if edits(n, k) <= most else (9, 9)
                if score < best:
                    best, hits = score, set()
                if score == best != (9, 9):
                    hits.add(k)
            assert got[n] == (hits.pop() if len(hits) == 1 else None, len(hits) > 1), n
    plan = lookup.resolve_dimension(df, "name", dim, "brand")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_spans_of_all_lengths(spark):
    rng = random.Random(0)
    spans = [(k, i, s, s + rng.choice([0, 0.5, 1, 3, 40, 5000, 1e6]) - rng.choice([0, 0, 0, 1])) for k in ("a", "b") for i, s in enumerate(rng.uniform(-2000, 2000) for _ in range(60))] + [("a", 98, None, 4.0), ("a", 99, 3.0, None)]
    points = [(k, rng.choice([float(rng.randint(-3000, 3000)), rng.uniform(-3000, 9000)])) for k in ("a", "b") for _ in range(200)] + [("a", None), ("c", 1.0)] + [("a", spans[0][2])]
    p, s = spark.createDataFrame(points, "k string, at double"), spark.createDataFrame(spans, "k string, id long, s double, e double")
    want = sorted((k, t, i) for k, t in points if t is not None for q, i, a, b in spans if k == q and a is not None and b is not None and a <= t <= b)
    for unit in (1.0, 0.25, 100.0):
        assert sorted(map(tuple, intervals.in_spans(p, s, ["k"], "at", "s", "e", unit).select("k", "at", "id").collect())) == want
    assert intervals.in_spans(p, s.limit(0), ["k"], "at", "s", "e").count() == 0


def test_long_spans_are_not_copied_along_their_length(spark):
    s = spark.createDataFrame([(1, 5, 5), (1, 7, 1_000_007), (1, 0, 9)], "k int, s long, e long")
    level = F.floor(F.log2((F.col("e") - F.col("s") + 1).cast("double"))).cast("int")
    n = s.select((intervals.node(F.col("e"), level) - intervals.node(F.col("s"), level) + 1).alias("n")).collect()
    assert max(r.n for r in n) <= 3
