"""Chunked folds against folds over whole keys, however rows are cut."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanline.functions import machine
from spanline.functions import scalars as sc
from spanline.operators import chunks
from spanline.operators import segments as sg
from spanline.operators import sequence as seq


@pytest.fixture(params=[1, 7, 40])
def partitions(spark, request):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_thin(spark, partitions):
    rng = random.Random(partitions)
    rows = [(k, rng.randint(-50, 900)) for k in (None, "a", "b", "hot") for _ in range(900 if k == "hot" else rng.choice([1, 30]))] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, p int")
    for gap in (0, 1, 4, 37, 5000):
        want = []
        for k in {k for k, _ in rows}:
            last = None
            for p in sorted({p for q, p in rows if q == k and p is not None}):
                if last is None or p - last >= max(1, gap):
                    want.append((k, p))
                    last = p
        assert sorted(map(tuple, seq.thin(df, ["k"], "p", gap).collect()), key=str) == sorted(want, key=str)
    assert seq.thin(df.limit(0), ["k"], "p", 3).count() == 0


def test_dialogue_segments(spark, partitions):
    rng = random.Random(partitions)
    rows = [(k, i, float(i), rng.choice([0.0, 9.0, 9.0]), rng.choice([0.0, 0.0, 1.0]), rng.choice([0.0, 9.0]), rng.choice([0.0, 0.0, 0.0, 1.0])) for k in (None, "a", "hot") for i in range(1500 if k == "hot" else 20)]
    rows += [("quiet", i, float(i), 0.0 if i < 300 else 9.0, 0.0, 0.0, 0.0) for i in range(600)]  # one segment through many chunks
    df = spark.createDataFrame(rows, "k string, idx long, ts double, presence double, diff double, name_presence double, name_diff double")
    for stable, clear, least in ((2, 2, 1.0), (1, 1, 0.0), (3, 4, 2.0)):
        cfg = {"presence": 5, "change": 0.5, "clear": 2, "name_presence": 8, "name_change": 0.5, "stable_frames": stable, "clear_frames": clear, "min_duration": least}
        flags = df.select("k", "idx", "ts", sc.flags("presence", "diff", "name_presence", "name_diff", cfg).alias("f")).select("k", "idx", "ts", "f.*").orderBy("k", "idx").collect()
        want = []
        for k in {r.k for r in flags}:
            own = [r for r in flags if r.k == k]
            m = machine.Segmenter(cfg)
            symbols = np.array([r.has_text * 1 + r.has_change * 2 + r.is_clear * 4 + r.name_changed * 8 for r in own])
            m.feed(np.array([r.idx for r in own]), np.array([r.ts for r in own]), symbols)
            m.finish()
            want += [(k, *x) for x in m.out]
        got = [(r.k, r.frame_start, r.frame_end, r.start, r.end, list(r.samples)) for r in sg.dialogue_segments(df, ["k"], ["idx"], cfg).collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and want


def test_a_long_key_lies_in_many_tasks(spark):
    df = spark.range(200_000).select(F.lit(1).alias("k"), F.col("id").alias("p"))
    c = chunks.Chunked(df.withColumn("_pos", F.col("p")), ["k"], ["p"], ["_pos"], lambda: seq.Thinned(5), None)
    sizes = [r["count"] for r in c.rows.groupBy("_chunk").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 200_000 / 8 and len(c.entered) == 7
    assert seq.thin(df, ["k"], "p", 5).count() == 40_000


def test_places():
    rng = np.random.default_rng(0)
    cfg = {"stable_frames": 2, "clear_frames": 3}
    goes, _ = machine.transitions(2, 3)
    for n in (0, 1, 2, 7, 100):
        symbols = rng.integers(0, 16, n)
        m = machine.Places(cfg)
        m.add(symbols[: n // 3])
        m.add(symbols[n // 3 :])
        for place in range(len(goes)):
            at = place
            for s in symbols:
                at = goes[at][s]
            assert m.apply(place) == at


def test_pieces():
    b = [pa.RecordBatch.from_pydict({"a": [1, 1, None], "b": ["x", "y", None]}), pa.RecordBatch.from_pydict({"a": pa.array([None, 2], pa.int64()), "b": [None, "z"]})]
    assert [(k, f, p.num_rows) for k, f, p in chunks.pieces(iter(b), 2)] == [((1, "x"), True, 1), ((1, "y"), True, 1), ((None, None), True, 1), ((None, None), False, 1), ((2, "z"), True, 1)]
