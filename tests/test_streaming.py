"""Streams give what the batch operators give."""

import random
import tempfile

from pyspark.sql import functions as F

from spanline.functions import machine
from spanline.functions import scalars as sc
from spanline.operators import segments as sg
from spanline.operators import sequence as seq
from spanline.streaming import streams as st


def as_stream(spark, df, order, files=4):
    """The rows in ``files`` files, which come one by one."""
    path = tempfile.mkdtemp()
    rows = df.orderBy(*order).collect()
    n = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * n : (i + 1) * n], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def ends(spark, df, k):
    """Adds eof: false for all rows, and one row with true for each key."""
    kinds = df.schema
    last = df.select(*k).distinct().withColumn("eof", F.lit(True))
    for f in kinds:
        if f.name not in k:
            last = last.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.withColumn("eof", F.lit(False)).unionByName(last)


def table(rows):
    return sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in rows)


def test_marker_stream(spark):
    rng = random.Random(1)
    rows = [(k, i, float(rng.random() < rng.choice([0.3, 0.7]))) for k in range(30) for i in range(rng.choice([1, 5, 80]))]
    df = spark.createDataFrame(rows, "k long, idx long, v double")
    want = seq.marker_segments(df, ["k"], ["idx"], "v", 0.5)
    s = as_stream(spark, ends(spark, df.select("k", "idx", (F.col("v") >= 0.5).alias("on")), ["k"]), ["eof", "idx"])
    got = st.run_to_table(st.stream_segments(s, ["k"], {"min_on": 2, "min_off": 2}, "marker"), tempfile.mkdtemp())
    assert table(got.collect()) == table(want.select("k", "frame_start", "frame_end", "sample").collect()) and got.count()


def test_dialogue_stream(spark):
    rng = random.Random(2)
    cfg = {"presence": 5, "change": 0.5, "clear": 2, "name_presence": 8, "name_change": 0.5, "stable_frames": 2, "clear_frames": 2, "min_duration": 1.0}
    rows = [(k, i, float(i), rng.random() * 10, rng.random(), rng.random() * 10, rng.random()) for k in range(10) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, idx long, ts double, presence double, diff double, name_presence double, name_diff double")
    want = sg.dialogue_segments(df, ["k"], ["idx"], cfg)
    flagged = df.select("k", "idx", "ts", sc.flags("presence", "diff", "name_presence", "name_diff", cfg).alias("f")).select("k", "idx", "ts", "f.*")
    got = st.run_to_table(st.stream_segments(as_stream(spark, ends(spark, flagged, ["k"]), ["eof", "idx"]), ["k"], cfg), tempfile.mkdtemp())
    assert table(got.collect()) == table(want.collect()) and got.count()


def test_pairs_stream(spark):
    rng = random.Random(3)
    rows = [(f"t{rng.randint(0, 5)}", i, rng.choice(["request", "response", "error", "other"])) for i in range(300)]
    df = spark.createDataFrame(rows, "tag string, id long, event string")
    want = st.pair_events(df, ["tag"], ["id"])
    got = st.run_to_table(st.stream_pairs(as_stream(spark, ends(spark, df, ["tag"]), ["eof", "id"]), ["tag"]), tempfile.mkdtemp())
    assert table(got.collect()) == table(want.collect())


def test_join_stream_drops_late_rows(spark):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "frame long, t string, score double").withColumn("ts", F.to_timestamp("t")).drop("t")
    a, b = as_stream(spark, df.select("frame", "ts"), ["ts"]), as_stream(spark, df.where("frame % 2 = 0"), ["ts"])
    got = st.run_to_table(st.stream_join_prune(a, b, ["frame"], "ts", "score", 10.0), tempfile.mkdtemp())
    assert sorted(r.frame for r in got.collect()) == [i for i in range(60) if i % 2 == 0 and i >= 10]
    late = spark.createDataFrame([(1, 0), (2, 1), (900, 2), (901, 3), (3, 4)], "frame long, n long").withColumn("ts", F.timestamp_seconds(F.col("frame") * 60)).withColumn("score", F.lit(50.0))
    a, b = as_stream(spark, late.select("frame", "ts", "n"), ["n"], 5), as_stream(spark, late.select("frame", "ts", "score", "n"), ["n"], 5)
    got = st.run_to_table(st.stream_join_prune(a, b, ["frame"], "ts", "score", 10.0, "5 minutes"), tempfile.mkdtemp())
    assert {r.frame for r in got.collect()} == {1, 2, 900, 901}


def test_chunks_stream(spark):
    rows = []
    for r in range(5):
        parts = [f'data: {{"choices":[{{"delta":{{"content":"w{i} "}}}}]}}' for i in range(4)] + ["", ": ping", "data: {bad", 'data: {"choices":[{"delta":{},"finish_reason":"stop"}],"usage":{"total_tokens":7}}', "data: [DONE]"]
        rows += [(r, i, p, r * 3600 + i) for i, p in enumerate(parts)]
    df = spark.createDataFrame(rows, "request_id long, seq long, line string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    want = {r.request_id: (r.content, r.finish, r.usage, r.malformed, r.empty) for r in st.assemble_chunks(df, ["request_id"]).collect()}
    assert want[0] == ("w0 w1 w2 w3 ", "stop", 7, 1, False)
    got = st.run_to_table(st.stream_chunks(as_stream(spark, df, ["ts"]), "request_id", "ts", "10 minutes", "1 minute"), tempfile.mkdtemp()).collect()
    assert got and all(want[r.request_id] == (r.content, r.finish, r.usage, r.malformed, r.empty) for r in got)


def test_silent_keys_end_and_lose_their_state(spark):
    """A timer ends a key once the watermark is past it, and drops its state; a gap within the rows ends it too."""
    cfg = {"stable_frames": 1, "clear_frames": 1}
    rows = [("gone", i, i * 10, True) for i in range(5)] + [("gap", 0, 0, True), ("gap", 1, 10, True), ("gap", 2, 400, True), ("gap", 3, 410, True)]
    rows += [("late", i, 5000 + i * 10, True) for i in range(3)] + [("last", i, 9000 + i * 10, True) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, idx long, s long, has_text boolean").selectExpr("*", "cast(s as double) as ts", "timestamp_seconds(s + 1000) as at", "false as has_change", "false as is_clear", "false as name_changed", "false as eof")
    s = as_stream(spark, df, ["s", "k"], 6)
    path = tempfile.mkdtemp()
    got = st.run_to_table(st.stream_segments(s, ["k"], cfg, "dialogue", "at", 100.0, "10 seconds"), path)
    assert table(got.collect()) == [("gap", 0, 1, 0.0, 10.0, (0, 1)), ("gap", 2, 3, 400.0, 410.0, (2, 3)), ("gone", 0, 4, 0.0, 40.0, (0, 1, 2, 3, 4)), ("late", 0, 2, 5000.0, 5020.0, (0, 1, 2))]
    left = spark.read.format("statestore").option("path", f"{path}/_state").option("stateVarName", "fold").load()
    assert {r.key[0] for r in left.select("key").collect()} == {"last"}


def test_marker_state_is_runs_not_frames():
    m = machine.MarkerMachine({"min_on": 2, "min_off": 2})
    for i in range(10_000):
        m.step(i, i > 0)
    assert m.seen == 2 and not m.ons
    other = machine.MarkerMachine({"min_on": 2, "min_off": 2})
    for i in range(10_000):
        other.step(i, True)
    assert other.ons == [(0, 9999)]
