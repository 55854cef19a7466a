"""Inputs on which queries once differed from their SQL."""

import duckdb
import pytest

from spanline.plans import queries
from tests.compare import assert_same


def tables(folder, **selects):
    """A data folder with the given tables; the others are those of sf0.001."""
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        source = selects.get(name, f"SELECT * FROM read_parquet('/root/testdata/sf0.001/{name}.parquet')")
        con.execute(f"COPY ({source}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def test_pixels_are_single_precision(spark, tmp_path):
    """values at which single and double precision give other pixels, at every place that the query shows."""
    x = [n / 400 - 0.32 for n in range(256)]
    edge = [f"CAST({v!r} AS FLOAT)" for v in x]
    rows = " UNION ALL ".join(f"SELECT {i}::BIGINT, list_transform(range(64), lambda j: [{e}, {e} - 1e-8::FLOAT, {e} + 1e-8::FLOAT][1 + j % 3])::FLOAT[], {i % 7}" for i, e in enumerate(edge))
    d = tables(tmp_path, embeddings=f"SELECT * FROM ({rows}) v(vec_id, embedding, label)")
    assert_same(spark, queries.QUERIES["a7_fan_out_rois"](spark, d), queries.ORACLES["a7_fan_out_rois"], d)


def test_thresholds_to_the_last_bit(spark, tmp_path):
    """series of which an anchor lies at the very margin of the percentile, on either side of it by its last bit."""
    rows = []
    for low in range(50, 400, 3):
        for step in range(1, 41, 2):
            edge = low + 4 * step - 50
            rows.append([edge - 30, edge - 36, edge - 37, edge, low, low, low, low, low, low + 5 * step, low, low, low + 5 * step + 10])
    con = duckdb.connect(str(tmp_path / "rows.db"))
    con.execute("CREATE TABLE s AS SELECT unnest(range(len(?::INTEGER[][]))) AS u, unnest(?::INTEGER[][]) AS v", [rows, rows])
    con.execute(f"COPY (SELECT u * 13 + j AS event_id, TIMESTAMP '2024-01-01' + to_seconds(u * 13 + j) AS ts, u AS user_id, 'view' AS event_type, v[j + 1] / 10.0 AS value FROM s, range(13) t(j)) TO '{tmp_path}/made.parquet' (FORMAT parquet)")
    d = tables(tmp_path, events=f"SELECT * FROM read_parquet('{tmp_path}/made.parquet')")
    assert_same(spark, queries.QUERIES["h1_coarse_to_fine"](spark, d), queries.ORACLES["h1_coarse_to_fine"], d)


def test_series_without_scores(spark):
    """a key whose anchors are all null has no threshold, and keeps its rows."""
    from pyspark.sql import functions as F

    from spanline.operators.segments import coarse_to_fine, percentiles

    df = spark.createDataFrame([(1, i, None) for i in range(8)] + [(2, i, float(i)) for i in range(8)], "k int, i int, v double")
    assert dict(percentiles(df, ["k"], "v", 0.7, "p").collect()) == {1: None, 2: pytest.approx(4.9)}
    assert coarse_to_fine(df, ["k"], ["i"], F.col("v"), 3, 0.5).count() == 16


def test_quotes_of_the_documents_own(spark, tmp_path):
    """texts that begin or end with quotes of any kind, or are null, in each of the eight ways that the query wraps them."""
    texts = ['a "b c"', '"a b" c', '"a b"', "「a」 b", "a 『b』", "「「a」」", '“a" b”', "a ”", "“ a", '"', "", "  a ", "((a) b", "NULL"]
    rows = ", ".join(f"({8 * i + k}, {'NULL' if t == 'NULL' else chr(39) + t + chr(39)})" for i, t in enumerate(texts) for k in range(8))
    d = tables(tmp_path, documents=f"SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, 'en' AS lang, 's' AS source, 0::BIGINT AS n_chars FROM (VALUES {rows}) v(doc_id, text)")
    assert_same(spark, queries.QUERIES["b1_normalize_quotes"](spark, d), queries.ORACLES["b1_normalize_quotes"], d)


def test_equal_frames_meet_equal_segments_once(spark, tmp_path, monkeypatch):
    """frames and segments in large groups of equal ones, an order given twice: pairs follow what differs, not the rows."""
    from spanline.operators import lookup as lk

    events = "SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_days(CAST(i % 3 AS INTEGER)) AS ts, i % 2 * 50 AS user_id, 'view' AS event_type, 1.0 AS value FROM range(600) t(i)"
    orders = "SELECT i // 2 AS o_orderkey, i % 2 * 50 AS o_custkey, TIMESTAMP '2023-12-30' + to_days(CAST(i % 4 AS INTEGER)) AS o_orderdate FROM range(800) t(i)"
    d = tables(tmp_path, events=events, orders=orders)
    joined, pairs = [], lk.frames_in_segments
    monkeypatch.setattr(lk, "frames_in_segments", lambda *a: joined.append(pairs(*a)) or joined[-1])
    assert_same(spark, queries.QUERIES["c8_frames_in_segments"](spark, d), queries.ORACLES["c8_frames_in_segments"], d)
    assert joined[0].count() <= 12


@pytest.mark.parametrize("name", ["g3_marker_segments", "h13_timeline"])
def test_no_table_goes_to_the_driver(spark, name):
    """what grows with the frames is joined where it lies, however small its files."""
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
