"""Batched calls: few rows' outcomes are held at once, and all rows come back."""

import pyarrow as pa
from pyspark.sql import functions as F

from spanline.operators.infer import batch_infer


def test_all_rows_come_back(spark):
    rows = spark.range(2000, numPartitions=1).select("id", F.when(F.col("id") % 10 != 3, F.format_string("r%d", "id")).alias("request"))
    got = batch_infer(rows, lambda r, timeout: (r or "", {"prompt": 2}), "request")

    assert {(r.id, r.result, r.status, r.prompt) for r in got.collect()} == {(i, f"r{i}" if i % 10 != 3 else None, "ok" if i % 10 != 3 else "empty", 2 if i % 10 != 3 else 0) for i in range(2000)}


def test_calls_are_made_in_short_runs():
    """The function behind mapInArrow, run here on one batch of 1000 rows."""
    seen = {}

    class Frame:
        columns = ["request"]

        def __init__(self):
            from pyspark.sql.types import StringType, StructField, StructType

            self.schema = StructType([StructField("request", StringType())])

        def drop(self, *names):
            return self

        def mapInArrow(self, run, schema):
            seen["run"] = run

    batch_infer(Frame(), lambda r, timeout: r, "request")
    out = list(seen["run"](iter([pa.RecordBatch.from_arrays([pa.array([f"r{i}" for i in range(1000)])], names=["request"])])))
    assert [x for b in out for x in b.column(1).to_pylist()] == [f"r{i}" for i in range(1000)]
    assert max(b.num_rows for b in out) <= 256
