"""Windows over unions of equally partitioned inputs see whole keys, with the session's settings untouched."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanline.operators.union import union_all


def test_keys_stay_whole(spark):
    rows = spark.range(20_000).select((F.col("id") % 97).alias("k"), F.col("id").alias("v"))
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v")))
    both = union_all(numbered, numbered.where("v % 11 = 0"), numbered.where("v < 50"))
    first = both.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("v", "n"))).where("r = 1")
    assert first.count() == 97
    assert both.groupBy("k").count().count() == 97
    assert spark.conf.get("spark.sql.unionOutputPartitioning", "true") == "true"
