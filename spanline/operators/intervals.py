"""Joins of points with the spans that hold them, as equi-joins at any span length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node(cell: Column, level: Column) -> Column:
    """The node of a dyadic level that holds a cell: 2 ** level cells each."""
    return F.floor(cell / F.pow(F.lit(2.0), level))


def in_spans(points: DataFrame, spans: DataFrame, k: list[str], at: str, start: str, end: str, unit: float = 1.0, merge: bool = True) -> DataFrame:
    """All (point, span) pairs of a key with start <= at <= end: the points' columns, then the spans' others.

    A span stands at the dyadic level of its own length, where it touches three nodes
    at most; a point asks its node of every level that some span stands at.  So a
    long span isn't copied along its length, nor do short ones share a wide cell,
    and there is no width to choose; ``unit`` is the step below which lengths are alike.
    Spans that end before they start, and nulls, hold nothing.  With ``merge`` neither side
    is sent to the driver: written tables are far larger in memory than their files suggest.
    """
    cell = lambda c: F.floor(F.col(c) / unit)
    placed = spans.where(F.col(end) >= F.col(start)).withColumn("_level", F.floor(F.log2((cell(end) - cell(start) + 1).cast("double"))).cast("int"))
    levels = placed.agg(F.collect_set("_level")).scalar()
    placed = placed.withColumn("_node", F.explode(F.sequence(node(cell(start), F.col("_level")), node(cell(end), F.col("_level")))))
    asked = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(levels)).withColumn("_node", node(cell(at), F.col("_level")))
    return asked.join(placed.hint("merge") if merge else placed, [*k, "_level", "_node"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_level", "_node")
