"""Union that later windows and joins may rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: More partitions than any union has, so that they stay as they are.
ANY = 1 << 20


def union_all(first: DataFrame, *more: DataFrame) -> DataFrame:
    """``unionByName``, without the claim that equally partitioned inputs stay so.

    Spark 4.1 takes a union of inputs that are hash-partitioned by the same key as
    partitioned by it and leaves out the exchange before a window or join on that
    key, and an explicit repartitioning by it too; when adaptive execution has
    coalesced the inputs' partitions differently, rows of one key then lie in
    several partitions and results are wrong.  A coalesce to more partitions than
    there are moves nothing, and claims nothing.
    """
    out = first
    for df in more:
        out = out.unionByName(df)
    return out.coalesce(ANY)
