"""Helpers shared by the operators: tables, scratch storage, components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}
_collected = 0.0

#: Rows (of some 30 bytes) up to which a measured table is broadcast instead of shuffling the other side.
SENT = 1_000_000
#: Links of one node from which they are joined apart from the others.
HUB = 50_000
#: Links for each partition of a round of :func:`components`.
EDGES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table below ``sf_dir``, whatever store that is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; where that is unset and all
    runs in one process (tests) a temporary folder is set for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="spanline-")
        _own[spark.sparkContext.applicationId] = root
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/spanline-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def cut(df: DataFrame, name: str, hashes: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a copy that survives the loss of any executor.  No dictionary
    is tried for the columns ``hashes``, of which the values hardly repeat.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in hashes}).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df_or_path: DataFrame | str, spark: SparkSession | None = None, now: bool = False) -> None:
    """Delete a scratch table that is no longer read.

    The shuffle files it was made from go once the driver's JVM has collected what
    refers to them, which is asked for here, now and then (``now``: at once): disks fill
    faster than heaps.
    """
    global _collected
    if isinstance(df_or_path, DataFrame):
        spark = df_or_path.sparkSession
        paths = {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()[:1]}
    else:
        paths = {df_or_path}
    for p in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(p)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    if now or time.monotonic() - _collected > 10:
        gc.collect()  # what Python refers to in the JVM
        spark._jvm.System.gc()
        _collected = time.monotonic()


def broadcast_if(df: DataFrame, weight: int | None, most: int) -> DataFrame:
    """``df`` marked for broadcast if its measured ``weight`` is at most ``most``; else it is left to be shuffled."""
    return F.broadcast(df) if (weight or 0) <= most else df


def buckets_for(spark: SparkSession) -> int:
    """How many hash buckets packed exchanges use: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(counted: DataFrame, on: list[str], times: str, least: int = HUB) -> DataFrame | None:
    """The keys of a table that count ``least`` or more rows elsewhere, if there are any, and few enough to be broadcast."""
    hot = counted.where(F.col(times) >= least).select(*on)
    return hot if 0 < hot.count() <= SENT else None


def hub_join(rows: DataFrame, side: DataFrame, on: str | list[str], hubs: DataFrame | None) -> DataFrame:
    """``rows`` inner join ``side`` (one row per key); keys in the short table ``hubs`` are joined where their rows are."""
    if hubs is None:
        return rows.join(side, on)
    hubs = F.broadcast(hubs)
    apart = rows.join(F.broadcast(side.join(hubs, on)), on)
    return apart.unionByName(rows.join(hubs, on, "left_anti").join(side, on))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the undirected ``edges(u, v)`` of comparable ids.

    ``component`` is the smallest node that can be reached.  Alternates large-star
    and small-star steps as joins against one minimum per node, so that no
    neighbour list is ever gathered; each round is written to the shared folder.
    Nodes of HUB links or more, of which E links allow 2 E / HUB, are joined by
    broadcast, so that no hub's links meet in one task.  Self-loops and nulls are
    ignored; no edges give no rows.
    """
    cur = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    total, seen = cur.count(), None
    while total:
        # Dealt by u into as many partitions as the links need; what follows on u needs no exchange.
        n = max(1, min(buckets_for(cur.sparkSession), -(-total // EDGES)))
        dealt = lambda df: df.repartition(n, "u")  # noqa: B023, E731
        both = dealt(cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))).distinct()
        hubs = None
        if HUB <= total and 2 * total <= HUB * SENT:
            hubs = cut(both.groupBy("u").agg(F.count("*").alias("links")).where(F.col("links") >= HUB).select("u"), "hubs")
        # Large star: every neighbour larger than u is moved to u's smallest neighbour.
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = hub_join(both.where("v > u"), low, "u", hubs).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = dealt(large).distinct()
        # Small star: the smaller neighbours of u, and u itself, are moved to the smallest of them.
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = dealt(large.join(low2, "u").select(F.explode(moved).alias("e")).select("e.*").where("u <> v")).distinct()
        nxt = cut(small, "edges")
        total, state = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_scratch(cur)
        if hubs is not None:
            drop_scratch(hubs)
        cur = nxt
        if state == seen:
            break
        seen = state
    roots = cur.select(F.col("v").alias("node")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )
