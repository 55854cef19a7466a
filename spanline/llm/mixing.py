"""Mixing sources to target weights with a low-discrepancy schedule (DataFrame operations only).

The mix is a schedule of slots.  Slot i takes the golden-ratio point frac(i * phi),
which falls into one source's part of the cumulative target weights.  The slots of a
source are ranked, and the r-th one takes the r-th block of that source's shuffled
documents, laid end to end and starting over after the last.  A source's blocks have
equally many words, to within one, so many that they add up to its target: their
number comes from the schedule, and they are about as long in all sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanline.llm.common import SENT, broadcast_if, cut

#: floor(2**32 / phi): consecutive multiples modulo 2**32 are golden-ratio points.
GOLDEN = 2654435769
PERIOD = 1 << 32
CELLS = 1024
#: Words of a slot's block, about.
BLOCK_WORDS = 1024


def running_sum(df: DataFrame, group: str, value: str, order: list[str], part: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over earlier rows of the group.

    ``part`` numbers consecutive pieces of each group's order; only one piece is
    ever sorted in one task, so a group may hold any share of the rows.
    """
    w = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = (
        df.groupBy(group, part).agg(F.sum(value).alias("_sum")).select(group, part, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_base"))
    )
    inner = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(base, [group, part])
        .withColumn("before", F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop("_base")
    )


def with_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and ``size``: the words parted by white space; null has none."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words.cast("long").alias("size"))


def source_targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.0, repeat: int = 3) -> DataFrame:
    """One row per source: sid (order by code point, null last), weight, source_size, target.

    Weights repeat in the sources' order.  Targets share ``share`` of all sizes by
    weight; none exceeds ``repeat`` times its source, the excess going to the
    others by weight until none is above: the common level at which the capped
    targets add up to the total, found over the sources sorted by cap per weight.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sid = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("sid", sid.cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * repeat).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    everyone = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(everyone) * F.lit(share))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.when(F.col("left") <= F.col("w_left") * F.col("cap") / F.col("weight"), F.col("left") / F.col("w_left")))
    )
    # The level holds from the first source, in this order, that isn't capped.
    level = F.first("level", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))).select(
        "source", "sid", "weight", "source_size", "n_docs", F.greatest("target", F.lit(0.0)).alias("target")
    )


def shares(targets: DataFrame) -> DataFrame:
    """(sid, lo, hi): the sources' parts of the cumulative target weights."""
    by_sid = Window.orderBy("sid")
    upto = targets.where("target > 0").withColumn("all", F.sum("target").over(Window.partitionBy()))
    return upto.select(
        "sid",
        (F.coalesce(F.sum("target").over(by_sid.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / F.col("all")).alias("lo"),
        F.when(F.lead("sid").over(by_sid).isNull(), F.lit(1.0)).otherwise(F.sum("target").over(by_sid.rowsBetween(Window.unboundedPreceding, 0)) / F.col("all")).alias("hi"),
    )


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """(slot, sid, rank): golden-ratio points mapped through the cumulative target weights.

    A slot's point picks its source through ``CELLS`` equal cells, an equi-join.  A
    source too small for any point has one slot more, in its part's place.
    """
    spark = targets.sparkSession
    parts = cut(shares(targets), "shares")
    cells = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    high = F.pmod(F.floor(F.col("id") / (1 << 16)) % (1 << 16) * GOLDEN, F.lit(PERIOD)) * (1 << 16)
    points = spark.range(slots).select(F.col("id").alias("slot"), (F.pmod(high + F.col("id") % (1 << 16) * GOLDEN, F.lit(PERIOD)) / F.lit(float(PERIOD))).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS))
    hit = points.join(cells, "cell").where("u >= lo and u < hi").select("slot", "sid", F.lit(1).alias("one"))
    hit = hit.withColumn("piece", F.floor(F.col("slot") / 1024))
    ranked = running_sum(hit, "sid", "one", ["slot"], "piece").select("slot", "sid", F.col("before").alias("rank"))
    ranked = cut(ranked, "schedule")
    missed = parts.join(ranked.select("sid").distinct(), "sid", "left_anti")
    return ranked.unionByName(missed.select(F.floor(F.col("lo") * slots).alias("slot"), "sid", F.lit(0).cast("long").alias("rank")))


def blocks(slots: DataFrame, targets: DataFrame) -> DataFrame:
    """(slot, sid, rank, start, end): the words of its source, counted through all repeats, that a slot takes."""
    n = slots.groupBy("sid").agg(F.count("*").alias("n"))
    per = cut(targets.select("sid", F.bround("target").cast("long").alias("words")).join(n, "sid"), "blocks")
    rows = slots.join(broadcast_if(per, per.count(), SENT), "sid")
    begin = lambda r: r * F.expr("words div n") + F.least(r, F.col("words") % F.col("n"))
    return rows.select("slot", "sid", "rank", begin(F.col("rank")).alias("start"), begin(F.col("rank") + 1).alias("end")).where("start < end")


def placed(sized: DataFrame, targets: DataFrame, piece_rows: int = 100, max_pieces: int = 8192) -> DataFrame:
    """Documents with ``before``, the words of their source before them, in the order of the MD5 of doc_id.

    That order's range is dealt to pieces of about ``piece_rows`` documents of the
    largest source, ``max_pieces`` at most, so that larger sources have larger
    pieces and the table of pieces stays small.
    """
    n, most = targets.agg(F.count("*"), F.max("n_docs")).first()
    pieces = max(1, min(max_pieces, (most or 0) // piece_rows))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    small = broadcast_if(targets, n, SENT)
    rows = (
        sized.join(small, sized["source"].eqNullSafe(targets["source"]))
        .select("doc_id", "sid", "size", "source_size", "target", key.alias("order"))
        .withColumn("piece", F.floor(F.conv(F.substring("order", 1, 7), 16, 10).cast("long") * pieces / F.lit(1 << 28)))
    )
    return running_sum(rows, "sid", "size", ["order", "doc_id", "size"], "piece")


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.0, repeat: int = 3, block_words: int = BLOCK_WORDS) -> dict[str, DataFrame]:
    """The mix of ``docs(doc_id, source, text, ...)`` as ``{"targets", "placed", "order"}``.

    ``order`` is the mix itself, (slot, sid, doc_id, before, start, words): in the order
    of (slot, sid, before), the stretches of documents that follow each other, from
    word ``start`` of the document on.  ``placed`` has the documents with the words
    before them.  Blocks and documents of a source meet in cells of ``block_words``
    words, so that a source may hold any share of the rows.

    Nulls: a null text has size 0 and takes nothing; null sources form one source,
    the last; a null doc_id sorts first.  Repeated rows are placed one after the
    other.  No rows give no rows.  Extra columns are ignored.  Reruns agree, as
    nothing depends on partitioning.
    """
    sized = cut(with_sizes(docs), "sizes")  # the texts are read once
    targets = cut(source_targets(sized, weights, share, repeat), "targets")
    total = targets.agg(F.sum("target")).first()[0] or 0
    taking = blocks(schedule(targets, max(1, round(total / block_words)) if total else 0), targets)
    rows = cut(placed(sized, targets), "placed")
    cells = lambda lo, hi: F.sequence(F.expr(f"{lo} div {block_words}L"), F.expr(f"({hi} - 1) div {block_words}L"))
    # A document stands in its source's stream once for each repeat that the target reaches.
    last = F.expr("(cast(bround(target) as bigint) - 1 - before) div source_size")
    again = rows.where("size > 0 AND before < bround(target)").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    again = again.select("sid", "doc_id", "before", (F.col("copy") * F.col("source_size") + F.col("before")).alias("lo"), "size").withColumn("hi", F.col("lo") + F.col("size"))
    at = again.withColumn("cell", F.explode(cells("lo", "hi")))
    to = taking.withColumn("cell", F.explode(cells("start", "end")))
    first, end = F.greatest("lo", "start"), F.least("hi", "end")
    met = at.join(to, ["sid", "cell"]).where((first < end) & (F.col("cell") == F.floor(first / block_words)))  # once, in the first cell of both
    order = met.select("slot", "sid", "doc_id", "before", "size", (first - F.col("lo")).alias("start"), (end - first).alias("words"))
    return {"targets": targets, "placed": rows, "order": order}


def taken(docs: DataFrame, repeat: int = 3, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (the words that the slots of :func:`mix` take of it).

    A source's slots take its target, to the nearest word; no word is used more
    than ``repeat`` times, so no document exceeds that.
    """
    m = mix(docs, repeat=repeat, **options)
    used = m["order"].groupBy("sid", "before").agg(F.sum("words").alias("taken"))
    rows = m["placed"].withColumn("_at", F.when(F.col("size") > 0, F.col("before")))  # rows without words share their place
    out = rows.join(used.withColumnRenamed("before", "_at"), ["sid", "_at"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
