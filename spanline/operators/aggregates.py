"""Aggregations, ranks and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanline.functions import scalars as sc
from spanline.operators.union import union_all
from spanline.sources.shared import shared_path


def score_stats(df: DataFrame, k: list[str], score: str) -> DataFrame:
    return df.groupBy(*k).agg(F.min(score).alias("min"), F.avg(score).alias("avg"), F.percentile(score, 0.95).alias("p95"), F.max(score).alias("max"))


def threshold_hint(df: DataFrame, k: list[str], score: str, share: float = 0.7) -> DataFrame:
    return df.groupBy(*k).agg(F.percentile(score, share).alias("threshold"))


def decision_counts(df: DataFrame, k: list[str], decision: str, score: str) -> DataFrame:
    """Counts of a presence decision struct, and sum, min, max and mean of its score."""
    d = F.col(decision)
    return df.groupBy(*k).agg(
        F.count("*").alias("total"),
        F.count_if(d["present"]).alias("on"),
        F.count_if(~d["present"] & ~d["uncertain"]).alias("off"),
        F.count_if(d["uncertain"] & (d["reason"] == "")).alias("uncertain"),
        F.count_if(d["uncertain"] & (d["reason"] != "")).alias("rejected"),
        F.sum(score).alias("score_sum"), F.min(score).alias("score_min"), F.max(score).alias("score_max"), F.avg(score).alias("score_avg"),
    )


def usage_totals(df: DataFrame, k: list[str], usage: str) -> DataFrame:
    u = F.col(usage)
    total = F.coalesce(F.nullif(u["total"], F.lit(0)), u["prompt"] + u["completion"])
    return df.groupBy(*k).agg(F.sum(u["prompt"]).alias("prompt"), F.sum(u["completion"]).alias("completion"), F.sum(total).alias("total"))


def multiplicity(df: DataFrame, k: list[str], ident: str, out: str = "times") -> DataFrame:
    return df.withColumn(out, F.count("*").over(Window.partitionBy(*k, ident)))


def ocr_lines(boxes: DataFrame, k: list[str], box_id: str = "box_id") -> DataFrame:
    """(k, text, confidence): recognised boxes in reading order; boxes(k, box_id, text, score, top, bottom, x).

    A box joins the row above while its top is less than the lowest bottom so far;
    rows go down, boxes in a row by centre.  An image with a malformed box (null
    edges) keeps its input order, in one row.
    """
    w = Window.partitionBy(*k)
    b = boxes.withColumn("_bad", F.bool_or(F.col("top").isNull() | F.col("bottom").isNull() | F.col("x").isNull()).over(w))
    down = w.orderBy("top", box_id)
    low = F.max("bottom").over(down.rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumn("_new", (low.isNotNull() & (F.col("top") >= low)).cast("int")).withColumn("_row", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    b = b.withColumn("_row", F.when(F.col("_bad"), 0).otherwise(F.col("_row"))).withColumn("_x", F.when(F.col("_bad"), F.col(box_id).cast("double")).otherwise(F.col("x")))
    part = F.struct(F.col("_x").alias("x"), F.col("top"), F.col(box_id).alias("id"), F.col("text").alias("text"))
    line = b.groupBy(*k, "_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "").alias("line"), F.sum("score").alias("s"), F.count("*").alias("n"))
    return line.groupBy(*k).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", "line"))), lambda r: r["line"]), "\n").alias("text"), (F.sum("s") / F.sum("n")).alias("confidence")
    )


def suspects(df: DataFrame, k: list[str], order: list, needs_review: str, suspect: str, reasons: str) -> DataFrame:
    """Rows flagged in any way, with their rank among those of their key and the key's count."""
    flagged = F.coalesce(F.col(needs_review), F.lit(False)) | F.coalesce(F.col(suspect), F.lit(False)) | (F.size(F.coalesce(F.col(reasons), F.array().cast("array<string>"))) > 0)
    w = Window.partitionBy(*k)
    return df.where(flagged).withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("suspects", F.count("*").over(w))


def uncertainty_summary(df: DataFrame, k: list[str], frame: str, score: str, reason: str) -> DataFrame:
    """One line on the uncertain rows of each key: count, frames, scores, histogram of reasons."""
    per = df.groupBy(*k, reason).agg(F.count("*").alias("n"), F.min(frame).alias("lo"), F.max(frame).alias("hi"), F.min(score).alias("smin"), F.max(score).alias("smax"))
    hist = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(reason) != "", F.struct(F.col(reason).alias("r"), "n")))), lambda x: F.concat(x["r"], F.lit(":"), x["n"].cast("string"))), ",")
    whole = per.groupBy(*k).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("smin").alias("smin"), F.max("smax").alias("smax"), hist.alias("hist"))
    return whole.select(*k, F.format_string("count=%d frames=[%d,%d] score=[%.4f,%.4f] reasons=%s", "n", "lo", "hi", "smin", "smax", "hist").alias("summary"))


def first_seen_distinct(df: DataFrame, k: list[str], value: str, pos: str) -> DataFrame:
    """(k, values): the distinct values that aren't empty, as first seen."""
    per = df.where(sc.text(value) != "").groupBy(*k, sc.text(value).alias("v")).agg(F.min(pos).alias("p"))
    return per.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x["v"]).alias("values"))


def chunk(df: DataFrame, k: list[str], order: list, n: int) -> DataFrame:
    """Adds ``chunk``: consecutive rows by n; all in one for n <= 0."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*k).orderBy(*order)) - 1) / n) if n > 0 else F.lit(0).cast("long"))


def default_start(df: DataFrame, k: list[str], ident: str, kind: str, start: str, length: float = 2.0) -> DataFrame:
    """(k, start, end): where a title goes by default: at the first row, else at any that is no title, else at 0."""
    s = F.coalesce(F.min(F.when(F.col(ident) == 1, F.col(start))), F.min(F.when(F.lower(sc.text(kind)) != "title", F.col(start))), F.lit(0.0))
    return df.groupBy(*k).agg(s.alias("start")).withColumn("end", F.col("start") + length)


def review_report(updates: DataFrame, k: list[str], errors: DataFrame) -> DataFrame:
    """(k, updates, changed, parse_errors, failed): counts, and the chunks that could not be parsed."""
    u = updates.groupBy(*k).agg(F.count("*").alias("updates"), F.count_if("changed").alias("changed"))
    e = errors.groupBy(*k).agg(F.count("*").alias("parse_errors"), F.array_sort(F.collect_list("chunk")).alias("failed"))
    return u.join(e, k, "full").select(*k, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("updates", "changed", "parse_errors")], F.coalesce("failed", F.array().cast("array<bigint>")).alias("failed"))


def normalize_subsegments(df: DataFrame, k: list[str], order: list, ident: str) -> DataFrame:
    """One leading blank (if any) and one dialogue for each run of equal marker ids.

    The dialogue goes from the first part with a name to the run's end and takes its
    middle frame as sample; a run without names becomes one blank.
    """
    w = Window.partitionBy(*k).orderBy(*order)
    d = df.withColumn("_turn", F.coalesce((F.col(ident) != F.lag(ident).over(w)).cast("int"), F.lit(0))).withColumn("_pos", F.row_number().over(w))
    d = d.withColumn("_run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*k, "_run")
    d = d.withColumn("_talk", F.coalesce(F.col("_pos") >= F.min(F.when(F.col("has_name"), F.col("_pos"))).over(run), F.lit(False)))
    last = F.max_by("frame_end", "_pos")
    reasons = F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("review_reason", F.array().cast("array<string>")).alias("r")))), lambda x: x["r"])
    out = d.groupBy(*k, "_run", F.col("_talk").alias("has_name")).agg(F.first(ident).alias(ident), F.min_by("frame_start", "_pos").alias("frame_start"), last.alias("frame_end"), sc.merge_reasons(F.flatten(reasons)).alias("review_reason"))
    middle = F.col("frame_start") + F.floor((F.col("frame_end") - F.col("frame_start")) / 2)
    return out.withColumn("sample", F.when(F.col("has_name"), middle)).drop("_run")


# --- ranks and sets ---------------------------------------------------------------


def run_kind(name, prefixes=("run_full_", "run_cache_", "run_subtitle_", "run_")) -> Column:
    """The longest of the prefixes that a name starts with."""
    out = F.lit(None).cast("string")
    for p in sorted(prefixes, key=len):
        out = F.when(F.startswith(sc.col(name), F.lit(p)), p).otherwise(out)
    return out


def keep_latest(df: DataFrame, k: list[str], order: list, n: int) -> DataFrame:
    """Adds ``keep``: whether a row is one of the newest n of its key."""
    return df.withColumn("keep", F.row_number().over(Window.partitionBy(*k).orderBy(*order)) <= max(1, n))


def latest_artifact(files: DataFrame, k: list[str], path: str = "path", run: str = "run", mtime: str = "mtime", run_mtime: str = "run_mtime", is_cache: str = "is_cache", strict_latest_run: bool = False) -> DataFrame:
    """(k, path) of the newest cache file; or of the newest run's, null if that one has none."""
    if not strict_latest_run:
        return files.where(F.col(is_cache)).groupBy(*k).agg(F.max_by(path, F.struct(mtime, path)).alias(path))
    newest = files.groupBy(*k).agg(F.max(F.struct(run_mtime, run)).alias("_r"))
    mine = files.where(F.col(is_cache)).groupBy(*k, F.struct(run_mtime, run).alias("_r")).agg(F.max_by(path, F.struct(mtime, path)).alias(path))
    return newest.join(mine, [*k, "_r"], "left").select(*k, path)


def archive_audit(expected: DataFrame, found: DataFrame, k: list[str], name: str = "artifact", path: str = "path", priority: str = "priority") -> DataFrame:
    """(k, present, missing, picks): what of the expected artefacts exists, each by its best candidate."""
    best = found.groupBy(*k, name).agg(F.min_by(path, F.struct(priority, path)).alias(path))
    j = expected.join(best, [*k, name], "left")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return j.groupBy(*k).agg(F.count(path).alias("present"), listed(F.when(F.col(path).isNull(), F.col(name))).alias("missing"), listed(F.concat(F.col(name), F.lit("="), F.col(path))).alias("picks"))


def upsert_title(entries: DataFrame, titles: DataFrame, k: list[str], ident: str = "id") -> DataFrame:
    """Entries with their titles (id 0) replaced by the given ones."""
    old = entries.join(titles.select(*k).distinct().withColumn(ident, F.lit(0)), [*k, ident], "left_anti")
    return union_all(old, titles)


def title_order(ident: str = "id", start: str = "start") -> list:
    return [F.col(start), F.col(ident) != 0, F.col(ident)]


def carry_over(new: DataFrame, old: DataFrame, k: list[str], ident: str = "id") -> DataFrame:
    """Titles (id 0) of the old entries, then the new rows: ``source`` 0 and 1."""
    return union_all(old.where(F.col(ident) == 0).withColumn("source", F.lit(0)), new.withColumn("source", F.lit(1)))


def keep_first(df: DataFrame, k: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*k).orderBy(*order))).where("_n = 1").drop("_n")


def unique_names(df: DataFrame, name: str, order: list, out: str = "unique_name") -> DataFrame:
    """Equal names get _2, _3 and so on, by order.

    A suffixed name that is already taken is numbered on: rows that clash with a
    name fixed before try the next numbers, until none clashes; each such round is
    written to the shared folder.
    """
    w = Window.partitionBy(name).orderBy(*order)
    named = lambda: F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), F.col("_n").cast("string")))
    own = Window.partitionBy(out).orderBy(F.col("_n") != 1, F.col("_n"), *order)
    df = df.withColumn("_n", F.row_number().over(w)).withColumn(out, named()).withColumn("_c", F.row_number().over(own) > 1)
    while df.where("_c").limit(1).count():
        bump = F.sum(F.col("_c").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn("_n", F.col("_n") + bump).withColumn(out, named()).withColumn("_c", F.row_number().over(own) > 1)
        path = shared_path(df.sparkSession, "names")
        df.write.parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
    return df.drop("_n", "_c")
