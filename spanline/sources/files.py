"""Stored entries, score series and subtitle files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanline.functions import scalars as sc
from spanline.operators.lookup import resolve_dimension
from spanline.operators.review import review_metadata
from spanline.operators.sequence import by
from spanline.sources.documents import write_documents

STYLE = "struct<" + ",".join(f"{f}:string" for f in ("font_name", "font_size", "font_size_scale", "primary_colour", "secondary_colour", "outline_colour", "back_colour", "bold", "italic", "outline", "shadow", "alignment")) + ">"
ENTRY = (
    "struct<segment_id:string,raw_id:string,time_start:double,time_end:double,dialogue_type:string,speaker:string,text_original:string,translation_subtitle:string,"
    f"subtitle_style:{STYLE},needs_review:boolean,review_reason:array<string>,auto_review_reason:string,debug_subtitle:string,review_reasons:array<string>,suspect:boolean>"
)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(project, video, pos, fields of ENTRY): entries of all cache documents below ``path``.

    A document is an object with entries, or a bare list of them; what isn't an
    object is skipped, and start / end texts of old files are left out.  The file's
    name is the project.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("project"))
    doc = F.try_parse_json("value")
    d = raw.withColumn("doc", doc).where("doc IS NOT NULL")
    entries = F.coalesce(F.try_variant_get("doc", "$.entries", "array<variant>"), F.try_variant_get("doc", "$", "array<variant>"))
    d = d.select("project", F.try_variant_get("doc", "$.video", "string").alias("video"), F.posexplode(entries).alias("pos", "e"))
    d = d.where(F.startswith(F.schema_of_variant("e"), F.lit("OBJECT")))
    e = F.from_json(F.to_json("e"), ENTRY)
    return d.select("project", "video", "pos", e.alias("e")).select("project", "video", "pos", "e.*")


def with_styles(entries: DataFrame, styles: DataFrame) -> DataFrame:
    """Dialogue rows without a style of their own get their speaker's, as ``subtitle_style``; ambiguous matches get a reason.

    styles(speaker, style fields), fields that styles lack are null.
    """
    fields = [f for f in STYLE.removeprefix("struct<").removesuffix(">").replace(":string", "").split(",")]
    named = styles.select(F.trim("speaker").alias("match"), F.struct(*[(F.col(f).cast("string") if f in styles.columns else F.lit(None).cast("string")).alias(f) for f in fields]).alias("_style"))
    named = named.groupBy("match").agg(F.min("_style").alias("_style"))
    d = resolve_dimension(entries, "speaker", styles, "speaker").join(named, "match", "left")
    own = F.col("subtitle_style") if "subtitle_style" in entries.columns else F.lit(None).cast(STYLE)
    empty = own.isNull() | F.coalesce(*[F.nullif(F.trim(own[f]), F.lit("")) for f in fields]).isNull()
    todo = empty & sc.is_dialogue("dialogue_type")
    stored = ["review_reason"] if "review_reason" in entries.columns else []
    why = F.array(F.when(todo & F.col("ambiguous"), "speaker_style_ambiguous"))
    d = d.withColumns({"subtitle_style": F.when(todo, F.col("_style")).otherwise(own), "review_reason": sc.merge_reasons(*stored, why)})
    return d.drop("match", "ambiguous", "_style")


def write_cache(entries: DataFrame, path: str, project: str = "project", meta: dict | None = None, styles: DataFrame | None = None) -> None:
    """One JSON document per project below ``path``/project=...: header fields and ordered entries.

    With ``styles`` speakers' styles are resolved first, see :func:`with_styles`.
    Review metadata is computed anew.  Entries stream into their project's document.
    """
    e = review_metadata(entries if styles is None else with_styles(entries, styles))
    fields = [c for c in e.columns if c not in (project, "pos", "video")]
    rows = e.select(project, "pos", F.to_json(F.struct(*fields)).alias("value"))
    head = json.dumps({"version": 1} | (meta or {}), ensure_ascii=False).removesuffix("}") + ', "entries": ['
    write_documents(rows, path, project, ["pos"], "value", "document.json", head, ",\n", "]}")


def checkpoint_segments(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_segments(spark: SparkSession, path: str, k: list[str], order: list) -> DataFrame:
    """Segments with the ids that are missing filled from each other, else by position."""
    return backfill_ids(spark.read.parquet(path), k, order)


def backfill_ids(df: DataFrame, k: list[str], order: list) -> DataFrame:
    n = F.row_number().over(by(k, order))
    marker, own = F.coalesce("marker_seg_id", "segment_id", n), F.coalesce("segment_id", "marker_seg_id", n)
    return df.withColumns({"_m": marker, "_s": own}).drop("marker_seg_id", "segment_id").withColumnsRenamed({"_m": "marker_seg_id", "_s": "segment_id"})


def pack_series(df: DataFrame, k: list[str], pos: str, value: str) -> DataFrame:
    """One row per range, its scores an array by position."""
    return df.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda x: x[value]).alias("scores"))


def unpack_series(df: DataFrame, scores: str = "scores", start: str = "start_sec", fps: str = "scan_fps") -> DataFrame:
    """One row per score, with pos and ts."""
    rest = [c for c in df.columns if c != scores]
    return df.select(*rest, F.posexplode(scores).alias("pos", "score")).withColumn("ts", F.col(start) + F.col("pos") / F.col(fps))


def write_subtitles(lines: DataFrame, path: str, project: str = "video_id") -> None:
    """One text file per project below ``path``, its lines by (section, pos, sub)."""
    write_documents(lines, path, project, ["section", "pos", "sub"], "line", "subtitles.ass", "", "\n", "\n")


def from_conversations(df: DataFrame) -> DataFrame:
    """Conversations as stored entries: turn 0 is the title."""
    t = F.col("turn")
    return df.select(
        F.col("conv_id").alias("project"), t.alias("pos"), t.cast("string").alias("segment_id"), F.lit(None).cast("string").alias("raw_id"), (t * 2.0).alias("time_start"), (t * 2.0 + 1.5).alias("time_end"),
        F.when(t == 0, "title").when(F.col("role") == "system", "blank_no_name").otherwise("speaker_dialogue").alias("dialogue_type"), F.col("role").alias("speaker"), F.col("text").alias("text_original"),
        F.col("text").alias("translation_subtitle"),
    )
