"""Review: stored entries, their metadata, correction requests and results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanline.functions import scalars as sc
from spanline.operators.aggregates import chunk
from spanline.operators.infer import Policy, batch_infer
from spanline.operators.lookup import apply_updates, validate_updates
from spanline.operators.sequence import occurrence, positions

EMPTY = "array<string>"


def coerce_entries(df: DataFrame, k: list[str], order: list) -> DataFrame:
    """Entries with defaults: id := position, end := start, type := speaker_dialogue, raw_id := id; quotes
    normalised, lines counted, and each raw id's occurrence (seen, times)."""
    d = positions(df, k, order, "_p")
    sid = F.coalesce(F.col("segment_id").try_cast("long"), F.col("_p") + 1)
    raw = F.trim(F.col("raw_id").cast("string"))
    start = F.coalesce(F.col("time_start").try_cast("double"), F.lit(0.0))
    d = d.withColumns({
        "segment_id": sid,
        "raw_id": F.when(raw == sc.MANUAL, raw).otherwise(F.coalesce(raw.try_cast("long"), sid).cast("string")),
        "time_start": start,
        "time_end": F.coalesce(F.col("time_end").try_cast("double"), start),
        "dialogue_type": F.coalesce(F.nullif("dialogue_type", F.lit("")), F.lit("speaker_dialogue")),
        "speaker": F.coalesce("speaker", F.lit("")),
        "text_original": F.coalesce("text_original", F.lit("")),
        "translation_subtitle": sc.normalize_quotes("translation_subtitle"),
    })
    d = d.withColumn("line_count", sc.line_count("translation_subtitle"))
    return occurrence(d, k, ["_p"], "raw_id").drop("_p")


def review_metadata(df: DataFrame, sticky_flag: bool = False) -> DataFrame:
    """Reasons recomputed: stored ones and flags of the translation; needs_review follows them.

    ``sticky_flag`` keeps the flag of rows marked suspect or flagged before.
    Legacy columns are dropped.
    """
    have = set(df.columns)
    debug = sc.debug_label("segment_id", "raw_id", "time_start", "time_end", "dialogue_type", legacy="debug_subtitle" if "debug_subtitle" in have else None)
    stored = [c for c in ("review_reason", "review_reasons") if c in have]
    reasons = sc.merge_reasons(*stored, sc.translation_flags("dialogue_type", "text_original", "translation_subtitle", debug))
    flag = F.size("_r") > 0
    if sticky_flag:
        for c in ("suspect", "needs_review"):
            if c in have:
                flag = flag | F.coalesce(F.col(c), F.lit(False))
    out = df.withColumn("_r", reasons).withColumn("needs_review", flag)
    return out.drop("review_reason", "review_reasons", "srt_start", "srt_end", "auto_review_reason", "debug_subtitle", "suspect").withColumnRenamed("_r", "review_reason")


def review_export(df: DataFrame) -> DataFrame:
    """The columns that reviewers get."""
    return df.select(
        "segment_id", "raw_id", "time_start", "time_end", "dialogue_type", "speaker", "text_original", "translation_subtitle", "line_count",
        F.col("text_ocr_confidence").alias("confidence"), "needs_review", "review_reason", "keyframe",
    )


def build_requests(df: DataFrame, template: dict[str, str], sections: list[tuple[str, str | Column]] = (), images: list[str] = ()) -> DataFrame:
    """Adds ``request``: a chat payload rendered from each row, as JSON.

    ``template`` holds texts for the roles system and user with {column}
    placeholders; ``sections`` (title, column) follow the system text where they
    aren't empty; ``images`` are columns of image references that go before the text.
    """

    def fill(text: str) -> Column:
        import re

        parts = re.split(r"\{(\w+)\}", text)
        return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("")) for i, p in enumerate(parts)])

    system = fill(template["system"])
    for title, c in sections:
        body = sc.text(c)
        system = F.concat(system, F.when(body != "", F.concat(F.lit(f"\n### {title}\n"), body)).otherwise(""))
    user = fill(template["user"])
    if images:
        parts = [F.struct(F.lit("image").alias("type"), F.col(c).cast("string").alias("value")) for c in images]
        user = F.to_json(F.array(*parts, F.struct(F.lit("text").alias("type"), user.alias("value"))))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return df.withColumn("request", F.to_json(F.struct(F.array(message("system", system), message("user", user)).alias("messages"))))


def eligible(entries: DataFrame, ident: str = "id") -> DataFrame:
    """Dialogue rows with a positive id and both texts."""
    return entries.where(sc.is_dialogue("kind") & (F.col(ident) > 0) & (sc.text("original") != "") & (sc.text("translation") != ""))


def auto_review(entries: DataFrame, fn: Callable, k: list[str], template: dict[str, str], size: int = 20, policy: Policy | None = None, ident: str = "id", repairs: int = 1) -> dict[str, DataFrame]:
    """Review in chunks: {"entries", "updates", "errors"}.

    Eligible rows go to ``fn`` by chunks of ``size``; replies are searched for JSON
    {"updates": [{id, translation, reason}]}; one that has none goes to ``fn`` again
    up to ``repairs`` times, and a chunk that stays without counts as an error and
    changes nothing.  Chunks are independent and run in parallel.
    """
    rows = chunk(eligible(entries, ident), k, [ident], size)
    item = F.struct(F.col(ident).alias("id"), "speaker", "original", "translation")
    batch = rows.groupBy(*k, "chunk").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("items"), F.min(ident).alias("first"), F.max(ident).alias("last"))
    asked = build_requests(batch, template).drop("items")  # the request has them
    reply = batch_infer(asked, fn, "request", policy)
    parsed = sc.extract_json(reply, "result", "json").withColumn("_ok", _has_updates("json"))
    for _ in range(repairs):
        again = batch_infer(parsed.where("NOT _ok").select(*k, "chunk", F.concat(F.lit("repair: "), F.coalesce("result", F.lit(""))).alias("request")), fn, "request", policy)
        again = sc.extract_json(again, "result", "fixed").select(*k, "chunk", "fixed")
        parsed = parsed.join(again, [*k, "chunk"], "left").withColumn("json", F.when(F.col("_ok"), F.col("json")).otherwise(F.col("fixed"))).drop("fixed")
        parsed = parsed.withColumn("_ok", _has_updates("json"))
    body = F.from_json("json", "struct<updates:array<struct<id:long,translation:string,reason:string>>>")["updates"]
    raw = parsed.where("_ok").select(*k, "chunk", F.posexplode(body).alias("seq", "u")).select(*k, "chunk", "seq", F.col("u.id").alias(ident), "u.translation", "u.reason")
    old = rows.select(*k, "chunk", ident, "speaker", "original", "translation")
    updates = validate_updates(raw, old, [*k, "chunk"], ident)
    return {"entries": apply_updates(entries, updates, k, ident), "updates": updates, "errors": parsed.where("NOT _ok").select(*k, "chunk", "first", "last")}


def _has_updates(c: str) -> Column:
    return F.coalesce(F.startswith(F.ltrim(F.get_json_object(c, "$.updates")), F.lit("[")), F.lit(False))
