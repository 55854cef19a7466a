"""End to end: subtitles from stored entries, and a timeline from frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanline.functions import scalars as sc
from spanline.operators import lookup as lk
from spanline.operators import segments as sg
from spanline.operators import sequence as seq
from spanline.operators.infer import Policy, batch_infer
from spanline.operators.render import entry_style, render_events
from spanline.operators.review import coerce_entries, review_metadata
from spanline.sources.shared import kept


def subtitles_from_cache(cache: DataFrame, layout: dict, styles: DataFrame | None = None, base: Column | None = None, debug: bool = False, timeline_only: bool = False) -> DataFrame:
    """Lines of each project's subtitle file from its stored entries.

    ``styles(speaker, outline_colour)`` are matched to speakers by name.  With
    ``timeline_only`` texts are left out and the labels shown.
    """
    e = coerce_entries(cache, ["project"], ["pos"])
    e = e.withColumn("label", sc.debug_label("segment_id", "raw_id", "time_start", "time_end", "dialogue_type", "seen", "times"))
    if timeline_only:
        e = e.withColumns({"speaker": F.lit(""), "text_original": F.lit(""), "translation_subtitle": F.col("label")})
    if styles is None:
        e = e.withColumn("style", entry_style())
    else:
        e = lk.resolve_dimension(e, "speaker", styles, "speaker")
        e = e.join(styles.select(F.trim("speaker").alias("match"), F.col("outline_colour").alias("_c")), "match", "left")
        e = e.withColumn("style", entry_style(outline_colour=F.when(F.lower("dialogue_type") != "title", F.col("_c"))))
    e = e.withColumnsRenamed({"segment_id": "id", "time_start": "start", "time_end": "end", "dialogue_type": "kind", "text_original": "original", "translation_subtitle": "translation"})
    return render_events(e, ["project"], layout, base, debug)


def timeline(frames: DataFrame, k: list[str], order: list, score: str, cfg: dict, confirm: str | None = None, cache: DataFrame | None = None, infer: Callable | None = None, policy: Policy | None = None) -> DataFrame:
    """Entries from a keyed score series: segments between marker disappearances, refined into blank and
    dialogue, looked up in ``cache``, and the rest given to ``infer``.

    cfg: threshold, fps, and optionally smooth, min_on, min_off, probe_frames,
    probe_hits, gap, min_blank.  ``confirm`` names the second score series.
    Without ``infer`` misses stay without text: the timeline alone.
    """
    f = kept(seq.positions(frames, k, order, "idx"), "frames")
    raw = seq.marker_segments(frames, k, order, score, cfg["threshold"], cfg.get("smooth", 1), True, cfg.get("min_on", 2), cfg.get("min_off", 2), fps=cfg["fps"])
    raw = kept(raw.withColumn("segment_id", F.row_number().over(seq.by(k, ["frame_start"]))), "raw")
    parts = sg.split_blank_dialogue(raw, f, k, confirm or score, cfg.get("confirm_threshold", cfg["threshold"]), cfg["fps"], cfg.get("probe_frames", 5), cfg.get("probe_hits", 4), cfg.get("gap", 2), cfg.get("min_blank", 2), merge=True)
    e = parts.withColumnRenamed("segment_id", "raw_id").withColumn("segment_id", F.row_number().over(seq.by(k, ["frame_start", "frame_end"])))
    e = e.withColumns({"start": F.col("frame_start") / cfg["fps"], "end": F.col("frame_end") / cfg["fps"], "kind": F.when(F.col("has_name"), "speaker_dialogue").otherwise("blank_no_name")})
    if cache is not None:
        e = lk.cache_lookup(e, cache, k, fuzz_frames=cfg.get("fuzz_frames", 0), fps=cfg["fps"])
    else:
        e = e.withColumns({"hit": F.lit(None).cast("string"), "cached_speaker": F.lit(None).cast("string"), "cached_original": F.lit(None).cast("string"), "cached_translation": F.lit(None).cast("string")})
    e = e.withColumnsRenamed({"cached_speaker": "speaker", "cached_original": "text_original", "cached_translation": "translation_subtitle"})
    if infer is not None:
        e = e.withColumn("request", F.to_json(F.struct(*k, "segment_id", "start", "end", "sample")))
        ask = (F.col("hit").isNull()) & (F.col("kind") == "speaker_dialogue")
        done = batch_infer(e.where(ask), infer, "request", policy)
        key = [*k, "segment_id"]
        e = e.join(done.select(*key, "result", "reason").hint("merge"), key, "left").withColumn("translation_subtitle", F.coalesce("translation_subtitle", "result"))
        e = e.withColumn("review_reason", sc.merge_reasons("review_reason", F.array("reason"))).drop("request", "result", "reason")
    e = e.withColumnsRenamed({"start": "time_start", "end": "time_end", "kind": "dialogue_type"}).withColumn("raw_id", F.col("raw_id").cast("string"))
    return review_metadata(e)
