"""Refining segments against frame series, and scoring coarse to fine."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanline.functions import machine
from spanline.functions import scalars as sc
from spanline.operators import sequence as seq
from spanline.operators.chunks import Chunked
from spanline.operators.intervals import in_spans
from spanline.operators.union import union_all
from spanline.sources.shared import kept

#: Seconds from a segment's start to its head probe.
PROBE_AFTER = 0.16


def in_segments(segments: DataFrame, frames: DataFrame, k: list[str], start: str = "frame_start", end: str = "frame_end", merge: bool = False) -> DataFrame:
    """Frames of every segment: k, segment_id, idx and all columns of frames(k, idx, ...)."""
    return in_spans(frames, segments.select(*k, "segment_id", start, end), k, "idx", start, end, merge=merge)


# --- expressions over a segment's frames -----------------------------------------
#
# ``fr`` is an array of structs (idx, ...), sorted by idx: one segment's frames.


def packed(inside: DataFrame, key: list[str], *cols: str) -> DataFrame:
    """(key, fr): each key's frames in order, with the given columns.  Bounded by the length of a segment."""
    return inside.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("idx", *cols))).alias("fr"))


def with_frames(segments: DataFrame, frames: DataFrame, k: list[str], *cols: str, merge: bool = False) -> DataFrame:
    """Segments with ``fr``; it is empty for those without frames.  With ``merge`` nothing is sent to the driver (:func:`in_spans`)."""
    key = [*k, "segment_id"]
    fr = packed(in_segments(segments.select(*key, "frame_start", "frame_end"), frames.select(*k, "idx", *cols), k, merge=merge), key, *cols)
    out = segments.join(fr.hint("merge") if merge else fr, key, "left")
    return out.withColumn("fr", F.coalesce("fr", F.array().cast(out.schema["fr"].dataType)))


def is_on(x: Column, flag: str) -> Column:
    return F.coalesce(x[flag], F.lit(False))


def idx_where(fr: Column, test) -> Column:
    return F.transform(F.filter(fr, test), lambda x: x["idx"])


def probe_hits(fr: Column, flag: str, start: Column, end: Column, fps: float, n: int) -> Column:
    """Flags among n frames from a little after the start, within the segment."""
    first = F.least(end, start + max(0, round(PROBE_AFTER * fps)))
    last = F.least(end, first + (max(1, n) - 1))
    return F.size(F.filter(fr, lambda x: is_on(x, flag) & x["idx"].between(first, last))).cast("long")


def candidate_run(fr: Column, flag: str, gap: int, start: Column) -> Column:
    """struct(run_start, run_end) of the first run of two flags or more (of all, if there is but one frame); gaps are filled."""
    need = F.least(F.lit(2), F.size(fr))
    at = F.filter(F.transform(fr, lambda x, i: F.when(is_on(x, flag), i)), lambda p: p.isNotNull())
    long_enough = lambda r: r["e"] - r["s"] + 1 >= need
    run = lambda s, e: F.struct(s.alias("s"), e.alias("e"))

    def grow(r: Column, p: Column) -> Column:
        return F.when(p - r["e"] - 1 <= max(0, gap), run(r["s"], p)).when(long_enough(r), r).otherwise(run(p, p))

    none = F.lit(None).cast("int")
    first = F.aggregate(at, run(none, none), grow, lambda r: F.when(long_enough(r), r))
    return sc.let(first, lambda r: F.struct((r["s"] + start).alias("run_start"), (r["e"] + start).alias("run_end")))


def run_confidence(fr: Column, presence: str, s: Column, e: Column) -> Column:
    """struct(run_len, run_avg, run_min, before_avg, rise) of a run; the frames before are up to four, and no more than the run has."""

    def mean(values: Column) -> Column:
        some = F.filter(values, lambda v: v.isNotNull())
        return F.try_divide(F.aggregate(some, F.lit(0.0), lambda acc, v: acc + v), F.size(some))

    value = lambda test: F.transform(F.filter(fr, test), lambda x: x[presence].cast("double"))
    within = value(lambda x: x["idx"].between(s, e))
    before = value(lambda x: (x["idx"] < s) & (x["idx"] >= s - F.least(e - s + 1, F.lit(4))))
    parts = F.struct((e - s + 1).alias("run_len"), mean(within).alias("run_avg"), F.array_min(within).alias("run_min"), F.coalesce(mean(before), F.lit(0.0)).alias("before_avg"))
    return sc.let(parts, lambda p: F.struct(p["run_len"].alias("run_len"), p["run_avg"].alias("run_avg"), p["run_min"].alias("run_min"), p["before_avg"].alias("before_avg"), (p["run_avg"] - p["before_avg"]).alias("rise")))


def back_start(fr: Column, flag: str, step: int = 1) -> Column:
    """The start of the last true run, as a coarse backward scan sees it; null if it sees none.

    Points at ``step`` from the end, and the start, are looked at backwards; of
    their last block of trues the earliest one lies in the run that counts, which
    starts where it does in all frames.
    """
    lo, hi = F.get(fr, F.lit(0))["idx"], F.try_element_at(fr, F.lit(-1))["idx"]
    point = lambda x: ((hi - x["idx"]) % max(1, step) == 0) | (x["idx"] == lo)
    top = F.array_max(idx_where(fr, lambda x: point(x) & is_on(x, flag)))
    broken = lambda top: F.array_max(idx_where(fr, lambda x: point(x) & ~is_on(x, flag) & (x["idx"] < top)))
    block = lambda top, off: F.array_min(idx_where(fr, lambda x: point(x) & is_on(x, flag) & (x["idx"] <= top) & (x["idx"] > F.coalesce(off, lo - 1))))
    off_before = lambda first: F.array_max(idx_where(fr, lambda x: ~is_on(x, flag) & (x["idx"] < first)))
    begin = lambda first: F.array_min(idx_where(fr, lambda x: x["idx"] > F.coalesce(off_before(first), lo - 1)))
    return sc.let(top, lambda t: F.when(t.isNotNull(), sc.let(broken(t), lambda off: sc.let(block(t, off), begin))))


def fore_start(fr: Column, flag: str, step: int = 1) -> Column:
    """The first position with two trues in a row from where a coarse forward scan wakes up.

    Null if there is none, or if two falses or more trail at the end.
    """
    lo, hi = F.get(fr, F.lit(0))["idx"], F.try_element_at(fr, F.lit(-1))["idx"]
    point = lambda x: ((x["idx"] - lo) % max(1, step) == 0) | (x["idx"] == hi)
    hit = F.array_min(idx_where(fr, lambda x: point(x) & is_on(x, flag)))
    wake = lambda hit: F.coalesce(F.array_max(idx_where(fr, lambda x: point(x) & (x["idx"] < hit))) + 1, lo)
    next_on = lambda i: F.coalesce(F.get(fr, i + 1)[flag], F.lit(False))
    pairs = F.filter(F.transform(fr, lambda x, i: F.when(is_on(x, flag) & next_on(i), x["idx"])), lambda p: p.isNotNull())
    last_on = F.array_max(idx_where(fr, lambda x: is_on(x, flag)))
    found = lambda hit: sc.let(wake(hit), lambda w: F.array_min(F.filter(pairs, lambda p: p >= w)))
    return F.when(hi - last_on < 2, sc.let(hit, found))


def is_blank(fr: Column, flag: str, start: Column, end: Column, n: int = 3, need: int = 2, step: int = 3) -> Column:
    """Fewer than ``need`` flags among up to n frames from either end of an interval, step apart."""
    count = F.when(end < start, 0).otherwise(F.least(F.lit(n), F.floor((end - start) / step) + 1))
    near = lambda far: (far % step == 0) & (far >= 0) & (far / step < count)
    return F.size(F.filter(fr, lambda x: is_on(x, flag) & (near(x["idx"] - start) | near(end - x["idx"])))) < need


# --- operators -------------------------------------------------------------------


def head_probe(inside: DataFrame, k: list[str], flag: str, fps: float, n: int) -> DataFrame:
    """(k, segment_id, probe_hits) of :func:`probe_hits`, from the frames within segments."""
    key = [*k, "segment_id"]
    return packed(inside, [*key, "frame_start", "frame_end"], flag).select(*key, probe_hits(F.col("fr"), flag, F.col("frame_start"), F.col("frame_end"), fps, n).alias("probe_hits"))


def boundary_confidence(inside: DataFrame, k: list[str], presence: str, run_start: str, run_end: str) -> DataFrame:
    """(k, segment_id, run_len, run_avg, run_min, before_avg, rise) of :func:`run_confidence`."""
    key = [*k, "segment_id"]
    return packed(inside, [*key, run_start, run_end], presence).select(*key, run_confidence(F.col("fr"), presence, F.col(run_start), F.col(run_end)).alias("c")).select(*key, "c.*")


def last_run_start(flags: DataFrame, k: list[str], flag: str, step: int = 1) -> DataFrame:
    """(k, found) of :func:`back_start`; flags(k, idx, flag) is one range per key."""
    return packed(flags, k, flag).select(*k, back_start(F.col("fr"), flag, step).alias("found"))


def first_durable_run(flags: DataFrame, k: list[str], flag: str, step: int = 1) -> DataFrame:
    """(k, found) of :func:`fore_start`."""
    return packed(flags, k, flag).select(*k, fore_start(F.col("fr"), flag, step).alias("found"))


def blank_confirmed(segments: DataFrame, frames: DataFrame, k: list[str], flag: str, n: int = 3, need: int = 2, step: int = 3) -> DataFrame:
    """(k, segment_id, confirmed) of :func:`is_blank`; an interval without frames is confirmed."""
    confirmed = is_blank(F.col("fr"), flag, F.col("frame_start"), F.col("frame_end"), n, need, step)
    return with_frames(segments, frames, k, flag).select(*k, "segment_id", confirmed.alias("confirmed"))


def _parts(df: DataFrame, k: list[str], split: Column, reasons: Column, *more: str) -> DataFrame:
    """A whole segment, or its blank and dialogue parts where ``split`` isn't null; samples are the dialogue's middle."""
    whole = F.struct(F.col("frame_start").alias("s"), F.col("frame_end").alias("e"), F.lit(True).alias("talk"))
    two = F.array(F.struct(F.col("frame_start").alias("s"), (split - 1).alias("e"), F.lit(False).alias("talk")), F.struct(split.alias("s"), F.col("frame_end").alias("e"), F.lit(True).alias("talk")))
    out = df.select(*k, "segment_id", F.explode(F.when(split.isNull(), F.array(whole)).otherwise(two)).alias("p"), reasons.alias("review_reason"), *more)
    middle = F.col("p.s") + F.floor((F.col("p.e") - F.col("p.s")) / 2)
    return out.select(*k, "segment_id", F.col("p.s").alias("frame_start"), F.col("p.e").alias("frame_end"), F.col("p.talk").alias("has_name"), F.when(F.col("p.talk"), middle).alias("sample"), "review_reason", *more)


def with_anchor(segments: DataFrame) -> DataFrame:
    """Adds the anchor: the first sample, else the end, within the segment."""
    return segments.withColumn("anchor", F.greatest("frame_start", F.least("frame_end", F.coalesce("sample", "frame_end"))))


def split_blank_dialogue(segments: DataFrame, frames: DataFrame, k: list[str], score: str, threshold: float, fps: float, probe_frames: int = 5, probe_least: int = 4, gap: int = 2, min_blank: int = 2, merge: bool = False) -> DataFrame:
    """Segments cut into a blank and a dialogue part by a second score series.

    Whole if the head probe hits; else the dialogue starts at the first durable run
    of flags up to the anchor.  Without one the segment stays whole, with a reason;
    also whole if the blank part would be shorter than ``min_blank``.
    segments(k, segment_id, frame_start, frame_end, sample), frames(k, idx, score).
    """
    frames = frames.select(*k, "idx", F.col(score).alias("_score"), F.coalesce(F.col(score) >= threshold, F.lit(False)).alias("_flag"))
    s = with_frames(with_anchor(segments), frames, k, "_score", "_flag", merge=merge)
    s = s.withColumn("_upto", F.filter("fr", lambda x: x["idx"] <= F.col("anchor")))
    scores = F.transform("_upto", lambda x: x["_score"])
    s = s.withColumns({
        "_hits": probe_hits(F.col("fr"), "_flag", F.col("frame_start"), F.col("frame_end"), fps, probe_frames),
        "_run": candidate_run(F.col("_upto"), "_flag", gap, F.col("frame_start")),
        "_lo": F.array_min(scores), "_hi": F.array_max(scores),
    })
    probed, start = F.col("_hits") >= max(1, probe_least), F.col("_run.run_start")
    split = F.when(~probed & (start - F.col("frame_start") >= max(1, min_blank)), start)
    why = F.format_string(f"marker2_boundary_unconfirmed:score=[%.4f,%.4f] threshold={threshold:.4f}", "_lo", "_hi")
    reasons = F.when(~probed & start.isNull() & F.col("_lo").isNotNull(), F.array(why)).otherwise(F.array().cast("array<string>"))
    return _parts(s, k, split, reasons)


def split_by_presence(
    segments: DataFrame, frames: DataFrame, k: list[str], mask: str, confirm: str | None, fps: float,
    probe_frames: int = 5, probe_least: int = 4, gap: int = 2, min_blank: int = 2, lookback: int = 6, step: int = 1,
    verify_frames: int = 3, verify_hits: int = 2, mask_fallback: bool = False,
    presence: str | None = None, split_presence: float = 0.0, split_run: int = 2, split_rise: float = 0.002,
) -> DataFrame:
    """Segments cut into blank and dialogue by name presence: adds ``outcome``.

    ``mask`` flags propose a boundary; ``confirm`` flags, of the better detector,
    look for it forward from a little before, then backward; without ``confirm`` the
    proposal counts if run length, mean and rise of ``presence`` allow.  The blank
    part must be long enough and hold few confirmed frames.  Outcomes: probe,
    miss, low, short, unconfirmed, not_blank, split, split_fallback.

    A segment's frames are gathered once and all is decided within its row.
    """
    seen = confirm or mask
    cols = list(dict.fromkeys(c for c in (mask, confirm, presence) if c))
    s = with_frames(with_anchor(segments), frames, k, *cols)
    s = s.withColumn("_upto", F.filter("fr", lambda x: x["idx"] <= F.col("anchor")))
    s = s.withColumns({
        "_hits": probe_hits(F.col("fr"), seen, F.col("frame_start"), F.col("frame_end"), fps, probe_frames),
        "_run": candidate_run(F.col("_upto"), mask, gap, F.col("frame_start")),
        "_back": back_start(F.col("_upto"), seen, step),
    })
    start, end = F.col("_run.run_start"), F.col("_run.run_end")
    low, fallback = F.lit(False), F.lit(False)
    if confirm:
        begin = F.greatest("frame_start", start - max(0, lookback))
        s = s.withColumn("_fore", F.when(start.isNotNull(), fore_start(F.filter("_upto", lambda x: x["idx"] >= begin), seen, step)))
        if mask_fallback:
            fallback = (end - start + 1 >= max(2, min(3, probe_least))) & (F.col("anchor") - end <= max(0, gap))
    else:
        s = s.withColumn("_fore", start)
        if presence:
            s = s.withColumn("_conf", run_confidence(F.col("_upto"), presence, start, end))
            conf = lambda f: F.col(f"_conf.{f}")
            low = (conf("run_len") < max(1, split_run)) | (conf("run_avg") < split_presence) | ((start > F.col("frame_start")) & (conf("rise") < split_rise))
    found = F.coalesce("_fore", "_back", F.when(fallback, start))
    s = s.withColumn("_at", F.when(start.isNull(), F.col("_back")).otherwise(found))
    s = s.withColumn("_blank", is_blank(F.col("fr"), seen, F.col("frame_start"), F.col("_at") - 1, verify_frames, verify_hits))
    need = max(1, min_blank)
    outcome = (
        F.when(F.col("_hits") >= max(1, probe_least), "probe")
        .when(start.isNull() & F.col("_at").isNull(), "miss")
        .when(start.isNotNull() & F.coalesce(low, F.lit(False)), "low")
        .when(start.isNotNull() & (start - F.col("frame_start") < need), "short")
        .when(F.col("_at").isNull(), "unconfirmed")
        .when(F.col("_at") - F.col("frame_start") < need, "short")
        .when(~F.col("_blank"), "not_blank")
        .when(start.isNotNull() & F.col("_fore").isNull() & F.col("_back").isNull(), "split_fallback")
        .otherwise("split")
    )
    s = s.withColumn("outcome", outcome)
    tags = {"miss": "name_split_boundary_unconfirmed:mask_miss_and_backward_" + ("ocr" if confirm else "mask") + "_failed", "low": "name_mask_low_confidence_candidate", "unconfirmed": "name_ocr_boundary_unconfirmed:forward_backward_ocr_both_failed", "not_blank": "name_split_blank_confirm_failed", "split_fallback": "name_ocr_boundary_fallback:mask_candidate_after_ocr_failed"}
    table = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    reasons = sc.merge_reasons(F.array(F.try_element_at(table, F.col("outcome"))))
    return _parts(s, k, F.when(F.startswith("outcome", F.lit("split")), F.col("_at")), reasons, "outcome")


def percentiles(df: DataFrame, k: list[str], c: str, q: float, out: str) -> DataFrame:
    """(k, out): the percentile of each key's values that aren't null, between the two next to it.

    The sum of their shares is rounded once, as in DuckDB's quantile_cont: comparisons
    at the very margin hang on the last bit, and Spark's percentile rounds both products.
    """
    w = Window.partitionBy(*k)
    place = (F.count(c).over(w) - 1) * F.lit(q)
    d = df.select(*k, F.col(c).alias("_v"), (F.row_number().over(w.orderBy(F.col(c).asc_nulls_last())) - 1).alias("_at"), place.alias("_place"))
    at = lambda side: F.max(F.when(F.col("_at") == side("_place"), F.col("_v")))
    d = d.groupBy(*k).agg(at(F.floor).alias("_lo"), at(F.ceil).alias("_hi"), F.max(F.col("_place") - F.floor("_place")).alias("_part"))
    both = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), F.col("_lo"), 1 - F.col("_part"), F.col("_hi") * F.col("_part")).cast("double")
    return d.select(*k, F.when((F.col("_part") == 0) | F.col("_lo").isNull(), F.col("_lo")).otherwise(both).alias(out))


def coarse_to_fine(df: DataFrame, k: list[str], order: list, score: Column, step: int, margin: float, threshold: float | None = None) -> DataFrame:
    """Adds score and ``computed``: every step-th row is scored, and more only near changes.

    ``score`` may be a costly Python function: it is evaluated on the rows that are
    needed, once each, in three passes whose results are written.  First on anchors
    (every step-th row and the last), then on the middles of calm intervals, then on
    the rows of intervals whose ends differ, lie within ``margin`` of the threshold, or
    whose middle does.  The rows of calm intervals take the nearer end's score.  The
    threshold is the 70th percentile of the anchors if none is given.

    A row is found by its key and place; an interval by the place of its left anchor.
    """
    step, margin = max(1, step), max(0.01, margin)

    w = Window.partitionBy(*k)
    d = seq.positions(df, k, order, "_p").withColumn("_n", F.count("*").over(w))
    d = d.withColumn("_step", F.when(F.col("_n") <= step + 1, 1).otherwise(step))
    d = kept(d.withColumn("_left", F.col("_p") - F.col("_p") % F.col("_step")), "series")
    at = [*k, "_p"]
    anchor = (F.col("_p") == F.col("_left")) | (F.col("_p") == F.col("_n") - 1)
    anchors = kept(d.where(anchor).select(*at, "_left", score.cast("double").alias("score")), "anchors")
    # Intervals between neighbouring anchors; the last anchor begins none.
    nxt = lambda c: F.lead(c).over(w.orderBy("_p"))
    spans = anchors.select(*k, "_p", F.col("score").alias("_ls"), nxt("_p").alias("_right"), nxt("score").alias("_rs")).where("_right IS NOT NULL")
    if threshold is None:
        levels = percentiles(anchors, k, "score", 0.7, "_thr")
        spans = same(spans, levels, k)
    else:
        spans = spans.withColumn("_thr", F.lit(float(threshold)))
    on = lambda x: F.col(x) >= F.col("_thr")
    near = lambda x: F.abs(F.col(x) - F.col("_thr")) <= margin
    spans = spans.withColumn("_rough", (on("_ls") != on("_rs")) | near("_ls") | near("_rs"))
    spans = kept(spans.withColumn("_mid", F.col("_p") + F.floor((F.col("_right") - F.col("_p")) / 2)), "spans")
    calm = spans.where("NOT _rough AND _mid > _p").select(*k, F.col("_mid").alias("_p"))
    middles = kept(same(d, calm, at, "left_semi").select(*at, "_left", score.cast("double").alias("score")), "middles")
    seen = middles.select(*k, F.col("_left").alias("_p"), F.col("score").alias("_ms"))
    spans = same(spans, seen, at, "left").withColumn("_rough", F.col("_rough") | F.coalesce(near("_ms") | (on("_ms") != on("_ls")), F.lit(False)))
    spans = kept(spans.withColumnRenamed("_p", "_left").select(*k, "_left", "_right", "_ls", "_rs", "_rough", F.col("_ms").isNotNull().alias("_seen"), "_mid"), "decided")
    rough = spans.where("_rough").select(*k, "_left", F.when(F.col("_seen"), F.col("_mid")).alias("_done"))
    rest = same(d.where(~anchor), rough, [*k, "_left"]).where("_done IS NULL OR _p <> _done")
    fine = kept(rest.select(*at, score.cast("double").alias("score")), "fine")
    known = union_all(anchors.select(*at, "score"), middles.select(*at, "score"), fine).select(*at, F.col("score").alias("_score"), F.lit(True).alias("_scored"))
    out = same(same(d, known, at, "left"), spans.where("NOT _rough").select(*k, "_left", "_right", "_ls", "_rs"), [*k, "_left"], "left")
    nearer = F.when(F.col("_p") - F.col("_left") <= F.col("_right") - F.col("_p"), F.col("_ls")).otherwise(F.col("_rs"))
    inner = F.col("_right").isNotNull() & ~anchor
    out = out.withColumn("score", F.when(inner, nearer).otherwise(F.col("_score"))).withColumn("computed", F.coalesce("_scored", F.lit(False)))
    return out.drop("_p", "_n", "_step", "_left", "_right", "_ls", "_rs", "_score", "_scored")


def same(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``a`` join ``b`` on equal columns, null being equal to null; the columns of a, then b's others."""
    b = b.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in b.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return a.join(b, cond, how).drop(*[f"_on_{c}" for c in on])


def dialogue_segments(df: DataFrame, k: list[str], order: list, cfg: dict) -> DataFrame:
    """Segments of an ordered series by the four-state dialogue machine.

    df(k, idx, ts, presence, diff, name_presence, name_diff); cfg as for
    :func:`spanline.functions.scalars.flags`, with stable_frames, clear_frames and
    min_duration.  Gives (k, frame_start, frame_end, start, end, samples).

    The machine has few places, so a chunk of a key is summed up as a map from place to
    place, and chunks are followed at once (:mod:`spanline.operators.chunks`); of
    each only the open segment is held.  Segments that lie in several chunks are put
    together afterwards.
    """
    flagged = df.withColumn("_f", sc.flags("presence", "diff", "name_presence", "name_diff", cfg))
    bits = [("has_text", machine.TEXT), ("has_change", machine.CHANGE), ("is_clear", machine.CLEAR), ("name_changed", machine.NAME)]
    symbol = sum((F.coalesce(F.col(f"_f.{name}"), F.lit(False)).cast("int") * bit for name, bit in bits), F.lit(0))
    rows = flagged.select(*k, *[c for c in order if c not in (*k, "idx", "ts")], F.col("idx").cast("long").alias("idx"), F.col("ts").cast("double").alias("ts"), symbol.alias("symbol"))

    class Summary:
        def __init__(self):
            self.places = machine.Places(cfg)

        def add(self, part: pa.RecordBatch) -> None:
            self.places.add(part.column("symbol").to_numpy(zero_copy_only=False))

        def apply(self, place: int) -> int:
            return self.places.apply(place)

    chunks = Chunked(rows, k, order, ["idx", "ts", "symbol"], Summary, 0)
    keys = [f"{c} {df.schema[c].dataType.simpleString()}" for c in k]
    schema = ", ".join([*keys, "_chunk int", "_seq int", machine.SCHEMA])
    got = chunks.fold(lambda key, chunk, entered, goes_on, batches: segment_rows(key, chunk, entered, goes_on, batches, cfg), schema)
    got = kept(got, "segments")
    # Parts of a segment follow each other; each that begins one begins a new group.
    parts = got.where("_seq IS NOT NULL")
    parts = parts.withColumn("_nth", F.sum(F.col("frame_start").isNotNull().cast("int")).over(Window.partitionBy(*k).orderBy("_chunk", "_seq")))
    at = F.struct("_chunk", "_seq")
    heard = F.array_sort(F.array_distinct(F.flatten(F.collect_list("samples"))))
    ends = F.max_by(F.struct("frame_end", "end"), F.when(F.col("frame_end").isNotNull(), at)).alias("_e")
    whole = parts.groupBy(*k, "_nth").agg(F.max("frame_start").alias("frame_start"), F.max("start").alias("start"), ends, heard.alias("samples"))
    whole = whole.where(F.col("start").isNotNull() & (F.col("_e.end") - F.col("start") >= cfg.get("min_duration", 0.0)))
    names = [*k, "frame_start", "frame_end", "start", "end", "samples"]
    return union_all(got.where("_seq IS NULL").select(*names), whole.select(*k, "frame_start", "_e.frame_end", "start", "_e.end", "samples"))


def segment_rows(key: tuple, chunk: int, entered: int | None, goes_on, batches: Iterator[pa.RecordBatch], cfg: dict) -> Iterator[pa.RecordBatch]:
    """Segments that lie within one chunk of a key, and with ``_seq`` the parts of others: 0 begun before, 1 begun here."""
    fold = machine.Segmenter(cfg, entered or 0)
    kinds = names = None

    def emit(done: list[tuple]) -> pa.RecordBatch:
        types = [*kinds, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
        cols = list(zip(*((*key, chunk, *row) for row in done), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[str(i) for i in range(len(types))])

    for b in batches:
        kinds = [b.schema.field(1 + i).type for i in range(len(key))]
        fold.feed(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("idx", "ts", "symbol")))
        if fold.out:
            yield emit([(None, *row) for row in fold.out])
            fold.out = []
    none = (None, None)
    parts = []
    if not goes_on():
        fold.finish()
    if fold.head is not None:
        last, heard = fold.head
        parts.append((0, None, (last or none)[0], None, (last or none)[1], heard))
    if goes_on() and (fold.cut or fold.begun is not None):
        begun, last = fold.begun or none, fold.last or none
        parts.append((0 if fold.cut else 1, begun[0], last[0], begun[1], last[1], fold.heard))
    done = [*((None, *row) for row in fold.out), *parts]
    if done:
        yield emit(done)
