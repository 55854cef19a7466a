"""Joins: reuse of earlier results, name resolution, updates, interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanline.functions import scalars as sc
from spanline.operators.intervals import in_spans
from spanline.operators.union import union_all


def last_by(df: DataFrame, key: list, order: list, name: str = "_rank") -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order])
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) == 1).drop(name)


def cache_tables(cache: DataFrame, k: list[str], pos: str) -> tuple[DataFrame, DataFrame]:
    """(by full key, by key without id): entries with a translation, the last one of equal keys."""
    c = cache.where(sc.text("translation") != "")
    payload = F.struct("speaker", "original", F.col("translation")).alias("_hit")
    full = c.select(*k, sc.cache_key("segment_id", "start", "end", "kind").alias("_key"), payload, F.col(pos).alias("_pos"))
    free = c.select(*k, sc.cache_key(F.lit(0), "start", "end", "kind").alias("_key"), payload, F.col(pos).alias("_pos"))
    return tuple(last_by(x, [*k, "_key"], ["_pos"]).drop("_pos") for x in (full, free))


def cache_lookup(segments: DataFrame, cache: DataFrame, k: list[str], pos: str = "pos", fuzz_frames: int = 0, fps: float | None = None, match_text: bool = False, prefer: str = "first") -> DataFrame:
    """Segments with the cached speaker, original and translation, and ``hit``: full, free, fuzzy or null.

    Equal keys first, the one with the id before the one without.  For misses, with
    ``fuzz_frames``, start and end are moved together over a grid of offsets up to
    that many frames; the first hit in ascending order of offsets counts (or the
    nearest, with prefer="nearest").  ``match_text`` also asks for equal source
    text, and never tries offsets.  segments: k, segment_id, start, end, kind,
    and original for match_text.
    """
    full, free = cache_tables(cache, k, pos)
    s = segments.withColumn("_k1", sc.cache_key("segment_id", "start", "end", "kind")).withColumn("_k2", sc.cache_key(F.lit(0), "start", "end", "kind"))
    s = s.join(full.withColumnRenamed("_key", "_k1").withColumnRenamed("_hit", "_h1"), [*k, "_k1"], "left")
    s = s.join(free.withColumnRenamed("_key", "_k2").withColumnRenamed("_hit", "_h2"), [*k, "_k2"], "left")
    if match_text:
        for h in ("_h1", "_h2"):
            s = s.withColumn(h, F.when(sc.text(F.col(h)["original"]) == sc.text("original"), F.col(h)))
    s = s.withColumn("_hit", F.coalesce("_h1", "_h2")).withColumn("hit", F.when(F.col("_h1").isNotNull(), "full").when(F.col("_h2").isNotNull(), "free"))
    s = s.drop("_k1", "_k2", "_h1", "_h2")
    if fuzz_frames > 0 and not match_text:
        ms = round(fuzz_frames / fps * 1000)
        step = max(1, round(max(1, fuzz_frames // 4) / fps * 1000))
        miss = s.where("hit IS NULL").select(*k, "segment_id", "start", "end", "kind").distinct()
        grid = miss.withColumn("_off", F.explode(F.filter(F.sequence(F.lit(-ms), F.lit(ms), F.lit(step)), lambda x: x != 0)))
        moved = [(F.col(c) + F.col("_off") / 1000) for c in ("start", "end")]
        grid = grid.withColumn("_tries", F.array(F.struct(F.lit(0).alias("r"), sc.cache_key("segment_id", *moved, "kind").alias("_key")), F.struct(F.lit(1).alias("r"), sc.cache_key(F.lit(0), *moved, "kind").alias("_key"))))
        grid = grid.select(*k, "segment_id", "start", "end", "kind", "_off", F.explode("_tries").alias("t")).select(*k, "segment_id", "start", "end", "kind", "_off", "t.r", "t._key")
        both = union_all(full.withColumn("r", F.lit(0)), free.withColumn("r", F.lit(1)))
        order = F.struct("_off", "r") if prefer == "first" else F.struct(F.abs("_off"), "_off", "r")
        best = grid.join(both, [*k, "r", "_key"]).groupBy(*k, "segment_id", "start", "end", "kind").agg(F.min_by("_hit", order).alias("_near"))
        s = s.join(best, [*k, "segment_id", "start", "end", "kind"], "left")
        s = s.withColumn("hit", F.when(F.col("hit").isNull() & F.col("_near").isNotNull(), "fuzzy").otherwise(F.col("hit"))).withColumn("_hit", F.coalesce("_hit", "_near")).drop("_near")
    return s.withColumns({f"cached_{c}": F.col("_hit")[c] for c in ("speaker", "original", "translation")}).drop("_hit")


def near_keys(names: DataFrame, keys: DataFrame, max_dist: int) -> DataFrame:
    """Pairs of names (nn) and keys (nk) of which one contains the other or that lie within ``max_dist`` edits, and some more.

    A name meets a key that it contains by its pieces of the lengths that keys
    have, and the other way round; names within d edits are equal after at most d
    letters are taken out of each.
    """

    def pieces(df: DataFrame, c: str, other: DataFrame, o: str) -> DataFrame:
        sized = df.withColumn("_n", F.explode(other.agg(F.collect_set(F.length(o))).scalar())).where(F.col("_n") <= F.length(c))
        cut = F.transform(F.sequence(F.lit(1), F.length(c) - F.col("_n") + 1), lambda i: F.substring(c, i, F.col("_n")))
        return sized.withColumn("_piece", F.explode(F.array_distinct(cut))).drop("_n")

    def whole(df: DataFrame, c: str) -> DataFrame:
        return df.withColumn("_piece", F.col(c))

    def shorter(c: str) -> Column:
        out = F.array(F.col(c))
        for _ in range(max_dist):
            less = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
            out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, less))))
        return out

    less = [df.withColumn("_piece", F.explode(F.array_distinct(shorter(c)))) for df, c in ((names, "nn"), (keys, "nk"))]
    sides = [(pieces(names, "nn", keys, "nk"), whole(keys, "nk")), (whole(names, "nn"), pieces(keys, "nk", names, "nn")), less]
    met = [left.join(right, "_piece").drop("_piece") for left, right in sides]
    return union_all(*met).distinct()


def resolve_dimension(df: DataFrame, name: str, dim: DataFrame, dim_name: str, max_dist: int = 1) -> DataFrame:
    """Adds ``match`` (the dimension's name) and ``ambiguous``.

    By tiers: the normalised name is a key as it stands; equal after normalising;
    one contains the other; smallest edit distance of at most max_dist.  The first
    tier with a candidate decides, and only with a single best one.  Work is per
    distinct name, and all tiers are equi-joins (:func:`near_keys`), at every size of
    the dimension.
    """
    keys = dim.select(F.trim(dim_name).alias("key")).where("key <> ''").distinct().withColumn("nk", sc.normalize_name("key")).where("nk <> ''")
    names = df.select(F.col(name).alias("name")).distinct().withColumn("nn", sc.normalize_name("name")).where("nn <> ''")
    raw = names.join(keys, F.col("nn") == F.col("key")).select("name", F.col("key"), F.lit(0).alias("tier"), F.lit(0).alias("dist"))
    equal = names.join(keys, F.col("nn") == F.col("nk")).select("name", "key", F.lit(1).alias("tier"), F.lit(0).alias("dist"))
    exact = union_all(raw, equal)
    rest = names.join(exact.select("name").distinct(), "name", "left_anti")
    near = F.contains("nn", "nk") | F.contains("nk", "nn")
    dist = F.levenshtein("nn", "nk", max_dist)
    pairs = near_keys(rest, keys, max_dist).where(near | (dist >= 0))
    loose = pairs.select("name", "key", F.when(near, 2).otherwise(3).alias("tier"), F.when(near, 0).otherwise(dist).alias("dist"))
    rank = Window.partitionBy("name")
    best = union_all(exact, loose).withColumn("top", F.min(F.struct("tier", "dist")).over(rank)).where(F.struct("tier", "dist") == F.col("top"))
    best = best.groupBy("name").agg(F.countDistinct("key").alias("n"), F.min("key").alias("key"))
    best = best.select(F.col("name").alias(name), F.when(F.col("n") == 1, F.col("key")).alias("match"), (F.col("n") > 1).alias("ambiguous"))
    return df.join(best, name, "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def validate_updates(updates: DataFrame, entries: DataFrame, k: list[str], ident: str = "id") -> DataFrame:
    """Updates whose id is among the entries and whose new text isn't empty, with the old values and ``changed``."""
    old = entries.select(*k, ident, F.col("translation").alias("old_translation"), F.col("speaker"), F.col("original"))
    new = updates.where(sc.text("translation") != "").withColumn("new_translation", sc.text("translation")).drop("translation", "speaker", "original")
    return new.join(old, [*k, ident]).withColumn("changed", F.col("new_translation") != sc.text("old_translation"))


def apply_updates(entries: DataFrame, updates: DataFrame, k: list[str], ident: str = "id", seq: str = "seq") -> DataFrame:
    """Entries with their last update's text and reason where it is changed, not empty and different; adds ``updated``."""
    u = updates.where(F.col("changed") & (sc.text("new_translation") != ""))
    u = last_by(u, [*k, ident], [seq]).select(*k, ident, F.col("new_translation").alias("_new"), F.col("reason").alias("_why"))
    e = entries.join(u, [*k, ident], "left").withColumn("updated", F.coalesce(F.trim("_new") != sc.text("translation"), F.lit(False)))
    e = e.withColumn("translation", F.when(F.col("updated"), F.trim("_new")).otherwise(F.col("translation")))
    return e.withColumn("auto_review_reason", F.when(F.col("updated"), F.col("_why"))).drop("_new", "_why")


def prune(frames: DataFrame, score: str, threshold: float) -> DataFrame:
    """Frames with a score of at least the threshold; none of those without a score."""
    return frames.where(F.coalesce(F.col(score), F.lit(0.0)) >= threshold)


def keep_anchors(frames: DataFrame, anchors: DataFrame, k: list[str]) -> tuple[DataFrame, DataFrame]:
    """(frames that are anchors, counts kept / removed by the first key column)."""
    marked = frames.join(anchors.select(*k).distinct().withColumn("_anchor", F.lit(True)), k, "left")
    counts = marked.groupBy(k[0]).agg(F.count("_anchor").alias("kept"), F.count_if(F.col("_anchor").isNull()).alias("removed"))
    return frames.join(anchors.select(*k).distinct(), k, "left_semi"), counts


def frames_in_segments(frames: DataFrame, segments: DataFrame, k: list[str], at: str, start: str, end: str, merge: bool = True) -> DataFrame:
    """All (frame, segment) pairs with start <= at <= end (:func:`spanline.operators.intervals.in_spans`)."""
    return in_spans(frames, segments, k, at, start, end, merge=merge)


def segment_at(points: DataFrame, segments: DataFrame, k: list[str], at: str, start: str, end: str, ident: Column, order: Column) -> DataFrame:
    """Points with ``segment``: the first one, by ``order``, that holds the point; null if none does."""
    s = segments.select(*k, F.col(start).alias("_s"), F.col(end).alias("_e"), order.alias("_o"), ident.alias("_id"))
    hit = frames_in_segments(points.select(*k, at).distinct(), s, k, at, "_s", "_e", merge=False)
    best = hit.groupBy(*k, at).agg(F.min_by("_id", "_o").alias("segment"))
    return points.join(best, [*k, at], "left")


def series_value_at(points: DataFrame, series: DataFrame, k: list[str], at: str = "at") -> DataFrame:
    """Points with ``score`` from series(k, range_index, start, end, fps, pos, score): the first range that holds the point.

    Its position is (at - start) * fps, rounded half to even; null outside of all
    ranges.
    """
    ranges = series.select(*k, "range_index", "start", "end", "fps").distinct()
    hit = frames_in_segments(points.select(*k, at).distinct(), ranges, k, at, "start", "end", merge=False)
    hit = hit.groupBy(*k, at).agg(F.min(F.struct("range_index", "start", "fps")).alias("r")).select(*k, at, "r.*")
    hit = hit.withColumn("pos", F.bround((F.col(at) - F.col("start")) * F.col("fps"), 0).cast("long"))
    got = hit.join(series.select(*k, "range_index", F.col("pos").cast("long").alias("pos"), "score"), [*k, "range_index", "pos"], "left")
    return points.join(got.select(*k, at, "score"), [*k, at], "left")


def backfill(scores: DataFrame, score: str, again: Column, out: str = "score") -> DataFrame:
    """Scores that are missing or not above 0 are taken from ``again``; 0 if that fails too."""
    need = F.coalesce(F.col(score), F.lit(0.0)) <= 0
    return scores.withColumn("rescored", need).withColumn(out, F.when(need, F.coalesce(again, F.lit(0.0))).otherwise(F.col(score)))


def fetch_with_status(want: DataFrame, frames: DataFrame, k: list[str], data: str = "gray", fallback: DataFrame | None = None) -> DataFrame:
    """Wanted frames with their data and status: hit, miss_not_found or miss_read_error (found but empty).

    Misses are looked up in ``fallback``; what is in neither has reason image_prepare_failed.
    """
    f = frames.select(*k, F.col(data).alias("_d"), F.lit(True).alias("_found"))
    out = want.join(f, k, "left").withColumn("status", F.when(F.col("_d").isNotNull(), "hit").when(F.col("_found"), "miss_read_error").otherwise("miss_not_found"))
    if fallback is not None:
        out = out.join(fallback.select(*k, F.col(data).alias("_d2")), k, "left").withColumn("_d", F.coalesce("_d", "_d2")).drop("_d2")
    return out.withColumn("reason", F.when(F.col("_d").isNull(), "image_prepare_failed")).withColumnRenamed("_d", data).drop("_found")
