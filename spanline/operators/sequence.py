"""Window operators over keyed series.

``key`` and ``order`` are lists of columns; order must end in a tie-breaker, so
that every row has one place.  Positions count from 0 within a key.  All of them
share the partitioning by key, so a chain of operators costs one exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanline.operators.chunks import Chunked
from spanline.operators.intervals import in_spans
from spanline.operators.union import union_all
from spanline.sources.shared import kept

PAST = Window.unboundedPreceding
AHEAD = Window.unboundedFollowing


def by(key: list[str], order: list) -> Window:
    return Window.partitionBy(*key).orderBy(*order)


def rows(w, lo, hi):
    return w.rowsBetween(lo, hi)


def positions(df: DataFrame, key: list[str], order: list, name: str = "pos") -> DataFrame:
    return df.withColumn(name, F.row_number().over(by(key, order)) - 1)


def change(df: DataFrame, key, order, col: str, out: str = "change", first: float = 1.0) -> DataFrame:
    """Absolute change from the previous row; the first row gets ``first``."""
    return df.withColumn(out, F.coalesce(F.abs(F.col(col) - F.lag(col).over(by(key, order))), F.lit(first)))


def mask_change(df: DataFrame, key, order, mask: str, out: str = "change") -> DataFrame:
    """Changed over united bits of packed 64-bit masks; 0 if both are empty, 1 for the first row."""
    prev = F.lag(mask).over(by(key, order))
    both = F.bit_count(prev.bitwiseOR(F.col(mask)))
    ratio = F.when(both == 0, 0.0).otherwise(F.bit_count(prev.bitwiseXOR(F.col(mask))) / both)
    return df.withColumn(out, F.when(prev.isNull(), 1.0).otherwise(ratio))


def moving_average(df: DataFrame, key, order, col: str, width: int, out: str = "smooth") -> DataFrame:
    """Centred mean over width // 2 rows on either side, fewer at the ends; width 1 or less copies."""
    half = width // 2
    return df.withColumn(out, F.col(col) if width <= 1 else F.avg(col).over(rows(by(key, order), -half, half)))


def with_runs(df: DataFrame, key, order, flag: str) -> DataFrame:
    """Adds pos, run (number of the run of equal values in its key), run_start, run_end, run_len, runs."""
    w = by(key, order)
    turn = F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(0))
    df = df.withColumn("pos", F.row_number().over(w) - 1).withColumn("_turn", turn)
    df = df.withColumn("run", F.sum("_turn").over(rows(w, PAST, 0))).drop("_turn")
    run = Window.partitionBy(*key, "run")
    return (
        df.withColumn("run_start", F.min("pos").over(run))
        .withColumn("run_end", F.max("pos").over(run))
        .withColumn("run_len", F.col("run_end") - F.col("run_start") + 1)
        .withColumn("runs", F.max("run").over(Window.partitionBy(*key)) + 1)
    )


RUN_COLUMNS = ["pos", "run", "run_start", "run_end", "run_len", "runs"]


def runs(df: DataFrame, key, order, flag: str) -> DataFrame:
    """One row per run: key, run, value, run_start, run_end, run_len."""
    w = by(key, order)
    turn = F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(0))
    df = df.select(*key, F.col(flag).alias("value"), (F.row_number().over(w) - 1).alias("pos"), turn.alias("_turn"), *[F.col(c).alias(f"_o{i}") if isinstance(c, str) else c.alias(f"_o{i}") for i, c in enumerate(order)])
    df = df.withColumn("run", F.sum("_turn").over(rows(by(key, ["pos"]), PAST, 0)))
    return df.groupBy(*key, "run").agg(F.first("value").alias("value"), F.min("pos").alias("run_start"), F.max("pos").alias("run_end"), F.count("*").alias("run_len"))


def debounce(df: DataFrame, key, order, flag: str, min_on: int, min_off: int, out: str = "debounced") -> DataFrame:
    """Turns on after min_on trues in a row, off after min_off falses; starts at the first raw value."""
    had = [c for c in RUN_COLUMNS if c in df.columns]
    kept = df.select(*df.columns)
    df = with_runs(kept.drop(*had) if had else kept, key, order, flag)
    streak = F.col("pos") - F.col("run_start") + 1
    event = F.when((F.col("pos") == 0) | (streak >= F.when(F.col(flag), F.lit(min_on)).otherwise(min_off)), F.col(flag))
    return df.withColumn(out, F.last(event, ignorenulls=True).over(rows(by(key, order), PAST, 0))).drop(*RUN_COLUMNS)


def edges(df: DataFrame, key, order, flag: str, min_on: int = 1, min_off: int = 1) -> DataFrame:
    """(key, pos, kind): 'appear' where the flag turns on and 'disappear' where it turns off.

    With min_on / min_off over 1 only on-runs of min_on rows count, and a
    disappearance needs min_off falses after it.  The first run can't appear and
    the last can't disappear.
    """
    r = runs(df, key, order, flag)
    w = by(key, ["run"])
    r = r.withColumn("next_len", F.lead("run_len").over(w)).where(F.col("value") & (F.col("run_len") >= min_on))
    kinds = F.array(
        F.when(F.col("run") > 0, F.struct(F.col("run_start").alias("pos"), F.lit("appear").alias("kind"))),
        F.when(F.col("next_len") >= min_off, F.struct((F.col("run_end") + 1).alias("pos"), F.lit("disappear").alias("kind"))),
    )
    return r.select(*key, F.explode(F.array_compact(kinds)).alias("e")).select(*key, "e.pos", "e.kind")


class Thinned:
    """What positions in order do to the last one kept: an exit for every position that a chunk may begin to keep at."""

    def __init__(self, gap: int):
        self.gap, self.seen = gap, []

    def add(self, part: pa.RecordBatch) -> None:
        self.seen.append(part.column("_pos").to_numpy(zero_copy_only=False))

    def __getstate__(self) -> dict:
        at = np.concatenate(self.seen)
        n = len(at)
        # Pointers to the next kept position, doubled until none goes on.
        jump = np.append(np.searchsorted(at, at + self.gap), n)
        last = np.arange(n + 1)
        while (jump[:n] < n).any():
            last = np.where(jump < n, last[jump], last)
            jump = jump[jump]
        some = int(np.searchsorted(at, at[0] + self.gap)) + 1  # the last one kept stands before the chunk
        return {"gap": self.gap, "starts": at[:some], "exits": at[last[: len(at[:some])]]}

    def apply(self, kept: int | None) -> int | None:
        i = 0 if kept is None else int(np.searchsorted(self.starts, kept + self.gap))
        return int(self.exits[i]) if i < len(self.starts) else kept


def thin(df: DataFrame, key, pos: str, min_gap: int) -> DataFrame:
    """Keep a position if it is min_gap or more after the last one kept; equal positions are one, nulls none.

    What is kept depends on all that came before.  A chunk of a key is summed up as
    where it would end for each position it may begin at, at most ``min_gap`` of them,
    and chunks are thinned at once (:mod:`spanline.operators.chunks`).
    """
    gap = max(1, min_gap)
    rows = df.select(*key, F.col(pos).cast("long").alias("_pos")).where("_pos IS NOT NULL")
    chunks = Chunked(rows, list(key), ["_pos"], ["_pos"], lambda: Thinned(gap), None)

    def run(values: tuple, chunk: int, kept: int | None, goes_on, batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("_pos").to_numpy(zero_copy_only=False)
            ahead = np.searchsorted(at, at + gap).tolist()
            i, keep = 0 if kept is None else int(np.searchsorted(at, kept + gap)), []
            while i < len(at):
                keep.append(i)
                i = ahead[i]
            if keep:
                kept = int(at[keep[-1]])
                own = [pa.array([v] * len(keep), b.schema.field(1 + j).type) for j, v in enumerate(values)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(at[keep])], names=[str(j) for j in range(len(values) + 1)])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key]
    return chunks.fold(run, ", ".join([*kinds, f"`{pos}` long"]))


def intervals(edge_rows: DataFrame, key, pos: str = "pos") -> DataFrame:
    """(key, start, end) between consecutive edges, the first from 0; neighbours share a position.

    What follows the last edge is left out; empty intervals too.
    """
    start = F.coalesce(F.lag(pos).over(by(key, [pos])), F.lit(0))
    return edge_rows.select(*key, start.alias("start"), F.col(pos).alias("end")).where(F.col("end") > F.col("start"))


def representative(frames: DataFrame, spans: DataFrame, appear: DataFrame, key, flag: str) -> DataFrame:
    """Adds ``sample`` to spans(key, start, end): the first appearance inside (ends included), else the
    middle one (n // 2) of the positions where the flag is on, else the span's middle.

    Ranks, not lists, find the middle.
    """
    at = frames.where(F.col(flag)).select(*key, F.col("pos").alias("_p"), F.lit(False).alias("_a"))
    at = union_all(at, appear.select(*key, F.col("pos").alias("_p"), F.lit(True).alias("_a")))
    span = [*key, "start", "end"]
    hit = in_spans(at, spans.select(*span), key, "_p", "start", "end")
    w = Window.partitionBy(*span)
    hit = hit.withColumn("_ons", F.count_if(~F.col("_a")).over(w)).withColumn("_nth", F.row_number().over(w.orderBy("_a", "_p")))
    middle = ~F.col("_a") & (F.col("_nth") == F.floor(F.col("_ons") / 2) + 1)
    best = hit.groupBy(*span).agg(F.coalesce(F.min(F.when(F.col("_a"), F.col("_p"))), F.max(F.when(middle, F.col("_p")))).alias("_best"))
    out = spans.join(best.hint("merge"), span, "left")
    return out.withColumn("sample", F.coalesce("_best", F.floor((F.col("start") + F.col("end")) / 2))).drop("_best")


def fill_gaps(df: DataFrame, key, order, flag: str, most: int, out: str = "filled") -> DataFrame:
    """Turn false runs of at most ``most`` rows to true if there is a true run on both sides.

    No effect with most <= 0 or under three rows.
    """
    r = with_runs(df.drop(*RUN_COLUMNS), key, order, flag)
    short = (F.col("run_len") <= most) & (F.col("run") > 0) & (F.col("run") < F.col("runs") - 1)
    return r.withColumn(out, F.col(flag) | (short if most > 0 else F.lit(False))).drop(*RUN_COLUMNS)


def first_run(df: DataFrame, key, order, flag: str, least: int) -> DataFrame:
    """(key, run_start, run_end) of the first true run of ``least`` rows or more; nulls if there is none."""
    r = runs(df, key, order, flag)
    good = F.when(F.col("value") & (F.col("run_len") >= least), F.struct("run_start", "run_end"))
    return r.groupBy(*key).agg(F.min(good).alias("r")).select(*key, "r.run_start", "r.run_end")


def with_context(df: DataFrame, key, order, item: Column, n: int, eligible: Column, mode: str = "eligible") -> DataFrame:
    """Adds ``before`` and ``after``: arrays of up to n items of rows around each row.

    ``eligible`` counts n eligible rows; ``positions`` looks at n rows and leaves
    out those that aren't.  Every row gets a context, eligible or not.
    """
    w = by(key, order)
    it = F.when(eligible, item)
    if mode == "positions":
        return df.withColumn("before", F.collect_list(it).over(rows(w, -n, -1))).withColumn("after", F.collect_list(it).over(rows(w, 1, n)))
    # Eligible rows are numbered; a row's context is a range of those numbers.
    df = df.withColumn("_n", F.coalesce(F.sum(eligible.cast("int")).over(rows(w, PAST, 0)), F.lit(0))).withColumn("_e", eligible)
    span = Window.partitionBy(*key).orderBy("_n")
    pick = F.when(F.col("_e"), F.struct(F.col("_n").alias("n"), item.alias("item")))
    df = df.withColumn("_back", F.collect_list(pick).over(span.rangeBetween(-n, 0))).withColumn("_ahead", F.collect_list(pick).over(span.rangeBetween(1, n)))
    own = F.when(F.col("_e"), F.col("_n")).otherwise(F.col("_n") + 1)
    back = F.filter("_back", lambda x: (x["n"] < own) & (x["n"] >= own - n))
    return (
        df.withColumn("before", F.transform(F.array_sort(back), lambda x: x["item"]))
        .withColumn("after", F.transform(F.array_sort("_ahead"), lambda x: x["item"]))
        .drop("_n", "_e", "_back", "_ahead")
    )


def occurrence(df: DataFrame, key, order, ident: str) -> DataFrame:
    """Adds seen (0-based occurrence of the id in its key) and times (how often it occurs)."""
    own = Window.partitionBy(*key, ident)
    return df.withColumn("seen", F.row_number().over(own.orderBy(*order)) - 1).withColumn("times", F.count("*").over(own))


def neighbors(df: DataFrame, key, ident: str, pos: str) -> DataFrame:
    """Adds prev_id / next_id by (numeric id, position); rows without a numeric id come last."""
    w = by(key, [F.col(ident).isNull(), F.col(ident), F.col(pos)])
    return df.withColumn("prev_pos", F.lag(pos).over(w)).withColumn("next_pos", F.lead(pos).over(w))


def next_flagged(df: DataFrame, key, order, flag: str, pos: str) -> DataFrame:
    """Adds next_pos and prev_pos of the nearest other flagged row, starting over at the ends; null if none."""
    w, all_rows = by(key, order), Window.partitionBy(*key).orderBy(*order).rowsBetween(PAST, AHEAD)
    hit = F.when(F.col(flag), F.col(pos))
    nxt = F.coalesce(F.first(hit, ignorenulls=True).over(rows(w, 1, AHEAD)), F.first(hit, ignorenulls=True).over(all_rows))
    prv = F.coalesce(F.last(hit, ignorenulls=True).over(rows(w, PAST, -1)), F.last(hit, ignorenulls=True).over(all_rows))
    return df.withColumn("next_pos", nxt).withColumn("prev_pos", prv)


def gap_times(df: DataFrame, key, order, start: str, end: str, pad: float = 1.0) -> DataFrame:
    """Adds before_start/before_end and after_start/after_end: default times of a row put in before or after.

    From the previous row's end, or up to the next one's start; where there is no
    such row, or no room, ``pad`` seconds.  Nothing is below 0.
    """
    w = by(key, order)
    prev_end, next_start = F.lag(end).over(w), F.lead(start).over(w)
    at = F.greatest(F.lit(0.0), F.col(start))
    back = F.greatest(F.lit(0.0), F.least(prev_end, at))
    padded = F.greatest(F.lit(0.0), at - pad)
    since = F.greatest(F.lit(0.0), F.col(end))
    upto = F.greatest(since, next_start)
    return (
        df.withColumn("before_start", F.when(prev_end.isNotNull() & (back < at), back).otherwise(padded))
        .withColumn("before_end", F.greatest("before_start", at))
        .withColumn("after_start", since)
        .withColumn("after_end", F.when(next_start.isNotNull() & (upto > since), upto).otherwise(since + pad))
    )


def merge_blank(df: DataFrame, key, order, blank: str, start: str, end: str, gap: float) -> DataFrame:
    """Adjacent blank intervals become one when the gap from the end reached so far is at most ``gap``."""
    w = by(key, order)
    df = df.withColumn("_turn", F.coalesce((F.col(blank) != F.lag(blank).over(w)).cast("int"), F.lit(0)))
    df = df.withColumn("_run", F.sum("_turn").over(rows(w, PAST, 0)))
    inner = by([*key, "_run"], order)
    reach = F.max(end).over(rows(inner, PAST, -1))
    fresh = ~F.col(blank) | reach.isNull() | (F.col(start) - reach > gap)
    df = df.withColumn("_new", fresh.cast("int")).withColumn("island", F.sum("_new").over(rows(w, PAST, 0)))
    return df.groupBy(*key, "island").agg(F.first(blank).alias(blank), F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged"))


def fill_unscored(df: DataFrame, key, order, col: str, out: str = "filled") -> DataFrame:
    """Null points take the next scored value, else the previous one, else 0."""
    w = by(key, order)
    nxt = F.first(col, ignorenulls=True).over(rows(w, 0, AHEAD))
    prv = F.last(col, ignorenulls=True).over(rows(w, PAST, 0))
    return df.withColumn(out, F.coalesce(F.col(col), nxt, prv, F.lit(0.0)))


def even_sample(df: DataFrame, key, order, n: int) -> DataFrame:
    """Rows at n evenly spaced positions of each key, first and last among them; all rows of shorter keys."""
    df = positions(df, key, order, "_p").withColumn("_size", F.count("*").over(Window.partitionBy(*key)))
    # Position p is taken if it is floor(j * (size - 1) / (n - 1)) for a whole j.
    j = F.ceil(F.col("_p") * F.lit(n - 1) / (F.col("_size") - 1)) if n > 1 else F.lit(0)
    taken = (F.floor(j * (F.col("_size") - 1) / F.lit(max(1, n - 1))) == F.col("_p")) & (j <= n - 1) if n > 1 else F.col("_p") == 0
    return df.where((F.col("_size") <= n) | taken).drop("_p", "_size")


def marker_segments(
    df: DataFrame, key, order, score: str, threshold: float, smooth: int = 1, use_debounce: bool = True, min_on: int = 2, min_off: int = 2, keep_tail: bool = False, min_duration: float = 0.0, fps: float = 1.0
) -> DataFrame:
    """Segments between the disappearances of a marker: (key, frame_start, frame_end, sample).

    The score is smoothed and thresholded, the flag debounced; edges of either kind
    closer than max(2, min_on + min_off) to the last one kept are thinned out.
    What follows the last disappearance is no segment unless ``keep_tail``.
    Flags and edges are written once, for all that looks at them.
    """
    df = moving_average(df, key, order, score, max(1, smooth), "_smooth").withColumn("_on", F.col("_smooth") >= threshold)
    if use_debounce:
        df = debounce(df, key, order, "_on", max(1, min_on), max(1, min_off), "_flag")
    else:
        df, min_on, min_off = df.withColumn("_flag", F.col("_on")), 1, 1
    frames = kept(positions(df, key, order).select(*key, "pos", "_flag"), "flags")
    e = edges(frames, key, ["pos"], "_flag", max(1, min_on), max(1, min_off))
    if use_debounce:
        e = thin(e, [*key, "kind"], "pos", max(2, min_on + min_off))
    e = kept(e, "edges")
    gone = e.where("kind = 'disappear'").select(*key, "pos")
    if keep_tail:
        gone = union_all(gone, frames.groupBy(*key).agg(F.max("pos").alias("pos"))).distinct()
    spans = intervals(gone, key)
    out = representative(frames, spans, e.where("kind = 'appear'"), key, "_flag")
    out = out.where((F.col("end") - F.col("start")) / fps >= min_duration)
    return out.select(*key, F.col("start").alias("frame_start"), F.col("end").alias("frame_end"), "sample")
