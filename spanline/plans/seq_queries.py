"""Sequence operators over the events table: key user_id, order (ts, event_id), score value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanline.operators import sequence as seq

KEY, ORDER = ["user_id"], ["ts", "event_id"]
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def frames(spark, d) -> DataFrame:
    df = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type", "ts", "value", (F.col("value") >= 35).alias("flag"))
    return seq.positions(df, KEY, ORDER, "i")


FR = """f AS (SELECT user_id, event_id, event_type, ts, value, value >= 35 AS flag,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"""
RUN = FR + """, t AS (SELECT *, CASE WHEN flag <> lag(flag) OVER (PARTITION BY user_id ORDER BY i) THEN 1 ELSE 0 END AS turn FROM f),
  r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY i) AS run FROM t),
  rr AS (SELECT user_id, run, bool_or(flag) AS v, min(i) AS rs, max(i) AS re, count(*) AS n, max(max(run)) OVER (PARTITION BY user_id) AS last FROM r GROUP BY user_id, run)"""


def deb(on: int, off: int, base: str = RUN, flag: str = "flag") -> str:
    return base + f""", ev AS (SELECT r.*, CASE WHEN r.i = 0 OR r.i - rr.rs + 1 >= CASE WHEN r.flag THEN {on} ELSE {off} END THEN r.flag END AS e
      FROM r JOIN rr USING (user_id, run)),
  db AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS state FROM ev)"""


@query("e01_change", f"WITH {FR} SELECT event_id, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY i)), 1.0) AS change FROM f")
def e01(spark, d):
    return seq.change(frames(spark, d), KEY, ORDER, "value").select("event_id", "change")


@query(
    "e01_mask_change",
    f"""WITH {FR}, m AS (SELECT *, CAST(floor(value * 97) AS BIGINT) AS mask FROM f),
p AS (SELECT event_id, mask, lag(mask) OVER (PARTITION BY user_id ORDER BY i) AS prev FROM m)
SELECT event_id, CASE WHEN prev IS NULL THEN 1.0 WHEN bit_count(prev | mask) = 0 THEN 0.0 ELSE bit_count(xor(prev, mask)) / CAST(bit_count(prev | mask) AS DOUBLE) END AS change FROM p""",
)
def e01b(spark, d):
    df = frames(spark, d).withColumn("mask", F.floor(F.col("value") * 97).cast("long"))
    return seq.mask_change(df, KEY, ORDER, "mask").select("event_id", "change")


@query("e02_moving_average", f"WITH {FR} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM f")
def e02(spark, d):
    return seq.moving_average(frames(spark, d), KEY, ORDER, "value", 5).select("event_id", F.round("smooth", 6).alias("smooth"))


@query("e03_debounce", f"WITH {deb(2, 3)} SELECT event_id, state AS debounced FROM db")
def e03(spark, d):
    return seq.debounce(frames(spark, d), KEY, ORDER, "flag", 2, 3).select("event_id", "debounced")


@query("e04_runs", f"WITH {RUN} SELECT user_id, CAST(run AS BIGINT) AS run, v AS value, rs AS run_start, re AS run_end, n AS run_len FROM rr")
def e04(spark, d):
    return seq.runs(frames(spark, d), KEY, ORDER, "flag").select("user_id", "run", "value", "run_start", "run_end", "run_len")


EDGE = """, e AS (SELECT user_id, rs AS pos, 'appear' AS kind FROM rr WHERE v AND n >= {on} AND run > 0
  UNION ALL SELECT a.user_id, a.re + 1, 'disappear' FROM rr a JOIN rr b ON a.user_id = b.user_id AND b.run = a.run + 1 WHERE a.v AND a.n >= {on} AND b.n >= {off})"""


@query("e05_edges", f"WITH {RUN}{EDGE.format(on=1, off=1)} SELECT * FROM e")
def e05(spark, d):
    return seq.edges(frames(spark, d), KEY, ORDER, "flag")


@query("e05_edges_debounced", f"WITH {RUN}{EDGE.format(on=2, off=2)} SELECT * FROM e")
def e05b(spark, d):
    return seq.edges(frames(spark, d), KEY, ORDER, "flag", 2, 2)


THIN = """, n AS (SELECT user_id, kind, pos, row_number() OVER (PARTITION BY user_id, kind ORDER BY pos) AS k FROM e),
  th AS (SELECT user_id, kind, pos, k, true AS kept, pos AS last FROM n WHERE k = 1
    UNION ALL SELECT n.user_id, n.kind, n.pos, n.k, n.pos - th.last >= {gap}, CASE WHEN n.pos - th.last >= {gap} THEN n.pos ELSE th.last END
    FROM th JOIN n ON n.user_id = th.user_id AND n.kind = th.kind AND n.k = th.k + 1)"""


@query("e06_thin", f"WITH RECURSIVE {RUN}{EDGE.format(on=1, off=1)}{THIN.format(gap=4)} SELECT user_id, kind, pos FROM th WHERE kept")
def e06(spark, d):
    return seq.thin(seq.edges(frames(spark, d), KEY, ORDER, "flag"), ["user_id", "kind"], "pos", 4).select("user_id", "kind", "pos")


@query(
    "e07_intervals",
    f"""WITH {RUN}{EDGE.format(on=1, off=1)}
SELECT * FROM (SELECT user_id, coalesce(lag(pos) OVER (PARTITION BY user_id ORDER BY pos), 0) AS "start", pos AS "end" FROM e WHERE kind = 'disappear') WHERE "end" > "start" """,
)
def e07(spark, d):
    e = seq.edges(frames(spark, d), KEY, ORDER, "flag").where("kind = 'disappear'")
    return seq.intervals(e, KEY)


SAMPLE = """, iv AS (SELECT * FROM (SELECT user_id, coalesce(lag(pos) OVER (PARTITION BY user_id ORDER BY pos), 0) AS s, pos AS t FROM {gone}) WHERE t > s),
  ap AS (SELECT iv.user_id, s, min(pos) AS first FROM iv JOIN {seen} a ON a.user_id = iv.user_id AND pos BETWEEN s AND t GROUP BY iv.user_id, s),
  onp AS (SELECT iv.user_id, s, list(i ORDER BY i) AS ons FROM iv JOIN {fr} x ON x.user_id = iv.user_id AND i BETWEEN s AND t WHERE {flag} GROUP BY iv.user_id, s),
  rep AS (SELECT iv.user_id, iv.s, iv.t, coalesce(first, ons[len(ons) // 2 + 1], (iv.s + iv.t) // 2) AS sample FROM iv LEFT JOIN ap USING (user_id, s) LEFT JOIN onp USING (user_id, s))"""


@query(
    "e08_representative",
    f"""WITH {RUN}{EDGE.format(on=1, off=1)}{SAMPLE.format(gone="(SELECT * FROM e WHERE kind = 'disappear')", seen="(SELECT * FROM e WHERE kind = 'appear')", fr='f', flag='flag')}
SELECT user_id, s AS "start", t AS "end", sample FROM rep""",
)
def e08(spark, d):
    fr = frames(spark, d)
    e = seq.edges(fr, KEY, ORDER, "flag")
    return seq.representative(fr.withColumn("pos", F.col("i")), seq.intervals(e.where("kind = 'disappear'"), KEY), e.where("kind = 'appear'"), KEY, "flag")


@query("e09_fill_gaps", f"WITH {RUN} SELECT event_id, flag OR (n <= 2 AND r.run > 0 AND r.run < last) AS filled FROM r JOIN rr USING (user_id, run)")
def e09(spark, d):
    return seq.fill_gaps(frames(spark, d), KEY, ORDER, "flag", 2).select("event_id", "filled")


@query("e10_first_run", f"WITH {RUN} SELECT user_id, min(rs) FILTER (v AND n >= 3) AS run_start, arg_min(re, rs) FILTER (v AND n >= 3) AS run_end FROM rr GROUP BY user_id")
def e10(spark, d):
    return seq.first_run(frames(spark, d), KEY, ORDER, "flag", 3)


@query(
    "e14_neighbors",
    """WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL ELSE 7 - turn END AS sid FROM conversations)
SELECT conv_id, turn, lag(turn) OVER w AS prev_pos, lead(turn) OVER w AS next_pos FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY sid IS NULL, sid NULLS FIRST, turn)""",
)
def e14(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.when(F.col("turn") % 3 != 2, 7 - F.col("turn")).alias("sid"))
    return seq.neighbors(c, ["conv_id"], "sid", "turn").select("conv_id", "turn", "prev_pos", "next_pos")


@query(
    "e15_next_flagged",
    f"""WITH {FR} SELECT event_id,
coalesce(first_value(CASE WHEN flag THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(CASE WHEN flag THEN i END) OVER (PARTITION BY user_id)) AS next_pos,
coalesce(last_value(CASE WHEN flag THEN i END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), max(CASE WHEN flag THEN i END) OVER (PARTITION BY user_id)) AS prev_pos FROM f""",
)
def e15(spark, d):
    return seq.next_flagged(frames(spark, d), KEY, ORDER, "flag", "i").select("event_id", "next_pos", "prev_pos")


@query(
    "e16_merge_blank",
    f"""WITH {FR}, iv AS (SELECT user_id, i, NOT flag AS blank, i * 2.0 AS s, i * 2.0 + CASE WHEN value > 20 THEN 3.0 ELSE 1.0 END AS e FROM f),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) - row_number() OVER (PARTITION BY user_id, blank ORDER BY i) AS grp FROM iv),
m AS (SELECT *, CASE WHEN NOT blank OR reach IS NULL OR s - reach > 0.5 THEN 1 ELSE 0 END AS fresh FROM (
  SELECT *, max(e) OVER (PARTITION BY user_id, blank, grp ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY i) AS island FROM m)
SELECT user_id, CAST(island AS BIGINT) AS island, bool_or(blank) AS blank, min(s) AS s, max(e) AS e, count(*) AS merged FROM k GROUP BY user_id, island""",
)
def e16(spark, d):
    iv = frames(spark, d).select("user_id", "i", (~F.col("flag")).alias("blank"), (F.col("i") * 2.0).alias("s"), (F.col("i") * 2.0 + F.when(F.col("value") > 20, 3.0).otherwise(1.0)).alias("e"))
    return seq.merge_blank(iv, KEY, ["i"], "blank", "s", "e", 0.5)


@query(
    "e22_gap_times",
    """WITH c AS (SELECT conv_id, turn, turn * 2.0 AS s, turn * 2.0 + CASE WHEN turn % 3 = 1 THEN 2.5 ELSE 1.5 END AS e FROM conversations),
p AS (SELECT *, lag(e) OVER w AS pe, lead(s) OVER w AS ns FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN least(pe, s) < s THEN least(pe, s) ELSE greatest(0, s - 1) END AS before_start, s AS before_end,
e AS after_start, CASE WHEN ns > e THEN ns ELSE e + 1 END AS after_end FROM p""",
)
def e22(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", (F.col("turn") * 2.0).alias("s"), (F.col("turn") * 2.0 + F.when(F.col("turn") % 3 == 1, 2.5).otherwise(1.5)).alias("e"))
    return seq.gap_times(c, ["conv_id"], ["turn"], "s", "e").select("conv_id", "turn", "before_start", "before_end", "after_start", "after_end")


@query(
    "e23_fill_unscored",
    f"""WITH {FR}, g AS (SELECT *, CASE WHEN i % 3 = 1 THEN value END AS x FROM f)
SELECT event_id, coalesce(first_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0.0) AS filled FROM g""",
)
def e23(spark, d):
    df = frames(spark, d).withColumn("x", F.when(F.col("i") % 3 == 1, F.col("value")))
    return seq.fill_unscored(df, KEY, ORDER, "x").select("event_id", "filled")


@query(
    "f1_even_sample",
    f"""WITH {FR}, s AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM f),
k AS (SELECT DISTINCT user_id, CAST(floor(j * (n - 1) / 6.0) AS BIGINT) AS i FROM (SELECT DISTINCT user_id, n FROM s WHERE n > 7), range(7) AS t(j))
SELECT event_id FROM s WHERE n <= 7 UNION ALL SELECT s.event_id FROM s JOIN k USING (user_id, i)""",
)
def f1(spark, d):
    return seq.even_sample(frames(spark, d), KEY, ORDER, 7).select("event_id")


#: From smoothed frames sm(user_id, i, raw) to intervals with their samples.
MARKER = f"""t0 AS (SELECT *, CASE WHEN raw <> lag(raw) OVER (PARTITION BY user_id ORDER BY i) THEN 1 ELSE 0 END AS turn FROM sm),
r0 AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY i) AS run FROM t0),
ev AS (SELECT *, CASE WHEN i = 0 OR i - min(i) OVER (PARTITION BY user_id, run) + 1 >= 2 THEN raw END AS e0 FROM r0),
f2 AS (SELECT user_id, i, last_value(e0 IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS flag FROM ev),
t AS (SELECT *, CASE WHEN flag <> lag(flag) OVER (PARTITION BY user_id ORDER BY i) THEN 1 ELSE 0 END AS turn FROM f2),
r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY i) AS run FROM t),
rr AS (SELECT user_id, run, bool_or(flag) AS v, min(i) AS rs, max(i) AS re, count(*) AS n FROM r GROUP BY user_id, run)
{EDGE.format(on=2, off=2)}{THIN.format(gap=4)}
{SAMPLE.format(gone="(SELECT * FROM th WHERE kept AND kind = 'disappear')", seen="(SELECT * FROM th WHERE kept AND kind = 'appear')", fr='f2', flag='flag')}"""


@query(
    "g3_marker_segments",
    f"""WITH RECURSIVE {FR.replace('value >= 35 AS flag,', '')}, sm AS (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) >= 35 AS raw FROM f),
{MARKER}
SELECT user_id, s AS frame_start, t AS frame_end, sample FROM rep""",
)
def g3(spark, d):
    return seq.marker_segments(frames(spark, d).select("user_id", "ts", "event_id", "value"), KEY, ORDER, "value", 35.0, smooth=3)
