"""Segment refinement over events: segments are blocks of twelve frames of a user."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanline.operators import segments as sg
from spanline.plans.seq_queries import FR, MARKER, frames

QUERIES, ORACLES = {}, {}
K, KEY = ["user_id"], ["user_id", "segment_id"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def blocks(spark, d):
    """(segments, frames): blocks of twelve, the sample two before the end in every second one."""
    f = frames(spark, d).select("user_id", F.col("i").alias("idx"), "value", "flag", (F.col("value") >= 25).alias("mask"))
    s = f.withColumn("segment_id", F.floor(F.col("idx") / 12)).groupBy(*KEY).agg(F.min("idx").alias("frame_start"), F.max("idx").alias("frame_end"))
    return s.withColumn("sample", F.when(F.col("segment_id") % 2 == 1, F.col("frame_end") - 2)), f


SEG = FR + """, g AS (SELECT *, i // 12 AS sid, value >= 25 AS mask FROM f),
  s AS (SELECT user_id, sid, min(i) AS fs, max(i) AS fe, greatest(min(i), CASE WHEN sid % 2 = 1 THEN max(i) - 2 ELSE max(i) END) AS anchor FROM g GROUP BY user_id, sid),
  x AS (SELECT g.user_id, g.sid, i, value, flag, mask, fs, fe, anchor FROM g JOIN s USING (user_id, sid))"""


def runs_sql(src: str, flag: str, name: str) -> str:
    """Runs of a flag within segments, gaps of up to two filled, as CTEs."""
    return f""", {name}0 AS (SELECT *, CASE WHEN {flag} <> lag({flag}) OVER (PARTITION BY user_id, sid ORDER BY i) THEN 1 ELSE 0 END AS tn FROM {src}),
  {name}1 AS (SELECT *, sum(tn) OVER (PARTITION BY user_id, sid ORDER BY i) AS rn FROM {name}0),
  {name}2 AS (SELECT user_id, sid, rn, bool_or({flag}) AS v, min(i) AS rs, max(i) AS re, count(*) AS n, max(max(rn)) OVER (PARTITION BY user_id, sid) AS last, sum(count(*)) OVER (PARTITION BY user_id, sid) AS rows FROM {name}1 GROUP BY user_id, sid, rn)"""


CAND = SEG + ", u AS (SELECT * FROM x WHERE i <= anchor)" + runs_sql("u", "{flag}", "a") + """,
  fl AS (SELECT a1.user_id, a1.sid, a1.i, v OR (n <= 2 AND rn > 0 AND rn < last AND rows >= 3) AS ff FROM a1 JOIN a2 USING (user_id, sid, rn))""" + runs_sql("fl", "ff", "b") + """,
  cand AS (SELECT user_id, sid, min(rs) AS rs, arg_min(re, rs) AS re FROM b2 WHERE v AND n >= least(2, rows) GROUP BY user_id, sid)"""
PROBE = """, pr AS (SELECT user_id, sid, count(*) FILTER ({flag} AND i BETWEEN least(fe, fs + 1) AND least(fe, fs + 3)) AS hits FROM x GROUP BY user_id, sid)"""


@query("e17_boundary_confidence", f"""WITH {CAND.format(flag='flag')}
SELECT user_id, sid AS segment_id, re - rs + 1 AS run_len, round(avg(value) FILTER (i BETWEEN rs AND re), 6) AS run_avg, min(value) FILTER (i BETWEEN rs AND re) AS run_min,
  round(coalesce(avg(value) FILTER (i < rs AND i >= rs - least(re - rs + 1, 4)), 0), 6) AS before_avg,
  round(avg(value) FILTER (i BETWEEN rs AND re) - coalesce(avg(value) FILTER (i < rs AND i >= rs - least(re - rs + 1, 4)), 0), 6) AS rise
FROM u JOIN cand USING (user_id, sid) GROUP BY user_id, sid, rs, re""")  # fmt: skip
def e17(spark, d):
    s, f = blocks(spark, d)
    s = sg.with_frames(sg.with_anchor(s), f, K, "flag", "value")
    s = s.withColumn("upto", F.filter("fr", lambda x: x["idx"] <= F.col("anchor"))).withColumn("run", sg.candidate_run(F.col("upto"), "flag", 2, F.col("frame_start")))
    out = s.where("run.run_start IS NOT NULL").withColumn("c", sg.run_confidence(F.col("upto"), "value", F.col("run.run_start"), F.col("run.run_end"))).select(*KEY, "c.*")
    return out.select(*KEY, "run_len", F.round("run_avg", 6).alias("run_avg"), "run_min", F.round("before_avg", 6).alias("before_avg"), F.round("rise", 6).alias("rise"))


@query("e18_head_probe", f"WITH {SEG}{PROBE.format(flag='flag')} SELECT user_id, sid AS segment_id, hits AS probe_hits FROM pr")
def e18(spark, d):
    s, f = blocks(spark, d)
    return sg.head_probe(sg.in_segments(s, f, K), K, "flag", 6.0, 3)


BACK = """, pt AS (SELECT *, (max(i) OVER (PARTITION BY user_id, sid) - i) % {step} = 0 OR i = min(i) OVER (PARTITION BY user_id, sid) AS p FROM {src}),
  hit AS (SELECT user_id, sid, max(i) AS top FROM pt WHERE p AND {flag} GROUP BY user_id, sid),
  brk AS (SELECT pt.user_id, pt.sid, max(i) AS b FROM pt JOIN hit USING (user_id, sid) WHERE p AND NOT {flag} AND i < top GROUP BY pt.user_id, pt.sid),
  low AS (SELECT pt.user_id, pt.sid, min(i) AS lo FROM pt JOIN hit USING (user_id, sid) LEFT JOIN brk USING (user_id, sid) WHERE p AND {flag} AND i <= top AND i > coalesce(b, -1) GROUP BY pt.user_id, pt.sid),
  bk AS (SELECT low.user_id, low.sid, coalesce(max(CASE WHEN NOT {flag} AND i < lo THEN i END) + 1, min(i)) AS back FROM low JOIN pt USING (user_id, sid) GROUP BY low.user_id, low.sid)"""


@query("e19_last_run_start", f"WITH {SEG}{BACK.format(step=3, src='x', flag='flag')} SELECT s.user_id, s.sid AS segment_id, back AS found FROM s LEFT JOIN bk USING (user_id, sid)")
def e19(spark, d):
    s, f = blocks(spark, d)
    return sg.last_run_start(sg.in_segments(s, f, K).select(*KEY, "idx", "flag"), KEY, "flag", 3)


FORE = """, fp AS (SELECT *, (i - min(i) OVER w) % {step} = 0 OR i = max(i) OVER w AS p, lead({flag}) OVER (PARTITION BY user_id, sid ORDER BY i) AS nx FROM {src} WINDOW w AS (PARTITION BY user_id, sid)),
  fh AS (SELECT user_id, sid, min(i) FILTER (p AND {flag}) AS h, min(i) AS lo, max(i) AS hi, max(i) FILTER ({flag}) AS lt FROM fp GROUP BY user_id, sid),
  fw AS (SELECT fh.*, coalesce((SELECT max(i) + 1 FROM fp WHERE fp.user_id = fh.user_id AND fp.sid = fh.sid AND p AND i < h), lo) AS wake FROM fh),
  fo AS (SELECT fw.user_id, fw.sid, CASE WHEN any_value(hi - lt) < 2 THEN min(i) FILTER (h IS NOT NULL AND i >= wake AND {flag} AND nx) END AS fore FROM fw JOIN fp USING (user_id, sid) GROUP BY fw.user_id, fw.sid)"""


@query("e20_first_durable_run", f"WITH {SEG}{FORE.format(step=2, src='x', flag='flag')} SELECT user_id, sid AS segment_id, fore AS found FROM fo")
def e20(spark, d):
    s, f = blocks(spark, d)
    return sg.first_durable_run(sg.in_segments(s, f, K).select(*KEY, "idx", "flag"), KEY, "flag", 2)


@query("e21_blank_confirmed", f"""WITH {SEG}
SELECT user_id, sid AS segment_id, count(*) FILTER (flag AND ((i - fs) % 3 = 0 AND i - fs <= 6 OR (fe - i) % 3 = 0 AND fe - i <= 6)) < 2 AS confirmed FROM x GROUP BY user_id, sid""")  # fmt: skip
def e21(spark, d):
    s, f = blocks(spark, d)
    return sg.blank_confirmed(s, f, K, "flag", 3, 2)


@query("d14_min_duration", f"WITH {FR} SELECT user_id, count(*) AS n FROM (SELECT user_id, i // 5 AS b, max(i) - min(i) AS len FROM f GROUP BY user_id, b) WHERE len / 2.0 >= 2.0 GROUP BY user_id")
def d14(spark, d):
    f = frames(spark, d).groupBy("user_id", F.floor(F.col("i") / 5).alias("b")).agg(F.min("i").alias("s"), F.max("i").alias("e"))
    return f.where((F.col("e") - F.col("s")) / 2.0 >= 2.0).groupBy("user_id").agg(F.count("*").alias("n"))


@query("h2a_split_by_score", f"""WITH {CAND.format(flag='flag')}{PROBE.format(flag='flag')},
j AS (SELECT s.*, hits, rs, (SELECT min(value) FROM u WHERE u.user_id = s.user_id AND u.sid = s.sid) AS lo, (SELECT max(value) FROM u WHERE u.user_id = s.user_id AND u.sid = s.sid) AS hi FROM s JOIN pr USING (user_id, sid) LEFT JOIN cand USING (user_id, sid)),
q AS (SELECT *, hits < 3 AND coalesce(rs - fs >= 2, false) AS cut, CASE WHEN hits < 3 AND rs IS NULL THEN printf('marker2_boundary_unconfirmed:score=[%.4f,%.4f] threshold=35.0000', lo, hi) ELSE '' END AS why FROM j)
SELECT user_id, sid AS segment_id, fs AS frame_start, rs - 1 AS frame_end, false AS has_name, NULL::BIGINT AS sample, why AS reasons FROM q WHERE cut
UNION ALL SELECT user_id, sid, CASE WHEN cut THEN rs ELSE fs END, fe, true, CASE WHEN cut THEN rs + (fe - rs) // 2 ELSE fs + (fe - fs) // 2 END, why FROM q""")  # fmt: skip
def h2a(spark, d):
    s, f = blocks(spark, d)
    out = sg.split_blank_dialogue(s, f, K, "value", 35.0, 6.0, probe_frames=3, probe_least=3)
    return out.select(*KEY, "frame_start", "frame_end", "has_name", "sample", F.array_join("review_reason", ",").alias("reasons"))


def timeline_sql() -> str:
    """The end-to-end timeline: marker segments, split by the score, numbered anew, with the stub's answers and reasons."""
    return f"""WITH RECURSIVE {FR}, sm AS (SELECT user_id, i, flag AS raw FROM f),
{MARKER},
s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY rep.s) AS sid, rep.s AS fs, rep.t AS fe, greatest(rep.s, least(rep.t, sample)) AS anchor FROM rep),
x AS (SELECT f.user_id, sid, i, value, flag, fs, fe, anchor FROM f JOIN s ON f.user_id = s.user_id AND i BETWEEN fs AND fe){CAND.format(flag='flag')[len(SEG):]},
pr AS (SELECT user_id, sid, count(*) FILTER (flag AND i BETWEEN fs AND least(fe, fs + 2)) AS hits FROM x GROUP BY user_id, sid),
lh AS (SELECT user_id, sid, min(value) AS lo, max(value) AS hi FROM u GROUP BY user_id, sid),
j AS (SELECT s.*, hits, rs, lo, hi, coalesce(hits < 3 AND rs - fs >= 2, false) AS cut FROM s LEFT JOIN pr USING (user_id, sid) LEFT JOIN cand USING (user_id, sid) LEFT JOIN lh USING (user_id, sid)),
q AS (SELECT *, CASE WHEN hits < 3 AND rs IS NULL THEN printf('marker2_boundary_unconfirmed:score=[%.4f,%.4f] threshold=35.0000', lo, hi) END AS why FROM j),
parts AS (
  SELECT user_id, fs, rs - 1 AS fe, false AS talk, NULL::BIGINT AS sample, why FROM q WHERE cut
  UNION ALL SELECT user_id, CASE WHEN cut THEN rs ELSE fs END AS fs, fe, true, CASE WHEN cut THEN rs + (fe - rs) // 2 ELSE fs + (fe - fs) // 2 END, why FROM q),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fs, fe) AS id FROM parts),
asked AS (SELECT *, '{{"user_id":' || user_id || ',"segment_id":' || id || ',"start":' || CAST(fs / 2.0 AS DOUBLE) || ',"end":' || CAST(fe / 2.0 AS DOUBLE) || ',"sample":' || sample || '}}' AS ask FROM o),
said AS (SELECT *, talk AND length(ask) % 5 > 0 AND length(ask) % 7 > 0 AS ok,
  CASE WHEN NOT talk THEN NULL WHEN length(ask) % 5 = 0 THEN 'stub_error:ValueError' WHEN length(ask) % 7 = 0 THEN 'stub_empty' END AS failed FROM asked)
SELECT user_id, id AS segment_id, fs AS frame_start, fe AS frame_end, CASE WHEN talk THEN 'speaker_dialogue' ELSE 'blank_no_name' END AS dialogue_type, CASE WHEN ok THEN upper(ask[1:12]) END AS translation_subtitle,
  concat_ws(',', why, failed, CASE WHEN talk AND NOT ok THEN 'translation_missing' END) AS reasons, why IS NOT NULL OR talk AND NOT ok AS needs_review FROM said"""


ORACLES["h13_timeline"] = timeline_sql()


def h2b_sql() -> str:
    return f"""WITH {CAND.format(flag='mask')}{PROBE.format(flag='flag')}{BACK.format(step=1, src='u', flag='flag')},
fwd AS (SELECT u.* FROM u JOIN cand USING (user_id, sid) WHERE i >= rs - 3){FORE.format(step=1, src='fwd', flag='flag')},
j AS (SELECT s.*, hits, rs, back, fore, CASE WHEN rs IS NULL THEN back ELSE coalesce(fore, back) END AS ct FROM s JOIN pr USING (user_id, sid) LEFT JOIN cand USING (user_id, sid) LEFT JOIN bk USING (user_id, sid) LEFT JOIN fo USING (user_id, sid)),
c AS (SELECT j.user_id, j.sid, count(*) FILTER (flag AND i < ct AND ((i - j.fs) % 3 = 0 AND i - j.fs <= 6 OR (ct - 1 - i) % 3 = 0 AND ct - 1 - i <= 6)) < 2 AS ok FROM j JOIN x USING (user_id, sid) GROUP BY j.user_id, j.sid),
o AS (SELECT j.*, CASE WHEN hits >= 3 THEN 'probe' WHEN rs IS NULL AND ct IS NULL THEN 'miss' WHEN rs - fs < 2 THEN 'short' WHEN ct IS NULL THEN 'unconfirmed' WHEN ct - fs < 2 THEN 'short' WHEN NOT ok THEN 'not_blank' ELSE 'split' END AS outcome FROM j JOIN c USING (user_id, sid))
SELECT user_id, sid AS segment_id, fs AS frame_start, ct - 1 AS frame_end, false AS has_name, outcome FROM o WHERE outcome = 'split'
UNION ALL SELECT user_id, sid, CASE WHEN outcome = 'split' THEN ct ELSE fs END, fe, true, outcome FROM o"""


@query("h2b_split_by_presence", h2b_sql())
def h2b(spark, d):
    s, f = blocks(spark, d)
    out = sg.split_by_presence(s, f, K, "mask", "flag", 6.0, probe_frames=3, probe_least=3, lookback=3)
    return out.select(*KEY, "frame_start", "frame_end", "has_name", "outcome")


def h2b_mask_sql() -> str:
    return f"""WITH {CAND.format(flag='mask')}{PROBE.format(flag='mask')}{BACK.format(step=1, src='u', flag='mask')},
cf AS (SELECT user_id, sid, re - rs + 1 AS len, avg(value) FILTER (i BETWEEN rs AND re) AS mean, coalesce(avg(value) FILTER (i < rs AND i >= rs - least(re - rs + 1, 4)), 0) AS before FROM u JOIN cand USING (user_id, sid) GROUP BY user_id, sid, rs, re),
j AS (SELECT s.*, hits, rs, coalesce(rs, back) AS ct, len < 2 OR mean < 30 OR (rs > fs AND mean - before < 0.002) AS low FROM s JOIN pr USING (user_id, sid) LEFT JOIN cand USING (user_id, sid) LEFT JOIN bk USING (user_id, sid) LEFT JOIN cf USING (user_id, sid)),
c AS (SELECT j.user_id, j.sid, count(*) FILTER (mask AND i < ct AND ((i - j.fs) % 3 = 0 AND i - j.fs <= 6 OR (ct - 1 - i) % 3 = 0 AND ct - 1 - i <= 6)) < 2 AS ok FROM j JOIN x USING (user_id, sid) GROUP BY j.user_id, j.sid),
o AS (SELECT j.*, CASE WHEN hits >= 3 THEN 'probe' WHEN ct IS NULL THEN 'miss' WHEN low THEN 'low' WHEN ct - fs < 2 THEN 'short' WHEN NOT ok THEN 'not_blank' ELSE 'split' END AS outcome FROM j JOIN c USING (user_id, sid))
SELECT user_id, sid AS segment_id, fs AS frame_start, ct - 1 AS frame_end, false AS has_name, outcome FROM o WHERE outcome = 'split'
UNION ALL SELECT user_id, sid, CASE WHEN outcome = 'split' THEN ct ELSE fs END, fe, true, outcome FROM o"""


@query("h2b_split_by_mask", h2b_mask_sql())
def h2b_mask(spark, d):
    s, f = blocks(spark, d)
    out = sg.split_by_presence(s, f, K, "mask", None, 6.0, probe_frames=3, probe_least=3, presence="value", split_presence=30.0)
    return out.select(*KEY, "frame_start", "frame_end", "has_name", "outcome")


@query("h1_coarse_to_fine", f"""WITH {FR}, p AS (SELECT *, i % 3 = 0 OR i = count(*) OVER (PARTITION BY user_id) - 1 OR count(*) OVER (PARTITION BY user_id) <= 4 AS anchor FROM f),
a AS (SELECT user_id, i AS a, value AS x, lead(i) OVER w AS b, lead(value) OVER w AS y, quantile_cont(value, 0.7) OVER (PARTITION BY user_id) AS thr FROM p WHERE anchor WINDOW w AS (PARTITION BY user_id ORDER BY i)),
v AS (SELECT a.*, f.i AS m, (x >= thr) <> (y >= thr) OR abs(x - thr) <= 5 OR abs(y - thr) <= 5 OR abs(f.value - thr) <= 5 OR (f.value >= thr) <> (x >= thr) AS rough FROM a JOIN f ON f.user_id = a.user_id AND f.i = a.a + (b - a.a) // 2)
SELECT event_id, round(CASE WHEN anchor OR rough THEN value WHEN i - a <= b - i THEN x ELSE y END, 6) AS score, anchor OR rough OR i = m AS computed
FROM p LEFT JOIN v ON p.user_id = v.user_id AND i >= a AND i < b""")  # fmt: skip
def h1(spark, d):
    f = frames(spark, d).select("user_id", "ts", "event_id", "value")
    return sg.coarse_to_fine(f, K, ["ts", "event_id"], F.col("value"), 3, 5.0).select("event_id", F.round("score", 6).alias("score"), "computed")


CFG = {"presence": 35.0, "change": 0.5, "clear": 15.0, "name_presence": 60.0, "name_change": 1.0, "stable_frames": 1, "clear_frames": 2, "min_duration": 1.0}


def metrics(spark, d):
    f = frames(spark, d)
    return f.select("user_id", F.col("i").alias("idx"), F.col("i").cast("double").alias("ts"), F.col("value").alias("presence"), ((F.col("event_id") % 10) / 10).alias("diff"), F.col("value").alias("name_presence"), (F.col("event_id") % 4 / 2).alias("name_diff"))


#: The machine row by row (stable_frames 1, clear_frames 2), then segments from where it opened (act 1, 3) and closed (2, 3).
FLAGS = "value >= 35 AS t, (event_id % 10) / 10.0 >= 0.5 AS c, value <= 15 AS x, value >= 60 AND (event_id % 4) / 2.0 >= 1.0 AS n"
MACHINE = """w AS (
  SELECT user_id, -1::BIGINT AS i, 'idle' AS phase, 0 AS gone, 0 AS act, false AS t FROM (SELECT DISTINCT user_id FROM m)
  UNION ALL
  SELECT user_id, i, CASE WHEN act % 2 = 1 THEN 'rising' WHEN act = 2 THEN 'idle' WHEN phase = 'rising' AND t AND NOT c THEN 'still' WHEN phase = 'still' AND x THEN 'fading' ELSE phase END,
    CASE WHEN act > 0 THEN 0 WHEN phase = 'rising' AND (t AND NOT c OR NOT x) THEN 0 WHEN phase = 'rising' THEN gone + 1 WHEN phase = 'still' THEN CASE WHEN x THEN 1 ELSE 0 END WHEN phase = 'fading' THEN gone + 1 ELSE 0 END, act, t
  FROM (
    SELECT m.*, phase, gone, CASE WHEN phase = 'idle' THEN CASE WHEN m.t THEN 1 ELSE 0 END
      WHEN n THEN CASE WHEN m.t THEN 3 ELSE 2 END
      WHEN phase = 'rising' THEN CASE WHEN x AND gone >= 1 THEN 2 ELSE 0 END
      WHEN phase = 'still' THEN CASE WHEN c AND NOT x THEN 3 ELSE 0 END
      WHEN m.t THEN 3 WHEN gone >= 1 THEN 2 ELSE 0 END AS act
    FROM w JOIN m ON m.user_id = w.user_id AND m.i = w.i + 1)),
ends AS (SELECT user_id, i AS r FROM w WHERE act >= 2 UNION ALL SELECT user_id, max(i) + 1 FROM w GROUP BY user_id HAVING arg_max(phase, i) <> 'idle'{ended}),
e AS (SELECT *, coalesce(lag(r) OVER (PARTITION BY user_id ORDER BY r), -1) AS since FROM ends),
s AS (
  SELECT e.user_id, r, max(i) FILTER (act % 2 = 1 AND i < r) AS a, max(i) FILTER (t AND i <= r) AS b, coalesce(string_agg({idx}, ',' ORDER BY i) FILTER (t AND i > since AND i <= r), '') AS samples
  FROM e JOIN w USING (user_id) GROUP BY e.user_id, r)"""
G2 = f"""WITH RECURSIVE {FR}, m AS (SELECT user_id, i, {FLAGS} FROM f),
{MACHINE.format(ended="", idx="i")}
SELECT user_id, a AS frame_start, b AS frame_end, CAST(a AS DOUBLE) AS start, CAST(b AS DOUBLE) AS "end", samples FROM s WHERE b - a >= 1"""


@query("g2_dialogue_segments", G2)
def g2(spark, d):
    return sg.dialogue_segments(metrics(spark, d), K, ["idx"], CFG).withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("string")), ","))
