"""Entries, reviews, edits, inference, rendering, files, vectors and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanline.functions import scalars as sc
from spanline.operators import edits as ed
from spanline.operators import review as rv
from spanline.operators import sequence as seq
from spanline.operators.infer import Policy, batch_infer, sequential_infer
from spanline.operators.render import entry_font_size, font_size, layered
from spanline.operators.vision import template_match
from spanline.plans import pipeline
from spanline.plans.scalar_queries import t
from spanline.plans.seq_queries import frames
from spanline.sources import files
from spanline.streaming import streams as st

QUERIES, ORACLES = {}, {}
LAYOUT = {"width": 1280, "height": 720, "text": (100, 500, 1180, 700), "title": (0, 0, 1280, 100), "info": (0, 100, 640, 140), "text_height": 200, "title_height": 60}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def stored(spark, d) -> DataFrame:
    return files.from_conversations(t(spark, d, "conversations"))


def short(spark, d) -> DataFrame:
    """Conversations as entries for review."""
    c = t(spark, d, "conversations")
    return c.select("conv_id", F.col("turn").alias("id"), F.when(F.col("role") == "system", "title").otherwise("speaker_dialogue").alias("kind"), F.col("role").alias("speaker"), F.col("text").alias("original"), F.col("text").alias("translation"))


@query(
    "e11_context",
    """WITH c AS (SELECT conv_id, turn, role, turn || ':' || text AS item, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
SELECT conv_id, turn, coalesce((SELECT string_agg(item, '|' ORDER BY turn) FROM (SELECT * FROM c b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND role <> 'system' ORDER BY turn DESC LIMIT 2)), '') AS before,
coalesce((SELECT string_agg(item, '|' ORDER BY turn) FROM (SELECT * FROM c b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND role <> 'system' ORDER BY turn LIMIT 2)), '') AS after FROM c a""",
)
def e11(spark, d):
    item = F.concat(F.col("turn").cast("string"), F.lit(":"), "text")
    c = seq.with_context(t(spark, d, "conversations"), ["conv_id"], ["turn"], item, 2, F.col("role") != "system")
    return c.select("conv_id", "turn", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@query(
    "e11_context_positions",
    """SELECT conv_id, turn, coalesce(string_agg(CASE WHEN role <> 'system' THEN CAST(turn AS VARCHAR) END, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before,
coalesce(string_agg(CASE WHEN role <> 'system' THEN CAST(turn AS VARCHAR) END, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM conversations""",
)
def e11b(spark, d):
    c = seq.with_context(t(spark, d, "conversations"), ["conv_id"], ["turn"], F.col("turn").cast("string"), 2, F.col("role") != "system", mode="positions")
    return c.select("conv_id", "turn", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@query(
    "e12_history",
    """SELECT conv_id, turn, coalesce((SELECT string_agg(CAST(turn AS VARCHAR), '|' ORDER BY turn) FROM (SELECT turn FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND role <> 'system' AND turn % 3 <> 0 ORDER BY turn DESC LIMIT 3)), '') AS history FROM conversations a""",
)
def e12(spark, d):
    c = t(spark, d, "conversations").withColumn("translation", F.when(F.col("turn") % 3 != 0, "x").otherwise(" "))
    ok = sc.is_dialogue(F.when(F.col("role") == "system", "blank").otherwise("speaker_dialogue")) & (sc.text("text") != "") & (sc.text("translation") != "")
    c = seq.with_context(c, ["conv_id"], ["turn"], F.col("turn").cast("string"), 3, ok)
    return c.select("conv_id", "turn", F.array_join("before", "|").alias("history"))


@query("e13_occurrence", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS seen, count(*) OVER (PARTITION BY conv_id, role) AS times FROM conversations")
def e13(spark, d):
    return seq.occurrence(t(spark, d, "conversations"), ["conv_id"], ["turn"], "role").select("conv_id", "turn", "seen", "times")


@query(
    "b26_style_layers",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN 'N' || n_nationkey ELSE 'Microsoft YaHei' END AS font,
greatest(20, CAST(floor(p_size * 4 / 2.0 * 0.8) AS INTEGER)) AS base, CASE WHEN p_size % 2 = 0 THEN greatest(1, p_size // 2) ELSE greatest(1, CAST(floor(greatest(20, CAST(floor(p_size * 4 / 2.0 * 0.8) AS INTEGER)) * 0.5) AS INTEGER)) END AS own
FROM part JOIN nation ON n_nationkey = p_partkey % 25""",
)
def b26(spark, d):
    n = t(spark, d, "nation").select((F.col("n_nationkey")).alias("k"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("nf"))
    p = t(spark, d, "part").withColumn("k", F.col("p_partkey") % 25).join(n, "k")
    k = F.col("p_size") % 3
    p = p.withColumn("entry", F.struct(F.when(k == 0, F.col("p_brand")).otherwise(" ").alias("font_name"), F.when(F.col("p_size") % 2 == 0, F.floor(F.col("p_size") / 2).cast("string")).alias("font_size"), F.lit("0.5").alias("font_size_scale")))
    p = p.withColumn("project", F.struct(F.when(k == 1, F.col("nf")).alias("font_name")))
    size = font_size(F.col("p_size") * 4, F.lit(720), F.lit(0.8), F.lit(20))
    p = p.withColumn("base", size)
    return p.select("p_partkey", layered("font_name", "entry", "project").alias("font"), "base", entry_font_size("entry", "base").alias("own"))


@query(
    "b27_coerce_entries",
    """SELECT conv_id AS project, turn + 1 AS segment_id, CASE WHEN turn % 3 = 0 THEN CAST(turn + 1 AS VARCHAR) ELSE 'manual_insert' END AS raw_id, turn * 2.0 AS time_end, CASE WHEN role = 'system' THEN 'blank' ELSE 'speaker_dialogue' END AS dialogue_type,
CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS line_count FROM (SELECT conv_id, turn, role, trim(text, ' ' || chr(10)) AS text FROM conversations)""",
)
def b27(spark, d):
    c = t(spark, d, "conversations").select(
        F.col("conv_id").alias("project"), "turn", F.lit("x").alias("segment_id"), F.when(F.col("turn") % 3 != 0, " manual_insert ").alias("raw_id"), (F.col("turn") * 2.0).alias("time_start"), F.lit(None).cast("double").alias("time_end"),
        F.when(F.col("role") == "system", "blank").alias("dialogue_type"), F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("string").alias("text_original"), F.col("text").alias("translation_subtitle"),
    )
    e = rv.coerce_entries(c, ["project"], ["turn"])
    return e.select("project", "segment_id", "raw_id", "time_end", "dialogue_type", F.col("line_count").cast("long").alias("line_count"))


@query("a3_backfill_ids", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN n ELSE CASE WHEN event_id % 3 = 1 THEN 100 ELSE 200 END END AS segment_id, CASE WHEN event_id % 3 = 0 THEN n ELSE CASE WHEN event_id % 3 = 1 THEN 100 ELSE 200 END END AS marker_seg_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)")
def a3(spark, d):
    k = F.col("event_id") % 3
    e = t(spark, d, "events").select("user_id", "ts", "event_id", F.when(k == 1, 100).alias("segment_id"), F.when(k == 2, 200).alias("marker_seg_id"))
    return files.backfill_ids(e, ["user_id"], ["ts", "event_id"]).select("event_id", "segment_id", "marker_seg_id")


@query("a4_series", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS score, 5.0 + (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 4.0 AS ts FROM events")
def a4(spark, d):
    packed = files.pack_series(frames(spark, d).select("user_id", "i", "value"), ["user_id"], "i", "value").withColumn("start_sec", F.lit(5.0)).withColumn("scan_fps", F.lit(4.0))
    return files.unpack_series(packed).select("user_id", "pos", "score", "ts")


@query("a5_review_export", "SELECT conv_id, turn AS segment_id, role AS speaker, 0.5 AS confidence, role = 'system' AS needs_review FROM conversations")
def a5(spark, d):
    c = t(spark, d, "conversations").select(
        "conv_id", F.col("turn").alias("segment_id"), F.concat(F.col("conv_id").cast("string")).alias("raw_id"), (F.col("turn") * 2.0).alias("time_start"), (F.col("turn") * 2.0).alias("time_end"), F.lit("speaker_dialogue").alias("dialogue_type"), F.col("role").alias("speaker"),
        F.col("text").alias("text_original"), F.col("text").alias("translation_subtitle"), F.lit(1).alias("line_count"), F.lit(0.5).alias("text_ocr_confidence"), (F.col("role") == "system").alias("needs_review"), F.array().cast("array<string>").alias("review_reason"), F.lit(None).cast("string").alias("keyframe"),
    )
    return rv.review_export(c).select(F.col("raw_id").cast("long").alias("conv_id"), "segment_id", "speaker", "confidence", "needs_review")


@query(
    "h12_review_metadata",
    """WITH c AS (SELECT conv_id, turn, role, CASE WHEN turn % 4 = 0 THEN 'old,' ELSE '' END || CASE WHEN role = 'system' THEN '' WHEN turn % 3 = 0 THEN 'translation_missing,' ELSE '' END AS r FROM conversations)
SELECT conv_id, turn, rtrim(r, ',') AS reasons, r <> '' AS needs_review FROM c""",
)
def h12(spark, d):
    c = t(spark, d, "conversations").select(
        "conv_id", "turn", F.col("turn").alias("segment_id"), F.lit("1").alias("raw_id"), (F.col("turn") * 2.0).alias("time_start"), (F.col("turn") * 2.0).alias("time_end"), F.when(F.col("role") == "system", "blank").otherwise("speaker_dialogue").alias("dialogue_type"),
        F.lit("").alias("text_original"), F.when(F.col("turn") % 3 != 0, F.col("text")).alias("translation_subtitle"), F.when(F.col("turn") % 4 == 0, F.array(F.lit(" old "))).alias("review_reason"), F.lit(True).alias("needs_review"), F.lit("x").alias("srt_start"),
    )
    return rv.review_metadata(c).select("conv_id", "turn", F.array_join("review_reason", ",").alias("reasons"), "needs_review")


STUB = Policy(retries=1, empty_limit=2, threads=2, name="stub")


def stub(request: str, timeout: float):
    """A deterministic stand-in for a model: fails on every fifth length, says nothing on every seventh."""
    if len(request) % 5 == 0:
        raise ValueError("no")
    return ("", {}) if len(request) % 7 == 0 else (request[:12].upper(), {"prompt": len(request), "completion": 3})


@query(
    "h5_batch_infer",
    """SELECT conv_id, turn, CASE WHEN n % 5 = 0 THEN 'error' WHEN n % 7 = 0 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN n % 5 = 0 OR n % 7 = 0 THEN 2 ELSE 1 END AS attempts,
CASE WHEN n % 5 = 0 THEN 'stub_error:ValueError' WHEN n % 7 = 0 THEN 'stub_empty' END AS reason, CASE WHEN n % 5 = 0 OR n % 7 = 0 THEN 0 ELSE n + 3 END AS total FROM (SELECT conv_id, turn, length(text) AS n FROM conversations)""",
)
def h5(spark, d):
    out = batch_infer(t(spark, d, "conversations").select("conv_id", "turn", "text"), stub, "text", STUB)
    return out.select("conv_id", "turn", "status", "attempts", "reason", "total")


@query("h6_sequential_infer", "SELECT conv_id, turn, length(text) + coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total FROM conversations")
def h6(spark, d):
    def add(text, before, after):
        return str(len(text) + (int(before[-1][1]) if before else 0))

    out = sequential_infer(t(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], ["turn"], add, "text", 2)
    return out.select("conv_id", "turn", F.col("result").cast("long").alias("total"))


@query(
    "h7_build_requests",
    """SELECT conv_id, turn, 'Translate for ' || role || '.' || CASE WHEN turn % 2 = 0 THEN chr(10) || '### Notes' || chr(10) || 'n' || turn ELSE '' END AS system, 'T: ' || text AS user FROM conversations""",
)
def h7(spark, d):
    c = t(spark, d, "conversations").withColumn("body", F.col("text")).withColumn("notes", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("n"), F.col("turn").cast("string"))).otherwise(" "))
    r = rv.build_requests(c, {"system": "Translate for {role}.", "user": "T: {body}"}, [("Notes", "notes")])
    return r.select("conv_id", "turn", F.get_json_object("request", "$.messages[0].content").alias("system"), F.get_json_object("request", "$.messages[1].content").alias("user"))


def reviewer(request: str, timeout: float):
    """Changes every second id; a chunk whose first id is 4 has no JSON, unless asked to repair it in vain."""
    import json

    if request.startswith("repair"):
        return "still nothing"
    rows = json.loads(json.loads(request)["messages"][1]["content"])
    if rows[0]["id"] == 4:
        return "sorry"
    return "Here: " + json.dumps({"updates": [{"id": r["id"], "translation": r["translation"] + "!", "reason": "r"} for r in rows if r["id"] % 2]})


@query(
    "h8_auto_review",
    """WITH e AS (SELECT conv_id, turn, role, text, trim(text, ' ' || chr(10)) <> '' AND role <> 'system' AND turn > 0 AS ok FROM conversations),
c AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS ch FROM e WHERE ok),
f AS (SELECT conv_id, ch, min(turn) AS first FROM c GROUP BY ALL)
SELECT e.conv_id, e.turn AS id, CASE WHEN f.first <> 4 AND e.turn % 2 = 1 THEN e.text || '!' ELSE e.text END AS translation, coalesce(f.first <> 4 AND e.turn % 2 = 1, false) AS updated
FROM e LEFT JOIN c USING (conv_id, turn) LEFT JOIN f ON f.conv_id = c.conv_id AND f.ch = c.ch""",
)
def h8(spark, d):
    out = rv.auto_review(short(spark, d), reviewer, ["conv_id"], {"system": "Review.", "user": "{items}"}, 3, Policy(name="review"))
    return out["entries"].select("conv_id", "id", "translation", "updated")


def edit_base(spark, d):
    c = short(spark, d)
    return c.select("conv_id", F.col("id").alias("pos"), "id", F.col("id").cast("string").alias("raw_id"), (F.col("id") * 2.0).alias("start"), (F.col("id") * 2.0 + 1.5).alias("end"), "kind", "speaker", "original", "translation", F.array().cast("array<string>").alias("review_reason"))


def one_edit(spark, d, op: str, anchor: int, where: str, **values):
    c = t(spark, d, "conversations").select("conv_id").distinct().where(where)
    fields = {f: F.lit(values.get(f)).cast("double" if f in ("start", "end") else "string").alias(f) for f in ("start", "end", "kind", "speaker", "original", "translation", "choices")}
    return c.select("conv_id", F.lit(1).alias("seq"), F.lit(op).alias("op"), F.lit(anchor).cast("long").alias("anchor_id"), *fields.values())


@query("h9_delete", "SELECT conv_id, turn AS old, turn - CASE WHEN turn > 1 AND conv_id % 2 = 0 THEN 1 ELSE 0 END AS id FROM conversations WHERE NOT (turn = 1 AND conv_id % 2 = 0)")
def h9(spark, d):
    out = ed.apply_edits(edit_base(spark, d), one_edit(spark, d, "delete", 1, "conv_id % 2 = 0"), ["conv_id"])
    return out.select("conv_id", F.col("raw_id").cast("long").alias("old"), "id")


@query("h9_delete_window", "SELECT conv_id, turn AS old, turn - CASE WHEN turn > 1 AND conv_id % 2 = 0 THEN 1 ELSE 0 END AS id FROM conversations WHERE NOT (turn = 1 AND conv_id % 2 = 0)")
def h9w(spark, d):
    out = ed.delete_rows(edit_base(spark, d), one_edit(spark, d, "delete", 1, "conv_id % 2 = 0"), ["conv_id"])
    return out.select("conv_id", F.col("raw_id").cast("long").alias("old"), "id")


@query(
    "h9_insert",
    """SELECT conv_id, CAST(turn AS VARCHAR) AS raw_id, turn + CASE WHEN turn > 1 AND EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = 1) THEN 1 ELSE 0 END AS id FROM conversations a
UNION ALL SELECT conv_id, 'manual_insert', 2 FROM conversations WHERE turn = 1""",
)
def h9i(spark, d):
    out = ed.apply_edits(edit_base(spark, d), one_edit(spark, d, "insert_after", 1, "true", start=3.5, end=3.9, kind="speaker_dialogue", original="x"), ["conv_id"])
    return out.select("conv_id", "raw_id", "id")


@query(
    "h9_merge",
    """WITH p AS (SELECT *, lead(text) OVER w AS t2, lead(turn) OVER w AS n2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn AS id, md5(CASE WHEN turn = 1 AND n2 IS NOT NULL THEN text || chr(10) || t2 ELSE text END) AS original, CASE WHEN turn = 1 AND n2 IS NOT NULL THEN n2 * 2.0 + 1.5 ELSE turn * 2.0 + 1.5 END AS "end"
FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.conv_id = a.conv_id AND b.turn = 1 AND b.n2 = a.turn)""",
)
def h9m(spark, d):
    out = ed.apply_edits(edit_base(spark, d), one_edit(spark, d, "merge", 1, "true"), ["conv_id"])
    return out.select("conv_id", "id", F.md5("original").alias("original"), "end")


@query("h9_set", "SELECT conv_id, turn AS id, CASE WHEN turn = 2 AND conv_id % 3 = 0 THEN 'new' ELSE text END AS translation FROM conversations")
def h9s(spark, d):
    out = ed.apply_edits(edit_base(spark, d), one_edit(spark, d, "set", 2, "conv_id % 3 = 0", translation="new"), ["conv_id"])
    return out.select("conv_id", "id", "translation")


LINES = r"""WITH c AS (SELECT conv_id, turn, role, turn * 2.0 AS s, turn * 2.0 + 1.5 AS e, trim(text, ' ' || chr(10)) AS q, text FROM conversations),
x AS (SELECT *, replace(CASE WHEN q <> '' THEN q ELSE text END, chr(10), '\N') AS shown, printf('0:00:%02d.%02d', CAST(floor(s) AS INTEGER), 0) AS a, printf('0:00:%02d.%02d', CAST(floor(e) AS INTEGER), 50) AS b FROM c)
SELECT conv_id AS project, 4 AS section, turn + 1 AS pos, 0 AS sub, 'Dialogue: 0,' || a || ',' || b || ',Default,,0,0,0,,' || CASE WHEN turn = 0 THEN '{\an5\pos(640,50)\fs48}' ELSE '{\an1\pos(100,700)}' END || shown AS line FROM x
UNION ALL SELECT conv_id, 4, 1, 1, 'Dialogue: 0,' || a || ',' || b || ',Default,,0,0,0,,{\an5\pos(320,120)\fs48}' || role FROM x WHERE turn = 0"""


@query("h10_subtitle_events", LINES)
def h10(spark, d):
    return pipeline.subtitles_from_cache(stored(spark, d), LAYOUT).where("section = 4")


@query(
    "h11_timeline_only",
    r"""SELECT conv_id AS project, turn + 1 AS pos, 'Dialogue: 0,' || printf('0:00:%02d.00,0:00:%02d.50', turn * 2, turn * 2 + 1) || ',Default,,0,0,0,,' || CASE WHEN turn = 0 THEN '{\an5\pos(640,50)\fs48}[TITLE]'
ELSE '{\an1\pos(100,700)}' || printf('[DEBUG] seg %d (id=%d) %.2f-%.2fs ', turn, turn, turn * 2.0, turn * 2.0 + 1.5) || CASE WHEN role = 'system' THEN 'blank' ELSE 'has_name=true' END END AS line FROM conversations""",
)
def h11(spark, d):
    return pipeline.subtitles_from_cache(stored(spark, d), LAYOUT, timeline_only=True).where("section = 4 AND sub = 0").select("project", "pos", "line")


STYLE = "'Style: {name},Microsoft YaHei,80,{primary},&H000000FF,' || {outline} || ',&H64000000,0,0,0,0,100,100,0,0,1,{rest},40,40,40,1'"
#: Whole files: headers, the two fixed styles, a style for each styled speaker's row, events as in h10 with it, labels on top.
FILES = LINES[: LINES.index("\nSELECT conv_id")] + rf""",
p AS (SELECT DISTINCT conv_id FROM x), k AS (SELECT *, turn > 0 AND role <> 'system' AS own FROM x)
SELECT conv_id AS project, section, pos, 0 AS sub, line FROM p, (VALUES (0, 0, '[Script Info]'), (0, 1, 'ScriptType: v4.00+'), (0, 2, 'PlayResX: 1280'), (0, 3, 'PlayResY: 720'), (0, 4, ''), (0, 5, '[V4+ Styles]'),
  (0, 6, 'Format: Name,Fontname,Fontsize,PrimaryColour,SecondaryColour,OutlineColour,BackColour,Bold,Italic,Underline,StrikeOut,ScaleX,ScaleY,Spacing,Angle,BorderStyle,Outline,Shadow,Alignment,MarginL,MarginR,MarginV,Encoding'),
  (1, 0, {STYLE.format(name="Default", primary="&H00FFFFFF", outline="'&H00000000'", rest="2.4,0.8,2")}), (1, 1, {STYLE.format(name="DebugOverlay", primary="&H0000FFFF", outline="'&H00000000'", rest="2.0,0.5,8")}),
  (3, 7, ''), (3, 8, '[Events]'), (3, 9, 'Format: Layer,Start,End,Style,Name,MarginL,MarginR,MarginV,Effect,Text')) AS h(section, pos, line)
UNION ALL SELECT conv_id, 2, turn + 1, 0, {STYLE.format(name="Entry_' || (turn + 1) || '", primary="&H00FFFFFF", outline="CASE role WHEN 'user' THEN '&H00004DFF' ELSE '&H00B76801' END", rest="2.4,0.8,2")} FROM k WHERE own
UNION ALL SELECT conv_id, 4, turn + 1, 0, 'Dialogue: 0,' || a || ',' || b || ',' || CASE WHEN own THEN 'Entry_' || (turn + 1) ELSE 'Default' END || ',,0,0,0,,' || CASE WHEN turn = 0 THEN '{{\an5\pos(640,50)\fs48}}' ELSE '{{\an1\pos(100,700)}}' END || shown FROM k
UNION ALL SELECT conv_id, 4, 1, 1, 'Dialogue: 0,' || a || ',' || b || ',Default,,0,0,0,,{{\an5\pos(320,120)\fs48}}' || role FROM k WHERE turn = 0
UNION ALL SELECT conv_id, 5, turn + 1, 0, 'Dialogue: 1,' || a || ',' || b || ',DebugOverlay,,0,0,0,,{{\an8\pos(640,40)}}' || CASE WHEN turn = 0 THEN '[TITLE]'
  ELSE printf('[DEBUG] seg %d (id=%d) %.2f-%.2fs ', turn, turn, s, e) || CASE WHEN role = 'system' THEN 'blank' ELSE 'has_name=true' END END FROM k"""


@query("h13_subtitles_from_cache", FILES)
def h13(spark, d):
    """Whole subtitle files, speakers' styles matched by name, labels on top."""
    styles = t(spark, d, "conversations").select(F.col("role").alias("speaker")).distinct().where("speaker <> 'system'").withColumn("outline_colour", F.when(F.col("speaker") == "user", "&H00004DFF").otherwise("&H00B76801"))
    return pipeline.subtitles_from_cache(stored(spark, d), LAYOUT, styles, debug=True)


@query("h13_timeline")
def h13b(spark, d):
    f = frames(spark, d).select("user_id", "ts", "event_id", "value")
    out = pipeline.timeline(f, ["user_id"], ["ts", "event_id"], "value", {"threshold": 35.0, "fps": 2.0, "probe_frames": 3, "probe_hits": 3}, infer=stub, policy=STUB)
    return out.select("user_id", "segment_id", "frame_start", "frame_end", "dialogue_type", "translation_subtitle", F.array_join("review_reason", ",").alias("reasons"), "needs_review")


@query(
    "h3_template_match",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), z AS (SELECT vec_id, list_transform(v, lambda x: x - list_avg(v)) AS c FROM e),
m AS (SELECT z.vec_id, max(list_dot_product(z.c, k.c) / sqrt(list_dot_product(z.c, z.c) * list_dot_product(k.c, k.c))) AS s FROM z, (SELECT c FROM z WHERE vec_id IN (1, 2, 3)) k GROUP BY z.vec_id)
SELECT vec_id, round(greatest(0, least(1, s)), 6) AS score FROM m""",
)
def h3(spark, d):
    e = t(spark, d, "embeddings")
    few = np.array([r.embedding for r in e.where("vec_id IN (1, 2, 3)").select("embedding").collect()])
    return template_match(e.select("vec_id", "embedding"), "embedding", few).select("vec_id", F.round("score", 6).alias("score"))


@query(
    "g4_pair_events",
    """WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'request' WHEN 'click' THEN 'response' WHEN 'error' THEN 'error' END AS ev FROM events),
p AS (SELECT *, lag(ev) OVER w AS pe, lag(event_id) OVER w AS pi FROM e WHERE ev IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id AS id, CASE WHEN pe = 'request' THEN pi END AS request_id FROM p WHERE ev <> 'request'""",
)
def g4(spark, d):
    ev = F.when(F.col("event_type") == "view", "request").when(F.col("event_type") == "click", "response").when(F.col("event_type") == "error", "error").otherwise("other")
    return st.pair_events(t(spark, d, "events").select("user_id", F.col("event_id").alias("id"), ev.alias("event")), ["user_id"], ["id"])


@query(
    "g5_assemble_chunks",
    """SELECT conv_id, md5(string_agg(text, '' ORDER BY turn) FILTER (turn % 5 <> 4)) AS content, CASE WHEN count(*) FILTER (turn = 3) > 0 THEN 'stop' END AS finish, count(*) FILTER (turn % 5 = 4) AS malformed FROM conversations GROUP BY conv_id""",
)
def g5(spark, d):
    js = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"), F.when(F.col("turn") == 3, "stop").alias("finish_reason"))).alias("choices")))
    line = F.when(F.col("turn") % 5 == 4, "data: {oops").otherwise(F.concat(F.lit("data: "), js))
    c = t(spark, d, "conversations").select("conv_id", F.col("turn").alias("seq"), line.alias("line"))
    return st.assemble_chunks(c, ["conv_id"]).select("conv_id", F.md5("content").alias("content"), "finish", "malformed")
