"""Hand-made rows for texts, times, decisions, edits and frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanline.functions import scalars as sc
from spanline.operators import aggregates as agg
from spanline.operators import edits as ed
from spanline.operators import lookup as lk
from spanline.operators import vision
from spanline.sources import files


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expr.alias("v")).collect()]


def test_quotes(spark):
    rows = ["“hello”", '"hi" there', "「これ", "『a』", "「「x」」", "don't", "he said 'yes' ok", "(all)", "a (b)", " 「 x 」 ", '"', "", None, "'start' it", "「'abc'」", "『a」", "it's 'a' 'b", "「a」 and 「b」"]
    want = ["hello", 'hi" there', "これ", "a", "「x」", "don't", "he said 『yes』 ok", "（all）", "a (b)", "x", '"', "", "", "'start' it", "『abc』", "a", "it's 『a』 'b", "a」 and 「b"]
    assert values(spark, rows, sc.normalize_quotes("s")) == want
    assert values(spark, ["don't"], sc.normalize_quotes("s", legacy=True)) == ["don『t"]


def test_reasoning_json_times(spark):
    assert values(spark, ["<think>x</think> a", "Answer: 1 final answer: 2 ", "<Reasoning>\n\n</reasoning>b<think>", None], sc.strip_reasoning("s")) == ["a", "2", "b<think>", None]
    rows = ['```json\n{"a": 1}\n```', 'x {"a": "l1\nl2", "b": "}"} tail', '{"a": 1} {', "none", '{"a": ', "[1, 2] x", None]
    df = sc.extract_json(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string"), "s")
    assert [r.json for r in df.orderBy("i").collect()] == ['{"a":1}', '{"a":"l1\\nl2","b":"}"}', '{"a":1}', None, None, "[1,2]", None]
    assert values(spark, ["1:02:03.5", "00：00：07，25", "12.5", "1:2", "x", "-3", None], sc.parse_time("s")) == [3723.5, 7.25, 12.5, None, None, -3.0, None]
    assert values(spark, ["0.005", "0.015", "59.995", "3600", "61.239"], sc.ass_time(F.col("s").cast("double"))) == ["0:00:00.00", "0:00:00.02", "0:01:00.00", "1:00:00.00", "0:01:01.24"]
    assert values(spark, ["0.0005", "0.0015"], sc.cache_key(F.lit(1), F.col("s").cast("double"), F.lit(2.0), F.lit("t"))) == ["id=1|0-2000|t", "id=1|2-2000|t"]


def test_brackets_names_gate(spark):
    assert values(spark, ["（(a\nb\nc", "a\nb", "[x", "【y\n"], sc.bracket_indent("s", ass=True)) == ["（(a\n\\h　b\n\\h　c", "a\nb", "[x", "【y\n　"]
    assert values(spark, ["Ａ・B：", "“x”\n", None, "ｶﾅ"], sc.normalize_name("s")) == ["AB", "x", "", "カナ"]
    assert values(spark, ["a b", "1-|", "", None, "lI 1x"], sc.text_gate("s")) == [True, False, False, False, False]
    assert values(spark, ["漢字漢字漢", "漢字"], sc.charclass_leak(F.lit("x漢字漢字漢y"), "s", sc.CJK, 5)) == [True, False]
    assert values(spark, ["a/b?.txt ", " .. ", None], sc.safe_name("s")) == ["a_b_.txt", "project", "project"]
    with pytest.raises(Exception, match="unknown value"):
        values(spark, ["zz"], sc.canonicalize("s", {"a": "b"}, unknown="raise"))


def test_unique_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a_2"), (4, "a"), (5, "b")], "i int, name string")
    got = {r.i: r.unique_name for r in agg.unique_names(df, "name", ["i"]).collect()}
    assert len(set(got.values())) == 5 and got[1] == "a" and got[5] == "b"


def test_resolve_tiers(spark):
    dim = spark.createDataFrame([("Anna",), ("Ann",), ("Bob",), ("Carla",), (" : ",)], "n string")
    df = spark.createDataFrame([("Anna",), ("Ann ",), ("annx",), ("Bobby",), ("Carlo",), ("zz",), (None,), ("An",)], "s string")
    got = {r.s: (r.match, r.ambiguous) for r in lk.resolve_dimension(df, "s", dim, "n", 1).collect()}
    assert got["Anna"] == ("Anna", False) and got["Ann "] == ("Ann", False) and got["Bobby"] == ("Bob", False) and got["Carlo"] == ("Carla", False)
    assert got["zz"] == (None, False) and got[None] == (None, False)
    assert {r.s: r.ambiguous for r in lk.resolve_dimension(df, "s", dim, "n").collect()}["An"]


def test_edit_log(spark):
    base = [(1, i, i, str(i), i * 2.0, i * 2.0 + 1, "title" if i == 0 else "speaker_dialogue", "s", f"o{i}", f"t{i}", []) for i in range(5)]
    entries = spark.createDataFrame(base, "p int, pos long, id long, raw_id string, start double, end double, kind string, speaker string, original string, translation string, review_reason array<string>")
    edit = lambda seq, op, anchor, **v: (1, seq, op, anchor, *[v.get(f) for f in ("start", "end", "kind", "speaker", "original", "translation", "choices")])
    edits = [edit(1, "insert_before", 1, start=1.2, end=1.4, kind="speaker_dialogue", original="new"), edit(2, "delete", 0), edit(3, "delete", 99), edit(4, "merge", 2, choices="speaker=other;original=joined;translation=current"), edit(5, "set", 1, translation="fixed"), edit(6, "set", 1, start=9.0, end=1.0)]
    log = spark.createDataFrame(edits, "p int, seq int, op string, anchor_id long, start double, end double, kind string, speaker string, original string, translation string, choices string")
    got = [(r.id, r.raw_id, r.original, r.translation) for r in ed.apply_edits(entries, log, ["p"]).orderBy("pos").collect()]
    assert got == [(1, sc.MANUAL, "new", "fixed"), (2, "1", "o1\no2", "t1"), (4, "3", "o3", "t3"), (5, "4", "o4", "t4")]


def test_styles(spark):
    """Inserted and merged rows take their speaker's colours; stored entries too, on writing."""
    rows = [(1, i, i, str(i), i * 2.0, i * 2.0 + 1, "speaker_dialogue", s, f"o{i}", f"t{i}", [], {"outline_colour": "red", "bold": "1"} if i != 2 else None) for i, s in enumerate(["Ann", "Bob", "Bob", "Eve"])]
    entries = spark.createDataFrame(rows, "p int, pos long, id long, raw_id string, start double, end double, kind string, speaker string, original string, translation string, review_reason array<string>, style map<string,string>")
    log = [(1, 1, "merge", 0, None, None, None, None, None, None, "speaker=other"), (1, 2, "insert_after", 2, 4.0, 5.0, "speaker_dialogue", "Anm", "x", "y", None), (1, 3, "merge", 3, None, None, None, None, None, None, "style=other;speaker=other")]
    log = spark.createDataFrame(log, "p int, seq int, op string, anchor_id long, start double, end double, kind string, speaker string, original string, translation string, choices string")
    styles = spark.createDataFrame([("Ann", "blue"), ("Bob", "green")], "speaker string, outline_colour string")
    got = ed.restyle(ed.apply_edits(entries, log, ["p"]), styles)
    got = {r.original: (r.speaker, r.style) for r in got.collect()}
    assert got["o0\no1"] == ("Bob", {"bold": "1", "outline_colour": "green"}) and got["o2"] == ("Bob", None) and got["x\no3"] == ("Eve", {"outline_colour": "red", "bold": "1"})
    cache = spark.createDataFrame([("speaker_dialogue", "Anm", None), ("title", "Ann", None), ("speaker_dialogue", "Bob", "pink"), ("speaker_dialogue", "Zed", None)], "dialogue_type string, speaker string, c string")
    fields = files.STYLE.removeprefix("struct<").removesuffix(">").replace(":string", "").split(",")
    cache = cache.withColumn("subtitle_style", F.struct(*[(F.col("c") if f == "outline_colour" else F.lit(None).cast("string")).alias(f) for f in fields]))
    got = {(r.dialogue_type, r.speaker): r.subtitle_style and r.subtitle_style.outline_colour for r in files.with_styles(cache, styles).collect()}
    assert got == {("speaker_dialogue", "Anm"): "blue", ("title", "Ann"): None, ("speaker_dialogue", "Bob"): "pink", ("speaker_dialogue", "Zed"): None}


def test_frames():
    img = np.zeros((40, 60), np.uint8)
    plain = {"scale": 1, "smooth": 0, "dark": False, "offset": 12.0}
    blank = vision.frame_stats(img, {})
    img[10:14, 5:12] = img[10:14, 20:27] = 255
    presence, n, x_min, x_max, x_span, y_span, largest = vision.frame_stats(img, plain)
    assert blank[:2] == (0.0, 0) and n == 2 and x_min == 5 / 60 and x_max == 26 / 60 and largest == 0.5 and presence == 56 / 2400
    noisy = img.copy()
    noisy[30, 40] = 255  # one pixel is no text once it is smoothed
    assert vision.frame_stats(noisy, plain | {"smooth": 2, "offset": 60.0})[1] == 2 < vision.frame_stats(noisy, plain | {"min_area": 1, "min_width": 1, "min_height": 1})[1]
    grown = vision.frame_stats(img, {"dark": False, "offset": 12.0})
    assert grown[1] == 2 and abs(grown[4] - x_span) < 0.05 and abs(grown[0] - presence) < 0.02
    assert vision.enlarged(np.array([[0.0, 4.0]]), 2).tolist() == [[0.0, 1.0, 3.0, 4.0]] * 2
    assert vision.shrunk(np.array([[1.0, 3.0, 5.0, 7.0]]), 2).tolist() == [[2.0, 6.0]] and vision.shrunk(np.arange(6.0)[None], 4).sum() == 10.0
    assert sorted(map(tuple, vision.components(np.array([[1, 0, 1], [1, 1, 1], [0, 0, 0], [1, 0, 1]], bool)).tolist())) == [(1, 0, 3, 0, 3), (1, 2, 3, 2, 3), (5, 0, 0, 2, 1)]


def test_plans_have_no_cartesian_product(spark):
    from spanline.plans import queries

    most = {"g3_marker_segments": 20, "e08_representative": 20, "c9_segment_at": 8, "c10_series_value_at": 14, "h10_subtitle_events": 6, "h2a_split_by_score": 8, "h2b_split_by_presence": 8, "h13_timeline": 45}
    for name, exchanges in most.items():
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert plan.count("SinglePartition") == plan.count("partial_collect_set(_level"), name  # the levels of spans, 64 at most, alone
        assert plan.count("Exchange ") <= exchanges, (name, plan.count("Exchange "))
