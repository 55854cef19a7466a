"""Column expressions over texts, times, identifiers and payloads.

All stay within the JVM but for :func:`normalize_name`, which needs Unicode
compatibility folding, and the leftovers of :func:`extract_json`.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------

#: Quote pairs that may wrap a whole text, outer first.
WRAPPERS = [("“", "”"), ('"', '"'), ("『", "』"), ("「", "」")]
OPENERS, CLOSERS = '"『「', '"』」'
#: Characters that names are compared without.
NAME_NOISE = " 　\n\r\t：:（）()「」『』【】\"'｢｣“”‘’・．"
#: Characters that count as no text when they are all a recogniser found.
TEXT_NOISE = "-1|lI"
KANA, CJK = "぀-ヿ", "一-鿿"
FULL_BRACKETS, HALF_BRACKETS = "（【〔｟", "(["
LANGUAGE_LABELS = {
    "ja": "日语", "jpn": "日语", "jp": "日语", "japanese": "日语",
    "zh": "简体中文", "zh-cn": "简体中文", "zh-hans": "简体中文", "zh-sg": "简体中文", "chinese": "简体中文", "simplified chinese": "简体中文",
}
MODE_ALIASES = {
    "vlm": "vlm_responses", "vlm_responses": "vlm_responses", "responses_vlm": "vlm_responses", "vlm_bailian": "vlm_responses", "qwen_vlm": "vlm_responses", "bailian": "vlm_responses",
    "ocr_chat": "ocr_chat_completions", "ocr_chat_completions": "ocr_chat_completions", "ocr_chat_completion": "ocr_chat_completions", "ocr_llm": "ocr_chat_completions", "text_chat": "ocr_chat_completions",
}
#: White space at either end, Unicode's included.
TRIM = r"(?U)^\s+|\s+$"
BLANK_TYPES = ["blank_no_name", "blank"]
NOT_DIALOGUE = [*BLANK_TYPES, "title"]
MANUAL = "manual_insert"
DEBUG_PREFIX = "[DEBUG]"


def text(c) -> Column:
    """Trimmed, null as empty."""
    return F.coalesce(F.trim(col(c)), F.lit(""))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(col(value)), use), F.lit(0))


# --- texts --------------------------------------------------------------------


def normalize_quotes(c, legacy: bool = False) -> Column:
    """Quote marks of a subtitle line in one style.

    A text wrapped in one pair of quotes loses it; one that has a quote at one end
    only, or two that don't match, loses those at its ends.  Inner single quotes,
    but for those between ASCII letters or digits, are paired to 『』 from the left;
    ``legacy`` also turns every one that is left over, contractions included, into
    『.  Whole-text ASCII brackets become full-width ones.  Null becomes empty.
    """

    def inside(s: Column) -> Column:
        return F.regexp_replace(F.substring(s, F.lit(2), F.length(s) - 2), TRIM, "")

    def ends(s: Column, a: str, b: str) -> Column:
        return (F.length(s) >= 2) & F.startswith(s, F.lit(a)) & F.endswith(s, F.lit(b))

    def unwrapped(s: Column) -> Column:
        out = None
        for a, b in WRAPPERS:
            got = F.concat(F.lit("「"), inside(s), F.lit("」"))
            out = F.when(ends(s, a, b), got) if out is None else out.when(ends(s, a, b), got)
        opens, closes = F.instr(F.lit(OPENERS), F.substring(s, 1, 1)) > 0, F.instr(F.lit(CLOSERS), F.right(s, F.lit(1))) > 0
        # Of two quotes at the ends that aren't a pair above, only a pair of one kind would match.
        odd = (F.length(s) > 0) & ((opens & ~closes) | (closes & ~opens) | (opens & closes & (F.length(s) >= 2)))
        stripped = F.regexp_replace(F.regexp_replace(s, "^[\"『』「」]+|[\"『』「」]+$", ""), TRIM, "")
        return out.when(odd, F.concat(F.lit("「"), stripped, F.lit("」"))).otherwise(s)

    def bracketed(s: Column) -> Column:
        return F.when(ends(s, "(", ")"), F.concat(F.lit("（"), F.substring(s, F.lit(2), F.length(s) - 2), F.lit("）"))).otherwise(s)

    plain = F.regexp_replace(F.coalesce(col(c), F.lit("")), TRIM, "")
    paired = let(plain, lambda s: pair_single_quotes(unwrapped(s), legacy))
    return let(let(paired, lambda s: F.when(ends(s, "「", "」"), inside(s)).otherwise(s)), bracketed)


def pair_single_quotes(s: Column, legacy: bool = False) -> Column:
    """Pairs of inner single quotes to 『 and 』; a lone last one stays (with ``legacy`` it becomes 『)."""
    mark = "\x00"
    # Quotes that may be paired are marked; the first and last character never are.
    marked = F.regexp_replace(s, r"(?<=.)(?<![A-Za-z0-9])'(?=.)|(?<=.)'(?![A-Za-z0-9])(?=.)", mark)
    paired = F.regexp_replace(marked, f"(?s){mark}([^{mark}]*){mark}", "『$1』")
    rest = F.replace(paired, F.lit(mark), F.lit("'"))
    return F.regexp_replace(rest, r"(?s)(?<=.)'(?=.)", "『") if legacy else rest


def strip_reasoning(c) -> Column:
    """Without reasoning blocks; then only what follows the last "answer:"."""
    s = col(c)
    for tag in ("think", "thinking", "reasoning"):
        s = F.regexp_replace(s, f"(?is)<{tag}>.*?</{tag}>", "")
    return F.trim(F.regexp_replace(s, r"(?is)\A.*answer\s*[:：]", ""))


def charclass_leak(original, translated, chars: str, n: int) -> Column:
    """Whether n characters in a row of the class occur in both texts at once."""
    runs = F.regexp_extract_all(F.coalesce(col(translated), F.lit("")), F.lit(f"[{chars}]{{{n},}}"), F.lit(0))
    source = F.coalesce(col(original), F.lit(""))
    return F.exists(runs, lambda r: F.exists(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.contains(source, F.substring(r, i, F.lit(n)))))


def canonicalize(c, mapping: dict[str, str], unknown: str = "keep", dash: bool = True) -> Column:
    """The value that an alias stands for; unknown ones are kept, or raise an error."""
    key = F.lower(F.trim(col(c)))
    if dash:
        key = F.replace(key, F.lit("_"), F.lit("-"))
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    other = col(c) if unknown == "keep" else F.raise_error(F.concat(F.lit("unknown value: "), F.coalesce(col(c), F.lit("null"))))
    return F.coalesce(F.try_element_at(table, key), other)


def bracket_indent(c, ass: bool = False) -> Column:
    """Later lines indented by the brackets that the first one starts with."""
    def padded(s: Column, lead: Column) -> Column:
        half = F.length(F.translate(lead, FULL_BRACKETS, ""))
        full = F.length(F.translate(lead, HALF_BRACKETS, ""))
        pad = F.concat(F.repeat(F.lit("\\h" if ass else " "), half), F.repeat(F.lit("　"), full))
        return F.when((F.length(lead) > 0) & F.contains(s, F.lit("\n")), F.replace(s, F.lit("\n"), F.concat(F.lit("\n"), pad))).otherwise(s)

    return let(c, lambda s: let(F.regexp_extract(s, rf"^[{FULL_BRACKETS}(\[]+", 0), lambda lead: padded(s, lead)))


def clip(c, n: int) -> Column:
    """One line of at most n characters, with an ellipsis where cut."""
    s = F.trim(F.replace(F.coalesce(col(c), F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(max(0, n - 3))), F.lit("..."))).otherwise(s)


def safe_name(c, fallback: str = "project", squeeze: bool = False) -> Column:
    """A file name: illegal characters become _, dots and blanks go from the ends."""
    s = F.regexp_replace(F.coalesce(col(c), F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_")
    if squeeze:
        s = F.regexp_replace(s, r"\s+", "_")
    return F.coalesce(F.nullif(F.btrim(s, F.lit(" .")), F.lit("")), F.lit(fallback))


@functools.lru_cache(maxsize=1)
def _fold():
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return fold


def normalize_name(c) -> Column:
    """Compatibility-folded and without NAME_NOISE; ASCII names never leave the JVM."""
    s = F.coalesce(col(c), F.lit(""))
    plain = s.rlike(r"\A[\x00-\x7F]*\z")
    folded = F.when(plain, s).otherwise(_fold()(F.when(~plain, s)))
    return F.translate(folded, NAME_NOISE, "")


def line_count(c) -> Column:
    return F.when(text(c) == "", F.lit(1)).otherwise(F.length(col(c)) - F.length(F.replace(col(c), F.lit("\n"), F.lit(""))) + 1)


def text_gate(c) -> Column:
    """Whether two characters or more are left without white space and noise."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s", ""), TEXT_NOISE, "")) >= 2


def is_dialogue(c) -> Column:
    return ~F.lower(text(c)).isin(NOT_DIALOGUE)


# --- keys, times, numbers -------------------------------------------------------


def cache_key(ident, start, end, kind) -> Column:
    """``id=1|1000-2000|type``: milliseconds are rounded half to even; id 0 stands for any."""
    ms = [F.bround(col(x) * 1000, 0).cast("long").cast("string") for x in (start, end)]
    return F.concat(F.lit("id="), col(ident).cast("string"), F.lit("|"), ms[0], F.lit("-"), ms[1], F.lit("|"), F.coalesce(col(kind), F.lit("")))


def ass_time(c) -> Column:
    """H:MM:SS.cc, centiseconds rounded half to even."""
    part = lambda cs, div, mod: (F.floor(cs / div) % mod).cast("long")
    clock = lambda cs: F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000).cast("long"), part(cs, 6000, 60), part(cs, 100, 60), cs % 100)
    return let(F.bround(col(c) * 100, 0).cast("long"), clock)


def parse_time(c) -> Column:
    """Seconds of plain numbers or H:M:S[.,]fff, full-width marks included; null for anything else."""
    s = F.translate(F.trim(col(c)), "：，", ":,")
    pattern = r"^(\d+):(\d{1,2}):(\d{1,2})(?:[.,](\d{1,3}))?$"
    part = lambda i: F.try_to_number(F.nullif(F.regexp_extract(s, pattern, i), F.lit("")), F.lit("999999999"))
    ms = F.coalesce(F.rpad(F.nullif(F.regexp_extract(s, pattern, 4), F.lit("")), 3, "0").cast("double"), F.lit(0.0))
    clock = part(1).cast("double") * 3600 + part(2).cast("double") * 60 + part(3).cast("double") + ms / 1000
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), s.try_cast("double")).when(s.rlike(pattern), clock)


def frame_number(ts, start, fps) -> Column:
    """1-based number of the frame at a time, not below 0."""
    return F.greatest(F.lit(0), F.bround((col(ts) - col(start)) * col(fps), 0).cast("long") + 1)


def absolute_frame(ts, fps) -> Column:
    return F.bround(col(ts) * col(fps), 0).cast("long")


def anchor_frame(start, end, n: int = 3) -> Column:
    """The n-th frame from the end of an interval, within it."""
    return F.when(col(end) < col(start), col(start)).otherwise(F.greatest(col(start), col(end) - (max(1, n) - 1)))


def seek_time(ts, fps) -> Column:
    """A time moved back to its frame's start."""
    return F.floor(col(ts) * col(fps)) / col(fps)


def parse_rate(c) -> Column:
    """``num/den`` or a number, null if it isn't a positive rate."""
    num = F.split_part(col(c), F.lit("/"), F.lit(1)).try_cast("double")
    den = F.when(F.contains(col(c), F.lit("/")), F.split_part(col(c), F.lit("/"), F.lit(2)).try_cast("double")).otherwise(F.lit(1.0))
    rate = F.try_divide(num, den)
    return F.when(rate > 0, rate)


def probe(c) -> Column:
    """struct(fps, duration) from a probe's JSON: real rate, else average; the stream's duration, else the container's."""
    j = F.from_json(col(c), "struct<streams:array<struct<r_frame_rate:string,avg_frame_rate:string,duration:string>>,format:struct<duration:string>>")
    s = F.try_element_at(j["streams"], F.lit(1))
    fps = F.coalesce(parse_rate(s["r_frame_rate"]), parse_rate(s["avg_frame_rate"]))
    return F.struct(fps.alias("fps"), F.coalesce(s["duration"].try_cast("double"), j["format"]["duration"].try_cast("double")).alias("duration"))


def numeric_id(c, positive: bool = False) -> Column:
    """Leading digits of a string as a number, else null; with ``positive`` 0 is null too."""
    n = F.nullif(F.regexp_extract(F.trim(col(c)), r"^(\d+)", 1), F.lit("")).try_cast("long")
    return F.when(n > 0, n) if positive else n


def clamp_rect(rect, w, h) -> Column:
    """The rectangle within the image, null if nothing is left of it."""
    r = col(rect)
    x1, y1 = (F.greatest(F.lit(0), F.least(r[k], n)) for k, n in (("x1", col(w)), ("y1", col(h))))
    x2, y2 = (F.greatest(F.lit(0), F.least(r[k], n)) for k, n in (("x2", col(w)), ("y2", col(h))))
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def rect_ok(rect, least: int = 2) -> Column:
    r = col(rect)
    return (r["x2"] - r["x1"] >= least) & (r["y2"] - r["y1"] >= least)


# --- reasons, labels, decisions -------------------------------------------------


def merge_reasons(*cols) -> Column:
    """Arrays or scalars as one array: trimmed, not empty, distinct, as first seen."""
    arrays = [F.coalesce(col(c), F.array().cast("array<string>")) for c in cols]
    return F.array_distinct(F.filter(F.transform(F.concat(*arrays), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def debug_label(ident, raw_id, start, end, kind, seen=None, times=None, legacy=None) -> Column:
    """A row's label; one that was stored wins unless it is blank."""
    dt, raw = F.lower(text(kind)), text(col(raw_id).cast("string"))
    sid = F.coalesce(col(ident).cast("long"), F.lit(0))
    base = F.when(raw == MANUAL, "manual").otherwise(F.concat(F.lit("seg "), F.coalesce(raw.try_cast("long"), sid).cast("string")))
    if times is not None:
        base = F.when(col(times) > 1, F.concat(base, F.lit("-"), col(seen).cast("string"))).otherwise(base)
    state = F.when(dt.isin(BLANK_TYPES), "blank").otherwise("has_name=true")
    label = F.concat(F.lit(DEBUG_PREFIX + " "), base, F.format_string(" (id=%d) %.2f-%.2fs ", sid, col(start), col(end)), state)
    label = F.when(dt == "title", "[TITLE]").otherwise(label)
    return label if legacy is None else F.coalesce(F.when(text(legacy) != "", col(legacy)), label)


def translation_flags(kind, original, translation, debug=None, n: int = 5, chars: str = CJK) -> Column:
    """Reasons to look at a translation again; none for blank rows and titles."""
    def reasons(t: Column, shown: Column) -> Column:
        fallback = F.startswith(t, F.lit(DEBUG_PREFIX)) | ((shown != "") & (t == shown))
        return F.array_compact(F.array(
            F.when(t == "", "translation_missing").when(fallback, "translation_fallback_debug_text"),
            F.when(charclass_leak(text(original), t, chars, n), "translation_kanji_overlap_with_original"),
        ))

    label = F.lit("") if debug is None else text(debug)
    found = let(normalize_quotes(text(translation)), lambda t: let(label, lambda shown: reasons(t, shown)))
    return F.when(is_dialogue(kind), found).otherwise(F.array().cast("array<string>"))


def presence_decision(score, components, x_min, x_span, y_span, largest, cfg: dict) -> Column:
    """struct(present, uncertain, reason): off, then odd shapes, then on, else uncertain; no score is absent."""
    shape = (
        F.when(col(components) < cfg["min_components"], "few_components")
        .when(col(components) > cfg["max_components"], "too_many_components")
        .when(col(x_min) > cfg["max_x_min"], "right_side_only")
        .when(col(y_span) > cfg["max_y_span"], "wide_y_span")
        .when(col(x_span) / F.greatest(F.lit(1e-6), col(y_span)) < cfg["min_aspect"], "not_horizontal_line")
        .when(col(largest) > cfg["max_largest"], "large_single_component")
    )
    out = lambda p, u, r: F.struct(F.lit(p).alias("present"), F.lit(u).alias("uncertain"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    return F.when(col(score).isNull(), out(False, False, "missing")).when(col(score) <= cfg["off"], out(False, False, "")).when(shape.isNotNull(), out(False, True, shape)).when(col(score) >= cfg["on"], out(True, False, "")).otherwise(out(False, True, ""))


def forced_threshold(base, forced=None) -> Column:
    """A forced threshold, within 0 and 1, goes before the base."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(forced))), col(base)) if forced is not None else col(base)


def flags(presence, diff, name_presence, name_diff, cfg: dict) -> Column:
    """struct(has_text, has_change, is_clear, name_changed) from metrics and thresholds."""
    name = F.lit(cfg.get("split_on_name_change", True)) & (col(name_presence) >= cfg["name_presence"]) & (col(name_diff) >= cfg["name_change"])
    return F.struct((col(presence) >= cfg["presence"]).alias("has_text"), (col(diff) >= cfg["change"]).alias("has_change"), (col(presence) <= cfg["clear"]).alias("is_clear"), name.alias("name_changed"))


def format_context(items, n: int, arrow: str = " -> ", speaker: str = "", last: bool = True) -> Column:
    """Items (speaker, original, translation) as lines, the last or first n of them."""
    line = lambda x: F.concat(
        F.when(F.coalesce(x["speaker"], F.lit(speaker)) != "", F.concat(F.coalesce(F.nullif(x["speaker"], F.lit("")), F.lit(speaker)), F.lit(": "))).otherwise(""),
        F.coalesce(x["original"], F.lit("")),
        F.when(F.coalesce(x["translation"], F.lit("")) != "", F.concat(F.lit(arrow), x["translation"])).otherwise(""),
    )
    arr = col(items)
    part = F.slice(arr, F.greatest(F.lit(1), F.size(arr) - n + 1), F.lit(n)) if last else F.slice(arr, 1, n)
    return F.array_join(F.transform(part, line), "\n")


# --- payloads -------------------------------------------------------------------


def pick_alias(j, names: list[str]) -> Column:
    """First of the fields of a JSON string that isn't empty, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(col(j), f"$.{n}")), F.lit("")) for n in names], F.lit(""))


def usage(j) -> Column:
    """struct(prompt, completion, total) of a JSON string, none below 0; the total falls back to the sum."""
    get = lambda *names: F.coalesce(*[F.get_json_object(col(j), f"$.{n}").try_cast("long") for n in names])
    p, c = (F.greatest(F.lit(0), F.coalesce(get(*n), F.lit(0))) for n in (("prompt_tokens", "input_tokens"), ("completion_tokens", "output_tokens")))
    t = F.greatest(F.lit(0), F.coalesce(F.nullif(get("total_tokens"), F.lit(0)), p + c))
    return F.struct(p.alias("prompt"), c.alias("completion"), t.alias("total"))


RESPONSE = "struct<output_text:string,output:array<struct<content:variant>>,choices:array<struct<message:struct<content:variant>>>>"


def response_text(j) -> Column:
    """Text of a model's response: top-level text, else output messages, else the first choice; parts by line."""
    body = lambda v: F.coalesce(
        F.array_join(F.filter(F.transform(F.try_variant_get(v, "$", "array<struct<text:string>>"), lambda p: p["text"]), lambda t: t.isNotNull() & (t != "")), "\n"),
        F.try_variant_get(v, "$", "string"),
    )
    r = F.from_json(col(j), RESPONSE)
    outputs = F.array_join(F.filter(F.transform(r["output"], lambda m: body(m["content"])), lambda t: t.isNotNull() & (t != "")), "\n")
    choice = body(F.try_element_at(r["choices"], F.lit(1))["message"]["content"])
    return F.trim(F.coalesce(*[F.nullif(x, F.lit("")) for x in (r["output_text"], outputs, choice)], F.lit("")))


def extract_json(df: DataFrame, c: str, out: str = "json") -> DataFrame:
    """Adds the JSON value in a model's text, as a string; null if there is none.

    A fence around the whole text goes; what starts with a JSON value is that value.  The rest is
    searched by :func:`_first_object` in Arrow batches: bare line breaks within
    strings are escaped, and the first balanced object is taken.
    """

    @F.pandas_udf("string")
    def search(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else _first_object(x))

    bare = F.trim(F.regexp_replace(col(c), r"(?s)\A\s*```(?:json)?\s*(.*?)\s*```\s*\z", "$1"))
    parsed = F.to_json(F.try_parse_json("_bare"))
    return df.withColumn("_bare", bare).withColumn(out, F.coalesce(parsed, search(F.when(parsed.isNull(), F.col("_bare"))))).drop("_bare")


def _first_object(s: str) -> str | None:
    import json

    lax = json.JSONDecoder(strict=False)
    for at in [0] if s[:1] in "[{" else []:
        try:
            return json.dumps(lax.raw_decode(s, at)[0], ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            pass
    at = s.find("{")
    if at < 0:
        return None
    try:
        return json.dumps(lax.raw_decode(s, at)[0], ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return None
