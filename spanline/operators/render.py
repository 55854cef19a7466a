"""Timed text rows: styles and events, in the order of a subtitle file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanline.functions import scalars as sc
from spanline.operators.union import union_all

# --- fixed values -------------------------------------------------------------

#: Built-in style, in the order of a style line; the file format's names and order.
DEFAULT_STYLE = {
    "font_name": "Microsoft YaHei", "font_size_scale": 0.8, "min_font_size": 20,
    "primary_colour": "&H00FFFFFF", "secondary_colour": "&H000000FF", "outline_colour": "&H00000000", "back_colour": "&H64000000",
    "border_style": 1, "outline": 2.4, "shadow": 0.8, "margin_l": 40, "margin_r": 40, "margin_v": 40,
    "bold": 0, "italic": 0, "underline": 0, "strike_out": 0, "scale_x": 100, "scale_y": 100, "spacing": 0, "angle": 0,
}
STYLE_LINE = ["font_name", "font_size", "primary_colour", "secondary_colour", "outline_colour", "back_colour", "bold", "italic", "underline", "strike_out", "scale_x", "scale_y", "spacing", "angle", "border_style", "outline", "shadow", "2", "margin_l", "margin_r", "margin_v", "1"]
STYLE_FORMAT = "Format: Name,Fontname,Fontsize,PrimaryColour,SecondaryColour,OutlineColour,BackColour,Bold,Italic,Underline,StrikeOut,ScaleX,ScaleY,Spacing,Angle,BorderStyle,Outline,Shadow,Alignment,MarginL,MarginR,MarginV,Encoding"
EVENT_FORMAT = "Format: Layer,Start,End,Style,Name,MarginL,MarginR,MarginV,Effect,Text"
TEXT_FIELDS = {"font_name", "primary_colour", "secondary_colour", "outline_colour", "back_colour"}
REAL_FIELDS = {"outline", "shadow"}


def layered(field: str, *layers) -> Column:
    """A style field from the first layer (a struct column) that sets it, else the built-in value."""
    return F.coalesce(*[F.nullif(F.trim(sc.col(x)[field].cast("string")), F.lit("")) for x in layers], F.lit(str(DEFAULT_STYLE[field])))


def font_size(height, video_height, scale: Column, least: Column, ratio: float = 0.05) -> Column:
    """Half the text area's height by the scale, or a share of the video's; at least the minimum."""
    own = F.when(sc.col(height) > 0, F.floor(sc.col(height) / 2 * scale)).otherwise(F.floor(sc.col(video_height) * ratio))
    return F.greatest(least.cast("int"), own.cast("int"))


def entry_font_size(style, base) -> Column:
    """An entry's own size, else its scale of the base, else the base; 1 at least."""
    own = F.nullif(F.trim(sc.col(style)["font_size"].cast("string")), F.lit("")).try_cast("double").cast("int")
    scaled = F.floor(sc.col(base) * F.nullif(F.trim(sc.col(style)["font_size_scale"].cast("string")), F.lit("")).try_cast("double")).cast("int")
    return F.coalesce(F.when(own.isNotNull(), F.greatest(F.lit(1), own)), F.when(scaled.isNotNull(), F.greatest(F.lit(1), scaled)), sc.col(base))


def style_line(name: Column, style: Column, base: Column, size: Column) -> Column:
    """A style line: the entry's fields where set, else the base style's."""
    parts = []
    for f in STYLE_LINE:
        if f.isdigit():
            parts.append(F.lit(f))
        elif f == "font_size":
            parts.append(size.cast("string"))
        else:
            v = F.coalesce(F.nullif(F.trim(style[f].cast("string")), F.lit("")), base[f].cast("string"))
            parts.append(v if f in TEXT_FIELDS else v.cast("double").cast("string") if f in REAL_FIELDS else v.cast("double").cast("int").cast("string"))
    return F.concat(F.lit("Style: "), name, F.lit(","), F.concat_ws(",", *parts))


def base_style(**overrides) -> Column:
    """The built-in style with overrides, as a struct of strings."""
    values = DEFAULT_STYLE | overrides
    return F.struct(*[F.lit(str(v)).alias(f) for f, v in values.items()])


def entry_style(**fields) -> Column:
    """A struct of nullable style fields with the given ones set."""
    names = [f for f in STYLE_LINE if not f.isdigit()] + ["font_size_scale", "alignment", "layer", "x", "y"]
    return F.struct(*[(fields[f].cast("string") if f in fields else F.lit(None).cast("string")).alias(f) for f in names])


def escape_lines(c: Column) -> Column:
    return F.replace(sc.bracket_indent(c, ass=True), F.lit("\n"), F.lit("\\N"))


def render_events(segments: DataFrame, k: list[str], layout: dict, base: Column | None = None, debug: bool = False, style: str = "style") -> DataFrame:
    """(k, section, pos, sub, line): all lines of each project's subtitle file, in order.

    segments(k, pos, id, start, end, kind, speaker, original, translation, style
    and, for debug, label).  layout: width, height, text (x1, y1, x2, y2), and
    optionally title, info (rectangles), text_height, title_height.  An entry gets
    a style line of its own only if it sets a field of one.  A title is one centred
    event, its speaker another; others stand at the text area's lower left, or at
    their own place.  An empty translation falls back to the original; empty
    texts make no event.  ``debug`` adds each label at the top, on layer 1.
    """
    base = base if base is not None else base_style()
    x1, _, _, y2 = layout["text"]
    mid = lambda r: (round((r[0] + r[2]) / 2), round((r[1] + r[3]) / 2))
    tx, ty = mid(layout.get("title") or layout["text"])
    ix, iy = mid(layout.get("info") or layout["text"])
    scale, least = base["font_size_scale"].cast("double"), base["min_font_size"].cast("double")
    size = font_size(F.lit(layout.get("text_height", 0)), F.lit(layout["height"]), scale, least)
    title_size = F.floor(F.lit(layout["title_height"]) * scale).cast("int") if layout.get("title_height") else size
    s = segments.withColumn("_base", base).withColumn("_size", size)
    st = F.col(style)
    fields = [f for f in STYLE_LINE if not f.isdigit()] + ["font_size_scale"]
    own = F.exists(F.array(*[st[f].isNotNull() for f in fields]), lambda x: x)
    w = Window.partitionBy(*k).orderBy("pos")
    s = s.withColumn("_own", F.coalesce(own, F.lit(False))).withColumn("_n", F.row_number().over(w))
    name = F.when(F.col("_own"), F.concat(F.lit("Entry_"), F.col("_n").cast("string"))).otherwise("Default")
    raw = F.coalesce(F.nullif("translation", F.lit("")), F.col("original"), F.lit(""))
    pick = lambda f, default: F.coalesce(F.nullif(F.trim(st[f]), F.lit("")), F.lit(str(default)))
    # Columns, so that what several rows name is computed and planned once.
    s = s.withColumns({
        "_name": name, "_text": escape_lines(raw), "_who": F.trim(F.replace(F.coalesce("speaker", F.lit("")), F.lit("\n"), F.lit("\\N"))),
        "_title": F.lower(sc.text("kind")) == "title", "_start": sc.ass_time("start"), "_end": sc.ass_time("end"),
    })
    s = s.withColumn("_head", F.concat(F.lit("Dialogue: "), pick("layer", 0), F.lit(","), F.col("_start"), F.lit(","), F.col("_end"), F.lit(","), F.col("_name"), F.lit(",,0,0,0,,")))
    name, text, who, title, head = (F.col(c) for c in ("_name", "_text", "_who", "_title", "_head"))
    centred = lambda x, y: F.concat(F.lit(f"{{\\an5\\pos({x},{y})\\fs"), title_size.cast("string"), F.lit("}"))
    placed = F.concat(F.lit("{\\an"), pick("alignment", 1), F.lit("\\pos("), F.coalesce(st["x"], F.lit(str(x1))), F.lit(","), F.coalesce(st["y"], F.lit(str(y2))), F.lit(")}"))
    shown, named = F.trim(text) != "", who != ""
    row = lambda section, sub, line: F.struct(F.lit(section).alias("section"), F.col("_n").alias("pos"), F.lit(sub).alias("sub"), line.alias("line"))
    rows = [
        F.when(F.col("_own"), row(2, 0, style_line(name, st, F.col("_base"), entry_font_size(st, "_size")))),
        F.when(title & shown, row(4, 0, F.concat(head, centred(tx, ty), text))),
        F.when(title & named, row(4, 1, F.concat(head, centred(ix, iy), who))),
        F.when(~title & shown, row(4, 0, F.concat(head, placed, text))),
    ]
    if debug:
        top = F.concat(F.lit("Dialogue: 1,"), F.col("_start"), F.lit(","), F.col("_end"), F.lit(f",DebugOverlay,,0,0,0,,{{\\an8\\pos({round(layout['width'] / 2)},40)}}"), F.replace(sc.text("label"), F.lit("\n"), F.lit("\\N")))
        rows.append(F.when(sc.text("label") != "", row(5, 0, top)))
    body = s.select(*k, F.explode(F.array_compact(F.array(*rows))).alias("r")).select(*k, "r.*")
    none = F.struct(*[F.lit(None).cast("string").alias(f) for f in STYLE_LINE if not f.isdigit()])
    lines = [(0, "[Script Info]"), (0, "ScriptType: v4.00+"), (0, f"PlayResX: {layout['width']}"), (0, f"PlayResY: {layout['height']}"), (0, ""), (0, "[V4+ Styles]"), (0, STYLE_FORMAT)]
    tail = [(3, ""), (3, "[Events]"), (3, EVENT_FORMAT)]
    fixed = [F.struct(F.lit(sec).alias("section"), F.lit(i).alias("pos"), F.lit(0).alias("sub"), F.lit(t).alias("line")) for i, (sec, t) in enumerate([*lines, *tail])]
    styles = [F.struct(F.lit(1).alias("section"), F.lit(0).alias("pos"), F.lit(0).alias("sub"), style_line(F.lit("Default"), none, base, size).alias("line"))]
    if debug:
        over = base.withField("primary_colour", F.lit("&H0000FFFF")).withField("outline_colour", F.lit("&H00000000")).withField("outline", F.lit("2.0")).withField("shadow", F.lit("0.5"))
        line = F.replace(style_line(F.lit("DebugOverlay"), none, over, F.greatest(F.lit(12), size)), F.lit(",2,40,"), F.lit(",8,40,"))
        styles.append(F.struct(F.lit(1).alias("section"), F.lit(1).alias("pos"), F.lit(0).alias("sub"), line.alias("line")))
    heads = s.select(*k).distinct().select(*k, F.explode(F.array(*fixed, *styles)).alias("r")).select(*k, "r.*")
    return union_all(heads, body)
