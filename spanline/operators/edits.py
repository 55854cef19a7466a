"""Edit logs: inserts, deletions, merges and field changes, in order, per project."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanline.functions import scalars as sc
from spanline.operators.chunks import pieces
from spanline.operators.lookup import resolve_dimension
from spanline.operators.union import union_all

FIELDS = ["id", "raw_id", "start", "end", "kind", "speaker", "original", "translation"]
#: Style fields that follow the speaker.
COLOURS = ["primary_colour", "secondary_colour", "outline_colour", "back_colour"]


def reasons_of(*lists) -> list[str]:
    out: dict[str, None] = {}
    for x in lists:
        for r in x if x is not None else []:
            if r and r.strip():
                out[r.strip()] = None
    return list(out)


class Rows:
    """Rows in order, found by id, whose ids are shifted from a place on.

    They lie in blocks of about the square root of their number.  A shift of a whole
    block is noted as x -> max(low, x + add), which shifts by one up and down add up to
    as positive ids stay positive, and is carried out when the block's rows are looked
    at.  Blocks are chosen by the range of their ids, all at once.
    """

    NONE = np.iinfo(np.int64).max >> 1

    def __init__(self, rows: list[dict]):
        self.size = max(16, math.isqrt(len(rows)))
        self.blocks = [rows[i : i + self.size] for i in range(0, len(rows), self.size)] or [[]]
        n = len(self.blocks)
        self.add, self.low = np.zeros(n, np.int64), np.ones(n, np.int64)
        self.least, self.most = np.empty(n, np.int64), np.empty(n, np.int64)
        for b in range(n):
            self.measure(b)

    def __iter__(self):
        for b in range(len(self.blocks)):
            self.settle(b)
            yield from self.blocks[b]

    def measure(self, b: int) -> None:
        ids = [r["id"] for r in self.blocks[b] if r["id"] is not None and r["id"] > 0]
        self.least[b], self.most[b] = (min(ids), max(ids)) if ids else (self.NONE, -self.NONE)

    def settle(self, b: int) -> None:
        add, low = int(self.add[b]), int(self.low[b])
        if add or low > 1:
            for r in self.blocks[b]:
                if r["id"] is not None and r["id"] > 0:
                    r["id"] = max(low, r["id"] + add)
            self.add[b], self.low[b] = 0, 1
            self.measure(b)

    def find(self, ident: int | None) -> tuple[int, int] | None:
        """(block, place) of the first row with the id."""
        if ident is None or ident <= 0:  # never shifted
            some = range(len(self.blocks))
        else:
            some = np.flatnonzero((np.maximum(self.low, self.least + self.add) <= ident) & (np.maximum(self.low, self.most + self.add) >= ident)).tolist()
        for b in some:
            if ident is not None and ident > 0:
                self.settle(b)
            for j, r in enumerate(self.blocks[b]):
                if r["id"] == ident:
                    return b, j
        return None

    def after(self, b: int, j: int) -> tuple[int, int] | None:
        if j + 1 < len(self.blocks[b]):
            return b, j + 1
        return next(((c, 0) for c in range(b + 1, len(self.blocks)) if self.blocks[c]), None)

    def shift(self, b: int, j: int, by: int) -> None:
        """Positive ids from place j of block b on move by one, never to 0 or below; titles and rows without id stay."""
        self.settle(b)
        for r in self.blocks[b][j:]:
            if r["id"] is not None and r["id"] > 0:
                r["id"] = max(1, r["id"] + by)
        self.measure(b)
        self.add[b + 1 :] += by
        self.low[b + 1 :] = np.maximum(1, self.low[b + 1 :] + by)

    def insert(self, b: int, j: int, row: dict) -> None:
        self.settle(b)
        block = self.blocks[b]
        block.insert(j, row)
        if len(block) > 2 * self.size:
            self.blocks[b : b + 1] = [block[: self.size], block[self.size :]]
            self.add, self.low, self.least, self.most = (np.insert(x, b, v) for x, v in ((self.add, 0), (self.low, 1), (self.least, 0), (self.most, 0)))
            self.measure(b + 1)
        self.measure(b)

    def pop(self, b: int, j: int) -> dict:
        self.settle(b)
        row = self.blocks[b].pop(j)
        self.measure(b)
        return row


class Project:
    """The entries of one project as dicts, edited in place."""

    def __init__(self, entries: list[dict], mark: bool = True, renumber: bool = False):
        self.rows, self.mark, self.renumber = Rows(entries), mark, renumber

    def insert(self, e: dict, after: bool) -> None:
        at = self.rows.find(e["anchor_id"])
        if at is None or (e["end"] if e["end"] is not None else 0) < (e["start"] if e["start"] is not None else 0):
            return
        b, j = at[0], at[1] + after
        anchor = e["anchor_id"] or 0
        blank = e["kind"] == "blank_no_name"
        row = {"id": max(1, anchor + after), "raw_id": sc.MANUAL, "start": e["start"] or 0.0, "end": e["end"] or 0.0, "kind": e["kind"] or "speaker_dialogue", "review_reason": [sc.MANUAL] if self.mark else []}
        row |= {f: "" if blank else (e[f] or "").strip() for f in ("speaker", "original", "translation")}
        row |= {"style": None, "restyle": True}
        self.rows.shift(b, j, 1)
        self.rows.insert(b, j, row)

    def delete(self, e: dict) -> None:
        at = self.rows.find(e["anchor_id"])
        if at is None:
            return
        gone = self.rows.pop(*at)
        if gone["id"] is not None and gone["id"] > 0:
            self.rows.shift(*at, -1)

    def merge(self, e: dict) -> None:
        """With the next row; ``choices`` says per field: current, other or joined.

        The style is the current or the other row's; where the speaker isn't that
        row's, its colours are to be looked up again.
        """
        at = self.rows.find(e["anchor_id"])
        nxt = at and self.rows.after(*at)
        if nxt is None:
            return
        self.rows.settle(nxt[0])
        a, b = self.rows.blocks[at[0]][at[1]], self.rows.blocks[nxt[0]][nxt[1]]
        pick = dict(p.split("=", 1) for p in (e["choices"] or "").split(";") if "=" in p)
        named = [x["kind"] for x in (a, b) if x["kind"] != "blank_no_name"]
        row = dict(a) | {"start": min(a["start"], b["start"]), "end": max(a["end"], b["end"]), "kind": named[0] if named else a["kind"]}
        for f in ("speaker", "original", "translation"):
            how = pick.get(f, "joined" if f != "speaker" else "current")
            row[f] = a[f] if how == "current" else b[f] if how == "other" else "\n".join(x for x in (a[f], b[f]) if x)
        if row["kind"] == "blank_no_name":
            row |= {"speaker": "", "original": "", "translation": ""}
        source = b if pick.get("style", "current") == "other" else a
        row["style"], row["restyle"] = source.get("style"), row["speaker"] != source["speaker"]
        own = ["manual_merge"] if self.mark else []
        source = pick.get("reasons", "joined")
        row["review_reason"] = reasons_of(own, a["review_reason"] if source in ("joined", "current") else [], b["review_reason"] if source in ("joined", "other") else [])
        self.rows.pop(*nxt)
        self.rows.blocks[at[0]][at[1]] = row
        if self.renumber and b["id"] is not None and b["id"] > 0:
            self.rows.shift(at[0], at[1] + 1, -1)

    def set(self, e: dict) -> None:
        at = self.rows.find(e["anchor_id"])
        if at is None:
            return
        row = self.rows.blocks[at[0]][at[1]]
        start, end = (e[f] if e[f] is not None else row[f] for f in ("start", "end"))
        if end < start:
            return
        row |= {"start": start, "end": end} | {f: e[f] for f in ("kind", "speaker", "original", "translation") if e[f] is not None}

    def apply(self, e: dict) -> None:
        op = e["op"]
        if op in ("insert_before", "insert_after"):
            self.insert(e, op == "insert_after")
        elif op in ("delete", "merge", "set"):
            getattr(self, op)(e)


EDIT = ["op", "anchor_id", "start", "end", "kind", "speaker", "original", "translation", "choices"]
#: Rows of a batch that is put out.
BATCH = 10_000


def apply_edits(entries: DataFrame, edits: DataFrame, k: list[str], mark: bool = True, renumber: bool = False) -> DataFrame:
    """Entries (k, pos, FIELDS, review_reason) after the edits (k, seq, op, anchor_id, FIELDS' values, choices).

    Edits of a project depend on those before: a project's entries, and then its edits
    in order of seq, stream through one task, which holds the entries
    (:class:`Rows`: an edit costs about the square root of their number).  Unknown ids
    are ignored.  Inserts and deletions shift the later positive ids; merging does
    not, unless ``renumber``.  pos is counted anew.  Entries with a ``style`` (a map of
    style fields) keep it, and ``restyle`` is added: whether :func:`restyle` is to
    look up the row's colours.
    """
    styled = "style" in entries.columns
    fields = [*FIELDS, "review_reason", *(["style"] if styled else [])]
    kinds = ", ".join(f"{c} {entries.schema[c].dataType.simpleString()}" for c in k)
    row = "id long, raw_id string, start double, end double, kind string, speaker string, original string, translation string, review_reason array<string>" + (", style map<string,string>" if styled else "")
    out = f"{kinds}, pos long, {row}" + (", restyle boolean" if styled else "")
    edit = "op string, anchor_id long, start double, end double, kind string, speaker string, original string, translation string, choices string"

    def typed(df: DataFrame, names: list[str], schema: str):
        kinds = {f.name: f.dataType for f in df.sparkSession.createDataFrame([], schema).schema}
        return F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names])

    def side(df: DataFrame, nth: int, order: str):
        own = [typed(entries, fields, row), F.lit(None).cast(f"struct<{edit.replace(' ', ':').replace(',:', ',')}>")] if nth == 0 else [F.lit(None).cast(f"struct<{row.replace(' ', ':').replace(',:', ',')}>"), typed(edits, EDIT, edit)]
        return df.select(*k, F.lit(nth).alias("_nth"), F.col(order).cast("double").alias("_seq"), own[0].alias("_row"), own[1].alias("_edit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, project, types = None, [], None, []

        def done() -> Iterator[pa.RecordBatch]:
            left = iter(project.rows if project else rows)
            at = 0
            while part := list(itertools.islice(left, BATCH)):
                cols = [[v] * len(part) for v in held] + [list(range(at, at + len(part)))] + [[r[f] for r in part] for f in fields] + ([[r["restyle"] for r in part]] if styled else [])
                names = [*k, "pos", *fields, *(["restyle"] if styled else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
                at += len(part)

        for key, fresh, part in pieces(batches, len(k)):
            if fresh:
                if held is not None:
                    yield from done()
                held, rows, project = key, [], None
            item = part.schema.field("_row").type
            types = [*(part.schema.field(i).type for i in range(len(k))), pa.int64(), *(item.field(f).type for f in fields), *([pa.bool_()] if styled else [])]
            for r, e in zip(part.column("_row").to_pylist(), part.column("_edit").to_pylist(), strict=True):
                if r is not None:
                    style = r.get("style")
                    rows.append(r | {"restyle": False, "style": None if style is None else dict(style)})
                else:
                    project = project or Project(rows, mark, renumber)
                    project.apply(e)
        if held is not None:
            yield from done()

    both = union_all(side(entries, 0, "pos"), side(edits, 1, "seq"))
    return both.repartition(*k).sortWithinPartitions(*k, "_nth", "_seq").mapInArrow(run, out)


def delete_rows(entries: DataFrame, gone: DataFrame, k: list[str]) -> DataFrame:
    """Deletions alone, without an order: later positive ids shift by the deletions of positive ids before."""
    marked = entries.join(gone.select(*k, F.col("anchor_id").alias("id")).distinct().withColumn("_gone", F.lit(True)), [*k, "id"], "left")
    before = Window.partitionBy(*k).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.sum(F.when(F.col("_gone") & (F.col("id") > 0), 1)).over(before), F.lit(0))
    marked = marked.withColumn("_n", n).where("_gone IS NULL")
    return marked.withColumn("id", F.when(F.col("id") > 0, F.col("id") - F.col("_n")).otherwise(F.col("id"))).drop("_gone", "_n")


def restyle(entries: DataFrame, styles: DataFrame, speaker: str = "speaker", max_dist: int = 1) -> DataFrame:
    """Rows marked ``restyle`` with their speaker's colours; ``restyle`` is dropped.

    styles(speaker, and any of COLOURS).  The other style fields stay; rows of no
    speaker that styles have lose their colours, blank rows and titles stay as they
    are, and an ambiguous match adds a reason.
    """
    have = [c for c in COLOURS if c in styles.columns]
    named = styles.select(F.trim(speaker).alias("match"), F.create_map(*[x for c in have for x in (F.lit(c), F.col(c).cast("string"))]).alias("_colours"))
    named = named.groupBy("match").agg(F.min_by("_colours", F.to_json("_colours")).alias("_colours"))
    todo = F.coalesce(F.col("restyle"), F.lit(False)) & sc.is_dialogue("kind")
    d = resolve_dimension(entries, speaker, styles, speaker, max_dist).join(named, "match", "left")
    none = F.create_map().cast("map<string,string>")
    rest = F.map_filter(F.coalesce("style", none), lambda f, _: ~f.isin(COLOURS))
    colours = F.map_filter(F.coalesce("_colours", none), lambda _, v: v.isNotNull())
    d = d.withColumn("style", F.when(todo, F.map_concat(rest, colours)).otherwise(F.col("style")))
    why = F.array(F.when(todo & F.col("ambiguous"), "speaker_style_ambiguous"))
    return d.withColumn("review_reason", sc.merge_reasons("review_reason", why)).select(*[c for c in entries.columns if c != "restyle"])
