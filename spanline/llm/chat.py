"""Chat formatting with a grammar round trip.

A turn is rendered as ``<s>[INST] role [/INST]`` + line feed + body + ``</s>`` +
line feed.  The rendered turn is parsed again by a deterministic parser; where
the parse fails or differs from the source, the turn is escaped and marked so.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings; none may stand unescaped within a role or body.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TO_ESCAPE = re.compile(r"\\|" + _CONTROL.pattern)
_ESCAPED = re.compile(r"\\(.)", re.S)
#: Markers of plain and escaped turns, after the header's first control string.
PLAIN, ESCAPED = "[INST] ", "[INST]\\ "


class ParseError(ValueError):
    """The text is not a sequence of turns."""


def escape(text: str) -> str:
    """A backslash before every backslash and before every control string."""
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render_turn(role: str, text: str, level: int) -> str:
    if level:
        return f"<s>{ESCAPED}{escape(role)} [/INST]\n{escape(text)}</s>\n"
    return f"<s>{PLAIN}{role} [/INST]\n{text}</s>\n"


def _until(text: str, at: int, closer: str, escaped: bool) -> tuple[str, int]:
    """The field from ``at`` to its closer; any other control string on the way is an error."""
    pos = at
    while m := _TO_ESCAPE.search(text, pos):
        if m[0] == "\\":
            # Within an escaped field a backslash takes what follows with it: a control string, or one character.
            nxt = _CONTROL.match(text, m.end()) if escaped else None
            pos = nxt.end() if nxt else m.end() + (1 if escaped else 0)
            continue
        if text.startswith(closer, m.start() - (1 if closer[0] == " " else 0)):
            end = m.start() - (1 if closer[0] == " " else 0)
            if end < at:
                break
            field = text[at:end]
            return (unescape(field) if escaped else field), end + len(closer)
        break
    raise ParseError(closer)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, body, start, end) for each turn of a rendered text; start and end bound the body as rendered."""
    turns, at = [], 0
    while at < len(text):
        for marker, escaped in ((PLAIN, False), (ESCAPED, True)):
            if text.startswith("<s>" + marker, at):
                role, body_at = _until(text, at + 3 + len(marker), " [/INST]\n", escaped)
                body, at_next = _until(text, body_at, "</s>\n", escaped)
                turns.append((role, body, body_at, at_next - 5))
                at = at_next
                break
        else:
            raise ParseError("turn")
    return turns


def format_turn(role: str, text: str) -> tuple[str, str, str, int, int]:
    """(rendered, role, text, start, end), the last four as parsed from the first.

    Rendered plainly if that reads back as the source; else escaped.
    """
    for level in (0, 1):
        out = render_turn(role, text, level)
        try:
            got = parse(out)
        except ParseError:
            continue
        if len(got) == 1 and got[0][:2] == (role, text):
            return out, *got[0]
    raise ParseError("round trip")


TURNS = "conv_id {}, turn {}, formatted string, role string, text string, loss boolean, start long, end long"


def format_turns(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Each row of ``rows(conv_id, turn, role, text)`` as a formatted piece.

    A conversation's formatted text is its pieces one after the other, by turn.
    ``role`` and ``text`` are read back from the piece; ``loss`` says whether the
    body is trained on, ``start``/``end`` where it stands in the piece.  Null role
    or text is empty; a null conv_id is a conversation of its own; extra columns
    are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [format_turn(r or "", t or "") for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            out, role, text, start, end = (list(x) for x in zip(*done, strict=True)) if done else ([], [], [], [], [])
            cols = [pa.array(x, pa.string()) for x in (out, role, text)] + [pa.array([r == loss_role for r in role], pa.bool_())]
            cols += [pa.array(x, pa.int64()) for x in (start, end)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["conv_id", "turn", "formatted", "role", "text", "loss", "start", "end"])

    src = rows.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    kinds = [src.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    return src.mapInArrow(run, TURNS.format(*kinds))


DIGEST = "conv_id {}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(pieces: DataFrame) -> DataFrame:
    """One row per conversation, by streaming its pieces in order of turn (ties: by the rendered piece).

    The formatted text is parsed piece by piece as it streams, so a conversation
    of any length needs the memory of one piece and two hash states.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows = None, []
        for b in batches:
            for conv, formatted, loss_from in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if state is None or state[0] != conv:
                    if state:
                        rows.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if loss_from:
                        state[3] += len(text)
                        state[4].update(text.encode("utf-8", "surrogatepass"))
                state[5] += len(formatted)
            if rows:
                yield batch(rows)
                rows = []
        if state:
            yield batch([state])

    def batch(rows):
        cols = list(zip(*[(r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]) for r in rows], strict=True))
        types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = pieces.schema["conv_id"].dataType
    conv_type = to_arrow_type(kind)
    src = pieces.select("conv_id", "formatted", "loss", "turn").repartition("conv_id")
    src = src.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "formatted")
    return src.select("conv_id", "formatted", "loss").mapInArrow(run, DIGEST.format(kind.simpleString()))
