"""Structured Streaming forms of segmenting, joining, pairing and assembling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spanline.functions import machine
from spanline.functions.machine import SCHEMA
from spanline.operators.sequence import by


def stream_join_prune(texts: DataFrame, markers: DataFrame, k: list[str], ts: str, score: str, threshold: float, delay: str = "1 hour") -> DataFrame:
    """Text frames joined with their marker frame, kept where its score reaches the threshold.

    Both are streams with an event time; a frame whose partner doesn't come within
    ``delay`` of the watermark is dropped, and so are rows later than that.
    """
    a = texts.withWatermark(ts, delay).alias("a")
    b = markers.select(*k, F.col(ts).alias("_ts"), F.col(score).alias("_score")).withWatermark("_ts", delay).alias("b")
    on = F.expr(f"a.{ts} BETWEEN _ts - INTERVAL {delay} AND _ts + INTERVAL {delay}")
    for c in k:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, on).where(F.col("_score") >= threshold).select("a.*", F.col("_score").alias("marker_score"))


class Fold(StatefulProcessor):
    """Rows of each key in order through a machine whose state is typed and has an end.

    A key ends with a row of ``eof``, after ``quiet`` seconds of event time without a
    row, within a batch as between batches, or once the watermark has passed its last
    row by that long: an event-time timer then ends it and drops its state.  Without
    an event time keys end with ``eof`` only.  Rows must come in order between
    batches; within one they are sorted.

    Subclasses have ``value`` and ``items`` (schemas of a row of state and of a list of
    things seen), ``columns`` of what they put out, and ``load``, ``step``, ``save`` and ``out``.
    """

    value, items, columns = "", "", []

    def __init__(self, k: list[str], order: list[str], event_time: str | None, quiet: float | None):
        self.k, self.order, self.event_time, self.quiet = k, order, event_time, None if quiet is None else int(quiet * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.one = handle.getValueState("fold", f"{self.value}, _last long, _timer long")
        self.many = handle.getListState("items", self.items) if self.items else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).sort_values(self.order)
        state = self.one.get() if self.one.exists() else None
        last, timer = state[-2:] if state else (None, None)
        self.load(tuple(state[:-2]) if state else None)
        live = state is not None
        at = pdf[self.event_time].astype("datetime64[ms]").astype("int64").to_numpy() if self.event_time else None
        for i, r in enumerate(pdf.itertuples(index=False)):
            if at is not None and live and self.quiet is not None and last is not None and at[i] - last > self.quiet:
                self.end()
                live = False
            if r.eof:
                if live:
                    self.end()
                live = False
                continue
            self.step(r)
            live, last = True, int(at[i]) if at is not None else None
        if timer is not None:
            self.handle.deleteTimer(timer)
        if live:
            timer = None
            if last is not None and self.quiet is not None:
                timer = last + self.quiet
                self.handle.registerTimer(timer)
            self.save(last, timer)
        elif state is not None:
            self.clear()
        yield self.rows(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.one.exists():
            self.load(tuple(self.one.get()[:-2]))
            self.end()
            self.clear()
            yield self.rows(key)

    def clear(self) -> None:
        self.one.clear()
        if self.many is not None:
            self.many.clear()

    def rows(self, key) -> pd.DataFrame:
        out = pd.DataFrame(self.out, columns=self.columns)
        for i, (c, v) in enumerate(zip(self.k, key, strict=True)):
            out.insert(i, c, v)
        self.out = []
        return out

    def end(self) -> None:
        """The key's input is over; what comes next starts anew."""
        self.load(None)

    def close(self) -> None:
        pass


class DialogueFold(Fold):
    """The four-state machine; samples of the open segment are appended to the list, never read before it closes."""

    value, items = "place int, begun_idx long, begun_ts double, last_idx long, last_ts double", "idx long"
    columns = ["frame_start", "frame_end", "start", "end", "samples"]
    bits = {"has_text": machine.TEXT, "has_change": machine.CHANGE, "is_clear": machine.CLEAR, "name_changed": machine.NAME}

    def __init__(self, cfg: dict, *args):
        super().__init__(*args)
        self.cfg, self.out = cfg, []

    def load(self, state: tuple | None) -> None:
        self.m = machine.Segmenter(self.cfg)
        self.stored = state is not None
        if state is not None:
            place, bi, bt, li, lt = state
            self.m.place = place
            self.m.begun, self.m.last = None if bi is None else (bi, bt), None if li is None else (li, lt)

    def step(self, r) -> None:
        symbol = sum(bit for name, bit in self.bits.items() if getattr(r, name) is True or getattr(r, name) == 1)
        heard = self.m.heard
        self.m.feed(np.array([r.idx], np.int64), np.array([r.ts], float), np.array([symbol]))
        if self.m.heard is not heard:
            self.closed()

    def closed(self) -> None:
        if self.stored:  # the first to close has samples in the list
            if self.m.out:
                first = self.m.out[0]
                self.m.out[0] = (*first[:4], sorted({*first[4], *(x[0] for x in self.many.get())}))
            self.stored = False
        self.out += self.m.out
        self.m.out = []

    def end(self) -> None:
        self.m.finish()
        self.closed()
        super().end()

    def save(self, last, timer) -> None:
        m = self.m
        heard = [(int(i),) for i in m.heard]
        if self.stored:
            if heard:
                self.many.appendList(heard)
        else:
            self.many.clear()
            if heard:
                self.many.put(heard)
        begun, until = m.begun or (None, None), m.last or (None, None)
        self.one.update((m.place, *begun, *until, last, timer))


class MarkerFold(Fold):
    value, items = ", ".join(f"{f} {t}" for f, t in machine.MarkerMachine.FIELDS.items()), "start long, end long"
    columns = ["frame_start", "frame_end", "sample"]

    def __init__(self, cfg: dict, *args):
        super().__init__(*args)
        self.cfg, self.out = cfg, []

    def load(self, state: tuple | None) -> None:
        self.m = machine.MarkerMachine(self.cfg)
        if state is not None:
            self.m.load(state, [tuple(x) for x in self.many.get()])

    def step(self, r) -> None:
        self.m.step(self.m.pos + 1, bool(r.on))  # positions count from 0 within a key
        self.out += self.m.out
        self.m.out = []

    def save(self, last, timer) -> None:
        self.many.clear()
        if self.m.ons:
            self.many.put(self.m.ons)
        self.one.update((*self.m.state(), last, timer))


class PairFold(Fold):
    """The newest pending request; the first response or error after it takes it."""

    value = "pending long"

    def __init__(self, ident: str, event: str, *args):
        super().__init__(*args)
        self.ident, self.event, self.out = ident, event, []
        self.columns = [ident, "request_id"]

    def load(self, state: tuple | None) -> None:
        self.pending = state[0] if state else None

    def step(self, r) -> None:
        ident, event = getattr(r, self.ident), getattr(r, self.event)
        if event == "request":
            self.pending = int(ident)
        elif event in ("response", "error"):
            self.out.append((int(ident), self.pending))
            self.pending = None

    def save(self, last, timer) -> None:
        self.one.update((self.pending, last, timer))


def folded(df: DataFrame, k: list[str], fold: Fold, schema: str, event_time: str | None, delay: str) -> DataFrame:
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in k)
    if event_time:
        df = df.withWatermark(event_time, delay)
    return df.groupBy(*k).transformWithStateInPandas(fold, f"{kinds}, {schema}", "Append", "EventTime" if event_time else "None")


def stream_segments(df: DataFrame, k: list[str], cfg: dict, mode: str = "dialogue", event_time: str | None = None, quiet: float | None = None, delay: str = "1 minute") -> DataFrame:
    """Segments of a stream of frames, emitted when they close; ``eof``, or ``quiet`` seconds, close the last.

    ``dialogue``: df(k, idx, ts, has_text, has_change, is_clear, name_changed, eof).
    ``marker``: df(k, idx, on, eof), as :func:`spanline.operators.sequence.marker_segments`
    without smoothing, in positions by ``idx``; what follows the last disappearance is
    left out.  ``event_time`` names a timestamp; rows later than ``delay`` are dropped.
    Sessions need the RocksDB state store (:func:`run_to_table` sets it).
    """
    args = (k, ["eof", "idx"], event_time, quiet)
    if mode == "dialogue":
        return folded(df, k, DialogueFold(cfg, *args), SCHEMA, event_time, delay)
    return folded(df, k, MarkerFold(cfg, *args), "frame_start long, frame_end long, sample long", event_time, delay)


def pair_events(df: DataFrame, tag: list[str], order: list, ident: str = "id", event: str = "event") -> DataFrame:
    """(tag, id, request_id) of responses and errors: paired if the tag's event just before is a request."""
    w = by(tag, order)
    d = df.where(F.col(event).isin("request", "response", "error"))
    d = d.withColumn("_e", F.lag(event).over(w)).withColumn("_i", F.lag(ident).over(w))
    return d.where(F.col(event) != "request").select(*tag, ident, F.when(F.col("_e") == "request", F.col("_i")).alias("request_id"))


def stream_pairs(df: DataFrame, tag: list[str], ident: str = "id", event: str = "event", event_time: str | None = None, quiet: float | None = None, delay: str = "1 minute") -> DataFrame:
    """As :func:`pair_events`, over a stream with ``eof``; with an event time a request is forgotten after ``quiet`` seconds."""
    return folded(df, tag, PairFold(ident, event, tag, ["eof", ident], event_time, quiet), f"{ident} long, request_id long", event_time, delay)


def parse_chunks(df: DataFrame, line: str = "line") -> DataFrame:
    """Adds delta, finish, usage and malformed from server-sent lines; keep-alives and DONE have none."""
    body = F.trim(F.regexp_replace(F.coalesce(F.col(line), F.lit("")), r"^data:\s*", ""))
    skip = (body == "") | (body == "[DONE]") | F.startswith(body, F.lit(":"))
    ok = F.try_parse_json(body).isNotNull()
    get = lambda p: F.when(~skip & ok, F.get_json_object(body, p))
    return df.withColumns({"delta": get("$.choices[0].delta.content"), "finish": get("$.choices[0].finish_reason"), "usage": get("$.usage.total_tokens").try_cast("long"), "malformed": ~skip & ~ok})


def assemble_chunks(df: DataFrame, request_id: list, seq: str = "seq", line: str = "line") -> DataFrame:
    """One row per request: content in order, last finish reason and usage, malformed lines, ``empty``.

    Over a stream, group by a session window too, as :func:`stream_chunks` does.
    """
    p = parse_chunks(df, line)
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq)))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("delta").isNotNull(), F.struct(seq, "delta")))), lambda x: x["delta"]), "")
    out = p.groupBy(*request_id).agg(content.alias("content"), last("finish").alias("finish"), last("usage").alias("usage"), F.count_if("malformed").alias("malformed"))
    return out.withColumn("empty", F.trim("content") == "")


def stream_chunks(df: DataFrame, request_id: str, ts: str, gap: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Requests of a stream of lines, emitted once no line has come for ``gap``."""
    d = df.withWatermark(ts, delay)
    return assemble_chunks(d, [F.session_window(ts, gap).alias("session"), request_id]).drop("session")


STORE = "spark.sql.streaming.stateStore.providerClass"


def run_to_table(df: DataFrame, path: str) -> DataFrame:
    """All that is available of a stream, written below ``path`` and read back.

    Streams take the session's state store when they start: RocksDB here, and what it was again afterwards.
    """
    spark = df.sparkSession
    was = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start(f"{path}/rows")
        q.awaitTermination()
    finally:
        if was is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, was)
    return spark.read.schema(df.schema).parquet(f"{path}/rows")
