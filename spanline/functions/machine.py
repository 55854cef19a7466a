"""Segment machines as folds over ordered rows, shared by batch and streaming.

The dialogue machine is a table: a row's flags are one symbol of four bits, a place
is a phase with its counters, and for each place and symbol the table has the next
place and what happens to the open segment.  A fold only follows the table; where
it opens and closes, segments are cut from whole columns.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SCHEMA = "frame_start long, frame_end long, start double, end double, samples array<long>"
#: Bits of a row's symbol.
TEXT, CHANGE, CLEAR, NAME = 1, 2, 4, 8
#: What a row may do: begin a segment, end the open one, or end it and begin the next.
OPEN, CLOSE = 1, 2

#: Another speaker is a boundary wherever a segment is open.
SPEAKER = [(NAME | TEXT, "rising", CLOSE | OPEN), (NAME, "idle", CLOSE)]
#: For each phase (bits, next phase, action): the first rule applies whose bits are all set.
RULES = {
    "idle": [(TEXT, "rising", OPEN)],
    "rising": SPEAKER,
    "still": [*SPEAKER, (CLEAR, "fading", 0), (CHANGE, "rising", CLOSE | OPEN)],
    "fading": [*SPEAKER, (TEXT, "rising", CLOSE | OPEN)],
}


@lru_cache(maxsize=64)
def transitions(stable_frames: int, clear_frames: int) -> tuple[list[list[int]], list[list[int]]]:
    """(next place, action) for each place, of which 0 is idle, and each of the sixteen symbols."""

    def follow(phase: str, calm: int, gone: int, symbol: int):
        for bits, then, action in RULES[phase]:
            if symbol & bits == bits:
                return (then, 0, int(then == "fading")), action
        if phase in ("idle", "still"):
            return (phase, 0, 0), 0
        gone = gone + 1 if phase == "fading" or symbol & CLEAR else 0
        if gone and gone >= clear_frames:
            return ("idle", 0, 0), CLOSE
        calm = calm + 1 if symbol & (TEXT | CHANGE) == TEXT else 0
        if phase == "rising" and calm >= stable_frames:
            return ("still", 0, 0), 0
        return (phase, calm if phase == "rising" else 0, gone), 0

    places, goes, does = [("idle", 0, 0)], [], []
    for place in places:  # grows while it is read
        row = [follow(*place, symbol) for symbol in range(16)]
        for to, _ in row:
            if to not in places:
                places.append(to)
        goes.append([places.index(to) for to, _ in row])
        does.append([action for _, action in row])
    return goes, does


class Segmenter:
    """Feeds ordered rows of one key through the table; ``out`` has the closed segments.

    A segment begins where it was opened and ends at the last row with text; its
    samples are the rows with text since the one before was closed.  Shorter ones
    than ``min_duration`` are dropped.

    Entered at a ``place`` other than idle, a segment is open whose beginning isn't
    known: what is heard of it comes out as ``head`` (last text, samples).
    """

    def __init__(self, cfg: dict, place: int = 0):
        self.goes, self.does = transitions(cfg.get("stable_frames", 2), cfg.get("clear_frames", 2))
        self.min_duration = cfg.get("min_duration", 0.0)
        self.place, self.begun, self.last, self.heard = place, None, None, []
        self.cut, self.head = place != 0, None
        self.out: list[tuple] = []

    def feed(self, idx: np.ndarray, ts: np.ndarray, symbols: np.ndarray) -> None:
        actions, place = [], self.place
        for symbol in symbols.tolist():
            actions.append(self.does[place][symbol])
            place = self.goes[place][symbol]
        self.place = place
        texts, done = np.flatnonzero(symbols & TEXT), 0

        def hear(upto: int) -> None:
            nonlocal done
            stop = int(np.searchsorted(texts, upto))
            self.heard.extend(idx[texts[done:stop]].tolist())
            if stop:
                self.last = (int(idx[texts[stop - 1]]), float(ts[texts[stop - 1]]))
            done = stop

        for at in np.flatnonzero(actions).tolist():
            if actions[at] & CLOSE:
                hear(at + 1)
                self.end()
            if actions[at] & OPEN:
                self.begun = (int(idx[at]), float(ts[at]))
        hear(len(symbols))

    def end(self) -> None:
        if self.cut:
            self.head = (self.last, self.heard)
        elif self.last is not None and self.last[1] - self.begun[1] >= self.min_duration:
            self.out.append((self.begun[0], self.last[0], self.begun[1], self.last[1], sorted(set(self.heard))))
        self.begun, self.heard, self.cut = None, [], False

    def finish(self) -> None:
        """End of input: an open segment ends too."""
        if self.begun is not None or self.cut:
            self.end()
        self.place = 0


class Places:
    """What rows do to the machine, wherever it is: for each place the place after them."""

    def __init__(self, cfg: dict):
        goes, _ = transitions(cfg.get("stable_frames", 2), cfg.get("clear_frames", 2))
        self.goes = np.array(goes)
        self.to = np.arange(len(goes))

    def add(self, symbols: np.ndarray) -> None:
        maps = self.goes[:, symbols].T
        while len(maps) > 1:  # neighbours become one, all at once
            odd = maps[len(maps) & ~1 :]
            maps = np.concatenate([np.take_along_axis(maps[1::2], maps[: len(maps) & ~1 : 2], axis=1), odd])
        if len(maps):
            self.to = maps[0][self.to]

    def apply(self, place: int) -> int:
        return int(self.to[place])


class MarkerMachine:
    """Marker segmentation one frame at a time: debounced flag, its run, and what the next segment needs.

    cfg: min_on, min_off.  A disappearance counts once min_off frames are off after
    an on-run of min_on; edges of a kind too close to the last one kept don't.
    Frames with the flag on are kept as runs, and only until an appearance makes them
    needless.
    """

    #: The state between frames, as columns and their types; with ``ons`` it is all there is.
    FIELDS = {
        "flag": "boolean", "raw": "boolean", "streak": "long", "begun": "long", "first": "boolean", "since": "long", "gone": "long",
        "came": "long", "seen": "long", "on_start": "long", "on_end": "long", "pos": "long",
    }

    def __init__(self, cfg: dict):
        self.min_on, self.min_off = max(1, cfg.get("min_on", 2)), max(1, cfg.get("min_off", 2))
        self.gap = max(2, cfg.get("min_on", 2) + cfg.get("min_off", 2))
        self.flag = self.raw = None
        self.streak, self.begun, self.first = 0, 0, True  # rows of equal raw flags; where the run began; whether it is the first
        self.since, self.gone, self.came, self.seen = 0, None, None, None  # last edge used, last disappearance and appearance kept, first appearance since the edge
        self.on_start = self.on_end = None  # the last on-run
        self.ons: list[tuple[int, int]] = []  # runs of frames that are on since the edge
        self.pos, self.out = -1, []

    def state(self) -> tuple:
        return tuple(getattr(self, f) for f in self.FIELDS)

    def load(self, state: tuple, ons: list[tuple[int, int]]) -> None:
        for f, v in zip(self.FIELDS, state, strict=True):
            setattr(self, f, v)
        self.ons = ons

    def step(self, idx: int, on: bool) -> None:
        self.pos = idx
        self.streak = self.streak + 1 if on == self.raw else 1
        self.raw = on
        was = self.flag
        if was is None or self.streak >= (self.min_on if on else self.min_off):
            self.flag = on
        if was is not None and self.flag != was:
            if was:
                self.on_start, self.on_end = self.begun, idx - 1
            self.begun, self.first = idx, False
        if self.flag:
            self.hold(idx)
            if idx - self.begun + 1 == self.min_on and not self.first and (self.came is None or self.begun - self.came >= self.gap):
                self.came = self.begun
                if self.seen is None and self.begun >= self.since:
                    self.seen, self.ons = self.begun, []
        elif self.on_end is not None and idx - self.begun + 1 == self.min_off:
            if self.on_end - self.on_start + 1 >= self.min_on and (self.gone is None or self.begun - self.gone >= self.gap):
                self.gone = self.begun
                self.emit(self.begun)

    def hold(self, idx: int) -> None:
        if self.seen is not None:
            return
        if self.ons and self.ons[-1][1] == idx - 1:
            self.ons[-1] = (self.ons[-1][0], idx)
        else:
            self.ons.append((idx, idx))

    def emit(self, edge: int) -> None:
        if edge > self.since:
            self.out.append((self.since, edge, self.seen if self.seen is not None else self.middle(edge)))
        self.since = edge
        self.seen = self.came if self.came is not None and self.came >= edge else None
        self.ons = []

    def middle(self, edge: int) -> int:
        """The middle one of the frames that are on, else of all."""
        rank = sum(e - s + 1 for s, e in self.ons) // 2
        for s, e in self.ons:
            if rank <= e - s:
                return s + rank
            rank -= e - s + 1
        return (self.since + edge) // 2

    def finish(self) -> None:
        """What follows the last disappearance is no segment."""
