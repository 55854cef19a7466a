"""Refinement operators against sequential folds on random series."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spanline.functions import machine
from spanline.operators import segments as sg
from spanline.operators import sequence as seq


def percentile(xs, q):
    xs = sorted(xs)
    p = q * (len(xs) - 1)
    lo = int(p)
    hi = min(lo + 1, len(xs) - 1)
    return xs[lo] + (xs[hi] - xs[lo]) * (p - lo)


def coarse(scores, step, margin):
    """Which rows are scored, and the result, one interval after the other."""
    n, out, done = len(scores), {}, set()
    if step <= 1 or n <= step + 1:
        return list(scores), set(range(n))
    anchors = sorted({*range(0, n, step), n - 1})
    for a in anchors:
        out[a] = scores[a]
    done |= set(anchors)
    thr, refine = percentile([scores[a] for a in anchors], 0.7), set()
    for a, b in zip(anchors, anchors[1:]):
        around = set(range(max(0, a - step), min(n - 1, b + step) + 1))
        x, y = scores[a], scores[b]
        if (x >= thr) != (y >= thr) or abs(x - thr) <= margin or abs(y - thr) <= margin:
            refine |= around
            continue
        m = a + (b - a) // 2
        done.add(m)
        if abs(scores[m] - thr) <= margin or (scores[m] >= thr) != (x >= thr):
            refine |= around
            continue
        for k in range(a + 1, b):
            out[k] = x if k - a <= b - k else y
    for k in refine - set(out):
        out[k] = scores[k]
        done.add(k)
    return [out[k] for k in range(n)], done


def series(rng, n):
    return [(k, i, round(rng.random() * rng.choice([1, 10]), 3)) for k in range(n) for i in range(rng.choice([0, 1, 2, 5, 17, 40]))]


def test_coarse_to_fine(spark):
    rng = random.Random(3)
    rows = series(rng, 60)
    got = sg.coarse_to_fine(spark.createDataFrame(rows, "k int, i int, v double"), ["k"], ["i"], F.col("v"), 4, 0.3).collect()
    by = {}
    for k, i, v in rows:
        by.setdefault(k, []).append(v)
    want = {(k, i): (s, i in done) for k, vs in by.items() for s, done in [coarse(vs, 4, 0.3)] for i, s in enumerate(s)}
    assert {(r.k, r.i): (r.score, r.computed) for r in got} == want


def test_only_needed_rows_are_scored(spark):
    """A Python scorer sees each row that counts as computed, once, and no other."""
    rows = [(k, i, round(float(100 * np.sin(i / 60 + (k or 2))), 3)) for k in (1, None, 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def scorer(v: pd.Series) -> pd.Series:
        calls.add(len(v))
        return v

    got = sg.coarse_to_fine(df, ["k"], ["i"], scorer("v"), 6, 5.0).collect()
    want = {(k, i): (s, i in done) for k in (1, None, 3) for s_all, done in [coarse([v for q, _, v in rows if q == k], 6, 5.0)] for i, s in enumerate(s_all)}
    assert {(r.k, r.i): (r.score, r.computed) for r in got} == want
    assert calls.value == sum(r.computed for r in got) < 0.5 * len(rows)


def test_machine_is_the_same_however_rows_are_dealt(spark):
    """Its rules are checked against SQL (g2_dialogue_segments); here rows one by one give what whole keys give."""
    rng = random.Random(4)
    for stable, clear in ((1, 1), (2, 2), (0, 0), (3, 1), (1, 4)):
        cfg = {"stable_frames": stable, "clear_frames": clear, "min_duration": 1.0}
        idx = np.arange(300)
        symbols = np.array([rng.choice([0, 1, 1, 3, 4, 9, 8, 2]) for _ in idx])
        whole, single = machine.Segmenter(cfg), machine.Segmenter(cfg)
        whole.feed(idx, idx * 1.0, symbols)
        whole.finish()
        for i in idx:
            single.feed(idx[i : i + 1], idx[i : i + 1] * 1.0, symbols[i : i + 1])
        single.finish()
        assert whole.out == single.out and whole.out
        assert all(b >= a + 1 and set(x) <= set(idx[symbols & 1 > 0]) for a, b, _, _, x in whole.out)


def test_dialogue_segments_of_null_and_many_keys(spark):
    rows = [(k, i, float(i), 9.0 if i % 7 < 4 else 0.0, 0.0, 0.0, 0.0) for k in (None, "a", "b") for i in range(30)]
    df = spark.createDataFrame(rows, "k string, idx long, ts double, presence double, diff double, name_presence double, name_diff double")
    cfg = {"presence": 5, "change": 0.5, "clear": 2, "name_presence": 8, "name_change": 0.5, "clear_frames": 2}
    got = {}
    for r in sg.dialogue_segments(df, ["k"], ["idx"], cfg).collect():
        got.setdefault(r.k, []).append((r.frame_start, r.frame_end, list(r.samples)))
    want = [(a, a + 3, list(range(a, a + 4))) for a in range(0, 28, 7)] + [(28, 29, [28, 29])]
    assert {k: sorted(v) for k, v in got.items()} == {None: want, "a": want, "b": want}
    assert sg.dialogue_segments(df.limit(0), ["k"], ["idx"], cfg).count() == 0


def test_debounce_fold(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.random() < 0.5) for k in range(40) for i in range(rng.choice([1, 2, 9, 30]))]
    got = {(r.k, r.i): r.debounced for r in seq.debounce(spark.createDataFrame(rows, "k int, i int, f boolean"), ["k"], ["i"], "f", 2, 3).collect()}
    state, streak, last = {}, {}, {}
    for k, i, f in rows:
        streak[k] = streak[k] + 1 if last.get(k) == f else 1
        last[k] = f
        if k not in state or streak[k] >= (2 if f else 3):
            state[k] = f
        assert got[k, i] == state[k]


def test_even_sample(spark):
    rows = [(n, i) for n in range(1, 40) for i in range(n)]
    got = {}
    for r in seq.even_sample(spark.createDataFrame(rows, "k int, i int"), ["k"], ["i"], 6).collect():
        got.setdefault(r.k, []).append(r.i)
    for n in range(1, 40):
        assert sorted(got[n]) == (list(range(n)) if n <= 6 else [j * (n - 1) // 5 for j in range(6)])
