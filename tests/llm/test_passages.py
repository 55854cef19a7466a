"""Super-k-mers against a dictionary of all windows."""

import random
import re

import numpy as np

from spanline.llm import passages
from spanline.llm import textkit as tk
from tests.llm.test_edges import crowded

DATA = "/root/testdata/sf0.001"


def brute(rows, window):
    """(doc_id, words, kept) for each row."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = {}
    for w in words:
        for i in range(len(w) - window + 1):
            count[tuple(w[i : i + window])] = count.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for (d, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((d, len(w), " ".join(x for j, x in enumerate(w) if j not in gone), len(gone)))
    return sorted(out, key=str)


def check(spark, rows, window=35, **options):
    df = crowded(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    got = passages.deduplicate(df, window=window, **options).collect()
    assert sorted(((r.doc_id, r.n_words, r.kept, sum(e - s for s, e in r.removed)) for r in got), key=str) == brute(rows, window)
    for r in got:  # maximal runs, in order
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))


def rows_of(seed=0):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("aa b c d é ff g".split()) for _ in range(n))
    p = text(60)
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, p), (4, p.replace(" ", " \n")), (5, p.upper()), (6, "a " * 300), (7, "ab cd " * 100), (8, p + " " + p), (9, text(34)), (9, text(40)), (10, text(90)), (10, None)]
    rows += [(20 + i, text(15) + " " + p[: rng.randint(20, 100)] + " " + text(15)) for i in range(40)]
    return rows + [(1, p), (1, p), (100, rows[11][1]), (100, rows[11][1])]


def test_edges(spark):
    check(spark, rows_of())
    check(spark, rows_of(), window=6, gram=3)
    check(spark, rows_of(), window=6, gram=3, frequent=2)  # windows travel one by one
    check(spark, rows_of(), window=5, gram=5)
    check(spark, rows_of(), window=1, gram=1, frequent=3)
    assert passages.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_real_texts(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    check(spark, rows)
    monkeypatch.setattr(passages, "CHUNK", 1000)
    monkeypatch.setattr(tk, "SLICE", 5000)
    check(spark, rows, frequent=2)


def test_equal_hashes_of_different_windows(monkeypatch):
    strings = [b"a b c d", b"a b x d", b"b c d e"]
    monkeypatch.setattr(passages, "window_hashes", lambda data, s, e, w: np.zeros(max(0, len(s) - w + 1), np.uint64))
    row, at = passages.repeated(strings, np.ones(3, np.int64), 3)
    assert list(zip(row.tolist(), at.tolist())) == [(0, 1), (2, 0)]


def test_minimisers():
    rng = np.random.default_rng(0)
    for n, w in ((50, 7), (50, 1), (9, 9), (3, 5)):
        x = rng.integers(0, 5, n)
        assert passages.sliding_argmin(x, w).tolist() == [i + int(x[i : i + w].argmin()) for i in range(n - w + 1)]
    text = (" ".join(map(str, rng.integers(0, 9, 400)))).encode()
    p = passages.Packed(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 35, 12)
    assert p.first[0] == 0 and p.last[-1] == 365 and (p.first[1:] == p.last[:-1] + 1).all() and len(p.first) < 80
    assert all(f <= a <= f + 23 for f, a in zip(p.last, p.at))
