"""Runs against brute force over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np

from spanline.llm import periods
from spanline.llm import textkit as tk
from tests.llm.test_edges import crowded


def brute(w):
    """(start, length, period) of all runs of the list ``w``, and the words that stay."""
    found = {}
    n = len(w)
    for q in range(1, n // 4 + 1):
        s = 0
        while s < n - q:
            e = s
            while e < n - q and w[e] == w[e + q]:
                e += 1
            if e > s and e + q - s >= max(6, 4 * q):
                found.setdefault((s, e + q - s), q)
            s = e + 1
    gone = {i for (s, k), q in found.items() for i in range(s + q, s + k)}
    return sorted((s, k, q) for (s, k), q in found.items()), [x for i, x in enumerate(w) if i not in gone]


def texts(seed=0):
    rng = random.Random(seed)
    out = [None, "", " \n", "one", "a " * 5, "a " * 6, "a " * 500, "a b " * 200, "é\tff\n" * 9 + "é", "a a a a b " * 40]
    for _ in range(150):
        w = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 90))]
        p = [rng.choice(["x", "yy", "zz"]) for _ in range(rng.randint(1, 40))]
        at = rng.randint(0, len(w))
        out.append(" ".join(w[:at] + (p * 12)[: rng.randint(0, len(p) * 9)] + w[at:]))
    return out


def test_brute_force(spark, monkeypatch):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts())] + [(1, "a b " * 30)] * 2
    df = crowded(spark.createDataFrame(rows, "doc_id long, text string"))
    for slice_bytes, block in ((tk.SLICE, periods.BLOCK), (200, 50)):
        monkeypatch.setattr(tk, "SLICE", slice_bytes)
        monkeypatch.setattr(periods, "BLOCK", block)
        got = []
        for b in df.select("doc_id", "text").toArrow().to_batches():
            for out in periods.run_rows([b]):
                got += out.to_pylist()
        want = []
        for d, t in rows:
            w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            runs, kept = brute(w)
            want.append((d, len(w), runs, " ".join(kept)))
        assert [(r["doc_id"], r["n_words"], [tuple(x.values()) for x in r["runs"]], r["collapsed"]) for r in got] == want
    assert sorted(str(r) for r in periods.find(df).select("n_words", "collapsed").collect()) == sorted(f"Row(n_words={n}, collapsed={k!r})" for _, n, _, k in want)
    assert periods.digest(periods.find(df.limit(0))).count() == 0
    best = {r.doc_id: r for r in periods.digest(periods.find(df.where("doc_id in (2, 6, 7)"))).collect()}
    assert (best[2].n_runs, best[2].start, best[2].exponent_milli, best[2].runs_sha256) == (0, None, None, hashlib.sha256(b"").hexdigest())
    assert (best[6].start, best[6].length, best[6].period, best[6].exponent_milli) == (0, 500, 1, 500000)
    assert best[7].runs_sha256 == hashlib.sha256(b"0,400,2\n").hexdigest() and best[7].collapsed_sha256 == hashlib.sha256(b"a b").hexdigest()


def test_extensions():
    rng = np.random.default_rng(0)
    for letters in (1, 2, 5):
        size = rng.integers(0, 300, 30)
        first = np.append(0, np.cumsum(size))
        code = rng.integers(1, letters + 1, first[-1])
        code[first[3] : first[4]] = np.resize([1, 2, 1], size[3])
        ext = periods.Extensions(code, first)
        row = rng.choice(np.flatnonzero(size), 2000)
        i = first[row] + rng.integers(0, size[row])
        j = i + 1 + rng.integers(0, 400, 2000) % (first[row + 1] - i)
        want = []
        for a, b, e in zip(i, j, first[row + 1]):
            k = 0
            while b + k < e and code[a + k] == code[b + k]:
                k += 1
            want.append(k)
        assert ext(i, j).tolist() == want
    assert len(ext.sampled) < 0.25 * len(code)


def test_planted(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i * 7 % 90))) for i in range(300)] + [(None, "x y"), (10, None)]
    got = periods.planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (d, t), r in zip(rows, got, strict=True):
        h, w = zlib.crc32(str(d).encode()), (t or "").split()
        if d is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))
        assert (r.doc_id, r.text) == (d, t)


def test_words_of_one_hash(monkeypatch):
    monkeypatch.setattr(tk, "span_hash", lambda p, s, e: np.zeros(len(s), np.uint64))
    data = np.frombuffer(b"aa bb aa c", np.uint8)
    assert periods.codes_of(data, *tk.words(data, np.array([0, 10]), tk.SPACED)[:2]).tolist() == [1, 2, 1, 3]
