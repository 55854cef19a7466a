"""Contamination against all windows compared, with small windows and many short items."""

import random
import re

from spanline.llm import decontaminate
from spanline.llm.common import cut

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(docs, bench, window):
    wins = {}
    for i, t in bench:
        w = words(t)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[a : a + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in wins:
                    hit |= set(range(a, a + n))
                    items |= wins[tuple(w[a : a + n])]
        out[d] = (len(w), hit, sorted(items))
    return out


def check(spark, docs, bench, window=13):
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), window).collect()
    want = brute(docs, bench, window)
    assert len(got) == len(want)
    for r in got:
        assert (r.n_words, {j for a, b in r.runs for j in range(a, b)}, list(r.items)) == want[r.doc_id], r.doc_id
        assert r.n_hit == len(want[r.doc_id][1]) and all(x[1] < y[0] for x, y in zip(r.runs, r.runs[1:]))


def test_few_letters(spark, monkeypatch):
    rng = random.Random(0)
    text = lambda n, letters: " ".join(rng.choice(letters) for _ in range(n))
    bench = [(i, text(rng.randint(0, 30), "abc")) for i in range(25)] + [(30, "A, b! C"), (31, None), (32, "rare")]
    docs = [(i, text(rng.randint(0, 120), "abcd")) for i in range(60)] + [(100, None), (101, "x " + bench[3][1].upper() + " y"), (102, "so rare")]
    check(spark, docs, bench)
    check(spark, docs, bench, 5)
    check(spark, docs, bench, 3)
    monkeypatch.setattr(decontaminate, "CONTEXTS", 0)
    check(spark, docs, bench)


def test_rows_of_a_contaminated_text_are_fingerprints(spark, monkeypatch):
    """A text that is all benchmark gives about a row for five words, not one for each."""
    passage = " ".join(f"w{i % 7}x{i}" for i in range(20_000))
    seen = {}

    def counting(df, name):
        out = cut(df, name)
        seen[name] = out
        return out

    monkeypatch.setattr(decontaminate, "cut", counting)
    docs, bench = [(1, passage), (2, "clean words " * 50)], [(1, passage)]
    got = {r.doc_id: r for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got[1].n_hit == 20_000 and got[1].runs == [[0, 20_000]] and got[2].n_hit == 0
    assert seen["spans"].count() < 20_000 / 4
