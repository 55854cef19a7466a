"""Suffix grouping and repeated passages against brute force."""

import hashlib
import random

from spanline.llm import suffixes

DATA = "/root/testdata/sf0.001"


def test_suffix_order():
    rng = random.Random(0)
    for _ in range(2000):
        s = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffixes.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        t = (t or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            w = hashlib.md5(t[i : i + 100]).digest()
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        out[d] = bytes(b for b, g in zip(t, gone) if not g)
    return out


def check(spark, rows, **options):
    got = suffixes.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert bytes(r.kept) == want[r.doc_id], r.doc_id
        assert r.n_bytes == len(r.kept) + sum(b - a for a, b in r.removed)


def test_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    check(spark, rows)
    check(spark, rows, hot_share=0.0)


def test_edges(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    p = word(130)
    rows = [(1, None), (2, ""), (None, p), (3, word(50) + p + word(60)), (4, p[:99]), (5, "a" * 500), (6, "ab" * 300), (7, p + p + p), (8, word(90) + p[20:125] + word(90)), (9, word(30) + p[:100]), (10, p[30:] + word(7))]
    rows += [(20 + i, word(80) + "this line of sixty bytes is very common in all of the corpus" + word(80)) for i in range(80)]
    check(spark, rows)
    check(spark, rows, hot_share=0.0)
    assert suffixes.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_null_and_textual_ids(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p, own = word(200), word(300)
    docs = spark.createDataFrame([(1, p), (5, word(20) + p), (5, own), (None, own[:150]), (7, p), (7, p)], "doc_id long, text string")
    rows = [(r.doc_id, r.n_bytes, len(r.kept)) for r in suffixes.deduplicate(docs).collect()]
    assert sorted(rows, key=str) == sorted([(1, 200, 200), (5, 220, 20), (5, 300, 150), (None, 150, 150), (7, 200, 0), (7, 200, 0)], key=str)
    texts = spark.createDataFrame([("b", p), ("a", p), ("c", own)], "doc_id string, text string").selectExpr("*", "1 as _doc", "2 as bucket", "3 as kind")
    assert {r.doc_id: len(r.kept) for r in suffixes.deduplicate(texts).collect()} == {"a": 200, "b": 0, "c": 300}


def test_more_buckets_than_partitions(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 2000)
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()])
