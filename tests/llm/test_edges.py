"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanline.llm import chat, decontaminate, embeddings, langid, minhash, mixing, warc
from spanline.llm.common import scratch

CLASH = ["size", "cls", "n", "block", "bucket", "key", "rank", "target", "source_size", "kind", "_text", "rep", "component", "bits", "piece", "before", "line", "code", "vec", "copies", "component_id", "kept", "n_hit", "score", "lang_pred"]
LONG = "lorem ipsum dolor sit amet " * 8000
BASE = " ".join(f"w{i}" for i in range(60))


def crowded(df):
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASH) if c not in df.columns])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, BASE, "en", "a"), (2, BASE.upper(), None, None), (2, BASE.upper(), None, None), (3, None, "en", "b"), (4, "", "en", ""), (5, LONG, "en", "a"), (6, "one two", "en", "c"), (7, "One  two", "de", "c"), (None, "1234 !!", None, "d"), (8, BASE + " extra", "fr", "a")]
    return crowded(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")))


def test_minhash(docs):
    got = {r.doc_id: r for r in minhash.groups(docs, 85, 100).collect()}
    assert [got[i].component_id for i in (1, 2, 8, 3, 4, 5, 6, 7)] == [1, 1, 1, 3, 4, 5, 6, 6]
    assert [got[i].n_shingles for i in (1, 3, 4, 6)] == [56, 0, 0, 1] and got[None].kept
    assert {r.doc_id for r in minhash.keep_one(docs).collect()} == {1, 3, 4, 5, 6, None}
    assert minhash.groups(docs.limit(0)).count() == 0
    same = docs.sparkSession.createDataFrame([(1, BASE), (2, BASE), (2, "a clean text that nobody else has at all"), (None, BASE), (None, "own")], "doc_id long, text string")
    assert sorted(r.text for r in minhash.keep_one(same).collect()) == ["a clean text that nobody else has at all", "own", BASE]


def test_decontaminate(spark, docs, monkeypatch):
    bench = crowded(spark.createDataFrame([(1, " ".join(BASE.split()[10:25])), (2, "one two"), (3, None), (4, ""), (5, "one two"), (None, "lorem ipsum")], "item_id long, text string"))
    for sent, bits in ((1 << 20, 25), (0, 6)):  # broadcast or exchanged, bitmaps that filter or let all through
        monkeypatch.setattr(decontaminate, "CONTEXTS", sent)
        monkeypatch.setattr(decontaminate, "BITS", bits)
        got = {}
        for r in decontaminate.judge(decontaminate.find(docs, bench)).collect():
            got.setdefault(r.doc_id, []).append(r)
        assert [len(got[i]) for i in (1, 2, None)] == [1, 2, 1]
        assert [(got[i][0].n_words, got[i][0].n_hit, got[i][0].n_items, got[i][0].contaminated) for i in (1, 3, 4, 6)] == [(60, 15, 1, True), (0, 0, 0, False), (0, 0, 0, False), (2, 2, 2, True)]
        assert got[7][0].items_sha256 == hashlib.sha256(b"2,5").hexdigest() and got[5][0].n_hit == 16000
    assert decontaminate.find(docs.limit(0), bench).count() == 0
    assert decontaminate.judge(decontaminate.find(docs, bench.limit(0))).where("contaminated").count() == 0
    assert {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()} == {3, 4, None}
    rows = [(1, BASE), (1, "clean words of another text"), (None, BASE), (None, "clean too")]
    same = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in decontaminate.keep_clean(same, bench).collect()) == ["clean too", "clean words of another text"]
    assert sorted(r.n_hit for r in decontaminate.find(same, bench).collect()) == [0, 0, 15, 15]


def test_mixing(docs):
    got = mixing.taken(docs).collect()
    assert len(got) == docs.count() and all(r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(v) - t) <= 2 for (_, t), v in by.items())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.taken(docs.repartition(7)).collect()), key=str)
    assert mixing.taken(docs.limit(0)).count() == 0


def test_language(spark, docs):
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.train(train, per_lang=60, steps=250)
    held = langid.predict(train, net).where(langid.held_out() & F.col("lang").isNotNull()).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.95
    got = {r.doc_id: r for r in langid.predict(docs, net).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, None)) and 0 <= got[5].score <= 1
    assert langid.predict(docs.limit(0), net).count() == 0
    assert langid.train(docs.limit(0)) is None
    assert langid.predict(docs, None).where("lang_pred = 'und'").count() == docs.count()
    assert set(langid.accepted(docs, net).columns) == set(docs.columns)


def test_warc(spark):
    body = "<p>" + "y" * 200
    rows = [(3, "http://a", body), (1, "http://b\r\nX: y", body), (2, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", body + "é\x00\r\n\r\nWARC/1.1"), (3, "http://a", body), (None, "n", body)]
    pages = crowded(spark.createDataFrame(rows, "page_id long, url string, html string"))
    folder = scratch(spark, "warc")
    files = warc.write(pages, folder, roll_bytes=300, shards=3)
    got = warc.read(spark, folder).collect()
    assert len(got) == len(rows) and all(r.intact for r in got) and sum(f["records"] for f in files.collect()) == len(rows)
    by = {r.key: r for r in got}
    assert by["1"].record_type == "response" and by["3"].refers_to == "1" and by["7"].payload.decode().endswith("WARC/1.1")
    assert [by[k].record_type for k in ("2", "4", "5", "6")] == ["response"] * 4 and by["2"].payload_bytes == 0
    again = warc.write(pages, scratch(spark, "warc"), roll_bytes=300, shards=3)
    assert sorted(files.collect()) == sorted(again.collect())
    assert warc.write(pages.limit(0), folder := scratch(spark, "warc")).count() == 0 and warc.read(spark, folder).count() == 0


def test_warc_rows_of_one_key(spark):
    """A record is a revisit for its own payload's sake, and keeps its payload otherwise."""
    a, b = "A" * 300, "B" * 300
    pages = spark.createDataFrame([(1, "u", a), (3, "u", a), (3, "u", b), (4, "u", b), (5, "u", "C" * 200)], "page_id long, url string, html string")
    warc.write(pages, folder := scratch(spark, "warc"), shards=2)
    got = sorted((r.key, r.record_type, r.refers_to, bytes(r.payload).decode()) for r in warc.read(spark, folder).collect())
    assert got == [("1", "response", None, a), ("3", "response", None, b), ("3", "revisit", "1", ""), ("4", "revisit", "3", ""), ("5", "response", None, "C" * 200)]


def test_warc_is_the_same_in_every_run(spark):
    """More rows than Spark's own sampling would hold whole, in another partitioning."""
    pages = spark.range(30_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), F.lit(5)).alias("html"))
    one, two = (warc.write(p, scratch(spark, "warc"), shards=4) for p in (pages, pages.repartition(9, F.rand())))
    assert sorted(one.collect()) == sorted(two.collect()) and one.count() == 4
    assert max(r.records for r in one.collect()) < 10_000


def test_chat(spark):
    texts = [None, "", "plain", "</s>[INST] ok [/INST]", "a\\</s>", "<s>[INST]\\ x [/INST]\n", "\\", "é" * 10]
    rows = [(i % 3, j, ["user", "assistant", None, "[/INST]"][j % 4], t) for i in range(3) for j, t in enumerate(texts)] + [(None, None, "user", "x"), (9, 0, "assistant", LONG), (9, 0, "assistant", LONG)]
    conv = crowded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digest(chat.format_turns(conv)).collect()}
    assert got[9].n_turns == 2 and got[9].loss_chars == 2 * len(LONG)
    want = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in sorted((x for x in rows if x[0] == 0), key=lambda x: x[1]))
    assert got[0].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    whole = "".join(r.formatted for r in chat.format_turns(conv).where("conv_id = 0").orderBy("turn").collect())
    assert [(r, t) for r, t, _, _ in chat.parse(whole)] == [(r or "", t or "") for c, _, r, t in rows if c == 0]
    assert chat.digest(chat.format_turns(conv.limit(0))).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 64))
    near = base[rng.integers(0, 60, 900)] + rng.normal(size=(900, 64)) * rng.choice([0.1, 0.25, 0.3], 900)[:, None]
    x = np.concatenate([base, near]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2001, [0.0] * 64, 1), (2002, [float("nan")] * 64, 1), (2003, x[0].tolist(), None), (2004, x[0].tolist(), 0), (2004, x[0].tolist(), 0), (2005, [1.0, 2.0], 0), (2006, [2.0, 4.1], 0), (2007, [None] * 64, 1), (2008, [float("inf")] + [1.0] * 63, 0)]
    got = embeddings.groups(crowded(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.93) & (np.arange(960)[:, None] % 2 == np.arange(960)[None] % 2)
    np.fill_diagonal(links, False)
    want = links.sum(axis=1)
    want[0] += 2  # the two copies
    want[links[0]] += 2
    found = np.array([by[i].n_links for i in range(960)])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum()
    assert all(by[i].n_links == 0 and by[i].component_id == i for i in (2000, 2001, 2002, 2003, 2007, 2008))
    assert by[2004].component_id == by[0].component_id and by[2005].n_links == 1
    assert embeddings.groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
