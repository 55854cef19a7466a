"""Targets of small sources beside a large one, and the order of the mix."""

import re

from pyspark.sql import functions as F

from spanline.llm import mixing


def corpus(spark):
    sizes = {"a": 2000, "b": 5000, "c": 12_000, "d": 25_000, "e": 40_000, "tiny": 3}
    small = spark.createDataFrame([(i, s, "w " * n) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, text string")
    hot = spark.range(100, 160).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.repeat(F.lit("w "), F.lit(100_000)).alias("text"))
    return small.unionByName(hot)


def test_small_sources_meet_their_targets(spark):
    for block in (1024, 100_000):
        by = {}
        for r in mixing.taken(corpus(spark), block_words=block).collect():
            by.setdefault((r.source_size, r.target), []).append(r.taken)
        assert len(by) == 7 and all(abs(sum(v) - t) <= 0.5 for (_, t), v in by.items())


def test_the_order_is_even(spark):
    """Any beginning of the mix has each source near its share; blocks are equal; stretches read on where they stopped."""
    rows = [(i, "abc"[i % 3], " ".join(f"d{i}w{j}" for j in range(i % 60))) for i in range(300)] + [(7, "a", None), (None, None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    m = mixing.mix(docs, block_words=16)
    target = {r.sid: r.target for r in m["targets"].collect()}
    order = sorted(m["order"].collect(), key=lambda r: (r.slot, r.sid, r.before + (r.start == 0) * 0))
    by_slot = {}
    for r in order:
        by_slot.setdefault((r.slot, r.sid), []).append(r.words)
    blocks = {}
    for (_, sid), words in by_slot.items():
        blocks.setdefault(sid, []).append(sum(words))
    assert all(max(v) - min(v) <= 1 and abs(sum(v) - target[s]) <= 0.5 for s, v in blocks.items())
    had, all_words, total = dict.fromkeys(target, 0), 0, sum(target.values())
    for r in order:
        had[r.sid] += r.words
        all_words += r.words
        assert all(abs(had[s] - all_words * t / total) < 6 * 16 for s, t in target.items())
    # Each source's stretches, in the order of its slots, are its documents end to end.
    placed = m["placed"].where("size > 0").collect()
    for sid in target:
        stream = [(r.doc_id, j) for r in sorted((p for p in placed if p.sid == sid), key=lambda p: p.before) for j in range(r.size)]
        own = {}
        for r in order:
            if r.sid == sid:
                own.setdefault(r.slot, []).append(r)
        got, at = [], 0
        for slot in sorted(own):
            left = {(r.doc_id, r.start): r.words for r in own[slot]}
            while left:
                here = stream[at % len(stream)]
                n = left.pop(here)
                got += [(here[0], here[1] + j) for j in range(n)]
                at += n
        assert got == (stream * 3)[: len(got)]
    texts = {i: re.findall(r"\S+", t or "") for i, _, t in rows if i != 7 or t}
    assert all(r.start + r.words <= len(texts[r.doc_id]) for r in order)
