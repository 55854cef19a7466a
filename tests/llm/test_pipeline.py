"""Each stage of the pipeline against brute force on its own input."""

import re

import corpus_pipeline
from spanline.llm.common import cut
from tests.llm.test_lines import brute

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(cut(stage(spark, kept[-1], DATA), name))
    assert all(d.columns == columns for d in kept[:-1])
    raw, lang, line, near, clean, mixed = ({r.doc_id: r for r in d.collect()} for d in kept)
    assert set(raw) - set(lang) == {i for i, r in raw.items() if not re.search(r"[^\W\d_]", r.text or "")}

    gone = brute([(r.doc_id, r.text) for r in lang.values()])
    for i, r in lang.items():
        want = "\n".join(x for k, x in enumerate(r.text.split("\n")) if (i, k) not in gone)
        assert line[i].text == want and line[i].n_chars == len(want)

    sets = {i: shingles(r.text) for i, r in line.items()}
    up = {i: i for i in sets}
    find = lambda i: i if up[i] == i else find(up[i])
    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    assert set(near) == {i for i in sets if find(i) == i}

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    for i, r in near.items():
        w = words(r.text)
        hit = {i for n in {len(x) for x in windows} for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in windows for i in range(s, s + n)}
        assert (i not in clean) == (len(hit) > 0 and 20 * len(hit) >= len(w))

    assert set(mixed) == set(clean) and all(r.taken <= 3 * r.size for r in mixed.values())
    by = {}
    for i, r in mixed.items():
        by.setdefault(clean[i].source, [r.target, 0])[1] += r.taken
    assert all(abs(t - s) <= 2 for t, s in by.values())


def test_stages_on_edges(spark):
    """Null, empty, repeated and clashing input, without n_chars, and empty tables."""
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(1, long, "en", "a"), (1, "another text of the same id\nand its line", "en", "a"), (2, long + " more", None, None), (2, long + " more", None, None), (3, None, "en", "b"), (4, "", None, "b"), (None, "a text without an id at all", "de", None), (None, long, "de", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as id", "2 as body", "3 as hits", "4 as keep")
    want = {
        "language_id": ["a text without an id at all", "another text of the same id\nand its line", long, long, long + " more", long + " more"],
        "line_dedup": ["", "", "", "", "a text without an id at all", "another text of the same id\nand its line", long, None],
        "minhash": ["", "a text without an id at all", "another text of the same id\nand its line", long, None],
        "decontaminate": sorted((r[1] for r in rows), key=str),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns and sorted((r.text for r in got.collect()), key=str) == sorted(want[name], key=str), name
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert corpus_pipeline.mix_sources(spark, docs, DATA).count() == len(rows)
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), DATA).count() == 0
