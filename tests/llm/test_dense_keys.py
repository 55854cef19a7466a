"""Dense and salted keys lose no link: what is found doesn't depend on how a key is handled."""

import numpy as np

from spanline.llm import buckets, lines, minhash
from tests.llm.test_lines import removed


def shuffled_rows(n=240, n_words=40):
    """Lines in pairs that differ in as many words as may be; some words are in all lines."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n):
        base = [f"common{j}" for j in range(20)] + [f"own{i}x{j}" for j in range(n_words - 20)]
        near = list(base)
        for j in rng.choice(n_words, n_words // 5, replace=False):
            near[j] = f"new{i}x{j}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
    return rows


def everything(spark, rows, monkeypatch):
    """What is removed if all pairs of a key are tried."""
    with monkeypatch.context() as m:
        m.setattr(buckets, "FEW", 1 << 40)
        return removed(spark, rows)


def test_salted_keys_lose_no_lines(spark, monkeypatch):
    rows = shuffled_rows()
    want = everything(spark, rows, monkeypatch)
    monkeypatch.setattr(buckets, "BLOCK", 5)
    monkeypatch.setattr(buckets, "DRAWN", 1)
    assert want <= removed(spark, rows)


def one_key(spark, bodies, kind, width, same, score, parts):
    """The links of bodies that share one key and all look alike before they are verified."""
    n = [len(b) // kind for b in bodies]
    classes = spark.createDataFrame([(i, m, [0] * width, [7]) for i, m in enumerate(n)], "id long, n long, sketch array<long>, keys array<long>")
    body = spark.createDataFrame(list(enumerate(bodies)), "id long, body binary")
    got = buckets.linked(classes, lambda ids: body.join(ids, "id"), same, score, parts)
    return {tuple(sorted(x)) for x in got.collect()}


def test_dense_keys_lose_no_lines(spark):
    rng = np.random.default_rng(3)
    bodies = []
    for i in range(300):
        x = np.append(rng.permutation(10), 100 + i * 20 + np.arange(10)).astype(np.uint32)
        y = x.copy()
        y[rng.choice(20, 4, replace=False)] = 9000 + i * 4 + np.arange(4)
        bodies += [x.tobytes(), y.tobytes()]
    got = one_key(spark, bodies, 4, lines.TABLES + lines.PARITIES, lines.alike(0.8), lines.likeness(0.8), lines.numbered(0.8))
    assert got == {(2 * i, 2 * i + 1) for i in range(300)}


def test_dense_keys_lose_no_documents(spark):
    bodies = []
    for i in range(300):
        x = np.append(np.arange(50), 100 + i * 100 + np.arange(50)).astype(np.uint64)
        bodies += [x.tobytes(), np.append(x[:-7], np.uint64(1 << 40)).tobytes()]  # 93 of 101
    got = one_key(spark, bodies, 8, 16, minhash.alike(85, 100), minhash.likeness(0.7, 0.85), minhash.elements(85, 100))
    assert got == {(2 * i, 2 * i + 1) for i in range(300)}


def test_parts_of_similar_lines_meet():
    """Of lines within the edit similarity, the first words in any order, as many as asked for, have one in common."""
    rng = np.random.default_rng(4)
    parts, met = lines.numbered(0.8), 0
    for _ in range(4000):
        x = rng.integers(0, 6, rng.integers(1, 12)).astype(np.uint32)
        y = np.array([*x[: rng.integers(0, len(x) + 1)], *rng.integers(0, 6, rng.integers(0, 3)), *x[rng.integers(0, len(x)) :]][:14], np.uint32)
        if len(y) and lines.alike(0.8)(x.tobytes(), y.tobytes()):
            (p, m), (q, n) = parts(x.tobytes()), parts(y.tobytes())
            assert set(np.sort(p)[:m].tolist()) & set(np.sort(q)[:n].tolist())
            met += 1
    assert met > 100
