"""Large labels of vectors: the work follows their size, and parting them changes no result."""

import numpy as np
import pytest

from spanline.llm import embeddings


def made(n, dense, seed=0):
    """Random vectors, near pairs at all angles about the threshold, and a group of near copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    x[: n // 4] = x[n // 4 : 2 * (n // 4)] + rng.normal(size=(n // 4, 64)) * rng.choice([0.1, 0.3, 0.39, 0.45], n // 4)[:, None]
    x[-dense:] = x[-1] + rng.normal(size=(dense, 64)) * 0.1
    return x.astype(np.float32)


def expected(x, label):
    """n_links and component_id of each row, by brute force."""
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links, root = np.zeros(len(x), np.int64), np.arange(len(x))
    pairs = [np.argwhere(np.triu((u[lo : lo + 1000] @ u.T >= 0.93) & (label[lo : lo + 1000, None] == label), lo + 1)) + [lo, 0] for lo in range(0, len(x), 1000)]
    a, b = np.concatenate(pairs).T
    for z in (a, b):
        np.add.at(links, z, 1)
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
    return links, root


def found(spark, x, label):
    rows = spark.createDataFrame([(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.groups(rows).collect()}
    return np.array([got[i].n_links for i in range(len(x))]), np.array([got[i].component_id for i in range(len(x))])


def shuffled(spark):
    """Rows that the session's stages have shuffled so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_rows_shuffled_follow_the_vectors(spark):
    """a label of more than 2 ** 13 vectors sent hundreds of rows for each, which at 6 GB no time sufficed for."""
    x, label = made(8500, 60), np.zeros(8500, np.int64)
    before, most = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where tables are large
    try:
        links, component = found(spark, x, label)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    sent = sum(n for k, n in shuffled(spark).items() if k not in before)
    want, root = expected(x, label)
    assert (links <= want).all() and links.sum() >= 0.999 * want.sum() and (component == root).mean() >= 0.999
    assert 0 < sent <= 20 * len(x)


@pytest.mark.parametrize("held", [1 << 22, 64 * 30])
def test_parted_labels_give_the_same(spark, monkeypatch, held):
    """Labels dealt by narrow tables, and cells dealt as pairs of blocks, of codes and of vectors."""
    x, label = made(1200, 300, 1), np.arange(1200) % 2
    monkeypatch.setattr(embeddings, "CELL", 40)
    monkeypatch.setattr(embeddings, "SMALL", 30)
    monkeypatch.setattr(embeddings, "HELD", held)
    links, component = found(spark, x, label)
    want, root = expected(x, label)
    assert (links <= want).all() and links.sum() >= 0.999 * want.sum() and (component == root).mean() >= 0.998


@pytest.mark.parametrize("small, tried", [(4000, 4000), (8, 4000), (8, 16)])
def test_pairs_meet_once(monkeypatch, small, tried):
    """All pairs of many cells, of one cell, or those of its tables: each near pair once, none across cells."""
    x = made(3000, 200, 2).astype(float)
    place = np.sort(np.arange(3000) % 3 == 0).astype(np.int64)
    own = embeddings.Codes(x, 0.93, 3000)
    monkeypatch.setattr(embeddings, "SMALL", small)
    monkeypatch.setattr(embeddings, "TRIED", tried)
    monkeypatch.setattr(embeddings, "RETRIED", tried)
    zero, codes = np.zeros(3000, np.int32), own(x)
    pairs = np.concatenate([np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1) for a, b in embeddings.meeting(own, place, zero, zero, codes)])
    assert len(np.unique(pairs, axis=0)) == len(pairs) and (place[pairs[:, 0]] == place[pairs[:, 1]]).all()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argwhere(np.triu((u @ u.T >= 0.93) & (place[:, None] == place), 1))
    met = {tuple(p) for p in pairs.tolist()}
    assert sum(tuple(p) in met for p in near.tolist()) >= 0.999 * len(near)
    marked = np.zeros(3000, bool)
    for a, b in embeddings.meeting(own, place, zero, zero, codes, marked):
        marked[a] = marked[b] = True
    assert marked[pairs.ravel()].all()


def test_tables_meet_at_the_threshold():
    """Labels of every size, and vectors that all lie close together."""
    rng = np.random.default_rng(3)
    for spread, sizes in ((1.0, [50, 5000, 60_000, 1_500_000]), (0.3, [5000])):
        x = rng.normal(size=64) * (spread < 1) + spread * rng.normal(size=(5000, 64))
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        turn = rng.normal(size=u.shape)
        turn -= (turn * u).sum(axis=1, keepdims=True) * u
        y = 0.93 * u + np.sqrt(1 - 0.93**2) * turn / np.linalg.norm(turn, axis=1, keepdims=True)
        for n in sizes:
            own = embeddings.Codes(x, 0.93, n)
            diff = own(x) ^ own(y)
            met = [np.any([diff[:, r] & mask == 0 for r, mask in tables], axis=0) for tables in (own.cells, own.tables)]
            bits = np.bitwise_count(diff)
            assert (met[0] & met[1] & (bits[:, 0] <= own.limits[0]) & (bits.sum(axis=1) <= own.limits[1])).mean() >= 0.998
