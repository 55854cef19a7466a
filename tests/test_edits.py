"""Edit logs against lists that are walked."""

import random
import time

from spanline.operators import edits as ed


class Walked:
    """The same interface as Rows, over one list."""

    def __init__(self, rows):
        self.blocks = [rows]

    def __iter__(self):
        return iter(self.blocks[0])

    def settle(self, b):
        pass

    def find(self, ident):
        return next(((0, i) for i, r in enumerate(self.blocks[0]) if r["id"] == ident), None)

    def after(self, b, j):
        return (0, j + 1) if j + 1 < len(self.blocks[0]) else None

    def shift(self, b, j, by):
        for r in self.blocks[0][j:]:
            if r["id"] is not None and r["id"] > 0 and r["id"] + by > 0:
                r["id"] += by

    def insert(self, b, j, row):
        self.blocks[0].insert(j, row)

    def pop(self, b, j):
        return self.blocks[0].pop(j)


def entry(ident, i):
    return {"id": ident, "raw_id": str(i), "start": i * 2.0, "end": i * 2.0 + 1, "kind": "speaker_dialogue", "speaker": "s", "original": f"o{i}", "translation": f"t{i}", "review_reason": [], "style": None, "restyle": False}


def edit(rng, top):
    op = rng.choice(["insert_before", "insert_after", "delete", "delete", "merge", "set", "nothing"])
    ident = rng.choice([None, 0, -3, 1, rng.randint(1, top)])
    return {"op": op, "anchor_id": ident, "start": rng.choice([None, 3.0]), "end": rng.choice([None, 9.0, 1.0]), "kind": None, "speaker": None, "original": "x", "translation": None, "choices": rng.choice([None, "original=other"])}


def test_random_logs():
    rng = random.Random(0)
    for n in (0, 1, 5, 300, 2000):
        for renumber in (False, True):
            ids = [rng.choice([None, 0, -3, i, i, i, i, rng.randint(1, n + 1)]) for i in range(n)]
            a, b = (ed.Project([entry(x, i) for i, x in enumerate(ids)], renumber=renumber) for _ in range(2))
            b.rows = Walked([entry(x, i) for i, x in enumerate(ids)])
            for _ in range(400):
                e = edit(rng, n + 5)
                a.apply(e)
                b.apply(e)
            assert list(a.rows) == list(b.rows)


def test_many_edits_take_seconds():
    rng = random.Random(1)
    n = 100_000
    p = ed.Project([entry(i + 1, i) for i in range(n)])
    log = [edit(rng, n) | {"anchor_id": rng.randint(1, n)} for _ in range(20_000)]
    since = time.perf_counter()
    for e in log:
        p.apply(e)
    assert time.perf_counter() - since < 20  # walking takes a quarter of an hour
    ids = [r["id"] for r in p.rows]
    assert len(ids) > 50_000
