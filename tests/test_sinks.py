"""Documents streamed by project, and calls that a repeated task does not make again."""

import glob
import json
import os
import tempfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanline.operators import infer
from spanline.sources import documents, files


def test_documents(spark):
    path = tempfile.mkdtemp() + "/out"
    rows = spark.range(5000).select((F.col("id") % 7).alias("p"), F.col("id").alias("n"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1, "x"), (None, 0, None)], "p long, n long, v string"))
    for _ in range(2):  # the second time over the first
        documents.write_documents(rows, path, "p", ["n"], "v", "d.txt", "<", "|", ">")
    for p in range(7):
        assert open(f"{path}/p={p}/d.txt").read() == "<" + "|".join(f"é{i}" for i in range(p, 5000, 7)) + ">"
    assert open(f"{path}/p=__HIVE_DEFAULT_PARTITION__/d.txt").read() == "<|x>"
    assert sorted(os.listdir(path)) == sorted([*(f"p={p}" for p in range(7)), "p=__HIVE_DEFAULT_PARTITION__"])
    documents.write_documents(rows.where("p = 3"), path, "p", ["n"], "v", "d.txt")
    assert os.listdir(path) == ["p=3"]


def test_a_project_is_never_held(monkeypatch):
    """However long a project is, what waits to be written stays within the buffer."""
    path = tempfile.mkdtemp()
    options = {"path": path, "name": "_t", "column": "p", "file": "f", "head": "[", "between": ",", "tail": "]"}
    w = documents.DocumentWriter(options, True)
    largest, real = 0, documents.fs.FileSystem.from_uri

    class Watched:
        def __init__(self, store):
            self.store = store

        def __getattr__(self, name):
            return getattr(self.store, name)

        def open_output_stream(self, p):
            out = self.store.open_output_stream(p)

            class Stream:
                def write(self, data):
                    nonlocal largest
                    largest = max(largest, len(data))
                    out.write(data)

                def close(self):
                    out.close()

            return Stream()

    monkeypatch.setattr(documents.fs, "FileSystem", type("FS", (), {"from_uri": staticmethod(lambda p: (Watched(real(p)[0]), real(p)[1]))}))
    message = w.write((("a", "x" * 1000) for _ in range(20_000)))
    assert largest < 2 * documents.BUFFER and glob.glob(f"{path}/_t/*/*")
    w.commit([message, None])
    assert os.path.getsize(f"{path}/p=a/f") == 20_000 * 1001 + 1 and not os.path.exists(f"{path}/_t")


def test_failed_tasks_leave_nothing(spark):
    path = tempfile.mkdtemp() + "/out"
    bad = spark.range(100).select((F.col("id") % 3).alias("p"), F.col("id").alias("n"), F.when(F.col("id") < 99, "v").otherwise(F.raise_error(F.lit("lost"))).alias("v"))
    with pytest.raises(Exception, match="lost"):
        documents.write_documents(bad, path, "p", ["n"], "v", "d.txt")
    assert not os.path.exists(path) or not [f for f in os.listdir(path) if f.startswith("p=")]


def test_cache_document(spark):
    path = tempfile.mkdtemp() + "/cache"
    e = spark.createDataFrame([(f"p{i % 2}", i, str(i), None, i * 1.0, i + 0.5, "speaker_dialogue", "s", f"o{i}", f't"{i}') for i in range(9)], "project string, pos long, segment_id string, raw_id string, time_start double, time_end double, dialogue_type string, speaker string, text_original string, translation_subtitle string")
    files.write_cache(e, path, meta={"video": "v é"})
    doc = json.load(open(f"{path}/project=p0/document.json"))
    assert doc["version"] == 1 and doc["video"] == "v é" and [x["text_original"] for x in doc["entries"]] == [f"o{i}" for i in range(0, 9, 2)]
    back = files.read_cache(spark, f"{path}/*").orderBy("project", "pos").collect()
    assert [r.translation_subtitle for r in back] == [f't"{i}' for i in (0, 2, 4, 6, 8, 1, 3, 5, 7)]


def test_sequential_calls(spark):
    rows = [(k, i, f"{k}{i}") for k in ("a", None, "b") for i in range(25)]
    df = spark.createDataFrame(rows, "k string, i long, t string").selectExpr("i", "t", "k").repartition(5)
    fn = lambda text, before, after: f"{text}<{','.join(r for _, r in before)[-20:]}>{','.join(after)}"
    for n in (0, 1, 3):
        want = {}
        for k in ("a", None, "b"):
            texts, done = [f"{k}{i}" for i in range(25)], []
            for i, t in enumerate(texts):
                done.append((t, fn(t, [list(x) for x in (done[max(0, i - n) : i] if n else [])], texts[i + 1 : i + 1 + n])))
                want[k, i] = done[-1][1]
        out = infer.sequential_infer(df, ["k"], ["i"], fn, "t", n)
        assert out.columns == ["i", "t", "k", "result"] and {(r.k, r.i): r.result for r in out.collect()} == want
    assert infer.sequential_infer(df.limit(0), ["k"], ["i"], fn, "t", 2).count() == 0


def test_a_repeated_task_asks_for_the_rest_only():
    calls, journal = [], tempfile.mkdtemp()
    batches = [pa.RecordBatch.from_pydict({"k": ["a"] * 10, "t": [str(b * 10 + i) for i in range(10)]}) for b in range(5)]

    def fn(text, before, after):
        if text == "33" and calls.count("33") == 0:
            calls.append(text)
            raise ConnectionError
        calls.append(text)
        return text + "!"

    run = lambda: [r for b in infer.sequential_rows(iter(batches), 1, 1, fn, 2, journal, 7) for r in b.column(2).to_pylist()]
    with pytest.raises(ConnectionError):
        run()
    assert len(calls) == 34
    assert run() == [f"{i}!" for i in range(50)]
    assert calls.count("33") == 2 and len(calls) == 51
    assert run() == [f"{i}!" for i in range(50)] and len(calls) == 51
