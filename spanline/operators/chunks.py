"""Folds over ordered rows of which one key may hold a large part: keys are cut into chunks.

Rows are range-partitioned by key and order, so a long key lies in several
partitions, one chunk in each.  A chunk is first summed up as what it does to every
state it could be entered with; the summaries of the chunks that a partition begins and
ends with, two for each at most, are chained on the driver, and then all chunks are
folded at once, each from the state it is known to be entered with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanline.sources.shared import shared_path


def turns(column: pa.Array) -> list[int]:
    """Where the values of a column change; null is a value."""
    try:
        return pc.run_end_encode(column).run_ends.to_pylist()[:-1]
    except pa.ArrowNotImplementedError:  # nested types
        values = column.to_pylist()
        return [i for i in range(1, len(values)) if values[i] != values[i - 1]]


def pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """(key, whether it begins here, rows) of batches sorted by their first ``width`` columns."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        cuts = [0, *sorted({at for i in range(width) for at in turns(b.column(i))}), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(b.column(i)[lo].as_py() for i in range(width))
            fresh, held = key != held, key
            yield key, fresh, b.slice(lo, hi - lo)


class Chunked:
    """``df`` as a written table of chunks, with what each chunk is entered with.

    ``summary()`` gives an object with ``add(rows)``, for rows of one key in order, and
    ``apply(state)``, the state after them; keys start with ``start``.
    """

    def __init__(self, df: DataFrame, k: list[str], order: list, columns: list[str], summary: Callable, start):
        spark = df.sparkSession
        self.k, self.columns, self.spark = k, columns, spark
        keys, by = [f"_k{i}" for i in range(len(k))], [f"_o{i}" for i in range(len(order))]
        named = [(F.col(c) if isinstance(c, str) else c).alias(b) for c, b in zip([*k, *order], [*keys, *by], strict=True)]
        rows = df.select(*named, *columns)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartitionByRange(n, *keys, *by).sortWithinPartitions(*keys, *by)
        rows = rows.withColumn("_chunk", F.spark_partition_id()).withColumn("_summary", F.lit(None).cast("binary")).withColumn("_end", F.lit(None).cast("boolean"))
        width = len(k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The rows as they are, and then the summaries of the partition's first and last key."""
            first = held = chunk = schema = None

            def watched():
                nonlocal chunk, schema
                for b in batches:
                    schema = b.schema
                    if b.num_rows:
                        chunk = b.column(b.schema.get_field_index("_chunk"))[0].as_py()
                        done.append(pa.RecordBatch.from_arrays(b.columns, names=b.schema.names))  # all nullable, as the summaries
                        yield b

            done: list[pa.RecordBatch] = []
            for key, fresh, part in pieces(watched(), width):
                while done:
                    yield done.pop()
                if fresh:
                    if held is not None and first is None:
                        first = held
                    held = (key, summary())
                held[1].add(part)
            if held is not None:
                ends = [(held, True)] if first is None else [(first, False), (held, True)]
                for (key, s), last in ends:
                    values = dict(zip(keys, key, strict=True)) | {"_chunk": chunk, "_summary": cloudpickle.dumps((key, s)), "_end": last}
                    yield pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], names=schema.names)

        path = shared_path(spark, "chunks")
        kinds = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])  # summaries leave the others null
        rows.mapInArrow(run, kinds).write.parquet(path)
        table = spark.read.schema(kinds).parquet(path)
        self.rows = table.where("_summary IS NULL").drop("_summary", "_end")
        self.by = by
        ends = table.where("_summary IS NOT NULL").select("_chunk", "_summary", "_end").collect()  # two rows a partition at most
        self.entered, self.goes_on = {}, set()
        held, state, before = None, start, None
        for r in sorted(ends, key=lambda r: (r["_chunk"], r["_end"])):
            key, s = cloudpickle.loads(bytes(r["_summary"]))
            if key != held:
                state = start
            elif before is not None and r["_chunk"] != before:
                self.entered[r["_chunk"]] = state
                self.goes_on.add(before)
            state, held, before = s.apply(state), key, r["_chunk"]

    def fold(self, run: Callable, schema: str) -> DataFrame:
        """``run(key, chunk, entered, goes_on, row batches)`` over all keys of all chunks at once, giving record batches.

        ``entered`` is None where a key begins, else the state before its chunk;
        ``goes_on`` tells that the key has more chunks.
        """
        entered, goes_on, width = self.entered, self.goes_on, len(self.k)
        names = [f"_k{i}" for i in range(width)]

        def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Keys here are (chunk, key), so that a partition may hold several chunks."""
            it = pieces(batches, width + 1)
            ahead = next(it, None)
            while ahead is not None:
                (chunk, *key), _, part = ahead
                state = entered.get(chunk) if chunk not in seen else None
                seen.add(chunk)
                group = [part]

                def own():
                    nonlocal ahead
                    yield group.pop()
                    while (ahead := next(it, None)) is not None and not ahead[1]:
                        yield ahead[2]

                # Whether this is the chunk's last key is known once its rows are read.
                last = lambda c=chunk: c in goes_on and (ahead is None or ahead[0][0] != c)
                yield from run(tuple(key), chunk, state, last, own())
                while group or (ahead is not None and not ahead[1]):  # rows that run() left
                    group.clear()
                    ahead = next(it, None)

        seen: set[int] = set()
        rows = self.rows.select("_chunk", *names, *self.columns, *self.by)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(n, "_chunk").sortWithinPartitions("_chunk", *names, *self.by)
        return rows.mapInArrow(folded, schema)
