"""Running a caller's model function over rows, in bounded parallel calls."""

from __future__ import annotations

import hashlib
import itertools
import json
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from spanline.operators.chunks import pieces

OUTCOME = "result string, status string, attempts int, error string, prompt long, completion long, total long, reason string"


@dataclass(frozen=True)
class Policy:
    """Retries: at most max(retries + 1, empty_limit) calls; empty results have a limit of their own.

    A timeout makes the next call's timeout longer by ``timeout_factor``.
    """

    retries: int = 2
    empty_limit: int = 2
    delay: float = 0.0
    timeout: float = 30.0
    timeout_factor: float = 2.0
    threads: int = 4
    name: str = "infer"


def call(fn: Callable, request, policy: Policy) -> tuple:
    """One row's outcome.  ``fn(request, timeout)`` returns a text, or a text and a usage dict."""
    timeout, empty, error, most = policy.timeout, 0, "", max(policy.retries + 1, policy.empty_limit)
    fails = 0
    for attempt in range(1, most + 1):
        try:
            got = fn(request, timeout)
            text, usage = got if isinstance(got, tuple) else (got, {})
            if text and text.strip():
                p, c = (max(0, int(usage.get(n, 0) or 0)) for n in ("prompt", "completion"))
                return text, "ok", attempt, None, p, c, max(0, int(usage.get("total", 0) or 0)) or p + c, None
            empty += 1
            if empty >= policy.empty_limit:
                return None, "empty", attempt, None, 0, 0, 0, f"{policy.name}_empty"
        except Exception as e:  # the function is the caller's: whatever it raises is an outcome
            error = type(e).__name__
            if isinstance(e, TimeoutError):
                timeout *= policy.timeout_factor
            fails += 1
            if fails > policy.retries:
                break
        if policy.delay:
            time.sleep(policy.delay)
    if error:
        return None, "error", attempt, error, 0, 0, 0, f"{policy.name}_error:{error}"
    return None, "empty", attempt, None, 0, 0, 0, f"{policy.name}_empty"


#: Rows whose calls are made, and whose outcomes are held, at once.
CALLS = 256


def batch_infer(df: DataFrame, fn: Callable, request: str, policy: Policy | None = None, partitions: int | None = None) -> DataFrame:
    """Adds (or replaces) the outcome of fn(row's request): OUTCOME's columns; result is null on failure.

    ``partitions`` times the policy's threads bounds the calls at once.  Rows may be
    run again after a lost task, so write the result before using it twice.
    """
    policy = policy or Policy()
    src = df.repartition(partitions) if partitions else df
    outcome = StructType.fromDDL(OUTCOME)
    names = outcome.names
    src = src.drop(*names)
    schema = StructType([*src.schema.fields, *outcome.fields])
    kinds = [pa.string() if isinstance(f.dataType, StringType) else pa.int32() if f.dataType.typeName() == "integer" else pa.int64() for f in outcome.fields]

    at = src.columns.index(request)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(policy.threads) as pool:
            for batch in batches:
                for start in range(0, batch.num_rows, CALLS):
                    part = batch.slice(start, CALLS)
                    got = list(pool.map(lambda r: call(fn, r, policy), part.column(at).to_pylist()))
                    new = [pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)

    return src.mapInArrow(run, schema)


class Journal:
    """Results of calls by what was asked, in small files of the shared folder, so that a repeated task doesn't ask again."""

    def __init__(self, path: str, key: tuple, every: int):
        self.store, base = fs.FileSystem.from_uri(path)
        self.folder = f"{base}/{hashlib.sha256(repr(key).encode()).hexdigest()}"
        self.every, self.new, self.known = every, {}, {}
        if self.store.get_file_info(self.folder).type == fs.FileType.Directory:
            for f in self.store.get_file_info(fs.FileSelector(self.folder)):
                with self.store.open_input_stream(f.path) as file:
                    try:
                        self.known |= json.loads(file.read())
                    except ValueError:  # cut short by a lost executor
                        continue

    def call(self, fn: Callable, text, before: list, after: list):
        asked = hashlib.sha256(json.dumps([text, before, after]).encode()).hexdigest()
        if asked not in self.known:
            self.known[asked] = self.new[asked] = fn(text, before, after)
            if len(self.new) >= self.every:
                self.flush()
        return self.known[asked]

    def flush(self) -> None:
        if self.new:
            self.store.create_dir(self.folder)
            with self.store.open_output_stream(f"{self.folder}/{uuid.uuid4().hex}") as file:
                file.write(json.dumps(self.new).encode())
            self.new = {}


def sequential_infer(df: DataFrame, k: list[str], order: list[str], fn: Callable, text: str, n: int, out: str = "result", journal: str | None = None, every: int = 20) -> DataFrame:
    """Strictly ordered calls within a key: fn(text, before, after) sees the n results before and the n texts after.

    ``before`` is a list of [text, result].  Keys run in parallel; a key's sorted rows
    stream through one task, which holds as many as it looks ahead.  With a
    ``journal`` (a folder that executors share) results are kept there by what was
    asked, ``every`` few, and read again when a task is repeated; it must not outlive
    a change of ``fn``.
    """
    df = df.drop(out)
    columns = [*k, *(c for c in df.columns if c not in k)]
    schema = StructType([*(df.schema[c] for c in columns), StructField(out, StringType())])
    rows = df.select(*columns).repartition(*k).sortWithinPartitions(*k, *order)
    found = rows.mapInArrow(lambda it: sequential_rows(it, len(k), columns.index(text), fn, n, journal, every), schema)
    return found.select(*df.columns, out)


def sequential_rows(batches: Iterator[pa.RecordBatch], width: int, text: int, fn: Callable, n: int, journal: str | None, every: int) -> Iterator[pa.RecordBatch]:
    held: deque[tuple[pa.RecordBatch, list]] = deque()  # rows whose results aren't all known
    ahead: deque = deque()
    before: deque = deque(maxlen=max(0, n))
    log: Journal | None = None

    def step() -> None:
        t = ahead.popleft()
        args = (t, [list(x) for x in before], list(itertools.islice(ahead, n)))
        result = log.call(fn, *args) if log else fn(*args)
        before.append((t, result))
        next(h for h in held if len(h[1]) < h[0].num_rows)[1].append(result)

    def done() -> Iterator[pa.RecordBatch]:
        while held and len(held[0][1]) == held[0][0].num_rows:
            b, results = held.popleft()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(results, pa.string())], names=[*b.schema.names, "_result"])

    try:
        for key, fresh, part in pieces(batches, width):
            if fresh:
                while ahead:
                    step()
                yield from done()
                before.clear()
                if log:
                    log.flush()
                log = Journal(journal, key, every) if journal else None
            held.append((part, []))
            ahead.extend(part.column(text).to_pylist())
            while len(ahead) > n:
                step()
            yield from done()
        while ahead:
            step()
        yield from done()
    finally:
        if log:
            log.flush()
