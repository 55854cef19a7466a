"""Deterministic sharded WARC writer and reader.

Records are range-sorted by key, between bounds from the keys of smallest hash; each
task streams its range into gzip members, rolls files by compressed size, and
writes them under temporary names.  The files of the tasks that succeeded are then
renamed, in tasks again, and listed in a manifest that Spark commits last; whatever a
lost or repeated attempt left behind is never read, and is swept away.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from spanline.llm.common import cut, hot_keys, hub_join

#: Names of this namespace are record ids: the same page gets the same id in every run.
NAMESPACE = uuid.UUID("6f1d3c52-8f0e-5b6e-9a3d-0c1d5b7a2e44")
#: Every record has the same date, a parameter of the collection, so that reruns give the same bytes.
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
#: Folders below the archive's: files that aren't committed, and the rows of the manifest.
TEMPORARY, MANIFEST = "_temporary_files", "manifest"
#: Keys drawn for each shard to set the bounds between shards.
DRAWN = 100
MANIFEST_ROW = "name string, temporary string, records long, bytes long, sha256 string, first_key string, last_key string"


def filesystem(uri: str):
    """(pyarrow file system, path) for a folder of the cluster's shared store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, key)}>"


def record(key: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC record, headers and digests generated anew; a revisit carries no payload."""
    http = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", record_id(key)),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join((url or "").split()) or "urn:none"),
        ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Key", json.dumps(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("X-Record-Key", json.dumps(key)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class Roller:
    """Writes members to files of about ``roll_bytes`` compressed bytes under temporary names."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, level: int):
        self.fs, self.path = filesystem(folder)
        self.shard, self.roll, self.level = shard, roll_bytes, level
        self.part, self.out, self.done = 0, None, []

    def add(self, key: str, data: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.temporary = f"{TEMPORARY}/{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(f"{self.path}/{self.temporary}", compression=None)
            self.sha, self.bytes, self.records, self.first = hashlib.sha256(), 0, 0, key
        member = gzip.compress(data, self.level, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1
        self.last = key
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.temporary, self.records, self.bytes, self.sha.hexdigest(), self.first, self.last))
            self.part, self.out = self.part + 1, None


def first_copies(pages: DataFrame, key: str, payload: str, least: int) -> DataFrame:
    """(_key, _digest, _ref) of the records that revisit another: equal payloads of ``least`` bytes or more.

    Only digests move; copies meet in one row per digest, summed up before the
    exchange, and a payload of very many copies is joined where they are.
    """
    body = F.coalesce(F.encode(F.col(payload), "utf-8"), F.lit(b""))
    seen = pages.select(F.col(key).alias("_key"), F.sha2(body, 256).alias("_digest"), F.length(body).alias("_n")).where(F.col("_n") >= least)
    firsts = seen.groupBy("_digest").agg(F.min("_key").alias("_first"), F.count("*").alias("_copies")).where("_copies > 1")
    firsts = cut(firsts, "firsts")
    out = hub_join(seen, firsts.select("_digest", "_first"), "_digest", hot_keys(firsts, ["_digest"], "_copies"))
    return out.where("_key <> _first").select("_key", "_digest", F.col("_first").alias("_ref"))


def bounds_of(pages: DataFrame, key: str, n: int) -> list:
    """Keys that part the rows into ``n`` ranges: quantiles of about DRAWN * n keys, those of the smallest hashes.

    Which keys are drawn depends on the keys alone, so reruns give the same ranges.
    """
    total = pages.count()
    share = min(1.0, DRAWN * n / max(1, total))
    low = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 40)) < int(share * (1 << 40))
    drawn = [r[0] for r in pages.where(F.col(key).isNotNull() & low).select(F.col(key)).distinct().orderBy(key).collect()]
    return sorted({drawn[i * len(drawn) // n] for i in range(1, n)}) if drawn else []


def write(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
    least: int = 100, roll_bytes: int = 64 << 20, level: int = 6, shards: int | None = None, date: str = DATE,
) -> DataFrame:
    """Write one record per row of ``pages`` below ``folder`` and commit; returns the manifest, a row per file.

    Rows are range-sorted by key (ties: url, then payload); equal input and
    ``shards`` give equal files.  Of records with equal payloads of at least
    ``least`` bytes the one with the smallest key is the response and the others
    revisit it; of rows that also share that key all are responses.  Rows of one
    key and other payloads are judged each by its own.  Null payloads are empty,
    null urls ``urn:none``; a null key sorts first and is written as the empty key,
    always as a response.  An empty table gives no files and an empty manifest.
    Extra columns are ignored.
    """
    spark = pages.sparkSession
    kind = pages.schema[key].dataType
    rows = pages.select(F.col(key).alias("_key"), F.lit(None).cast(kind).alias("_ref"), F.lit(1).alias("_kind"), F.col(url).cast("string").alias("_url"), F.col(payload).cast("string").alias("_body"))
    marks = first_copies(pages, key, payload, least).distinct().select("_key", "_ref", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("_url"), F.col("_digest").alias("_body"))
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = spark.sparkContext.broadcast(bounds_of(pages, key, n))

    def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [0 if k is None else bisect.bisect_right(bounds.value, k) for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=[*b.schema.names, "_shard"])

    both = rows.unionByName(marks)
    both = both.mapInArrow(shard_rows, StructType([*both.schema.fields, StructField("_shard", IntegerType())]))
    # The marks of a key sort before its records, so that one exchange both sorts and joins them.
    ordered = both.repartitionById(n, "_shard").sortWithinPartitions("_key", "_kind", "_url", "_body")
    ordered = ordered.select(F.col("_key").cast("string"), F.col("_ref").cast("string"), "_kind", "_url", "_body", "_shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, marked = None, None, {}
        for b in batches:
            for k, ref, kind, link, body, shard in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out = Roller(folder, shard, roll_bytes, level)
                if k != held:
                    held, marked = k, {}
                if kind == 0:
                    marked[body] = ref
                    continue
                data = (body or "").encode("utf-8", "surrogatepass")
                same = marked.get(hashlib.sha256(data).hexdigest()) if marked else None
                out.add("" if k is None else k, record("" if k is None else k, link, data, same, date))
        if out is not None:
            out.close()
            cols = list(zip(*out.done, strict=True))
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["name", "temporary", "records", "bytes", "sha256", "first_key", "last_key"])

    fs, path = filesystem(folder)
    fs.create_dir(f"{path}/{TEMPORARY}", recursive=True)
    files = cut(ordered.mapInArrow(run, MANIFEST_ROW), "files")

    def move_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, root = filesystem(folder)
        for b in batches:
            for old, new in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True):
                if own.get_file_info(f"{root}/{old}").is_file:  # an attempt before this one may have moved it
                    own.move(f"{root}/{old}", f"{root}/{new}")
            yield b.drop_columns(["temporary"])

    moved = files.mapInArrow(move_rows, MANIFEST_ROW.replace("temporary string, ", ""))
    moved.write.json(f"{folder}/{MANIFEST}")
    fs.delete_dir(f"{path}/{TEMPORARY}")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, records, bytes, sha256, first_key, last_key) of the files of a committed archive."""
    return spark.read.schema(MANIFEST_ROW.replace("temporary string, ", "")).json(f"{folder}/{MANIFEST}")


RECORD = "key string, record_type string, url string, refers_to string, payload_bytes long, payload_digest string, payload binary, intact boolean"


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    d, out = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            out.append(d.decompress(data))
            data = b""
            if d.eof:
                yield b"".join(out)
                data, d, out = d.unused_data, zlib.decompressobj(31), []
    if any(out):
        raise EOFError("the archive ends within a record")


def parse(data: bytes) -> dict:
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = block[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    intact = lines[0] == "WARC/1.1" and "sha256:" + hashlib.sha256(block).hexdigest() == h["WARC-Block-Digest"]
    if h["WARC-Type"] == "response":
        intact = intact and size == len(payload) and "sha256:" + hashlib.sha256(payload).hexdigest() == h["WARC-Payload-Digest"]
    return {
        "key": json.loads(h["X-Record-Key"]), "record_type": h["WARC-Type"], "url": h["WARC-Target-URI"],
        "refers_to": json.loads(h["X-Refers-To-Key"]) if "X-Refers-To-Key" in h else None,
        "payload_bytes": size, "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha256:"), "payload": payload, "intact": intact,
    }


def read(spark: SparkSession, folder: str, payloads: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """The records of all files that the manifest names, each file streamed by one task.

    ``payload_bytes`` and ``payload_digest`` are of the full payload, for revisits
    as their headers state; ``intact`` says whether all digests hold.
    """
    files = manifest(spark, folder).select("name").repartition("name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("intact", pa.bool_())])
        own, root = filesystem(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with own.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        rows.append(parse(data))
                        if not payloads:
                            rows[-1]["payload"] = None
                        held += len(data)
                        if held >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, RECORD)
