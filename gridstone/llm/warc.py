"""Deterministic sharded WARC writer and reader.

Pages are cut into shards by ranges of page id (boundaries from a hash sample, so the same rows give the same shards) and
sorted inside them.  Each task writes its shard as gzip members, one per record, and starts a new file once the file has
reached ``roll_bytes`` compressed bytes.  A file is written under a temporary name and renamed when it is closed; names
and bytes depend on the data alone, so a task that runs twice replaces its files by the same files.  The manifest of
finished files is written last, through Spark's committer: readers take the files it names and no others.

Headers and digests are made anew from the payload.  Of records with equal payloads the one with the smallest page id is a
response; the others are revisits that name it and carry no payload.  Which those are is settled on narrow rows (id and
digest), sent to the same shards as marks that sort before the page they belong to: the html moves once.

The folder is one that all executors share (``spark.checkpoint.dir``), reached through ``pyarrow.fs``.

Defined results: null html is the empty payload; a null url gives an empty target; a null page id sorts first and is written
without an id; rows that repeat the smallest id of a payload are all responses; a very long page is one member of its shard,
whole; an empty table gives no files and
an empty manifest; extra columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import partitions, range_bounds
from gridstone.session import shared_path

ROLL_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, shard int, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """One WARC record, uncompressed.  A revisit holds the HTTP header only and points to the response's record."""
    digest = base32(hashlib.sha1(payload).digest())
    head = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~-._")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
        ("X-Page-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page-ID", str(first))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with no name and no time in it."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class RollingFiles:
    """Writes members to ``shard-number`` files, each under a temporary name until it is whole."""

    def __init__(self, root: str, shard: int, roll_bytes: int):
        self.files, self.root = fs.FileSystem.from_uri(root)
        self.shard, self.roll_bytes, self.number, self.out = shard, roll_bytes, 0, None
        self.done: list[tuple] = []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:05d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.root}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha = self.files.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.sha.update(data)
        self.size, self.records = self.size + len(data), self.records + 1
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.move(self.temporary, f"{self.root}/{self.name}")
            self.done.append((self.name, self.shard, self.records, self.size, self.sha.hexdigest()))
            self.out, self.number = None, self.number + 1


def write(pages: DataFrame, roll_bytes: int = ROLL_BYTES, least_duplicate: int = 0) -> str:
    """Write all ``pages`` (page_id, url, html) as archives in a new shared folder; return the folder.

    Payloads under ``least_duplicate`` bytes are always responses.
    """
    spark, shards = pages.sparkSession, partitions(pages.sparkSession)
    root = shared_path(spark, "warc")
    # distinct ids: the sample takes all rows of an id or none, and the rows of a frequent id must not reach the driver
    bounds = range_bounds(pages.select("page_id").where("page_id is not null").distinct(), ["page_id"], shards)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    ids = pages.select(F.col("page_id").cast("long"), F.sha1(payload).alias("digest"), F.length(payload).alias("size"))
    first = ids.where(F.col("size") >= least_duplicate).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    marks = ids.where(F.col("size") >= least_duplicate).join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct()

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series) -> pd.Series:
        return pd.Series([0 if pd.isna(x) else bisect_right(bounds, (int(x),)) for x in page_id.astype(object)], dtype="int32")

    null = F.lit(None)
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), null.cast("string").alias("digest"), null.cast("long").alias("first"), F.lit(1).alias("kind"))
    rows = rows.unionByName(marks.select("page_id", null.cast("string").alias("url"), null.cast("binary").alias("payload"), "digest", "first", F.lit(0).alias("kind")))
    sharded = rows.withColumn("shard", shard_of("page_id")).repartitionById(max(shards, len(bounds) + 1), F.col("shard"))
    ordered = sharded.sortWithinPartitions(F.col("page_id").asc_nulls_first(), "kind", "url", "payload")

    def run(batches):
        out, current, marked = None, None, {}
        for batch in batches:
            for page_id, url, data, digest, of, kind, shard in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first", "kind", "shard")), strict=True):
                out = out or RollingFiles(root, shard, roll_bytes)
                if current is None or current[0] != page_id:
                    current, marked = (page_id,), {}
                if kind == 0:
                    marked[digest] = of
                    continue
                revisited = marked.get(hashlib.sha1(data).hexdigest()) if marked else None
                out.add(member(build_record(page_id, url, data, revisited, revisited is not None)))
        if out:
            out.close()
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out.done, strict=True)], names=["file", "shard", "records", "bytes", "sha256"])

    fs.FileSystem.from_uri(root)[0].create_dir(fs.FileSystem.from_uri(root)[1], recursive=True)
    ordered.mapInArrow(_cast(run, MANIFEST), MANIFEST).write.json(f"{root}/manifest")
    return root


def _cast(run, schema: str):
    """Batches of ``run`` with the types of ``schema``."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    target = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])
    return lambda batches: (pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, target, strict=True)], schema=target) for b in run(batches))


def members(stream, chunk: int = 1 << 20):
    """Uncompressed members of a gzip stream, one at a time."""
    z, parts, pending = zlib.decompressobj(31), [], b""
    while True:
        data = pending or stream.read(chunk)
        if not data:
            break
        parts.append(z.decompress(data))
        pending = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []


def parse_record(data: bytes) -> tuple:
    """A row of RECORD from one uncompressed record; digests are computed anew and must equal the record's."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if base32(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"][5:]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not match")
    page_id = int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None
    digest, kind = fields["WARC-Payload-Digest"][5:], fields["WARC-Type"]
    if kind == "revisit":
        return page_id, fields["WARC-Target-URI"], kind, int(fields["X-Page-Payload-Length"]), digest, int(fields["X-Refers-To-Page-ID"]), None
    payload = block.partition(b"\r\n\r\n")[2]
    if base32(hashlib.sha1(payload).digest()) != digest:
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} does not match")
    return page_id, fields["WARC-Target-URI"], kind, len(payload), digest, None, payload


def read(spark, root: str, payloads: bool = True) -> DataFrame:
    """The records (RECORD) of the files that the manifest of ``root`` names; without ``payloads`` that column is null."""
    listed = spark.read.schema(MANIFEST).json(f"{root}/manifest").select("file")

    def run(batches):
        import pyarrow as pa

        files, base = fs.FileSystem.from_uri(root)
        rows, size = [], 0
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for data in members(stream):
                        row = parse_record(data)
                        rows.append(row if payloads else (*row[:-1], None))
                        size += len(data)
                        if size > 4 << 20 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[str(i) for i in range(7)])
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[str(i) for i in range(7)])

    return listed.repartition(partitions(spark), "file").mapInArrow(_cast(run, RECORD), RECORD)


def manifest(spark, root: str) -> list[dict]:
    """Rows of a (small) manifest, for looking at it; readers use ``read``."""
    return [json.loads(x) for x in spark.read.schema(MANIFEST).json(f"{root}/manifest").toJSON().collect()]
