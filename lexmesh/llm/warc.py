"""Deterministic sharded WARC archives: written by range, rolled by compressed size, committed by a manifest.

Rows are ordered by key and hash of their payload, and this order is cut into shards where the exact running sum of payload bytes
passes a multiple of the shard size: the layout depends on the rows alone, not on sampling, partitioning or how the keys are
spread, and no key, outlier or lack of keys makes a shard larger. A task writes the shards it holds in key order, one gzip member per record, into files with temporary names, and rolls to the next file of the shard once the compressed size is
reached. What it reports are manifest rows; only the attempts whose reports arrive are renamed into place, and readers
follow the manifest, so files of lost attempts are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmesh.llm.storage import written
from lexmesh.session import cut_lineage

_MOST_SHARDS = 1 << 14
_LEAST_SHARDS = 64
_RECORD_HEAD = 400
MANIFEST = "temporary string, name string, records long, bytes long, sha256 string, first_key long, last_key long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _payload(value) -> bytes:
    return value.as_py() or b""


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; its identifier follows from key, address and digest, so a rewrite gives the same bytes."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}\n{url}\n{digest}")
    address = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    block = b"" if refers_to is not None else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>",
            f"WARC-Target-URI: {address}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Block-Digest: sha1:{payload_digest(block)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}",
            f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}", f"X-Has-Target: {int(url is not None)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _open(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    if folder.startswith("file:") or "://" not in folder:
        return arrow_fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(folder)


class _Roller:
    """The open file of one shard."""

    def __init__(self, folder: str, limit: int):
        self.files, self.root = _open(folder)
        self.attempt, self.limit, self.stream = uuid.uuid4().hex, limit, None

    def add(self, shard: int, key, member: bytes) -> Iterator[tuple]:
        if self.stream is not None and (shard != self.shard or self.size + len(member) > self.limit):
            yield self.close()
        if self.stream is None:
            self.number = self.number + 1 if getattr(self, "shard", None) == shard else 0
            self.shard, self.size, self.count, self.first, self.sum = shard, 0, 0, key, hashlib.sha256()
            self.temporary = f"_temporary/{self.attempt}-{shard:06d}-{self.number:05d}"
            path = posixpath.join(self.root, self.temporary)
            self.files.create_dir(posixpath.dirname(path), recursive=True)
            self.stream = self.files.open_output_stream(path, compression=None)
        self.stream.write(member)
        self.sum.update(member)
        self.size, self.count, self.last = self.size + len(member), self.count + 1, key

    def close(self) -> tuple:
        self.stream.close()
        self.stream = None
        return self.temporary, f"shard-{self.shard:06d}-{self.number:05d}.warc.gz", self.count, self.size, self.sum.hexdigest(), self.first, self.last


def _write(folder: str, limit: int):
    names = [x.split()[0] for x in MANIFEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, done = _Roller(folder, limit), []
        key, revisits = object(), {}
        for batch in batches:
            for shard, page_id, digest, refers_to, url, value in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5).cast(pa.large_binary())):
                if page_id != key:
                    key, revisits = page_id, {}
                if digest is not None:  # says that the page of this id and SHA-1 is a revisit; sorted before the page
                    revisits[digest] = refers_to
                    continue
                payload = _payload(value)
                own = payload_digest(payload)
                member = gzip.compress(_record(page_id, url, payload, own, revisits.get(hashlib.sha1(payload).hexdigest())), 6, mtime=0)
                done += roller.add(shard, page_id, member)
        if roller.stream is not None:
            done.append(roller.close())
        if done:
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in done], pa.int64() if n in ("records", "bytes", "first_key", "last_key") else pa.string()) for i, n in enumerate(names)})

    return run


def _cuts_of(before: dict[int, int], shard_bytes: int):
    """The rows of each partition at which a shard begins; ``before`` is the bytes of all earlier partitions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = before.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            ends = done + np.cumsum(batch.column("size").to_numpy())
            starts = np.concatenate([[done], ends[:-1]])
            # a row opens a shard if a multiple of the shard size lies within its bytes
            opens = np.flatnonzero(-(-starts // shard_bytes) * shard_bytes < ends)
            done = int(ends[-1]) if len(ends) else done
            yield batch.select(["page_id", "spread"]).take(pa.array(opens))
    return run


def _cuts(sizes: DataFrame, shard_bytes: int) -> list[tuple]:
    """(key, payload hash) at which each shard but the first begins: ``_MOST_SHARDS`` + 1 at most, whatever the rows.

    Only keys, hashes and byte counts are sorted, rows of equal key and payload as one.
    """
    units = sizes.groupBy("page_id", "spread").agg(F.sum(F.col("size") + _RECORD_HEAD).alias("size"))
    placed = cut_lineage(units.orderBy(F.col("page_id").asc_nulls_first(), "spread"))
    totals = sorted(placed.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("size").alias("size")).collect())  # one row per partition
    before, whole = {}, 0
    for row in totals:
        before[row["part"]] = whole
        whole += row["size"]
    shard_bytes = max(min(shard_bytes, whole // _LEAST_SHARDS + 1), whole // _MOST_SHARDS + 1)
    rows = placed.mapInArrow(_cuts_of(before, shard_bytes), "page_id long, spread long").collect()
    order = lambda r: (r["page_id"] is not None, r["page_id"] or 0, r["spread"])
    return [(r["page_id"], r["spread"]) for r in sorted(rows, key=order)][1:]


def _shard(cuts: list[tuple]) -> Column:
    """How many of the sorted ``cuts`` are not above (page_id, spread), by binary search; no key is first of all."""
    if not cuts:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps([{"page_id": k, "spread": h} for k, h in cuts])), "array<struct<page_id:bigint,spread:bigint>>")
    own = F.struct("page_id", "spread")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= own, at + step).otherwise(at))


def write_archives(pages: DataFrame, folder: str, file_bytes: int = 256 << 20, shard_bytes: int = 256 << 20) -> DataFrame:
    """Write a record per (page_id, url, html) row into ``folder`` and return the manifest that was committed.

    Of records with equal payloads that with the largest page_id is a response and the others are revisits of it;
    rows that repeat this id with the same payload are all responses. Rows without an id come first; they are
    revisits if a row with an id has their payload, responses otherwise. Null html is an empty payload, null
    addresses come back as null. Ids may lie anywhere in the range of 64 bits. Extra columns are ignored. An empty table gives an empty manifest.
    ``file_bytes`` rolls files by compressed size (a single larger record has a file of its own);
    a shard holds about ``shard_bytes`` of payload, or a 64th of all payload if that is less, or a 16,384th if that is more. Only rows that repeat both
    id and payload, and a single larger record, exceed this; they are streamed to files of ``file_bytes`` like others.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    digest = F.sha1(F.coalesce("html", F.lit("")))
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    sizes = written(rows.select("page_id", digest.alias("digest"), size.alias("size")).withColumn("spread", F.xxhash64("digest")), "warc-digests")
    # max per payload is combined in every task first, so a payload of a third of all pages is one row a task
    last = written(sizes.groupBy("digest").agg(F.max("page_id").alias("refers_to")), "warc-last")
    revisits = sizes.join(last, "digest").filter(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    marks = revisits.select("page_id", "digest", "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")).distinct()
    plain = rows.select("page_id", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"), "url", "html", F.xxhash64(digest).alias("spread"))
    both = plain.unionByName(marks.withColumn("spread", F.xxhash64("digest")))
    cuts = _cuts(sizes, shard_bytes)
    placed = both.withColumn("shard", _shard(cuts)).repartition(len(cuts) + 1, "shard").sortWithinPartitions(
        "shard", "page_id", "spread", F.col("digest").isNull(), "url", F.xxhash64("html"))
    manifest = written(placed.select("shard", "page_id", "digest", "refers_to", "url", "html").mapInArrow(_write(folder, file_bytes), MANIFEST), "warc-manifest")
    return _commit(spark, manifest, folder)


def _commit(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Rename what the manifest lists, then publish the manifest: readers see all of it or none."""
    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        for batch in batches:
            for temporary, name in zip(batch["temporary"].to_pylist(), batch["name"].to_pylist()):
                source, target = posixpath.join(root, temporary), posixpath.join(root, name)
                if files.get_file_info(source).type != arrow_fs.FileType.NotFound:  # a second attempt finds it done
                    files.move(source, target)
            yield batch

    manifest.mapInArrow(rename, MANIFEST).write.mode("overwrite").parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def _members(stream) -> Iterator[bytes]:
    """The records of a file, one gzip member at a time."""
    engine, parts = zlib.decompressobj(31), []
    while chunk := stream.read(1 << 20):
        while chunk:
            parts.append(engine.decompress(chunk))
            chunk = engine.unused_data
            if engine.eof:
                yield b"".join(parts)
                engine, parts = zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("the archive ends inside a record")


def _parse(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{payload_digest(block)}":
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    kind = fields["WARC-Type"]
    number = lambda name: int(fields[name]) if fields.get(name) else None
    url = fields["WARC-Target-URI"] if fields["X-Has-Target"] == "1" else None
    return (number("X-Page-Id"), url, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), kind,
            number("X-Refers-To-Page-Id"), block.decode() if kind == "response" else None)


def read_archives(spark: SparkSession, folder: str, with_html: bool = False) -> DataFrame:
    """The records of all files the manifest lists; block digests are checked. Revisits have null html."""
    wanted = RECORD if with_html else RECORD.rpartition(",")[0]
    names = [x.split()[0] for x in wanted.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in wanted.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

        for batch in batches:
            for name in batch["name"].to_pylist():
                rows, held = [], 0
                with files.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                    for record in _members(stream):
                        rows.append(_parse(record))
                        held += len(record) if with_html else 200
                        if held >= 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    # a row is a file: spread the names, not their contents
    parts = max(1, spark.sparkContext.defaultParallelism * 4)
    return manifest.select("name").repartition(parts, "name").mapInArrow(run, wanted)
