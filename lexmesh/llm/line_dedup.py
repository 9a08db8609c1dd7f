"""Line dedup with two Bloom filters.

A first pass hashes every line key into a filter of keys seen once and one of keys seen at least twice. Lines
that the second filter lets pass are the only ones that are shuffled: their 128-bit digests are grouped to
confirm the repeat and to find the smallest document that holds it. Nothing else about a line moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.sketch import bits_for, repeated_keys
from lexmesh.llm.storage import written

_TRIM = b" \t\n\x0b\x0c\r"


def _key(line: bytes) -> bytes:
    return line.strip(_TRIM).lower()  # bytes.lower changes A-Z alone


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def _line_hashes(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for text in _texts(batch.column(0)):
                found = {xxhash.xxh3_64_intdigest(k) for k in map(_key, text.split(b"\n")) if _long_enough(k, least)}
                if found:
                    yield np.fromiter(found, np.uint64, len(found))
    return run


def _suspects(least: int, test: Callable[[np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, digests, lines = [], [], [], []
            for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2))):
                keys: dict[bytes, list[int]] = {}
                for i, key in enumerate(map(_key, text.split(b"\n"))):
                    if _long_enough(key, least):
                        keys.setdefault(key, []).append(i)
                if not keys:
                    continue
                passed = test(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
                for ok, (key, at) in zip(passed, keys.items()):
                    if ok:
                        ids.append(doc_id)
                        rows.append(row)
                        digests.append(hashlib.blake2b(key, digest_size=16).digest())
                        lines.append(at)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(digests, pa.binary()), pa.array(lines, pa.list_(pa.int32()))],
                    ["doc_id", "row", "digest", "lines"])
    return run


def _rewrite(keep_text: bool, carried: int):
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256", *["text"] * keep_text, *(f"c{i}" for i in range(carried))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4 + keep_text)]
            for doc_id, text, groups in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), batch.column(2).to_pylist()):
                lines = text.split(b"\n")
                dropped = {i for group in groups or () for i in group}
                kept = b"\n".join(x for i, x in enumerate(lines) if i not in dropped) if dropped else text
                values = [doc_id, len(lines), len(dropped), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")]
                for column, value in zip(out, values):
                    column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(out, [pa.int64()] * 3 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays([*arrays, *(batch.column(3 + i) for i in range(carried))], names)
    return run


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 10, keep_text: bool = True,
                        carry: Sequence[str] = (), expected_lines: int | None = None) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256 and, if asked for, the kept text.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased. A key of at least
    ``least`` code points that occurs in two documents or more loses all its lines but those of the smallest id.
    Null or empty text is one empty line. Rows without an id take part as one document larger than all others;
    rows that repeat an id count as one document when keys are compared, and each row is returned. The columns
    in ``carry`` come back behind the others; further columns are not read, whatever their names. ``expected_lines`` sizes the filters (counted by default); the
    result does not depend on it.
    """
    text = F.col(text_column).cast("string")
    carried = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"), *carried)
    if expected_lines is None:
        # line ends per text: a scan of one column without a shuffle of rows
        ends = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))
        expected_lines = rows.agg(F.sum(ends + 1)).first()[0] or 0
    twice = repeated_keys(rows.select("text"), _line_hashes(least), bits_for(expected_lines), depth=4)
    suspects = rows.select("doc_id", "row", "text").mapInArrow(_suspects(least, twice.reader()), "doc_id long, row long, digest binary, lines array<int>")
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    repeats = suspects.groupBy("digest").agg(F.min(order).alias("first"), F.max(order).alias("last")).filter("first < last")
    repeats = written(repeats, "repeated-lines")  # read again, the join deals out both sides itself and can split a hot line
    later = suspects.join(repeats, "digest").filter(order > F.col("first"))
    drops = later.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("lines").alias("groups"))
    same = (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    placed = rows.join(drops.hint("shuffle_hash"), same, "left")
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * keep_text
    schema += "".join(f", c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    kept = placed.select("doc_id", "text", "groups", *(f"c{i}" for i in range(len(carry)))).mapInArrow(_rewrite(keep_text, len(carry)), schema)
    return kept.withColumnsRenamed({f"c{i}": c for i, c in enumerate(carry)})
