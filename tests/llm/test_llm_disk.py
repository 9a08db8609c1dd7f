"""What the tables in between leave on disk."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa

from lexmesh.llm import sketch
from lexmesh.llm.storage import written


def _shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def _gone(spark, before: int) -> bool:
    for _ in range(50):
        if _shuffle_files(spark) <= before:
            return True
        time.sleep(0.1)
    return False


def test_written_leaves_no_shuffle_files(spark):
    """what was shuffled for a table stayed until the driver collected its garbage."""
    before = _shuffle_files(spark)
    table = written(spark.range(1000).repartition(3, "id").groupBy("id").count(), "numbers")
    assert _gone(spark, before) and table.count() == 1000
    before = _shuffle_files(spark)
    sketch.repeated_keys(spark.range(10), lambda batches: (b.column(0).to_numpy().view(np.uint64) for b in batches), 16, 1)
    assert _gone(spark, before)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_keys_seen_once_do_not_fill_the_filter(spark, monkeypatch):
    """with 16 keys a bit, keys of one set alone passed as shared."""
    monkeypatch.setattr(sketch, "_LARGEST_SEGMENT", 14)  # several segments in a task
    keys = np.arange(1 << 20, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    twice = keys[::1 << 10]
    frame = spark.range(0, 4, 1, 4).withColumnRenamed("id", "part")

    def contributions(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                yield keys[part::4]
                if part == 1:
                    yield twice

    def passed(fine):
        test = sketch.repeated_keys(frame, contributions, 16, 1, fine).reader()
        assert test(twice).all()
        return test(keys).mean()

    assert passed(0) > 0.99 and passed(sketch.fine_bits(len(keys))) < 0.6
    assert sketch.fine_bits(1 << 31) == 35 and sketch.fine_bits(0) == 16


def test_fine_counters_give_one_bit_for_several():
    rows = [pa.RecordBatch.from_pydict({"segment": pa.array([s, s], pa.int32()), "level": pa.array([1, level], pa.int32()), "payload": [sketch._pack(np.array([3, 9])), sketch._pack(np.array([9]))]}) for s, level in ((0, 1), (5, 2))]
    found = {r["segment"][0].as_py(): np.unpackbits(np.frombuffer(sketch.zlib.decompress(r["payload"][0].as_py()), np.uint8)).tolist() for r in sketch._merge(64, 8)(iter(rows))}
    assert found == {0: [0, 1, 0, 0, 0, 0, 0, 0], 5: [0, 1, 0, 0, 0, 0, 0, 0]}
