from __future__ import annotations

from lexmesh.streaming import shards


def write(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n")


def test_epoch_resumes_where_it_stopped(spark, tmp_path):
    source, output, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    write(source, "shard1.txt", ["first line here", "", " a "])
    write(source, "shard2.txt", ["second line here ."])
    for _ in range(2):  # the second run finds nothing new
        shards.run_epoch(shards.clean_stream(shards.stream_shards(spark, str(source))), output, state).awaitTermination()
    assert sorted(r.line for r in spark.read.parquet(output).collect()) == ["first line here", "second line here."]
    write(source, "shard3.txt", ["third line here"])
    shards.run_epoch(shards.clean_stream(shards.stream_shards(spark, str(source))), output, state).awaitTermination()
    assert sorted((r.file, r.line) for r in spark.read.parquet(output).collect()) == [
        ("shard1.txt", "first line here"), ("shard2.txt", "second line here."), ("shard3.txt", "third line here")]

