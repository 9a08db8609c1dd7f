"""File formats with the quirks of their readers, from hand-written fixtures."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lexmesh.functions.sections import number_sections
from lexmesh.operators import scripts, split, tagged
from lexmesh.sinks import writers
from lexmesh.sources import corpus, scripts as script_tables, tagged as readers


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_records_are_numbered_across_file_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("only\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = corpus.read_records(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("file", "/"), -1))
        got = rows(found, "file", "record_no")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [("a.txt", i + 1, line) for i, line in enumerate(lines)] + [("b.txt", 1, "only")]


def test_scan_lines_strips_unicode_space_and_drops_blanks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  one 　\n\n \t \ntwo\x1f\n", encoding="utf-8")
    found = corpus.scan_lines(spark, str(tmp_path / "a.txt")).select("line_no", "line")
    assert rows(found, "line_no") == [(1, "one"), (4, "two")]


def test_language_files(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.txt").write_text(f"{name}1\n{name}2\n")
    files = {"et": [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], "ru": [str(tmp_path / "c.txt")]}
    found = corpus.scan_language_files(spark, files).select("lang", "line")
    assert rows(found, "lang", "line") == [("et", "a1"), ("et", "a2"), ("et", "b1"), ("et", "b2"), ("ru", "c1"), ("ru", "c2")]


CONLLU = """# sent_id = 1
# text = Mon kal
1-2\tMonkal\t_\t_\t_\t_\t_\t_\t_\t_
1\tMon\t_\tPRON\t_\t_\t2\tx\t_\t_
2\tkal\t_\t_\t_\t_\t0\tx\t_\t_
2.1\tnull\t_\tVERB\t_\t_\t_\t_\t_\t_


# text =  Vot
1\tVot\t_\tX\t_\t_\t0\tx\t_\t_"""


def test_conllu(spark, tmp_path):
    (tmp_path / "x.conllu").write_text(CONLLU)
    lines = readers.read_conllu(spark, str(tmp_path / "x.conllu"))
    words = readers.parse_conllu(lines).select("sent_no", "word_no", "word", "upos")
    assert rows(words, "sent_no", "word_no") == [(0, 1, "Mon", "PRON"), (0, 2, "kal", "_"), (0, 3, "null", "VERB"), (2, 1, "Vot", "X")]
    assert rows(readers.conllu_text(lines).select("sentence"), "sentence") == [("Mon kal",), ("Vot",)]


def test_conllu_needs_ten_fields(spark):
    lines = spark.createDataFrame([("f", 1, "1\tword")], "file string, line_no long, line string")
    with pytest.raises(Exception, match="10 tab-separated"):
        readers.parse_conllu(lines).collect()


def test_sentence_blocks_drop_an_unclosed_one_and_round_trip(spark, tmp_path):
    (tmp_path / "x.conllu").write_text(CONLLU)
    lines = readers.read_conllu(spark, str(tmp_path / "x.conllu"))
    blocks = split.group_sentences(lines)
    assert split.count_sentences(lines).first()[0] == 1 and blocks.count() == 6
    writers.write_conllu(blocks, str(tmp_path / "out"))
    again = readers.parse_conllu(readers.read_conllu(spark, str(tmp_path / "out"))).select("word")
    assert rows(again, "word") == [("Mon",), ("kal",), ("null",)]


BIO = "Mon mon O\nErzya erzya B-LOC\nmoda moda I-LOC\n\nshort\nNext next O\n\n\nBroken broken B-PER\n\nLast last B-PER\n"


def test_bio_groups(spark, tmp_path):
    (tmp_path / "wikiann-myv.bio").write_text(BIO)
    tokens = readers.parse_bio(readers.read_bio(spark, str(tmp_path)))
    found = tokens.select("lang", "sent_no", "word_no", "token", "span_text", "tag")
    assert rows(found, "sent_no", "word_no") == [
        ("myv", 1, 1, "Mon", "mon", "O"), ("myv", 1, 2, "Erzya", "erzya", "B-LOC"), ("myv", 1, 3, "moda", "moda", "I-LOC"),
        ("myv", 4, 1, "Last", "last", "B-PER")]
    made = tagged.bio_instances(tokens, ["file", "sent_no"]).orderBy("sent_no").collect()
    assert made[0].tokens == ["Mon", "Erzya", "moda"] and made[0].ner_tags == [0, 5, 6]
    assert made[0].langs == ["myv"] * 3 and made[0].spans == ["LOC: erzya"]


def test_unknown_tag_fails(spark):
    tokens = spark.createDataFrame([("B-XYZ",)], "tag string")
    with pytest.raises(Exception, match="unknown tag"):
        tagged.encode_bio_tags(tokens).collect()


def test_ner_json_array_and_lines(spark, tmp_path):
    data = [{"tokens": ["Ёж"], "ner_tags": [1], "langs": ["ru"], "spans": ["PER: Ёж"]}, {"tokens": [], "ner_tags": [], "langs": [], "spans": []}]
    (tmp_path / "a.json").write_text(json.dumps(data, ensure_ascii=False), encoding="utf-8")
    instances = readers.read_ner_json(spark, str(tmp_path / "a.json"), array_files=True)
    assert [r.tokens for r in instances.collect()] == [["Ёж"]]
    writers.write_ner_json(instances.withColumn("split", F.lit("test")), str(tmp_path / "out"), "split")
    part = next((tmp_path / "out" / "split=test").glob("part*"))
    assert "Ёж" in part.read_text(encoding="utf-8")
    assert readers.read_ner_json(spark, str(tmp_path / "out")).count() == 1


SCRIPTS = """# comment
0041..005A    ; Latin # L& [26]

00AA          ; Latin # Lo
0400..0484    ; Cyrillic # L&
0030..0039    ; Common # Nd
2581          ; Common # So
"""


def test_script_table_file(spark, tmp_path):
    (tmp_path / "Scripts.txt").write_text(SCRIPTS)
    table = script_tables.read_script_table(spark, str(tmp_path / "Scripts.txt"))
    assert rows(table, "cp_from") == [(0x30, 0x39, "Common"), (0x41, 0x5A, "Latin"), (0xAA, 0xAA, "Latin"), (0x400, 0x484, "Cyrillic"), (0x2581, 0x2581, "Common")]
    vocab = spark.createDataFrame([("▁", 0), ("▁AЖЖ", 1), ("AЖ", 2), ("a", 3), ("▁12", 4), ("<mask>", 5)], "token string, id long")
    found = scripts.script_categories(vocab, word_position=True, table=table).select("id", "category")
    assert rows(found, "id", "category") == [(0, "Common_initial"), (1, "Cyrillic_initial"), (2, "Latin_medial"), (3, "UNK_medial"),
                                             (4, "Common_initial"), (5, "UNK_medial"), (5, "xlmr_special")]
    preferred = scripts.script_categories(vocab, table=table, preferred=["Cyrillic"]).filter("id = 2").first()
    assert preferred.category == "Cyrillic"


def test_jvm_scripts_agree_with_ranges(spark):
    ranges = script_tables.unicode_script_ranges(spark).cache()
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(["▁привет", "hello", "мир2", "日本のカナ", "𐍈𐍈", "שלום", "தமிழ்", "\U000e0fff", "é1"])], "token string, id long")
    by_table = rows(scripts.char_scripts(vocab, ranges).select("id", "pos", "ch", "script"), "id", "pos")
    by_jvm = rows(scripts.char_scripts(vocab).select("id", "pos", "ch", "script"), "id", "pos")
    assert by_table == by_jvm
    names = {r.script for r in ranges.select("script").distinct().collect()}
    assert {"Latin", "Old_Italic", "SignWriting", "Han", "Common", "Inherited"} <= names and "UNK" not in names


def test_write_shards_and_splits(spark, tmp_path):
    lines = spark.range(103).select(F.col("id").alias("k"), F.concat(F.lit("line "), F.col("id")).alias("line"))
    sharded = split.make_shards(lines, 10, ["k"])
    sizes = [r[1] for r in sharded.groupBy("shard_id").count().orderBy("shard_id").collect()]
    assert sizes == [10] * 7 + [11] * 3
    writers.write_shards(sharded, str(tmp_path / "s"), ["k"])
    first = spark.read.text(str(tmp_path / "s" / "shard_id=1")).collect()
    assert sorted(r.value for r in first) == sorted(f"line {i}" for i in range(10))
    assert len(list((tmp_path / "s").glob("shard_id=*"))) == 10
    full = split.split_ratio(lines, ["k"], 0.5, 0.5)
    writers.write_splits(full, str(tmp_path / "p"), ["k"])
    assert {p.name for p in (tmp_path / "p").glob("split=*")} == {"split=train", "split=dev"}


@pytest.mark.parametrize("partitions,batch", [(1, 3), (4, 1), (7, 1000)])
def test_sections_in_any_order(spark, partitions, batch):
    """Files cut over partitions and batches at every place, in order or not, number as one pass over each file does."""
    rng = random.Random(partitions)
    rows, expected = [], {}
    for file in range(12):
        section = place = 0
        size = rng.choice([1, 2, 5, 40])
        kinds = [rng.choice("bwwc") for _ in range(size)]
        for at, kind in enumerate(kinds, 1):
            place += kind == "w"
            expected[file, at] = (section, place, "b" in kinds[at - (kind == "b"):] if kind != "b" else True)
            rows.append((file, at, kind == "b", kind == "w", f"x{at}"))
            if kind == "b":
                section, place = section + 1, 0
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for mixed in (False, True):
            if mixed:
                rng.shuffle(rows)
            df = spark.createDataFrame(spark.sparkContext.parallelize(rows, partitions), "file long, line_no long, _blank boolean, _counted boolean, text string")
            plain = {(r.file, r.line_no): (r.section, r.place) for r in number_sections(df).collect()}
            assert plain == {k: v[:2] for k, v in expected.items()}
            ends = {(r.file, r.line_no): (r.section, r.place, r.ends) for r in number_sections(df, open_sections=True).collect()}
            words = [(r[0], r[1]) for r in rows if r[3]]
            assert ends.keys() == expected.keys() and [ends[k] for k in words] == [expected[k] for k in words]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_parsing_shuffles_no_text(spark, tmp_path):
    (tmp_path / "a.conllu").write_text("# text = a b\n1\ta\t_\tX\t_\t_\t_\t_\t_\t_\n2\tb\t_\tY\t_\t_\t_\t_\t_\t_\n\n")
    df = readers.parse_conllu(readers.read_conllu(spark, str(tmp_path)))
    assert sorted((r.sent_no, r.word_no, r.word, r.upos) for r in df.collect()) == [(0, 1, "a", "X"), (0, 2, "b", "Y")]
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert all("word" not in line and "line#" not in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
