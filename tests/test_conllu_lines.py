"""CoNLL-U lines made, read and written in tasks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from lexmesh.functions.text import BLANK, BLANKS, strip, words
from lexmesh.plans.inputs import conllu_files
from lexmesh.sinks import writers
from lexmesh.sources import tagged

ODD = "　 Naïve kala  kümneteist1 \x1c x\r\n\r\n\ttäht😀se seitse7 yksteisttä   \rend\n \x85 \n"


def test_trimmed_characters_are_the_blanks_of_the_expression(spark):
    texts = spark.createDataFrame([(c, chr(c)) for c in range(0x3100)], "id long, c string")
    found = texts.filter(F.col("c").rlike(rf"(?U)^{BLANK}$")).select("c").collect()
    assert {r.c for r in found} == set(BLANKS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
    assert spark.createDataFrame([(ODD,)], "t string").select(strip(F.col("t")).alias("t")).first().t == ODD.strip()


def test_conllu_files_split_as_the_words_do(spark):
    """files are made in tasks a batch at a time; sentences and words are those of the text expressions."""
    texts = spark.createDataFrame([(1, ODD), (2, None), (3, " \n")], "file long, text string")
    rows = conllu_files(texts).orderBy("file", "line_no").collect()
    assert [r.line_no for r in rows] == list(range(1, len(rows) + 1)) and {r.file for r in rows} == {1}
    lines = [line for line in (x.strip() for x in ODD.replace("\r\n", "\n").replace("\r", "\n").split("\n")) if line]
    assert [r.line[9:] for r in rows if r.line.startswith("# text = ")] == lines
    split = spark.createDataFrame([(line,) for line in lines], "line string").select(words(F.col("line")).alias("w")).collect()
    plain = [r.line.split("\t")[1] for r in rows if r.line and not r.line.startswith("#") and r.line.split("\t")[0].isdigit()]
    assert plain == [w for r in split for w in r.w]
    assert sum(1 for r in rows if "-" in r.line.split("\t")[0] and "\t" in r.line) == sum(len(w) == 7 for w in plain)
    assert sum(1 for r in rows if ".1\t" in r.line) == sum(len(w) == 11 for w in plain)


def test_parsing_conllu_is_one_pass_in_tasks(spark):
    """the lines were taken apart by expressions of the JVM, and every line came back from the numbering."""
    lines = ["# x", "　 \t", " 1\ta\t_\tX\t_\t_\t_\t_\t_\t_ ", "1-2\tab\t_\tX\t_\t_\t_\t_\t_\t_", "2\ta-b\t_\tY\t_\t_\t_\t_\t_\t_", "", "3.1\tc\t_\tZ\t_\t_\t_\t_\t_\t_"]
    df = spark.createDataFrame([(7, i + 1, x) for i, x in enumerate(lines)], "file long, line_no long, line string").coalesce(1)
    found = tagged.parse_conllu(df)
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [tuple(r) for r in found.collect()] == [(7, 1, 1, "a", "X"), (7, 1, 2, "a-b", "Y"), (7, 2, 1, "c", "Z")]


def test_written_sentences_are_closed_and_in_order(spark, tmp_path):
    """sentences are written as sorted lines, not as strings made of arrays of structs."""
    rows = [("b", 0, 2, "y"), ("b", 0, 1, "x"), ("a", 1, 5, "w"), ("a", 0, 1, "u"), ("a", 0, 2, "v"), (None, 0, 1, "n")]
    writers.write_conllu(spark.createDataFrame(rows, "file string, block_no long, line_no long, line string"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "n\n\nu\nv\n\nw\n\nx\ny\n\n"
    keys = [pa.RecordBatch.from_pydict({"k": [1, 1], "line": ["a", "b"]}), pa.RecordBatch.from_pydict({"k": [1, 2], "line": ["c", "d"]})]
    assert [x for b in writers._closed(iter(keys)) for x in b.column(0).to_pylist()] == ["a", "b", "c", "", "d", ""]
