"""File-to-file jobs on small folders."""

from __future__ import annotations

import csv
import json
import math

import pytest

from lexmesh.operators import language_id
from lexmesh.plans import workflows


def written(folder, suffix="*.txt"):
    return [line for part in sorted(folder.rglob(f"part-{suffix}")) for line in part.read_text(encoding="utf-8").split("\n") if line]


@pytest.fixture
def corpora(tmp_path):
    (tmp_path / "a.txt").write_text("Hello there world\n\nhello THERE, world!\n1234 5678 99\nred green blue\n")
    (tmp_path / "b.txt").write_text("red green blue\nsingle\none two , three\n")
    return tmp_path, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]


def test_clean_merge_detokenize(spark, corpora):
    folder, inputs = corpora
    workflows.clean_files(spark, inputs, str(folder / "clean"))
    assert written(folder / "clean") == ["Hello there world", "red green blue", "one two , three"]
    workflows.merge_distinct(spark, inputs, str(folder / "merged"))
    assert len(written(folder / "merged")) == 6
    workflows.detokenize_file(spark, inputs[1:], str(folder / "detok"))
    assert written(folder / "detok")[-1] == "one two, three"


def test_clean_with_a_language_model(spark, corpora):
    folder, inputs = corpora
    known = [("en", "hello there world"), ("en", "one two three")] * 20 + [("xx", "zzrgh qqkva blüe grëen"), ("xx", "red qreen blve")] * 20
    model = language_id.fit_language_id(spark.createDataFrame(known, "lang string, line string"))
    workflows.clean_files(spark, inputs, str(folder / "clean"), model)
    assert "Hello there world" not in written(folder / "clean")


def test_clean_files_keeps_input_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("The second text has enough words here\nShared line that stands in both files\n")
    (tmp_path / "b.txt").write_text("Shared line that stands in both FILES\nThe first text has enough words too\n")
    workflows.clean_files(spark, [str(tmp_path / "b.txt"), str(tmp_path / "a.txt")], str(tmp_path / "out"))
    found = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert found == ["Shared line that stands in both FILES", "The first text has enough words too", "The second text has enough words here"]


def test_shuffled_shards_are_written_in_shuffled_order(spark, tmp_path):
    from lexmesh.operators import split
    (tmp_path / "in.txt").write_text("".join(f"line {i}\n" for i in range(50)))
    workflows.shard_file(spark, str(tmp_path / "in.txt"), str(tmp_path / "out"), 3, seed=1)
    lines = workflows.raw_lines(spark, str(tmp_path / "in.txt"))
    ranked = [r.line for r in split.seeded_shuffle(lines, workflows.KEY, 1).orderBy("position").collect()]
    found = [line for k in (1, 2, 3) for f in sorted((tmp_path / "out" / f"shard_id={k}").glob("part-*")) for line in f.read_text().splitlines()]
    assert found == ranked


def test_multilingual_set(spark, corpora):
    folder, inputs = corpora
    workflows.multilingual_set(spark, {"a": inputs[:1], "b": inputs[1:]}, 0.2, str(folder / "set"), 40, str(folder / "composition"))
    lines = written(folder / "set")
    assert len(lines) == 40 and set(lines) <= {"Hello there world", "hello THERE, world!", "1234 5678 99", "red green blue", "single", "one two , three"}
    rows = list(csv.DictReader(written(folder / "composition", "*.csv")))
    assert {(r["lang"], r["lines"]) for r in rows} == {("a", "4"), ("b", "3")}


def test_shards_and_splits(spark, tmp_path):
    (tmp_path / "in.txt").write_text("".join(f"line {i}\n" + ("\n" if i % 4 == 0 else "") for i in range(20)))
    workflows.shard_file(spark, str(tmp_path / "in.txt"), str(tmp_path / "shards"), 3)
    assert [len(written(tmp_path / "shards" / f"shard_id={k}")) for k in (1, 2, 3)] == [6, 7, 7]
    assert written(tmp_path / "shards") == [f"line {i}" for i in range(20)]
    workflows.split_file(spark, str(tmp_path / "in.txt"), str(tmp_path / "s"), 0.5, 0.2)
    sizes = {p.name: sum(len(f.read_text().split("\n")) - 1 for f in p.glob("part-*")) for p in (tmp_path / "s").glob("split=*")}
    assert sizes == {"split=train": 13, "split=dev": 5, "split=test": 7}  # five blank lines count
    workflows.split_file_absolute(spark, str(tmp_path / "in.txt"), str(tmp_path / "t"), 3, 4, drop_blank=True)
    assert [len(written(tmp_path / "t" / f"split={s}")) for s in ("train", "dev", "test")] == [13, 3, 4]


def test_treebank(spark, tmp_path):
    rows = "".join(f"# text = s {i}\n1\tw{i % 3}\t_\t{'NOUN' if i % 3 else 'VERB'}\t_\t_\t0\tx\t_\t_\n\n" for i in range(30))
    (tmp_path / "t.conllu").write_text(rows)
    path = str(tmp_path / "t.conllu")
    workflows.downsample_treebank(spark, path, str(tmp_path / "kept"), eval_size=8, eval_output=str(tmp_path / "eval"))
    kept, held = [[x for x in written(tmp_path / d) if x.startswith("#")] for d in ("kept", "eval")]
    assert len(kept) == 22 and len(held) == 8 and not set(kept) & set(held)
    workflows.downsample_treebank(spark, path, str(tmp_path / "small"), size=5)
    assert sum(x.startswith("#") for x in written(tmp_path / "small")) == 5
    with pytest.raises(ValueError):
        workflows.downsample_treebank(spark, path, "x")
    scores = {r.baseline: r.score for r in workflows.treebank_baselines(spark, path, path).collect()}
    assert scores == {"majority": pytest.approx(200 / 3), "per word majority": 100.0}


def test_ner_folders(spark, tmp_path):
    source = tmp_path / "bio"
    source.mkdir()
    for lang, n in (("et", 60), ("fi", 10)):
        (source / f"wikiann-{lang}.bio").write_text("\n".join(f"Tartu{i} t{i} B-LOC\non on O\n" for i in range(n)))
    limits = {"threshold": 20, "min_dev": 4, "min_test": 8}
    report = {(r.lang, r.split): r.n for r in workflows.prepare_ner(spark, str(source), str(tmp_path / "out"), "all", **limits).collect()}
    assert report == {("et", "test"): 8, ("et", "dev"): 4, ("et", "train"): 48, ("fi", "test"): 10}
    assert len(written(tmp_path / "out" / "all" / "split=train")) == 48 and not (tmp_path / "out" / "all" / "split=test").exists()
    first = json.loads(written(tmp_path / "out" / "languages" / "lang=fi")[0])
    assert first["langs"] == ["fi", "fi"] and first["spans"][0].startswith("LOC: t")
    again = workflows.combine_ner(spark, str(tmp_path / "out"), ["et", "fi"], str(tmp_path / "out"), "both", **limits)
    assert {r.split: r.n for r in again.collect()} == {"test": 8, "dev": math.ceil(4 / 70 / (1 - 8 / 70) * 62), "train": 58}


def test_vocabularies_and_counts(spark, tmp_path):
    (tmp_path / "et.txt").write_text("tere tere maailm\ntere tulemast maailma\n\n" * 30 + "ž\n")
    (tmp_path / "fi.txt").write_text("terve maailma\n" * 40)
    files = [str(tmp_path / "et.txt"), str(tmp_path / "fi.txt")]
    bpe_vocab = {r.token: r.id for r in workflows.learn_vocabulary(spark, files, 40, "bpe").collect()}
    assert bpe_vocab["[UNK]"] == 0 and bpe_vocab["[MASK]"] == 4 and "ter" in bpe_vocab and len(bpe_vocab) <= 40 and "z" in bpe_vocab
    vocab = workflows.learn_vocabulary(spark, files, 40, "unigram", str(tmp_path / "vocab"))
    tokens = {r.token for r in spark.read.parquet(str(tmp_path / "vocab")).collect()}
    assert "▁" in tokens and "ž" not in tokens and len(tokens) <= 40
    workflows.count_tokens(spark, {"et": files[:1], "fi": files[1:]}, vocab, str(tmp_path / "counts"), max_lines=10)
    rows = {r["token"]: (int(r["et"]), int(r["fi"])) for r in csv.DictReader(written(tmp_path / "counts", "*.csv"))}
    assert set(rows) == tokens and rows["<s>"] == rows["</s>"] == (10, 10) and rows["<mask>"] == (0, 0)
    sentences = spark.createDataFrame([(1, ["tere", "maa ilm"], ["INTJ", "?"])], "k long, words array<string>, labels array<string>")
    row = workflows.tagging_examples(sentences, vocab, ("INTJ",), 64).first()
    names = {r.id: r.token for r in vocab.collect()}
    assert "".join(names[i] for i in row.input_ids) == "<s>▁tere▁maa▁ilm</s>" and row.labels == [0, -100] and row.alignment[0][0] == 1


def test_presets_written(spark, tmp_path):
    old = spark.createDataFrame([("<s>", 0, [1.0, 2.0]), ("▁a", 1, [3.0, 4.0]), ("▁b", 2, [5.0, 6.0])], "token string, id long, vector array<float>")
    new = spark.createDataFrame([("<s>", 0), ("▁b", 1), ("▁c", 2)], "token string, id long")
    workflows.initialize_embeddings(old, new, 2, str(tmp_path / "m"))
    for name in ("script", "identity", "script+identity", "script+position", "script+pos+ident"):
        rows = {r.id: r.vector for r in spark.read.parquet(str(tmp_path / "m" / name)).collect()}
        assert len(rows) == 3 and rows[0] == [1.0, 2.0] and (rows[1] == [5.0, 6.0]) == ("ident" in name)
