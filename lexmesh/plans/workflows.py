"""File-to-file workflows: readers, operators and writers composed into the jobs a user runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmesh.functions.text import strip, words
from lexmesh.operators import bpe, clean, embed, examples, language_id, metrics, sampling, split, tagged, unigram, vocabulary
from lexmesh.session import lookup
from lexmesh.sinks import writers
from lexmesh.sources import corpus, tagged as readers

KEY = ["file", "line_no"]
MODELS = ("unigram", "bpe")


def raw_lines(spark: SparkSession, paths: str | list[str], drop_blank: bool = False) -> DataFrame:
    """Stripped lines with blanks kept, as the splitters need them."""
    lines = corpus.read_records(spark, paths).select("file", F.col("record_no").alias("line_no"), F.col("value").alias("line"))
    return corpus.drop_blank(lines) if drop_blank else lines.withColumn("line", strip(F.col("line")))


def merge_distinct(spark: SparkSession, inputs: list[str], output: str) -> None:
    """All distinct lines of several files; their order is not part of the result."""
    clean.dedup_exact(corpus.scan_lines(spark, inputs)).write.mode("overwrite").text(output)


def clean_files(spark: SparkSession, inputs: list[str], output: str, model: language_id.LanguageModel | None = None,
                language: str = "en", threshold: float = 0.9) -> None:
    """Merge in the order of ``inputs``, deduplicate, drop lines of one language if a model is given, apply the line filters.

    Of duplicates the first in input order stays, and the output keeps that order.
    """
    order = ["input_no", "line_no"]
    lines = clean.dedup_normalized(corpus.with_input_order(corpus.scan_lines(spark, inputs), inputs), order)
    if model is not None:
        lines = language_id.filter_language_id(lines, model, language, threshold)
    writers.write_lines(clean.filter_quality(lines), output, order)


def detokenize_file(spark: SparkSession, inputs: str | list[str], output: str) -> None:
    writers.write_lines(clean.detokenize_punctuation(corpus.scan_lines(spark, inputs)), output, KEY)


def multilingual_set(spark: SparkSession, files: dict[str, list[str]], alpha: float, output: str, size: int | None = None,
                     composition: str | None = None, seed: int = 1) -> None:
    """Resample a language collection with exponent alpha into one corpus."""
    lines = corpus.scan_language_files(spark, files)
    if composition:
        writers.write_composition(sampling.language_composition(lines), composition)
    writers.write_lines(sampling.sample_languages(lines, alpha, KEY, size, seed), output, ["draw"])


def shard_file(spark: SparkSession, inputs: str | list[str], output: str, shards: int, seed: int | None = None) -> None:
    """Contiguous shards; a seed shuffles first, and each shard is then written in shuffled order."""
    sharded = split.make_shards(corpus.scan_lines(spark, inputs), shards, KEY, seed, position="position")
    writers.write_shards(sharded, output, ["position"])


def split_file(spark: SparkSession, inputs: str | list[str], output: str, train: float, dev: float, seed: int = 1, drop_blank: bool = False) -> None:
    parts = split.split_ratio(raw_lines(spark, inputs, drop_blank), KEY, train, dev, seed, position="position")
    writers.write_splits(parts, output, ["position"])


def split_file_absolute(spark: SparkSession, inputs: str | list[str], output: str, dev: int, test: int, seed: int = 1, drop_blank: bool = False) -> None:
    parts = split.split_absolute(raw_lines(spark, inputs, drop_blank), KEY, dev, test, seed, position="position")
    writers.write_splits(parts, output, ["position"])


def downsample_treebank(spark: SparkSession, inputs: str | list[str], output: str, size: int | None = None, eval_size: int | None = None,
                        eval_output: str | None = None, seed: int = 1) -> None:
    """Keep ``size`` random sentences, or hold ``eval_size`` of them out into a second file."""
    if not size and not eval_size or eval_size and not eval_output:
        raise ValueError("give size, or eval_size with eval_output")
    sentences = split.group_sentences(readers.read_conllu(spark, inputs))
    if not eval_size:
        writers.write_conllu(split.downsample_sentences(sentences, size, seed), output)
        return
    parts = split.holdout_sentences(sentences, eval_size, seed)
    writers.write_conllu(parts.filter(F.col("part") == "kept"), output)
    writers.write_conllu(parts.filter(F.col("part") == "eval"), eval_output)


def prepare_ner(spark: SparkSession, folder: str, output: str, dataset: str, dev_size: float = 0.05, test_size: float = 0.1, **limits) -> DataFrame:
    """BIO files to JSON instances: ``lang=<l>/split=<s>/`` folders, plus train and dev of all
    languages pooled under ``<dataset>``. Returns the size report."""
    tokens = readers.parse_bio(readers.read_bio(spark, folder))
    instances = tagged.bio_instances(tokens, ["file", "sent_no"])
    parts = split.split_threshold(instances, ["file", "sent_no"], ["lang"], dev_size=dev_size, test_size=test_size, **limits)
    record = F.to_json(F.struct("tokens", "ner_tags", "langs", "spans")).alias("value")
    parts.select("lang", "split", record).write.mode("overwrite").partitionBy("lang", "split").text(f"{output}/languages")
    writers.write_ner_json(split.pool_train_dev(parts), f"{output}/{dataset}", "split")
    return split.split_size_report(parts)


def combine_ner(spark: SparkSession, folder: str, langs: Sequence[str], output: str, dataset: str, **options) -> DataFrame:
    """Pool the instances ``prepare_ner`` wrote for some languages and split the pool anew."""
    # every instance is a line of a part file, which gives it a key of its own
    rows = raw_lines(spark, [f"{folder}/languages/lang={lang}/*/" for lang in langs], drop_blank=True)
    known = readers.parse_ner_json(rows, "line").withColumn("lang", F.regexp_extract("file", "/lang=([^/]+)/", 1))
    parts = split.combine_and_resplit(known, langs, dataset, KEY, **options)
    writers.write_ner_json(parts, f"{output}/{dataset}", "split")
    return split.split_size_report(parts, ("dataset",))


def learn_vocabulary(spark: SparkSession, inputs: str | list[str], size: int, model: str = "unigram", output: str | None = None,
                     coverage: float = 0.999, seed_size: int = 1_000_000) -> DataFrame:
    """A vocabulary ``(token, id, is_special, score)`` of a corpus.

    The unigram form splits on whitespace and leaves characters beyond ``coverage`` to the unknown
    piece; the BPE form normalises and splits off punctuation first.
    """
    if model not in MODELS:
        raise ValueError(f"model must be one of {MODELS}")
    lines = corpus.scan_lines(spark, inputs)
    if model == "bpe":
        line = vocabulary.normalize_nfd_lower_strip(F.col("line"))
        found = lines.select(F.explode(vocabulary.pretokenize(line)).alias("word"))
        frequencies = vocabulary.word_frequencies(found)
        pieces = bpe.bpe_pieces(frequencies, bpe.train_bpe(frequencies, size))
        vocab = vocabulary.assemble_vocab(pieces, size, vocabulary.BPE_RESERVED)
    else:
        frequencies = vocabulary.word_frequencies(lines.select(F.explode(words(F.col("line"))).alias("word")))
        covered = vocabulary.restrict_to_alphabet(frequencies, vocabulary.alphabet_by_coverage(frequencies, coverage))
        vocab = vocabulary.assemble_vocab(unigram.train_unigram(covered, size, seed_size), size)
    if output:
        vocab.write.mode("overwrite").parquet(output)
    return vocab


def count_tokens(spark: SparkSession, files: dict[str, list[str]], vocab: DataFrame, output: str, max_lines: int = 100_000) -> None:
    """Token x language table over the first lines of each language, special tokens included."""
    names = [n for n, paths in sorted(files.items())]
    heads = [head_of_files(spark, paths, max_lines).withColumn("lang", F.lit(lang)) for lang, paths in sorted(files.items())]
    encoded = unigram.encode_lines(clean.merge_corpora(*heads), vocab)
    ids = encoded.select("lang", F.explode(F.concat(F.array(F.lit(0)), "ids", F.array(F.lit(2)))).alias("id"))
    by_id = ids.groupBy("id", "lang").agg(F.count(F.lit(1)).alias("n")).join(vocab.select("id", "token"), "id")
    grid = vocab.select("token", F.explode(F.array(*[F.lit(n) for n in names])).alias("lang"))
    counts = grid.join(by_id.select("token", "lang", "n"), ["token", "lang"], "left").fillna(0, ["n"])
    writers.write_token_counts(counts, output, names)


def head_of_files(spark: SparkSession, paths: list[str], max_lines: int) -> DataFrame:
    """First physical lines of a language's files in name order, blank ones counted but empty."""
    lines = raw_lines(spark, paths)
    sizes = lines.groupBy("file").agg(F.max("line_no").alias("n"))
    before = F.sum("n").over(sampling.file_order())
    room = sizes.select("file", F.greatest(F.lit(max_lines) - F.coalesce(before, F.lit(0)), F.lit(0)).alias("room"))
    return lookup(lines, room, ["file"]).filter(F.col("line_no") <= F.col("room")).select("line")


def initialize_embeddings(old: DataFrame, new_vocab: DataFrame, dims: int, output: str, presets: Sequence[str] = tuple(embed.PRESETS),
                          seed: int = 1, table: DataFrame | None = None, auxiliary: DataFrame | None = None) -> None:
    """One matrix per preset under ``<output>/<preset>``, and the matched tokens under ``<output>/matched``.

    ``old`` is ``(token, id, vector)``. With ``auxiliary`` vectors of the new vocabulary ``<output>/similarity`` is made too.
    """
    embed.matched_tokens(old, new_vocab).write.mode("overwrite").option("header", True).csv(f"{output}/matched")
    if auxiliary is not None:
        writers.write_embeddings(embed.init_combined(old, new_vocab, dims, seed=seed, auxiliary=auxiliary), f"{output}/similarity")
    for name in presets:
        matrix = embed.init_combined(old, new_vocab, dims, seed=seed, table=table, **embed.PRESETS[name])
        writers.write_embeddings(matrix, f"{output}/{name}")


def treebank_baselines(spark: SparkSession, train: str, test: str) -> DataFrame:
    """Majority-label and per-word majority baselines of a treebank, in per cent."""
    seen, unseen = [readers.parse_conllu(readers.read_conllu(spark, p)).withColumnRenamed("upos", "label") for p in (train, test)]
    majority = metrics.majority_label_baseline(seen).select(F.lit("majority").alias("baseline"), F.col("majority_baseline").alias("score"))
    per_word = metrics.per_word_majority_baseline(seen, unseen, tagged.POS_LABELS)
    return majority.unionByName(per_word.select(F.lit("per word majority").alias("baseline"), F.col("per_word_baseline").alias("score")))


def tagging_examples(sentences: DataFrame, vocab: DataFrame, labels: Sequence[str], max_length: int = 512) -> DataFrame:
    """Sentences ``(keys..., words, labels)`` to aligned examples of at most ``max_length`` ids."""
    keys = [c for c in sentences.columns if c not in ("words", "labels")]
    encoded = unigram.encode_words(sentences, vocab)
    chunked = examples.chunk_by_length(encoded.select(*keys, "ids", "labels"), max_length, labels="labels")
    index = F.transform("labels", lambda l: F.coalesce(tagged.index_of(l, labels), F.lit(tagged.IGNORED)))
    return chunked.withColumn("labels", index)
