"""Invariants and brute-force comparisons on small fixtures."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmesh.operators import bpe, clean, embed, examples, metrics, projection, sampling, similarity, split, unigram, vocabulary
from lexmesh.operators.lattice import Lattice
from lexmesh.operators.scripts import script_cluster_select
from lexmesh.operators.tagged import POS_LABELS


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- cleaning ---------------------------------------------------------------------------------

def test_filters_at_their_limits(spark):
    lines = ["one", "a b", "ab cd", " ".join(["word"] * 100), " ".join(["word"] * 101), "x" * 31 + " ab", "x" * 32 + " ab", "12 34", "ab 12",
             "x" * 17 + " " + "y" * 16, "x" * 16 + " " + "y" * 16]
    df = frame(spark, [(x,) for x in lines], "line string")
    keep = lambda op: [lines.index(r.line) for r in op(df).collect()]
    assert keep(clean.filter_word_count) == [1, 2, 3, 5, 6, 7, 8, 9, 10]
    assert keep(clean.filter_avg_word_length) == [0, 2, 3, 4, 7, 8, 10]  # 16.5 and 17 are above 16, single letters below 2
    assert 5 in keep(clean.filter_long_word) and 6 not in keep(clean.filter_long_word)
    assert 7 not in keep(clean.filter_alphabet_ratio) and 1 in keep(clean.filter_alphabet_ratio)


def test_dedup_normalized_keeps_first_and_other_columns(spark):
    df = frame(spark, [(2, "HELLO world!", "x"), (1, "Hello, World", "y"), (3, "12", "z"), (4, "--", "w"), (5, "Ёж", "v"), (6, "ёж!", "u")],
               "k long, line string, tag string").repartition(3)
    got = sorted((r.k, r.line, r.tag) for r in clean.dedup_normalized(df, ["k"]).collect())
    assert got == [(1, "Hello, World", "y"), (3, "12", "z"), (5, "Ёж", "v")]


def test_detokenize(spark):
    df = frame(spark, [("Hi , you ( a ) « b » ! „ c “",)], "line string")
    assert clean.detokenize_punctuation(df).first().line == "Hi, you (a) «b»! „c“"


# --- splits -------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1791, 1792, 5000, 20000])
def test_threshold_sizes(spark, n):
    df = spark.range(n).withColumn("lang", F.lit("x"))
    sizes = dict(split.split_threshold(df, ["id"], ["lang"]).groupBy("split").count().collect())
    if n < 1792:
        assert sizes == {"test": n}
        return
    ts, ds = max(0.1, 512 / n), max(0.05, 256 / n)
    tests = math.ceil(ts * n)
    devs = math.ceil(ds / (1 - ts) * (n - tests))
    assert sizes == {"test": tests, "dev": devs, "train": n - tests - devs}


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(1000)
    one = sorted(split.split_ratio(df.coalesce(1), ["id"], 0.7, 0.2).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        many = sorted(split.split_ratio(df.repartition(9), ["id"], 0.7, 0.2).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == many


def test_split_absolute_needs_enough_rows(spark):
    with pytest.raises(Exception, match="fewer rows"):
        split.split_absolute(spark.range(5), ["id"], 3, 3).collect()
    with pytest.raises(ValueError):
        split.split_absolute(spark.range(5), ["id"], 0, 0)


@pytest.mark.parametrize("n,k", [(3, 7), (14, 7), (20, 7), (0, 4)])
def test_shards_differ_by_one(spark, n, k):
    got = [r[1] for r in split.make_shards(spark.range(n), k, ["id"], shuffle_seed=1).groupBy("shard_id").count().orderBy("shard_id").collect()]
    assert got == [x for x in [n // k] * (k - n % k) + [n // k + 1] * (n % k) if x]


# --- sampling ------------------------------------------------------------------------------------

def corpus(spark):
    return spark.range(4000).select("id", F.when(F.col("id") < 3600, "big").when(F.col("id") < 3960, "mid").otherwise("low").alias("lang"))


def test_alpha_weights(spark):
    composition = sampling.language_composition(corpus(spark))
    for row in sampling.alpha_weights(composition, 1.0).collect():
        assert row.weight == pytest.approx(row.proportion)
    weights = {r.lang: r for r in sampling.sampling_rates(sampling.alpha_weights(composition, 0.3)).collect()}
    total = sum(p ** 0.3 for p in (0.9, 0.09, 0.01))
    assert sum(r.weight for r in weights.values()) == pytest.approx(1)
    assert weights["low"].weight == pytest.approx(0.01 ** 0.3 / total) and weights["low"].rate > 1 > weights["big"].rate


def test_samples_follow_the_weights(spark):
    weights = {r.lang: r.weight for r in sampling.alpha_weights(sampling.language_composition(corpus(spark)), 0.3).collect()}
    drawn = sampling.sample_languages(corpus(spark), 0.3, ["id"], size=8000)
    assert drawn.count() == 8000 and drawn.select("draw").distinct().count() == 8000
    for lang, n in drawn.groupBy("lang").count().collect():
        assert n / 8000 == pytest.approx(weights[lang], abs=0.02)
    copies = dict(sampling.sample_languages_rate(corpus(spark), 0.3, ["id"], size=8000).groupBy("lang").count().collect())
    assert sum(copies.values()) == pytest.approx(8000, rel=0.05)
    for lang, n in copies.items():
        assert n / 8000 == pytest.approx(weights[lang], abs=0.03)


# --- vocabularies --------------------------------------------------------------------------------

WORDS = {"lower": 5, "lowest": 3, "newer": 6, "wider": 3, "new": 2, "banana": 4, "aaaa": 3, "ёлка": 2, "б": 9, "😀😀x": 2}


def sequential_merges(words, count):
    table, merges = {w: list(w) for w in words}, []
    while len(merges) < count:
        pairs = Counter()
        for w, s in table.items():
            for a, b in zip(s, s[1:]):
                pairs[a, b] += words[w]
        if not pairs:
            break
        (a, b), n = min(pairs.items(), key=lambda x: (-x[1], len("".join(x[0])), x[0][0].encode(), x[0][1].encode()))
        merges.append((a, b, n))
        for w, s in table.items():
            out, i = [], 0
            while i < len(s):
                if s[i:i + 2] == [a, b]:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            table[w] = out
    return merges


def test_bpe_equals_one_merge_at_a_time(spark):
    rng = random.Random(3)
    runs = {"aaaa": 10, "xy": 5, "aaaaaaa": 3, "baab": 4, "a\x03\x02b": 6, "\x02\x03": 7}
    for words in (WORDS, runs, {"a" * k + "b" * (k % 3): k for k in range(1, 12)}, {"".join(rng.choice("abcde") for _ in range(rng.randint(1, 8))): rng.randint(1, 9) for _ in range(60)}):
        frequencies = frame(spark, list(words.items()), "word string, n long")
        letters = len(set("".join(words)))
        got = bpe.train_bpe(frequencies, letters + 5 + 25, rounds_per_checkpoint=3).orderBy("rank").collect()
        assert [(r.left, r.right, r.n) for r in got] == sequential_merges(words, 25)
    pieces = {r.piece for r in bpe.bpe_pieces(frequencies, bpe.train_bpe(frequencies, letters + 5 + 4)).collect()}
    assert len(pieces) == letters + 4


def rounds_of_merges(words, count, held):
    """The trainer's rounds on blocks held in memory: (rules, rounds)."""
    ranking = bpe.Ranking(held)
    for c in sorted(set("".join(words))):
        ranking.symbol(c)
    table = list(bpe._blocks(ranking.numbers)(iter([pa.RecordBatch.from_pydict({"w": pa.array(list(words)), "n": pa.array(list(words.values()), pa.int64())})])))

    def differences():
        sums = Counter()
        for b in table:
            for k, d in zip(b.column(3)[0].as_py(), b.column(4)[0].as_py()):
                sums[k] += d
        return sums

    def load(sums):
        sizes, taken, ranking.floor = sorted(Counter(sums.values()).items(), reverse=True), 0, 1
        for i, (n, pairs) in enumerate(sizes):
            if taken + pairs > held and i:
                ranking.floor = n + 1
                break
            taken += pairs
        ranking.counts = {k: n for k, n in sums.items() if n >= ranking.floor}
        ranking._heap = sorted(ranking._entry(k, n) for k, n in ranking.counts.items())

    load(differences())
    done, maker, rounds = [], {}, 0
    while True:
        batch = bpe.next_merges(ranking, 64)
        if not batch and ranking.floor > 1:
            sums = Counter()
            for b in bpe._recounted(iter(table)):
                sums.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
            load(sums)
            continue
        if not batch or len(done) >= count and next(ranking.ranked())[0] > done[bpe.in_order(done)[count - 1]][0]:
            break
        known = len(ranking.names)
        rules = [(key >> 32, key & 0xFFFFFFFF, ranking.symbol(rank[2] + rank[3])) for rank, key in batch]
        first, rounds = len(done), rounds + 1
        done += [(rank, tuple({maker[x] for x in rank[2:] if x in maker})) for rank, _ in batch]
        maker.update({rank[2] + rank[3]: first + i for i, (rank, _) in enumerate(batch)})
        table = [o for b in table for o in bpe._merged(rules)(iter([b]))]
        ranking.change(list(differences().items()), set(range(known, len(ranking.names))))
    return [(done[i][0][2], done[i][0][3], -done[i][0][0]) for i in bpe.in_order(done)[:count]], rounds


@pytest.mark.parametrize("seed", range(60))
def test_bpe_rounds_equal_one_merge_at_a_time(seed):
    """Few letters make the hard cases frequent: equal symbols, one string made in two ways, chains and ties."""
    rng = random.Random(seed)
    letters = "abcdefgh"[:rng.randint(1, 8)]
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))): rng.randint(1, rng.choice([2, 9, 50])) for _ in range(rng.randint(1, 90))}
    expected = sequential_merges(words, 120)
    found, rounds = rounds_of_merges(words, 120, rng.choice([10**9, 3, 20]))
    assert found == expected and rounds <= len(expected) + 120


def test_bpe_merges_many_pairs_in_a_round():
    rng = random.Random(1)
    words = {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))): rng.randint(1, 5) for _ in range(700)}
    found, rounds = rounds_of_merges(words, 400, 10**9)
    assert found == sequential_merges(words, 400) and rounds < len(found) / 4


def every_split(text):
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        out = [text[0]]
        for cut, c in zip(cuts, text[1:]):
            if cut:
                out.append(c)
            else:
                out[-1] += c
        yield out


def test_unigram_expectations_and_best_split():
    scores = {p: math.log(w) for p, w in {"a": .2, "b": .15, "ab": .3, "ba": .1, "aba": .05, "bab": .2}.items()}
    text = "ababa"
    valid = [s for s in every_split(text) if all(p in scores for p in s)]
    weights = [math.exp(sum(scores[p] for p in s)) for s in valid]
    expected = Counter()
    for s, w in zip(valid, weights):
        for p in s:
            expected[p] += 3 * w / sum(weights)
    block = Lattice([text, "axa", "", "bb"], 3)
    values = np.array([scores.get(p, -np.inf) for p in block.pieces()])
    alone = np.array([3, 0, 0, 0])
    found = {p: x for p, x in zip(block.pieces(), block.expected(values, alone)) if x}
    assert found == pytest.approx(dict(expected))
    score, word, piece, known = block.best(values, unknown=-20.0)
    names = block.pieces()
    parts = [[names[p] for w2, p in zip(word, piece) if w2 == w] for w in range(4)]
    assert score[0] == pytest.approx(math.log(max(weights))) and "".join(parts[0]) == text
    assert parts[1:] == [["a", "x", "a"], [], ["b", "b"]] and list(known[word == 1]) == [True, False, True]
    assert block.best(values)[0][1] == -np.inf  # without a price for unknown characters


@pytest.mark.parametrize("seed", range(12))
def test_lattice_of_random_words(seed):
    """Numbers of substrings, counts, expectations and best splits against every split of every word."""
    rng = random.Random(seed)
    letters = "ab\U0001f600é"[:rng.randint(1, 4)]
    block_words = list({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(25)})
    n, longest = np.array([rng.randint(1, 5) for _ in block_words]), rng.randint(1, 5)
    block = Lattice(block_words, longest)
    expected = Counter()
    for w, k in zip(block_words, n):
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + longest) + 1):
                expected[w[i:j]] += int(k)
    assert dict(zip(block.pieces(), block.counts(n).tolist())) == dict(expected) and len(block.pieces()) == len(expected)
    scores = {p: -rng.random() * 5 for p in expected if len(p) == 1 or rng.random() < 0.7}
    values = np.array([scores.get(p, -np.inf) for p in block.pieces()])
    totals, whole, apart = Counter(), [], []
    for w, k in zip(block_words, n):
        splits = [(sum(scores[p] for p in s), s) for s in every_split(w) if all(p in scores for p in s)]
        mass = math.log(sum(math.exp(x) for x, _ in splits))
        for x, s in splits:
            for p in s:
                totals[p] += int(k) * math.exp(x - mass)
        whole.append(max(x for x, _ in splits))
        apart.append(max((x for x, s in splits if len(s) > 1), default=-math.inf))
    assert dict(zip(block.pieces(), block.expected(values, n))) == pytest.approx({p: totals[p] for p in expected})
    assert block.best(values)[0] == pytest.approx(whole) and block.best(values, split=True)[0] == pytest.approx(apart)


def test_unigram_training_and_encoding(spark):
    frequencies = frame(spark, [(w, n * 10) for w, n in WORDS.items()], "word string, n long")
    pieces = unigram.train_unigram(frequencies, vocab_size=45)
    found = {r.piece: r.score for r in pieces.collect()}
    assert {c for w in WORDS for c in w} <= set(found) and len(found) <= 40 and any(len(p) > 2 for p in found)
    vocab = vocabulary.assemble_vocab(pieces, 45)
    ids = {r.token: r.id for r in vocab.collect()}
    assert [ids[t] for t in ("<s>", "<pad>", "</s>", "<unk>", "<mask>")] == [0, 1, 2, 3, 4] and sorted(ids.values()) == list(range(len(ids)))
    encoded = unigram.encode_lines(frame(spark, [("newer QQ  lower",)], "line string"), vocab).first().ids
    names = {i: t for t, i in ids.items()}
    assert "".join(names[i] for i in encoded) == "▁newer▁<unk>▁lower"


def test_coverage_and_templates(spark):
    frequencies = frame(spark, [("aaaaaaa", 100), ("b", 1)], "word string, n long")
    assert [r.ch for r in vocabulary.alphabet_by_coverage(frequencies, 0.99).orderBy("rank").collect()] == ["a", "▁"]
    ids, types = vocabulary.add_special_template(F.array(F.lit(7)), F.array(F.lit(8), F.lit(9)))
    row = spark.range(1).select(ids.alias("i"), types.alias("t")).first()
    assert row.i == [1, 7, 2, 8, 9, 2] and row.t == [0, 0, 0, 1, 1, 1]


@pytest.mark.parametrize("size", [0, 1, 3, 50])
def test_largest_is_exact(spark, size):
    values = [(f"w{i:03d}", float((i * 7919) % 23 - 5)) for i in range(40)]
    df = frame(spark, values, "w string, s double").repartition(3)
    got = [(r.w, r.s) for r in vocabulary.largest(df, size, "s", "w").orderBy(F.desc("s"), "w").collect()]
    assert got == sorted(values, key=lambda x: (-x[1], x[0]))[:size]


def test_token_counts_keep_zeros(spark):
    tokens = frame(spark, [("a", "x"), ("a", "x"), ("b", "y"), ("z", "y")], "token string, lang string")
    counts = vocabulary.token_language_counts(tokens, frame(spark, [("a",), ("b",), ("c",)], "token string"), ["x", "y"])
    assert {(r.token, r.lang): r.n for r in counts.collect()} == {("a", "x"): 2, ("a", "y"): 0, ("b", "x"): 0, ("b", "y"): 1, ("c", "x"): 0, ("c", "y"): 0}


# --- examples -------------------------------------------------------------------------------------

def greedy(counts, limit):
    out, used, words = [], 1, []
    for i, n in enumerate(counts):
        if not n:
            continue
        if used + n > limit - 1:
            out.append(words)
            used, words = 1, []
        used += n
        words.append(i)
    return out + [words]


@pytest.mark.parametrize("limit", [4, 7, 12])
def test_chunking_is_the_greedy_rule(spark, limit):
    rng = random.Random(limit)
    lines = [[], [0], [9], [9, 1], [1, 9, 9, 1]] + [[rng.randint(0, 6) for _ in range(rng.randint(1, 30))] for _ in range(60)]
    rows = [(i, [[100 * i + w] * n for w, n in enumerate(line)], [str(w) for w in range(len(line))]) for i, line in enumerate(lines)]
    df = frame(spark, rows, "k long, ids array<array<int>>, labels array<string>")
    got = {}
    for r in examples.chunk_by_length(df, limit, labels="labels").collect():
        got.setdefault(r.k, {})[r.example_no] = r
    for i, line in enumerate(lines):
        expected = greedy(line, limit)
        assert sorted(got[i]) == list(range(1, len(expected) + 1))
        for no, words in enumerate(expected, 1):
            r = got[i][no]
            assert r.labels == [str(w) for w in words] and r.n_words == len(words)
            assert r.input_ids == [0] + [100 * i + w for w in words for _ in range(line[w])] + [2]
            assert [r.input_ids[p[0]] for p in r.alignment] == [100 * i + w for w in words]
            assert [len(p) for p in r.alignment] == [line[w] for w in words]


def test_alignment_covers_the_pieces(spark):
    df = frame(spark, [(1, [["a", "b"], [], ["c"], ["d", "e", "f"]])], "k long, pieces array<array<string>>")
    got = [(r.word_no, r.first, r.last) for r in examples.align_words(df).orderBy("word_no").collect()]
    assert got == [(1, 1, 2), (3, 3, 3), (4, 4, 6)]


def test_masking_shares(spark):
    df = spark.range(400).select("id", F.concat(F.array(F.lit(0)), F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: i + 100), F.array(F.lit(2))).alias("input_ids"))
    total = chosen = masked = kept = 0
    for r in examples.mask_tokens(df, ["id"]).collect():
        for x, y, label in zip(r.input_ids, r.masked_ids, r.mask_labels):
            assert label in (-100, x) and (label != -100 or x == y)
            assert x > 4 or label == -100
            total += x > 4
            chosen += label != -100
            masked += label != -100 and y == 4
            kept += label != -100 and y == x
    assert chosen / total == pytest.approx(0.15, abs=0.01)
    assert masked / chosen == pytest.approx(0.8, abs=0.02) and kept / chosen == pytest.approx(0.1, abs=0.02)


@pytest.mark.parametrize("cursor", [0, 3, 17])
def test_resume_serves_every_row_once_by_modulo(spark, cursor):
    lines = frame(spark, [(s, i, f"{s}{i}") for s, n in (("a", 5), ("b", 8), ("c", 7)) for i in range(n)], "shard string, i long, line string")
    epoch = examples.epoch_order(lines, "shard", ["i"])
    shards = {}
    for r in epoch.collect():
        shards.setdefault(r.shard_no, {})[r.index_in_shard] = r.line
    expected, request = [], 0
    for no in sorted(shards):
        n = len(shards[no])
        for _ in range(n):
            expected.append((request, shards[no][request % n]))
            request += 1
    got = sorted((r.request, r.line) for r in examples.resume_epoch(epoch, cursor).collect())
    assert got == expected[cursor:]
    assert examples.resume_epoch(epoch, cursor, reset=True).count() == 20


def test_class_weight(spark):
    rows = [(0, x) for x in (0, 0, 0, 1)] + [(1, x) for x in (0, 0)] + [(2, x) for x in (0, 1, 1)]
    got = {r.batch: r.outside_weight for r in examples.batch_class_weight(frame(spark, rows, "batch long, label_id int")).collect()}
    assert got == {0: pytest.approx(1 / 3), 1: 1.0, 2: 1.0}


# --- embeddings --------------------------------------------------------------------------------------

def small_matrices(spark):
    old = [("<s>", 0), ("<pad>", 1), ("</s>", 2), ("<unk>", 3), ("<mask>", 4), ("▁the", 5), ("▁cat", 6), ("ing", 7), ("мир", 8)]
    rows = [(t, i, [float(i + d) for d in range(3)]) for t, i in old]
    new = [("<s>", 0), ("<pad>", 1), ("</s>", 2), ("<unk>", 3), ("<mask>", 4), ("▁the", 5), ("▁dog", 6), ("ed", 7), ("дом", 8), ("中", 9)]
    return frame(spark, rows, "token string, id long, vector array<float>"), frame(spark, new, "token string, id long"), dict((t, v) for t, _, v in rows)


def test_combined_precedence(spark):
    old, new, rows = small_matrices(spark)
    got = {r.token: r for r in embed.init_combined(old, new, 3, **embed.PRESETS["script+pos+ident"]).collect()}
    assert got["<mask>"].origin == "special" and got["<mask>"].vector == rows["<mask>"]
    assert got["▁the"].origin == "identity" and got["▁the"].vector == rows["▁the"]
    assert got["▁dog"].origin == "script" and got["中"].origin == "random"
    # one Cyrillic medial token: no spread, so the draw is its mean
    assert got["дом"].origin == "script" and got["дом"].vector == pytest.approx(rows["мир"])
    overwritten = {r.token: r for r in embed.init_combined(old, new, 3, by_script=True, reproduce_special_overwrite=True).collect()}
    assert overwritten["<mask>"].origin == "script"
    plain = {r.token: r for r in embed.init_combined(old, new, 3, **embed.PRESETS["identity"]).collect()}
    assert plain["▁dog"].origin == "random" and plain["▁the"].origin == "identity"
    with pytest.raises(ValueError):
        embed.init_combined(old, new, 3, by_position=True)


def test_start_rows_look_normal(spark):
    vectors = np.array([r.vector for r in embed.init_random(spark.range(300).withColumn("token", F.lit("x")), 16).collect()])
    assert abs(vectors.mean()) < 0.05 and abs(vectors.std() - 1) < 0.05


def test_moments_of_a_single_member(spark):
    rows = frame(spark, [("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [5.0, 5.0])], "category string, vector array<float>")
    got = {r.category: r for r in embed.category_moments(rows).collect()}
    assert got["a"].mean == [2.0, 4.0] and got["a"].std == pytest.approx([math.sqrt(2), math.sqrt(8)]) and got["b"].std is None


def sparsemax(z):
    z = np.asarray(z)
    low, high = z.min() - 1, z.max()
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if np.maximum(z - mid, 0).sum() > 1 else (low, mid)
    return np.maximum(z - low, 0)


@pytest.mark.parametrize("tile", [4, 1000])
def test_similarity_in_tiles_equals_dense(spark, tile):
    rng = np.random.default_rng(5)
    aux_new, aux_old, source = rng.normal(size=(15, 6)), rng.normal(size=(22, 6)), rng.normal(size=(22, 3))
    new = frame(spark, [(i, v.tolist()) for i, v in enumerate(aux_new)], "id long, aux array<double>")
    overlap = frame(spark, [(i + 100, v.tolist(), s.tolist()) for i, (v, s) in enumerate(zip(aux_old, source))], "id long, aux array<double>, vector array<double>")
    got = {r.id: r.vector for r in similarity.init_by_similarity(new, overlap, tile).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    similar = unit(aux_new) @ unit(aux_old).T
    assert len(got) == 15
    for i in range(15):
        assert got[i] == pytest.approx(sparsemax(similar[i]) @ source)


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5)) + 4
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(data)], "id long, vector array<double>")
    got = projection.project_pca(df, projection.fit_pca(df)).orderBy("id").collect()
    _, _, axes = np.linalg.svd(data - data.mean(axis=0), full_matrices=False)
    for k, name in enumerate(("pc1", "pc2")):
        axis = axes[k] * np.sign(axes[k][np.abs(axes[k]).argmax()])
        assert [r[name] for r in got] == pytest.approx(((data - data.mean(axis=0)) @ axis).tolist())


def test_ellipse_and_views(spark):
    points = frame(spark, [("a", float(i), float(i * i)) for i in range(6)] + [("b", 1.0, 2.0)] * 2, "script string, x double, y double")
    got = projection.confidence_ellipse(points).collect()
    assert len(got) == 1
    cov = np.cov(range(6), [i * i for i in range(6)])
    r = cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1])
    assert (got[0].pearson, got[0].radius_x, got[0].scale_y) == pytest.approx((r, math.sqrt(1 + r), 3 * math.sqrt(cov[1, 1])))
    counts = frame(spark, [("Latin", 9000), ("Han", 50), ("Hiragana", 3)], "category string, tokens long")
    views = {(r.script, r.view) for r in script_cluster_select(counts).collect()}
    assert views == {("Latin", "frequent"), ("Han", "cluster"), ("Han", "Chinese"), ("Hiragana", "cluster"), ("Hiragana", "frequent"), ("Hiragana", "Japanese")}


# --- metrics --------------------------------------------------------------------------------------------

def chunks(spark, tags):
    df = frame(spark, [(0, i, t) for i, t in enumerate(tags)], "batch long, i long, tag string")
    return {(r.first, r.last, r.type) for r in metrics.entity_chunks(df.withColumn("i", F.col("i") + 1), ["batch"], "i").collect()}


@pytest.mark.parametrize("tags,expected", [
    (["O", "I-PER", "I-PER"], {(2, 3, "PER")}),
    (["I-PER", "I-ORG", "O"], {(1, 1, "PER"), (2, 2, "ORG")}),
    (["B-PER", "B-PER", "I-PER"], {(1, 1, "PER"), (2, 3, "PER")}),
    (["B-LOC", "I-LOC", "I-PER", "I-PER"], {(1, 2, "LOC"), (3, 4, "PER")}),
    (["O", "O"], set()),
])
def test_entity_chunks(spark, tags, expected):
    assert chunks(spark, tags) == expected


def test_entity_crosses_a_sentence_inside_a_batch(spark):
    df = frame(spark, [(0, 1, 1, "B-PER"), (0, 2, 2, "I-PER"), (1, 3, 1, "I-PER")], "batch long, sent long, i long, tag string")
    got = {(r.batch, r.first, r.last) for r in metrics.entity_chunks(df, ["batch"], "i").collect()}
    assert got == {(0, 1, 2), (1, 1, 1)}
    nothing = df.select("batch", "sent", "i", F.lit("O").alias("tag"), F.lit("O").alias("pred_tag"))
    assert metrics.ner_f1(nothing, ["batch"], "i").first().f1 == 0.0
    half = df.withColumn("pred_tag", F.when(F.col("batch") == 1, "B-PER").otherwise("O"))
    assert metrics.ner_f1(half, ["batch"], "i").first()[:] == (2, 1, 1, pytest.approx(2 / 3))


def test_per_word_baseline_rules(spark):
    train = frame(spark, [("a", "VERB"), ("a", "NOUN"), ("b", "X"), ("b", "_"), ("b", "_")], "word string, label string")
    test = frame(spark, [("a", "NOUN"), ("a", "VERB"), ("b", "X"), ("b", "_"), ("new", "X")], "word string, label string")
    assert metrics.per_word_majority_baseline(train, test, POS_LABELS).first()[0] == pytest.approx(40.0)  # the tie goes to NOUN
    assert metrics.per_word_majority_baseline(train, test, POS_LABELS, exclude_unlabelled=True).first()[0] == pytest.approx(50.0)
    assert metrics.majority_label_baseline(train).first()[0] == pytest.approx(100 / 3)


def replay(scores, patience, every):
    best, used, best_epoch, epoch = 0, 0, None, 0
    stopped = False
    for epoch in range(1, len(scores) + 1):
        if epoch % every:
            continue
        if best > scores[epoch - 1]:
            if used == patience:
                stopped = True
                break
            used += 1
        else:
            best, used, best_epoch = scores[epoch - 1], 0, epoch
    return epoch, stopped, epoch - used * every, best_epoch


@pytest.mark.parametrize("patience,every", [(0, 1), (1, 2), (2, 2), (3, 1)])
def test_early_stopping(spark, patience, every):
    rng = random.Random(patience * 10 + every)
    series = {f"t{i}": [rng.randint(0, 5) / 5 for _ in range(rng.randint(1, 25))] for i in range(40)}
    df = frame(spark, [(t, e + 1, s) for t, xs in series.items() for e, s in enumerate(xs)], "trial string, epoch long, score double")
    got = {r.trial: (r.stopped_at, r.early, r.reported_epochs, r.best_epoch) for r in metrics.early_stopping_replay(df, patience, every, chunk=4).collect()}
    assert got == {t: replay(xs, patience, every) for t, xs in series.items()}


def test_trial_summary_uses_population_deviation(spark):
    df = frame(spark, [("x", 1.0, 2.0), ("x", 3.0, 4.0)], "lang string, score double, epochs double")
    row = metrics.trial_summary(df, ["lang"]).first()
    assert (row.mean_score, row.std_score, row.mean_epochs, row.std_epochs) == (2.0, 1.0, 3.0, 1.0)


def test_similarity_as_a_flag(spark):
    old = frame(spark, [("<s>", 0, [9.0, 9.0]), ("a", 1, [1.0, 0.0]), ("b", 2, [0.0, 1.0])], "token string, id long, vector array<double>")
    new = frame(spark, [("<s>", 0), ("b", 1), ("c", 2), ("a", 3), ("d", 4)], "token string, id long")
    aux = frame(spark, [(0, [-1.0, -1.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 0.0])], "id long, aux array<double>")
    found = {r.token: r for r in embed.init_combined(old, new, 2, auxiliary=aux).collect()}
    assert {t: r.origin for t, r in found.items()} == {"<s>": "special", "a": "identity", "b": "identity", "c": "similarity", "d": "random"}
    assert list(found["b"].vector) == [0.0, 1.0] and list(found["c"].vector) == [0.0, 1.0]  # c's description equals b's
    assert embed.matched_tokens(old, new).first().asDict() == {"matched": 3, "new_tokens": 5, "share": 0.6}


def test_trigram_scores_of_a_batch():
    from lexmesh.operators import language_id
    rng = random.Random(3)
    lines = ["", "a", "", "ab", "é漢𝒳 z"] + ["".join(rng.choice("abc é漢𝒳") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["long " * 60_000, "", "end", ""]
    weights = np.random.default_rng(1).normal(size=(1 << 10, 3))
    wanted = []
    for line in lines:
        points = [ord(c) for c in f" {line} "]
        wanted.append(sum((weights[(a * 961 + b * 31 + c) % (1 << 10)] for a, b, c in zip(points, points[1:], points[2:])), np.zeros(3)))
    found = language_id.line_scores(pd.Series(lines), weights)
    assert np.allclose(found, wanted, rtol=1e-9, atol=1e-9)
    assert language_id.line_scores(pd.Series([], dtype=object), weights).shape == (0, 3)


def test_language_counts_leave_out_nulls(spark):
    from lexmesh.operators import language_id
    rows = [("a", "xyz"), ("b", "uvw"), ("a", "xyx"), (None, "xyz"), ("b", None), ("a", "")]
    model = language_id.fit_language_id(spark.createDataFrame(rows, "lang string, line string"))
    assert model.languages == ["a", "b"] and np.allclose(np.exp(model.priors), [0.75, 0.25])
    told = {r.line: r.predicted for r in language_id.identify_language(spark.createDataFrame([("xyz",), ("uvw",), (None,)], "line string"), model).collect()}
    assert told["xyz"] == "a" and told["uvw"] == "b" and None in told
