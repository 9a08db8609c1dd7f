"""Training examples: alignment, chunking, batching, padding, masking and epoch order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.functions.hashing import below, hash_key, uniform
from lexmesh.functions.numbering import number_rows, rank_by_hash
from lexmesh.operators.tagged import IGNORED
from lexmesh.session import lookup


def truncate_encode(ids: Column, max_length: int = 256, bos: int = 0, eos: int = 2) -> Column:
    """Begin and end tokens around the ids, at most ``max_length`` long; the end token survives."""
    return F.concat(F.array(F.lit(bos)), F.slice(ids, 1, max_length - 2), F.array(F.lit(eos)))


def word_starts(counts: Column) -> Column:
    """Position of each word's first piece, from 1, given the pieces per word.

    Linear in the pieces: the words' piece numbers are laid end to end and the first ones kept.
    """
    numbered = F.flatten(F.transform(counts, lambda n: F.sequence(F.lit(1), n)))
    placed = F.transform(numbered, lambda k, at: F.struct(k.alias("k"), (at + 1).alias("at")))
    return F.transform(F.filter(placed, lambda x: x["k"] == 1), lambda x: x["at"])


def chunk_limits(counts: Column, room: int) -> Column:
    """Limits of greedy bins over words of ``counts`` pieces, at most ``room`` pieces a bin.

    Bin i holds the words from limit i up to, not including, limit i + 1. A longer word sits alone;
    if it is the first word, an empty bin precedes it. No word at all gives one empty bin.
    """
    start = F.struct(F.array(F.lit(0)).alias("limits"), F.lit(0).alias("used"), F.lit(0).alias("at"))

    def place(bins: Column, n: Column) -> Column:
        fits = bins["used"] + n <= room
        return F.struct(F.when(fits, bins["limits"]).otherwise(F.concat(bins["limits"], F.array(bins["at"]))).alias("limits"),
                        F.when(fits, bins["used"] + n).otherwise(n).alias("used"), (bins["at"] + 1).alias("at"))

    return F.aggregate(counts, start, place, lambda bins: F.concat(bins["limits"], F.array(bins["at"])))


def align_words(lines: DataFrame, pieces: str = "pieces") -> DataFrame:
    """Per word its first and last subword position, counted from 1 after the begin token.

    ``pieces`` is an array of piece arrays, one per word; words without pieces are skipped. A line
    is one row until the end, so nothing is shuffled.
    """
    others = [c for c in lines.columns if c != pieces]
    numbered = F.transform(pieces, lambda p, i: F.struct((i + 1).alias("word_no"), F.size(p).alias("n_pieces")))
    kept = lines.select(*others, F.filter(numbered, lambda w: w["n_pieces"] > 0).alias("_w"))
    placed = kept.select(*others, F.explode(F.arrays_zip(
        F.col("_w").alias("word"), word_starts(F.transform("_w", lambda w: w["n_pieces"])).alias("first"))).alias("z"))
    return placed.select(*others, "z.word.word_no", "z.word.n_pieces", "z.first",
                         (F.col("z.first") + F.col("z.word.n_pieces") - 1).alias("last"))


def chunk_by_length(lines: DataFrame, max_length: int, ids: str = "ids", labels: str | None = None, bos: int = 0, eos: int = 2) -> DataFrame:
    """Lines of word id arrays to examples of at most ``max_length`` ids, begin and end included.

    Output: ``example_no``, ``first_word``, ``n_words``, ``input_ids``, ``alignment`` (subword
    positions per word) and the words' ``labels`` if given. All of it stays inside the line's row.
    """
    others = [c for c in lines.columns if c not in (ids, labels)]
    columns = [F.col(ids).alias("ids")] + ([F.col(labels).alias("label")] if labels else [])
    kept = lines.select(*others, F.filter(F.arrays_zip(*columns), lambda w: F.size(w["ids"]) > 0).alias("_w"))
    counts = F.transform("_w", lambda w: F.size(w["ids"]))
    laid = kept.select(*others, "_w", chunk_limits(counts, max_length - 2).alias("_limits"))
    bins = laid.select(*others, "_w", "_limits", F.explode(F.sequence(F.lit(1), F.size("_limits") - 1)).alias("example_no"))
    low, high = F.get("_limits", F.col("example_no") - 1), F.get("_limits", F.col("example_no"))
    taken = bins.withColumn("_w", F.slice("_w", low + 1, high - low))
    aligned = F.zip_with("_w", word_starts(counts), lambda w, s: F.sequence(s, s + F.size(w["ids"]) - 1))
    out = [*others, "example_no", low.alias("first_word"), (high - low).alias("n_words"),
           F.concat(F.array(F.lit(bos)), F.flatten(F.transform("_w", lambda w: w["ids"])), F.array(F.lit(eos))).alias("input_ids"),
           aligned.alias("alignment")]
    if labels:
        out.append(F.transform("_w", lambda w: w["label"]).alias("labels"))
    return taken.select(*out)


def fertility(words: DataFrame, by: Sequence[str] = ("lang",)) -> DataFrame:
    """Mean pieces per word, over words with at least one piece; ``words`` holds ``n_pieces``."""
    kept = words.filter(F.col("n_pieces") > 0)
    return kept.groupBy(*by).agg(F.sum("n_pieces").alias("subwords"), F.count(F.lit(1)).alias("words"),
                                 (F.sum("n_pieces") / F.count(F.lit(1))).alias("fertility"))


def assign_batches(df: DataFrame, order: Sequence[str], size: int, shuffle_seed: int | None = None) -> DataFrame:
    """0-based ``batch`` of consecutive rows; ``row_in_batch`` from 1."""
    if shuffle_seed is None:
        numbered = number_rows(df, order, name="_row")
    else:
        numbered = rank_by_hash(df, shuffle_seed, order, name="_row")
    index = F.col("_row") - 1
    return numbered.withColumn("batch", F.floor(index / size).cast("long")).withColumn(
        "row_in_batch", (index % size + 1).cast("long")).drop("_row")


def pad_batches(batches: DataFrame, pad: int = 1) -> DataFrame:
    """Pad ``input_ids`` to the longest example of the batch."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("batch"))
    missing = F.col("_longest") - F.size("input_ids")
    return batches.withColumn("_longest", longest).withColumn(
        "input_ids", F.concat("input_ids", F.array_repeat(F.lit(pad), missing))).drop("_longest")


def mask_tokens(df: DataFrame, key: Sequence[str], ids: str = "input_ids", probability: float = 0.15, mask: int = 4, vocab_size: int = 32768,
                special: Sequence[int] = (0, 1, 2, 3, 4), seed: int = 1) -> DataFrame:
    """Masked-LM corruption as array expressions: ``masked_ids`` and ``mask_labels``.

    A chosen position becomes the mask id (80 %), a random id (10 %) or stays (10 %); its label is
    the original id, all other labels are -100. Special ids are never chosen.
    """
    reserved = F.array(*[F.lit(s) for s in special])
    # what the positions of a row share is spelled once: a column of its own would be merged into the expression for each of them
    shared = F.array(F.concat_ws(":", F.lit("pick"), *[F.col(k).cast("string") for k in key]))

    def draw(row: Column, x: Column, i: Column) -> Column:
        chosen = ~F.array_contains(reserved, x) & below(probability, seed, row, i)
        how = uniform(seed, F.lit("how"), *key, i)
        other = F.floor(uniform(seed, F.lit("other"), *key, i) * vocab_size).cast("int")
        return F.struct(x.alias("x"), F.when(chosen, F.when(how < 0.8, F.lit(mask)).when(how < 0.9, other).otherwise(x)).alias("y"))

    drawn = df.withColumn("_drawn", F.get(F.transform(shared, lambda row: F.transform(ids, lambda x, i: draw(row, x, i))), F.lit(0)))
    return drawn.withColumn("masked_ids", F.transform("_drawn", lambda d: F.coalesce(d["y"], d["x"]))).withColumn(
        "mask_labels", F.transform("_drawn", lambda d: F.when(d["y"].isNull(), F.lit(IGNORED)).otherwise(d["x"]))).drop("_drawn")


def batch_class_weight(words: DataFrame, label_id: str = "label_id") -> DataFrame:
    """Weight of class 0 per batch: non-0 / 0 when class 0 is the majority and another occurs."""
    others, zeros = F.count_if(F.col(label_id) != 0), F.count_if(F.col(label_id) == 0)
    counted = words.groupBy("batch").agg(others.alias("entity_words"), zeros.alias("outside_words"))
    weight = F.when((F.col("entity_words") > 0) & (F.col("outside_words") > F.col("entity_words")),
                    F.col("entity_words") / F.col("outside_words")).otherwise(F.lit(1.0))
    return counted.withColumn("outside_weight", weight)


def dataset_length(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count(F.lit(1)).alias("examples"))


def _shard_offsets(lines: DataFrame, shard: str, shuffle_seed: int | None) -> DataFrame:
    """Per shard its place in the epoch and the rows before it: one row per shard."""
    by = [hash_key(shuffle_seed, shard), F.col(shard)] if shuffle_seed is not None else [F.col(shard)]
    order = Window.partitionBy(F.lit(0)).orderBy(*by)
    sizes = lines.groupBy(shard).agg(F.count(F.lit(1)).alias("shard_rows"))
    before = F.sum("shard_rows").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select(shard, "shard_rows", F.row_number().over(order).cast("long").alias("shard_no"),
                        F.coalesce(before, F.lit(0)).alias("rows_before"))


def epoch_order(lines: DataFrame, shard: str, order: Sequence[str], shuffle_shards: bool = True, shuffle_within: bool = True,
                sort_by_length: bool = False, seed: int = 1) -> DataFrame:
    """Add ``shard_no``, ``index_in_shard`` and ``position`` (both from 0) of one epoch.

    Shards follow a seeded order or their name. Inside a shard a shuffle overrides the sort by
    descending length, which overrides file order.
    """
    if shuffle_within:
        ranked = rank_by_hash(lines, seed, order, by=[shard], name="index_in_shard")
    elif sort_by_length:
        measured = lines.withColumn("_shorter", -F.char_length("line"))
        ranked = number_rows(measured, ["_shorter", *order], by=[shard], name="index_in_shard").drop("_shorter")
    else:
        ranked = number_rows(lines, order, by=[shard], name="index_in_shard")
    placed = lookup(ranked, _shard_offsets(lines, shard, seed if shuffle_shards else None), [shard])
    placed = placed.withColumn("index_in_shard", F.col("index_in_shard") - 1)
    return placed.withColumn("position", F.col("rows_before") + F.col("index_in_shard")).drop("rows_before")


def resume_epoch(epoch: DataFrame, cursor: int, reset: bool = False) -> DataFrame:
    """The rest of an epoch from request ``cursor`` on, as (``request``, row).

    Request g is answered by row g mod n of its shard, n being that shard's size, so a shard is
    served rotated by the rows before it; ``reset`` starts over.
    """
    start = 0 if reset else cursor
    before = F.col("position") - F.col("index_in_shard")
    turn = F.pmod(F.col("index_in_shard") - before, F.col("shard_rows"))
    return epoch.withColumn("request", before + turn).filter(F.col("request") >= start)
