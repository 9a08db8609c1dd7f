"""Baselines, accuracy, entity F1 and summaries over trials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.functions.numbering import running
from lexmesh.operators.tagged import UNLABELLED, index_of


def majority_label_baseline(words: DataFrame) -> DataFrame:
    """Share of the commonest label in per cent; unlabelled words do not count."""
    counts = words.filter(F.col("label") != UNLABELLED).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.max("n") / F.sum("n") * 100).alias("majority_baseline"))


def word_label_counts(words: DataFrame) -> DataFrame:
    return words.filter(F.col("label") != UNLABELLED).groupBy("word", "label").agg(F.count(F.lit(1)).alias("n"))


def majority_label_by_word(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Commonest label of each word; a tie goes to the lower label index."""
    rank = F.struct("n", -index_of(F.col("label"), labels))
    return counts.groupBy("word").agg(F.max_by("label", rank).alias("guess"))


def per_word_majority_baseline(train: DataFrame, test: DataFrame, labels: Sequence[str], exclude_unlabelled: bool = False) -> DataFrame:
    """Per cent of test words whose commonest train label is right; unseen words are wrong.

    Test words are counted by (word, label) before the join, so a frequent word is one row.
    """
    guesses = majority_label_by_word(word_label_counts(train), labels)
    if exclude_unlabelled:
        test = test.filter(F.col("label") != UNLABELLED)
    tested = test.groupBy("word", "label").agg(F.count(F.lit(1)).alias("n"))
    joined = tested.join(guesses, "word", "left")
    right = F.sum(F.when(F.col("guess") == F.col("label"), F.col("n")).otherwise(0))
    return joined.agg((right / F.sum("n") * 100).alias("per_word_baseline"))


def predict_top1(scored: DataFrame, probabilities: str = "probabilities") -> DataFrame:
    """Index of the largest class probability; the first of equals."""
    best = F.array_position(probabilities, F.array_max(probabilities)) - 1
    return scored.withColumn("prediction", best.cast("int"))


def accuracy(words: DataFrame, by: Sequence[str] = (), exclude_unlabelled: bool = False) -> DataFrame:
    """Correct over all words; ignored labels (-100) are in the denominator unless excluded."""
    if exclude_unlabelled:
        words = words.filter(F.col("label_id") >= 0)
    return words.groupBy(*by).agg(
        F.count(F.lit(1)).alias("words"), F.count_if(F.col("prediction") == F.col("label_id")).alias("correct"),
        (F.count_if(F.col("prediction") == F.col("label_id")) / F.count(F.lit(1))).alias("accuracy"))


def _kind(tag: Column) -> Column:
    return F.substr(tag, F.lit(3))  # what follows "B-" or "I-"


def entity_chunks(words: DataFrame, sequence: Sequence[str], position: str, tag: str = "tag") -> DataFrame:
    """Entities ``(sequence..., first, last, type)`` of BIO tags.

    ``position`` numbers the words of a sequence (a sentence or a batch) without gaps. An I tag
    after O, after another type or at the start opens an entity. Only tagged words are shuffled: a
    gap in their positions shows where an O word was.
    """
    tagged = words.filter(F.col(tag) != "O").select(*sequence, F.col(position).alias("_at"), F.col(tag).alias("_tag"))
    line = Window.partitionBy(*sequence).orderBy("_at")
    rows = tagged.withColumns({"_tag_before": F.lag("_tag").over(line), "_at_before": F.lag("_at").over(line)})
    joined = (F.col("_at_before") == F.col("_at") - 1) & (_kind(F.col("_tag_before")) == _kind(F.col("_tag")))
    opens = (F.substring("_tag", 1, 1) == "B") | ~F.coalesce(joined, F.lit(False))
    numbered = rows.withColumn("_entity", F.sum(opens.cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*sequence, "_entity", _kind(F.col("_tag")).alias("type")).agg(
        F.min("_at").alias("first"), F.max("_at").alias("last")).drop("_entity")


def ner_f1(words: DataFrame, sequence: Sequence[str], position: str, tag: str = "tag", predicted: str = "pred_tag") -> DataFrame:
    """Micro entity F1 of predicted against true tags; 0 when there is no entity.

    Both taggings go through the same window pass, under a key that tells them apart.
    """
    sides = F.explode(F.array(F.struct(F.lit(1).alias("true"), F.col(tag).alias("tag")), F.struct(F.lit(0).alias("true"), F.col(predicted).alias("tag"))))
    both = words.filter((F.col(tag) != "O") | (F.col(predicted) != "O")).select(*sequence, position, sides.alias("_s"))
    found = entity_chunks(both.select(*sequence, position, "_s.true", "_s.tag"), [*sequence, "true"], position)
    spans = found.groupBy(*sequence, "first", "last", "type").agg(F.max("true").alias("t"), F.max(1 - F.col("true")).alias("p"))
    totals = spans.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("true_entities"), F.coalesce(F.sum("p"), F.lit(0)).alias("predicted_entities"),
                       F.coalesce(F.sum(F.col("t") * F.col("p")), F.lit(0)).alias("matched"))
    size = F.col("true_entities") + F.col("predicted_entities")
    return totals.withColumn("f1", F.when(size > 0, 2.0 * F.col("matched") / size).otherwise(F.lit(0.0)))


def trial_summary(trials: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation over seeds, rounded to 2."""
    return trials.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trials"),
        F.round(F.avg("score"), 2).alias("mean_score"), F.round(F.stddev_pop("score"), 2).alias("std_score"),
        F.round(F.avg("epochs"), 2).alias("mean_epochs"), F.round(F.stddev_pop("epochs"), 2).alias("std_epochs"))


def early_stopping_replay(series: DataFrame, patience: int, eval_every: int = 2, chunk: int = 1 << 16) -> DataFrame:
    """Where training stops, given ``(trial, epoch, score)`` with epochs 1..n.

    Every ``eval_every`` epochs the score is compared with the best so far (0 at the start): lower
    costs a step of patience, and stops once ``patience`` steps are used; equal or higher resets.
    ``reported_epochs`` is the stopping epoch less the counted steps; ``best_epoch`` the last best.
    """
    judged = F.col("epoch") % eval_every == 0
    scored = series.withColumn("_score", F.when(judged, F.col("score")))
    best = running(scored, ["trial"], "epoch", F.col("_score"), "_prior", "max", inclusive=False, chunk=chunk)
    best = best.withColumn("_improves", F.col("_score") >= F.greatest(F.coalesce("_prior", F.lit(0.0)), F.lit(0.0)))
    last = running(best, ["trial"], "epoch", F.when(F.col("_improves"), F.col("epoch")), "_best", "max", chunk=chunk)
    lost = (F.col("epoch") - F.coalesce("_best", F.lit(0))) / eval_every  # judged epochs since the best one
    # what follows the stop does not matter to it, so one aggregation tells both outcomes
    ends = last.groupBy("trial").agg(
        F.max("epoch").alias("_epochs"),
        F.min(F.when(judged & (lost == patience + 1), F.col("epoch"))).alias("_stop"),
        F.max(F.when(judged, F.col("epoch"))).alias("_last"), F.max("_best").alias("_best"))
    early = F.col("_stop").isNotNull()
    unused = F.coalesce(F.col("_last") - F.coalesce("_best", F.lit(0)), F.lit(0))
    return ends.select(
        "trial", F.coalesce("_stop", "_epochs").cast("long").alias("stopped_at"), early.alias("early"),
        F.when(early, F.col("_stop") - patience * eval_every).otherwise(F.col("_epochs") - unused).cast("long").alias("reported_epochs"),
        F.when(early, F.nullif(F.col("_stop") - (patience + 1) * eval_every, F.lit(0))).otherwise(F.col("_best")).cast("long").alias("best_epoch"))


def select_best_trial_checkpoint(series: DataFrame, eval_every: int = 1) -> DataFrame:
    """Epoch with the best score per trial, the latest of equals; only every ``eval_every``-th epoch is judged."""
    judged = series.filter(F.col("epoch") % eval_every == 0)
    return judged.groupBy("trial").agg(F.max_by("epoch", F.struct("score", "epoch")).alias("best_epoch"), F.max("score").alias("best_score"))
