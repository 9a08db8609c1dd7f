"""Unicode script and word position of vocabulary tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.functions.text import WORD_INITIAL
from lexmesh.operators.vocabulary import characters
from lexmesh.sources.scripts import UNLISTED, expand_ranges, jvm_script

# Tokens shared by old and new vocabularies, and the name of their category.
SPECIAL_TOKENS = ("<s>", "</s>", "<unk>", "<pad>", "<mask>")
SPECIAL_CATEGORY = "xlmr_special"

# Scripts left out of, or grouped for, the cluster views.
SKIPPED_SCRIPTS = ("Cyrillic", "Braille", "Common", "Latin")
ALWAYS_FREQUENT = ("Katakana", "Hiragana")
MIXED_GROUP = ("Common", "Cyrillic", "Latin")
SCRIPT_FAMILIES = {
    "Dravidian": ("Kannada", "Malayalam", "Tamil", "Telugu"),
    "Indo-Aryan": ("Bengali", "Devanagari", "Gujarati", "Gurmukhi", "Oriya", "Sinhala"),
    "Semitic": ("Arabic", "Hebrew", "Syriac"),
    "Tai-Kadai": ("Lao", "Thai"),
    "Japanese": ("Hiragana", "Katakana"),
    "Chinese": ("Bopomofo", "Han"),
}


def token_text(token: Column) -> Column:
    """The token without one leading marker, unless the marker is the whole token."""
    return F.when(token.startswith(WORD_INITIAL) & (F.char_length(token) > 1), F.substr(token, F.lit(2))).otherwise(token)


def is_special(token: Column) -> Column:
    return token.isin(*SPECIAL_TOKENS)


def script_array(text: Column) -> Column:
    """Script of every character, from the JVM's Unicode data."""
    return F.transform(characters(text), lambda c: jvm_script(F.ascii(c)))


def char_scripts(tokens: DataFrame, table: DataFrame | None = None, token: str = "token") -> DataFrame:
    """One row per character: ``pos`` from 1, ``ch`` and ``script``.

    A given ``(cp_from, cp_to, script)`` table is expanded to code points (bounded by Unicode) and
    broadcast; without one the script is a plain expression.
    """
    others = tokens.columns
    rows = tokens.select(*others, F.posexplode(characters(F.col(token))).alias("_pos", "ch"))
    rows = rows.select(*others, (F.col("_pos") + 1).alias("pos"), "ch")
    if table is None:
        return rows.withColumn("script", jvm_script(F.ascii("ch")))
    points = F.broadcast(expand_ranges(table))
    return rows.withColumn("cp", F.ascii("ch")).join(points, "cp", "left").withColumn(
        "script", F.coalesce("script", F.lit(UNLISTED))).drop("cp")


def top_script(scripts: Column, preferred: Sequence[str] | None = None) -> Column:
    """Most frequent entry of a script array; a tie goes to a preferred script, then to the first seen."""
    wanted = F.array(*[F.lit(s) for s in preferred]) if preferred else F.array().cast("array<string>")
    ranked = F.transform(F.array_distinct(scripts), lambda s: F.struct(
        F.size(F.filter(scripts, lambda x: x == s)).alias("n"),
        F.array_contains(wanted, s).cast("int").alias("in_set"),
        (-F.array_position(scripts, s)).alias("seen"),
        s.alias("script")))
    return F.array_max(ranked)["script"]


def with_scripts(tokens: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Add ``scripts`` (of the token text) to a vocabulary ``(token, id)``."""
    if table is None:
        return tokens.withColumn("scripts", script_array(token_text(F.col("token"))))
    text = tokens.withColumn("_text", token_text(F.col("token")))
    per_char = char_scripts(text, table, "_text")
    gathered = per_char.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "script"))).alias("s"))
    return tokens.join(gathered.select("id", F.transform("s", lambda x: x["script"]).alias("scripts")), "id")


def script_categories(vocab: DataFrame, word_position: bool = False, table: DataFrame | None = None,
                      preferred: Sequence[str] | None = None) -> DataFrame:
    """``(token, id, category)``: the top script, optionally with position; special tokens are also
    members of their own category."""
    token = F.col("token")
    category = top_script(F.col("scripts"), preferred)
    if word_position:
        category = F.concat(category, F.when(token.startswith(WORD_INITIAL), F.lit("_initial")).otherwise(F.lit("_medial")))
    scripted = with_scripts(vocab.select("token", "id"), table).select("token", "id", category.alias("own"))
    both = F.when(is_special(token), F.array("own", F.lit(SPECIAL_CATEGORY))).otherwise(F.array("own"))
    return scripted.select("token", "id", F.explode(both).alias("category"))


def script_token_counts(categories: DataFrame) -> DataFrame:
    return categories.groupBy("category").agg(F.count(F.lit(1)).alias("tokens"))


def unlisted_tokens(categories: DataFrame) -> DataFrame:
    """Tokens whose script is not in the table."""
    return categories.filter(F.col("category") == UNLISTED).select("id", "token")


def script_cluster_select(counts: DataFrame, frequent_above: int = 4000) -> DataFrame:
    """Scripts per view: all but the dominant ones, the frequent ones, and six fixed families."""
    script = F.col("category")
    views = [F.when(~script.isin(*SKIPPED_SCRIPTS), F.lit("cluster")),
             F.when((F.col("tokens") > frequent_above) | script.isin(*ALWAYS_FREQUENT), F.lit("frequent"))]
    views += [F.when(script.isin(*members), F.lit(name)) for name, members in SCRIPT_FAMILIES.items()]
    return counts.select(script.alias("script"), "tokens", F.explode(F.array_compact(F.array(*views))).alias("view"))
