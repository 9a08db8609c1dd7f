"""Secret scans through an incremental ledger of blobs. DataFrame functions only.

Every version of a file is addressed by the SHA-256 of its content. The ledger is a Parquet table partitioned by
rule version, with a row per blob already scanned; a run scans the blobs that have no row under the present rule
version, appends their findings and joins the ledger back to all paths that hold the content. A blob that comes
back in another path, copy or revision is never scanned again; a new rule version scans everything once. Runs that start
before another has appended scan the same blobs and append equal rows; the ledger is reduced to one row per blob when it is read, so
this costs a scan and changes no result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.session import scratch_folder

# Kinds in the order in which ties are listed, their patterns, and what a match must hold.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
LEAST_ASSIGNED = 6
RULES = "1"

LEDGER = "blob string, n_assign long, n_access long, n_hex long, spans string"


def _matches(kind: str) -> Column:
    """(kind number, gap before, match length, kept) of each match of one kind in ``text``.

    Access keys and hex runs take the whole run of their class, so the least length can stand in the pattern. An
    assignment that is too short still uses up its text, hence it is matched first and dropped afterwards.
    """
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    gaps = F.split("text", pattern, -1)
    if kind == "assign":
        kept = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(2)), lambda v: F.char_length(v) >= LEAST_ASSIGNED)
    else:
        kept = F.transform(found, lambda v: F.lit(True))
    rows = F.arrays_zip(found.alias("found"), F.slice(gaps, 1, F.size(found)).alias("gap"), kept.alias("kept"))
    sizes = F.transform(rows, lambda r, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.char_length(r["gap"]).alias("gap"),
        F.char_length(r["found"]).alias("size"), r["kept"].alias("kept")))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,kept:boolean>>")
    return F.when(F.col("text").rlike(pattern), sizes).otherwise(none)


def scan(blobs: DataFrame) -> DataFrame:
    """Findings of (blob, text) rows, one per blob; ``spans`` is kind:start:end by start, then kind, comma-joined."""
    matches = F.concat(*[_matches(kind) for kind in KINDS])
    rows = blobs.select("blob", F.explode_outer(matches).alias("m")).select("blob", "m.*")
    # starts are running sums of gaps and matches, so a text with a great many matches stays linear
    before = "partition by blob, kind order by i rows between unbounded preceding and current row"
    placed = rows.withColumn("end", F.expr(f"sum(gap + size) over ({before})")).withColumn("start", F.col("end") - F.col("size"))
    names = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    item = F.struct(F.col("start"), F.col("kind"), F.concat_ws(":", names, F.col("start").cast("string"), F.col("end").cast("string")).alias("span"))
    counts = [F.count_if(F.col("kept") & (F.col("kind") == i)).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    spans = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kept"), item))), lambda x: x["span"]), ",").alias("spans")
    return placed.groupBy("blob").agg(*counts, spans)


def scan_versions(versions: DataFrame, ledger: str, rules: str = RULES) -> DataFrame:
    """Findings of all (path, text) versions: path, blob, n_assign, n_access, n_hex, spans.

    ``ledger`` is a folder that lasts between runs. Null text is empty text; null paths and repeated rows are kept
    as they are. Columns other than path and text are dropped, so their names cannot clash. Texts without a finding
    get zero counts and an empty ``spans``. Spans of one start are listed in the order of ``KINDS``.
    """
    if not re.fullmatch(r"[\w.-]+", rules):
        raise ValueError("a rule version is letters, digits, dots and hyphens")
    spark, folder = versions.sparkSession, f"{ledger}/rules={rules}"
    # mode "ignore" makes the table if it is new and leaves one that is there alone
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(folder)
    known = spark.read.schema(LEDGER).parquet(folder).select("blob")
    addressed = versions.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    # one text per content; copies meet inside a task first, so a content that is a third of all rows moves once a task
    contents = addressed.groupBy("blob").agg(F.first("text").alias("text"))
    scan(contents.join(known, "blob", "left_anti")).write.mode("append").parquet(folder)
    rows = spark.read.schema(LEDGER).parquet(folder).filter(F.col("spans") != "")
    found = rows.groupBy("blob").agg(*[F.max(f"n_{k}").alias(f"n_{k}") for k in KINDS], F.max("spans").alias("spans"))
    joined = addressed.select("path", "blob").join(found, "blob", "left")
    zero = F.lit(0).cast("long")
    return joined.select("path", "blob", *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS], F.coalesce("spans", F.lit("")).alias("spans"))


def find_secrets(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Documents as one revision of a tree whose paths are doc_id; a fresh ledger unless one is given."""
    versions = docs.select(F.col("doc_id").alias("path"), "text")
    found = scan_versions(versions, ledger or scratch_folder(docs.sparkSession, "secret-ledger"))
    return found.select(F.col("path").alias("doc_id"), *[f"n_{k}" for k in KINDS], F.sha2("spans", 256).alias("base_sha256"), "spans")
