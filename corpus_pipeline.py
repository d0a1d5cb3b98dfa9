"""A corpus from raw documents to a training mix, in stages that each read what the one before wrote."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from querytide.functions.stage import drop_stages, staged, stages
from querytide.llm import decontaminate, jaccard_join, line_dedup, mixing, queries, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


_working: dict[str, list[str]] = {}


def stage(work):
    """A stage whose working tables are removed when the next one begins, for by then its result is written."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        drop_stages(spark, _working.pop(app, []))
        before = set(stages(spark))
        out = work(spark, docs, sf_dir)
        if work.__name__ != "mixed":  # no stage follows
            _working[app] = [p for p in stages(spark) if p not in before]
        return out

    return run_stage


@stage
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among them, scores below its threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, toxicity.fold("doc_id", 4, 2))
    scored = toxicity.score(docs.select(*COLUMNS), model, "_score")
    return scored.where(F.col("_score") < toxicity.THRESHOLD).select(*COLUMNS)


@stage
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that come earlier; those of which no word is left go. n_chars is counted anew."""
    cut = line_dedup.deduplicated(docs.select(*COLUMNS))
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text")).cast("long")
    return cut.where(left).select("doc_id", "text", "lang", "source", chars.alias("n_chars"))


def keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and `_key`: doc_id (rows without one last) and 128 bits of the text.

    Rows of the same key have the same text, so decisions on a text reach exactly its rows, also where ids repeat or are missing.
    """
    bits = [F.xxhash64(F.lit(seed), "text").alias(f"bits{seed}") for seed in (1, 2)]
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), *bits)
    return docs.select(*COLUMNS, key.alias("_key"))


@stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of every group of near-duplicates, one row of it.

    Rows without doc_id come after all others; texts without words are no duplicates of each other.
    """
    rows = keyed(docs)
    groups = staged(jaccard_join.classes(rows.select(F.col("_key").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_key"))
    gone = staged(groups.where("_key <> component_id").select("_key").distinct())
    several = staged(groups.where("n_shingles > 0 and _key = component_id").groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key"))
    small = line_dedup.small_side
    kept = rows.join(small(gone), "_key", "left_anti")
    again = kept.join(small(several), "_key", "left_semi").dropDuplicates(["_key"])
    return kept.join(small(several), "_key", "left_anti").unionByName(again).select(*COLUMNS)


@stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item (nor a shorter item as a whole)."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = keyed(docs)
    found = decontaminate.matches(staged(decontaminate.index(rows, "_key")), items)
    hit = staged(found.select(F.col("doc_id").alias("_key")).distinct())
    return rows.join(line_dedup.small_side(hit), "_key", "left_anti").select(*COLUMNS)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in the target proportions, with epoch and n_tokens."""
    return mixing.mix(docs.select(*COLUMNS), queries.source_domain(), queries.MIX)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing", mixed),
]

#: SQL cannot train the toxicity model; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, work) in enumerate(STAGES, 1):
        docs = work(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = staged(docs)
    return docs
