"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

A row is told by its doc_id (which may be null) and its text, so rows that share a doc_id are judged each on
its own text. Null texts fail the quality rules. Rows equal in doc_id and text are copies of each
other: the second stage keeps one. Columns that a stage does not name pass through it. An empty table passes
every stage as an empty table of the same columns. Texts of any length are judged whole; one text is in memory at a time
beside its stage's batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import decontam, packing, pii, quality, simhash
from seqloom.llm._common import drop, ended, written
from seqloom.tables import if_small, spread


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, row): what tells a row, and the row."""
    return docs.select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go."""
    return docs.where(quality.measured(F.col("text"))["kept"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the document with the smallest doc_id stays (null comes first).

    Those that go are few, and are written as a list first; where the list is small by count it is broadcast, so that
    texts do not travel. Rows that are equal in doc_id and text are counted beside it; only they are
    made one in a step of their own, which is left out where there are none.
    """
    rows = _keyed(docs)
    found, found_path = written(simhash.near_duplicates(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))), "components")
    gone, _ = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    again, _ = written(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("n")).where("n > 1").select("_again"), "again")
    drop(spark, found_path)
    kept = rows.join(if_small(gone), F.col("key") == F.col("_gone"), "left_anti")
    if not again.isEmpty():
        again = if_small(again)
        once = kept.join(again, F.col("key") == F.col("_again"), "left_anti").select("row")
        kept = once.unionByName(kept.join(again, F.col("key") == F.col("_again")).dropDuplicates(["_again"]).select("row"))
    return kept.select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _keyed(docs)
    found = decontam.contamination(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), items.select("item_id", "text"))
    gone, _ = written(found.where("contaminated").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return rows.join(if_small(gone), F.col("key") == F.col("_gone"), "left_anti").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind's name in brackets."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 1024 tokens."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Tokens, bootstrapped patterns and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    """All stages over documents. A stage's rows are written, and those of the stage before deleted then. With a folder `at`, which the caller
    names for these documents alone, a stage's rows are kept there under its name, and a run that failed goes on behind the last stage that has ended."""
    docs, before = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), []
    for k, (name, stage) in enumerate(STAGES):
        if at is None:
            docs, path = written(stage(spark, docs, sf_dir), name)
            drop(spark, *before)
            before = [path]
            continue
        path = f"{at}/{k}-{name}"
        if not ended(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
