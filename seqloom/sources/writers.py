"""Writers: text formats as rows of lines for Spark's text sink, index tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.text import wrapped

INDEX_TABLES = ("sequences", "bwt_runs", "c_array", "phi")


def save_index(path: str, **tables: DataFrame) -> None:
    """Each table of an index as Parquet under path."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(column).write.mode("overwrite").text(path)


def sequence_index_lines(index: DataFrame) -> DataFrame:
    return index.select(F.concat_ws(" ", "name", F.col("start").cast("string")).alias("value"))


def fastq(reads: DataFrame) -> DataFrame:
    """(name, seq) as records with quality ~."""
    return reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("~"), F.length("seq"))).alias("value"))


def fasta(seqs: DataFrame, width: int = 60) -> DataFrame:
    return seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), wrapped(F.col("seq"), width)).alias("value"))


def pattern_lines(seeds: DataFrame, k: int, file: str) -> DataFrame:
    """(ord, value): the header, then a pattern a line."""
    head = seeds.agg(F.format_string("# number=%d length=%d file=%s forbidden=", F.count("*"), F.lit(k), F.lit(file)).alias("value"))
    return head.select(F.lit(-1).cast("bigint").alias("ord"), "value").unionByName(seeds.select(F.col("ord").cast("bigint"), F.col("seed").alias("value")))


def count_lines(counts: DataFrame) -> DataFrame:
    """name, matched over length, count, tab-separated; counts: (name, match_len, m, occ)."""
    return counts.select(F.concat_ws("\t", F.concat("name", F.lit(" ")), F.concat_ws("/", F.col("match_len").cast("string"), F.col("m").cast("string")), F.col("occ").cast("string")).alias("value"))


def occurrence_lines(hits: DataFrame) -> DataFrame:
    return hits.orderBy("pos").select(F.col("pos").cast("string").alias("value"))


def sa_lines(sa: DataFrame, lo: int, hi: int) -> DataFrame:
    return sa.where(F.col("rk").between(lo, hi)).select("rk", F.format_string("%d: %d", "rk", "pos").alias("value"))


def space_report(**tables: DataFrame) -> DataFrame:
    """(component, n_rows, n_columns) of an index's tables."""
    out = None
    for name, df in tables.items():
        d = df.agg(F.lit(name).alias("component"), F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"))
        out = d if out is None else out.unionByName(d)
    return out
