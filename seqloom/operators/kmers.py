"""Substrings by position: chunked k-mers, seeds, windows.

Spark's substring walks a string from its start. Cutting a text into nested chunks first keeps the walk short for
texts of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNKS = (1 << 20, 1 << 16, 1 << 12, 1 << 8)


def chunks(seqs: DataFrame, overlap: int, sizes: tuple[int, ...] = CHUNKS, before: int = 0) -> DataFrame:
    """(seq_id, base, own, chunk, lead): `chunk` holds `lead` characters of context (`before`, or as many as there are), then
    `own` start positions, at base + off for off < own, and behind them `overlap` characters more, as far as the text goes."""
    d = seqs.select("seq_id", F.lit(0).cast("bigint").alias("base"), F.length("seq").alias("own"), F.col("seq").alias("chunk"), F.lit(0).alias("lead"))
    for size in sizes:
        d = d.where("own > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("own") - 1, F.lit(size))).alias("o")).withColumn("at", F.col("lead") + F.col("o"))
        lead = F.least(F.lit(before), F.col("at"))
        d = d.select("seq_id", (F.col("base") + F.col("o")).alias("base"), F.least(F.lit(size), F.col("own") - F.col("o")).alias("own"), F.substring("chunk", F.col("at") - lead + 1, lead + size + overlap).alias("chunk"), lead.alias("lead"))
    return d


def kmers(seqs: DataFrame, k: int) -> DataFrame:
    """(seq_id, pos, kmer): every substring of length k; narrow."""
    d = chunks(seqs, k - 1).select("seq_id", "base", "own", "chunk", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("off"))
    return d.where(F.col("off") + k <= F.length("chunk")).select("seq_id", (F.col("base") + F.col("off")).alias("pos"), F.substring("chunk", F.col("off") + 1, F.lit(k)).alias("kmer"))


def seeds(reads: DataFrame, k: int, skip: int) -> DataFrame:
    """(read_id, off, seed): substrings of length k that begin every skip + 1 characters."""
    d = reads.where(F.length("seq") >= k).select("read_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - k, F.lit(skip + 1))).alias("off"))
    return d.select("read_id", F.col("off").cast("bigint").alias("off"), F.substring("seq", F.col("off") + 1, F.lit(k)).alias("seed"))
