"""Alignment records: projection, filters, comparison with a truth set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.text import aligned_length

COLUMNS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "tags")


def records(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """Alignment rows. reads: (read_id, qname, seq, qual); hits: (read_id, rname, off, nh, nth from 1, cigar).
    Reads without a hit get flag 4 and stars; hits after the first flag 256 and no sequence."""
    d = reads.join(hits, "read_id", "left")
    mapped, later = F.col("off").isNotNull(), F.col("nth") > 1
    star = lambda ok, c: F.when(ok, c).otherwise("*")
    return d.select(
        "qname",
        F.when(~mapped, 4).when(later, 256).otherwise(0).alias("flag"),
        star(mapped, F.col("rname")).alias("rname"),
        star(mapped, (F.col("off") + 1).cast("string")).alias("pos"),
        star(mapped, F.lit("255")).alias("mapq"),
        F.coalesce("cigar", F.concat(F.length("seq").cast("string"), F.lit("M"))).alias("cigar"),
        F.lit("*").alias("rnext"),
        F.lit(0).alias("pnext"),
        F.lit(0).alias("tlen"),
        star(~mapped | ~later, F.col("seq")).alias("seq"),
        star(~mapped | ~later, F.col("qual")).alias("qual"),
        F.concat(F.lit("NH:i:"), F.coalesce("nh", F.lit(0)).cast("string"), F.lit(" ")).alias("tags"),
    )


def flag_is(flags: int | None) -> Column:
    """(flag & flags) != 0; nothing is filtered for None and 0."""
    return F.col("flag").bitwiseAND(F.lit(flags)) != 0 if flags else F.lit(True)


def aligned_at_least(n: int | None) -> Column:
    return (F.col("cigar") != "*") & (aligned_length(F.col("cigar")) >= n) if n else F.lit(True)


def filtered(sam: DataFrame, flags: int | None = None, min_length: int | None = None) -> DataFrame:
    return sam.where(flag_is(flags) & aligned_at_least(min_length))


def mapped(sam: DataFrame) -> DataFrame:
    return sam.where(F.col("flag").bitwiseAND(F.lit(4)) == 0)


def of_haplotype(sam: DataFrame, part: str) -> DataFrame:
    return sam.where(F.col("qname").contains(part))


def without_repeats(sam: DataFrame, key: str = "flag", order: str | None = None) -> DataFrame:
    """Groups of one qname in which `key` repeats go as a whole. With `order`, only neighbouring
    rows of a qname are a group, as in a file that is not sorted by name."""
    group = ["qname"]
    if order:
        from seqloom.operators.index import runs_of

        sam, group = runs_of(sam, order, "qname").withColumnRenamed("run", "_run"), ["_run"]
    ok = sam.groupBy(*group).agg(F.count("*").alias("_n"), F.count_distinct(key).alias("_d")).where("_n = _d").select(*group)
    return sam.join(ok, group, "left_semi").drop("_run")


def against_truth(sam: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (unaligned, incorrect, total); truth: (qname, pos). Mapped records whose (qname, pos) is
    not in the truth are incorrect."""
    t = truth.select("qname", "pos").distinct().withColumn("_true", F.lit(True))
    d = sam.join(t, ["qname", "pos"], "left")
    lost = F.col("flag").bitwiseAND(F.lit(4)) != 0
    return d.agg(F.count_if(lost).alias("unaligned"), F.count_if(~lost & F.col("_true").isNull()).alias("incorrect"), F.count("*").alias("total"))


def unique_position_refs(sam: DataFrame, haplotype: str | None = None) -> DataFrame:
    """(pos, refs): mapped reads with one distinct position give their references to it; refs sorted."""
    m = mapped(sam)
    if haplotype:
        m = of_haplotype(m, haplotype)
    one = m.groupBy("qname").agg(F.count_distinct("pos").alias("n"), F.min("pos").alias("_p")).where("n = 1").select("qname")
    pairs = m.join(one, "qname", "left_semi").select(F.col("pos").cast("bigint").alias("pos"), "rname").distinct()
    return pairs.groupBy("pos").agg(F.sort_array(F.collect_set("rname")).alias("refs"))


def all_refs(sam: DataFrame) -> DataFrame:
    return mapped(sam).select("rname").distinct()


def as_lines(sam: DataFrame) -> DataFrame:
    return sam.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in COLUMNS]).alias("value"))


def header(lengths: DataFrame) -> DataFrame:
    """Header lines with their order: @HD, then @SQ per sequence (name, len, ord)."""
    top = lengths.sparkSession.createDataFrame([(-1, "@HD\tVN:1.6\tSO:unknown")], "ord long, value string")
    return top.unionByName(lengths.select(F.col("ord").cast("long"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("len").cast("string")).alias("value")))


def numbered(hits: DataFrame) -> DataFrame:
    """hits with nth: from 1, by sequence and position, where no other order is asked for."""
    return hits.withColumn("nth", F.row_number().over(Window.partitionBy("read_id").orderBy("seq_id", "pos")))
