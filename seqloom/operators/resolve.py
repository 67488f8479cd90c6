"""Concatenated coordinates: cumulative starts, offsets back to sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.tables import drop, ranked, running_total, stored, written


def sequence_index(seqs: DataFrame) -> DataFrame:
    """(seq_id, name, start, len): starts in the concatenation without separators, in seq_id order."""
    s = seqs.select("seq_id", "name", F.length("seq").cast("bigint").alias("len"))
    return running_total(s, "len", "seq_id", name="start").select("seq_id", "name", "start", "len")


def names_and_lengths(index: DataFrame, text_size: int) -> DataFrame:
    """(name, len) from starts alone: the next start, or the text's size, minus the own."""
    r = ranked(index.select("name", "start"), "start", name="_i")
    ahead = r.select((F.col("_i") - 1).alias("_i"), F.col("start").alias("_next"))
    return r.join(ahead, "_i", "left").select("name", (F.coalesce("_next", F.lit(text_size)) - F.col("start")).alias("len"))


def ends(seqs: DataFrame, n: int) -> DataFrame:
    """(seq_id, len, head, end): n letters of either end, in one pass over the texts; written."""
    return written(seqs.select("seq_id", F.length("seq").cast("bigint").alias("len"), F.substring("seq", 1, n).alias("head"), F.substring("seq", -n, n).alias("end")), "ends")


def following(of: DataFrame, n: int) -> DataFrame:
    """(seq_id, start, i, tail): the n letters that follow each sequence, which the next ones begin with; put together by doubling. of: ends(seqs, n)."""
    at = written(ranked(running_total(of.select("seq_id", "len"), "len", "seq_id", name="start").select("seq_id", "start"), "seq_id", name="i"), "sequences")
    heads, path = stored(of.select("seq_id", "head").join(at, "seq_id").select("i", "head"), "heads")
    step, total = 1, at.count()
    while step < total and not heads.where((F.length("head") < n) & (F.col("i") + step < total)).isEmpty():
        more = heads.select((F.col("i") - step).alias("i"), F.col("head").alias("_more"))
        longer = heads.join(more, "i", "left").select("i", F.substring(F.concat("head", F.coalesce("_more", F.lit(""))), 1, n).alias("head"))
        (heads, new), step = stored(longer, "heads"), 2 * step
        drop(of.sparkSession, path)
        path = new
    return at.join(heads.select((F.col("i") - 1).alias("i"), F.col("head").alias("tail")), "i", "left").select("seq_id", "start", F.coalesce("tail", F.lit("")).alias("tail"))


def resolve(positions: DataFrame, index: DataFrame, bucket: int | None = None) -> DataFrame:
    """positions (x, ...) with seq_id, name, off: the sequence with the greatest start <= x among
    those that are not empty, and x - start. Positions beyond the end have none.

    An equi-join on buckets of coordinates with a range condition in it: a sequence is filed under
    each bucket that it reaches into, so every position meets only the sequences near it. A bucket is about as long as the mean
    sequence: a position then meets two sequences or so, and a sequence has two rows or so.
    """
    i = index.where("len > 0")
    if bucket is None:
        bucket = 1 << max(8, int(i.agg(F.avg("len")).first()[0] or 1).bit_length())
    i = i.select(F.col("seq_id"), F.col("name"), F.col("start"), F.col("len"), F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("start") + F.col("len") - 1) / bucket))).alias("_b"))
    p = positions.withColumn("_x", F.floor(F.col("x") / bucket))
    on = (F.col("_x") == F.col("_b")) & (F.col("x") >= F.col("start")) & (F.col("x") < F.col("start") + F.col("len"))
    return p.join(i, on, "left").withColumn("off", F.col("x") - F.col("start")).drop("_x", "_b", "start", "len")


def to_chromosome(alignments: DataFrame, lengths: DataFrame, one_based: bool = True) -> DataFrame:
    """Alignments against a concatenation with rname and pos of the sequence instead; unmapped ones
    get '*' for both. lengths: (ord, name, len) in file order. one_based: pos counts from 1, and is
    turned to 0 and back; else the 1-based position is looked up as it is, as the older tool does."""
    index = running_total(lengths.select("ord", "name", "len"), "len", "ord", name="start").select(F.col("ord").alias("seq_id"), "name", "start", "len")
    shift = 1 if one_based else 0
    a = alignments.withColumn("x", F.expr("try_cast(pos as bigint)") - shift)
    r = resolve(a.drop("rname", "pos"), index)
    mapped = F.col("flag").bitwiseAND(F.lit(4)) == 0
    return r.withColumns({"rname": F.when(mapped, F.col("name")).otherwise("*"), "pos": F.when(mapped, (F.col("off") + shift).cast("string")).otherwise("*")}).drop("x", "name", "seq_id", "off")
