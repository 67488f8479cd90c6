"""Neighbourhoods, chimeras, simulated reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def neighbourhood(words: DataFrame, d: int, alphabet: str = "ACGT") -> DataFrame:
    """(word, neighbour): all strings over the alphabet within d substitutions of each word. One
    round per substitution, each at a place behind the last, so that none is made twice."""
    letters = F.array(*[F.lit(x) for x in alphabet])
    level = words.select("word", F.col("word").alias("neighbour"), F.lit(0).alias("_from"))
    out = level
    for _ in range(d):
        at = level.where(F.col("_from") < F.length("word")).select("*", F.explode(F.sequence(F.col("_from"), F.length("word") - 1)).alias("_at"))
        at = at.select("*", F.explode(letters).alias("_c")).where(F.substring("word", F.col("_at") + 1, F.lit(1)) != F.col("_c"))
        new = F.concat(F.substring("neighbour", F.lit(1), F.col("_at")), F.col("_c"), F.substring("neighbour", F.col("_at") + 2, F.length("word")))
        level = at.select("word", new.alias("neighbour"), (F.col("_at") + 1).alias("_from"))
        out = out.unionByName(level)
    return out.select("word", "neighbour")


def chimera(pairs: DataFrame, segment: int) -> DataFrame:
    """(name, seq) of pairs (name1, seq1, name2, seq2): segments of fixed length in turn from both, up to the
    shorter length; the last slice takes a whole segment, as far as its own sequence goes."""
    n = F.least(F.length("seq1"), F.length("seq2"))
    part = lambda i: F.when(F.pmod(i, F.lit(2)) == 0, F.substring("seq1", i * segment + 1, F.lit(segment))).otherwise(F.substring("seq2", i * segment + 1, F.lit(segment)))
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / segment).cast("int")), part)).otherwise(F.array().cast("array<string>"))
    return pairs.select(F.concat("name1", F.lit("+"), "name2").alias("name"), F.array_join(parts, "").alias("seq"))


def drawn_places(per_seq: int, length: int, seed: int = 0) -> Column:
    """Where reads are drawn from a sequence (seq_id, seq), by digest: an array, null for those shorter than a read."""
    n = (F.length("seq") - length + 1).cast("bigint")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(per_seq - 1)), lambda i: F.pmod(F.xxhash64(F.lit(seed), "seq_id", i), n)))


def simulated_reads(seqs: DataFrame, per_seq: int, length: int, errors: int, seed: int = 0) -> DataFrame:
    """(qname, seq_id, pos, seq): reads at places drawn by digest, with up to `errors` substitutions; the
    truth stays in seq_id and pos. The same in every run."""
    d = seqs.select("seq_id", "seq", F.posexplode(drawn_places(per_seq, length, seed)).alias("i", "pos"))
    d = d.withColumn("read", F.substring("seq", (F.col("pos") + 1).cast("int"), F.lit(length))).drop("seq")
    for k in range(errors):
        at = F.pmod(F.xxhash64(F.lit(seed), "seq_id", "i", F.lit(k), F.lit("at")), F.lit(length)).cast("int")
        c = F.get(F.array(*[F.lit(x) for x in "ACGT"]), F.pmod(F.xxhash64(F.lit(seed), "seq_id", "i", F.lit(k)), F.lit(4)).cast("int"))
        d = d.withColumn("read", F.concat(F.substring("read", F.lit(1), at), c, F.substring("read", at + 2, F.lit(length))))
    return d.select(F.concat_ws("_", F.lit("read"), "seq_id", "i").alias("qname"), "seq_id", "pos", F.col("read").alias("seq"))
