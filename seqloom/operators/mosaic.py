"""Clusters of positions that share references, and the mosaic of tiles they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.tables import as_of, if_small, ranked, written


def clusters(positions: DataFrame, key: str | None = None) -> DataFrame:
    """(key, cluster, first_pos, last_pos, n_pos, refs): in position order reference sets are intersected; where that
    would be empty, a cluster ends and the next begins with the current set. With a key (a chromosome, say) also where it changes; clusters
    are numbered by key. A position without references is a cluster of its own.

    Nothing is folded. A cluster that begins at a position reaches as far as one of its references stands in every set from
    there on: to the furthest end of these consecutive stretches, which is an as-of lookup of each (position, reference). So every position
    knows where the next cluster would begin, and those that do begin one are reached from the first position by jumps
    of 1, 2, 4 ... clusters, in log2 of their number of rounds. No row or task holds a stretch, however many sets one reference is in.
    """
    name = key or "key"
    p = positions.withColumn("_key", F.col(key) if key else F.lit(0)).select("_key", "pos", "refs")
    r = written(ranked(p, "_key", "pos", name="_i"), "positions")
    each = r.select("_i", "_key", F.explode(F.array_distinct("refs")).alias("ref"))
    ahead = each.select((F.col("_i") - 1).alias("_j"), F.col("_key").alias("_k"), F.col("ref").alias("_r"))
    ends = each.join(ahead, (F.col("_i") == F.col("_j")) & F.col("_key").eqNullSafe(F.col("_k")) & (F.col("ref") == F.col("_r")), "left_anti")
    # the least end at or behind a position, as the greatest of the negative ones
    reach = as_of(each.select("_i", "ref", (-F.col("_i")).alias("_at")), ends.select("ref", (-F.col("_i")).alias("_end")), "_at", "_end", by="ref")
    far = reach.groupBy("_i").agg(F.max(-F.col("_end")).alias("last"), F.collect_list(F.struct((-F.col("_end")).alias("end"), "ref")).alias("all"))
    far = far.select(F.col("_i").alias("_of"), "last", F.transform(F.filter("all", lambda x: x["end"] == F.col("last")), lambda x: x["ref"]).alias("shared"))
    hop = r.join(far, F.col("_i") == F.col("_of"), "left").select("_i", "_key", "pos", F.coalesce("last", "_i").alias("last"), F.coalesce("shared", F.array().cast("array<string>")).alias("shared"))
    hop = written(hop, "reach")
    keys = hop.groupBy("_key").agg(F.min("_i").alias("_i"), F.max("_i").alias("_max"))
    jump = hop.join(keys.select(F.col("_key").alias("_k"), "_max"), F.col("_key").eqNullSafe(F.col("_k"))).where("last < _max").select("_i", (F.col("last") + 1).alias("to"))
    jump, begun, k = written(jump, "jump"), written(keys.select("_i", F.lit(0).cast("bigint").alias("cluster")), "begun"), 0
    while not jump.isEmpty():
        begun = written(begun.unionByName(begun.join(jump, "_i").select(F.col("to").alias("_i"), (F.col("cluster") + (1 << k)).alias("cluster"))), "begun")
        jump, k = written(jump.join(jump.select(F.col("_i").alias("to"), F.col("to").alias("_to")), "to").select("_i", F.col("_to").alias("to")), "jump"), k + 1
    ends = r.select(F.col("_i").alias("last"), F.col("pos").alias("last_pos"))
    d = hop.join(begun, "_i").join(ends, "last")
    return d.select(F.col("_key").alias(name), F.col("cluster").cast("int").alias("cluster"), F.col("pos").alias("first_pos"), "last_pos", (F.col("last") - F.col("_i") + 1).alias("n_pos"), F.sort_array("shared").alias("refs"))


def popularity(c: DataFrame) -> DataFrame:
    """(ref, n): in how many clusters; ties by name."""
    return c.select(F.explode("refs").alias("ref")).groupBy("ref").agg(F.count("*").alias("n"))


def chosen(c: DataFrame, default: str) -> DataFrame:
    """Clusters with ref: the default if it is a member, else the most popular member (ties: least name)."""
    key = c.columns[0]
    each = c.select(key, "cluster", F.explode("refs").alias("ref")).join(if_small(written(popularity(c), "popularity")), "ref")
    best = each.groupBy(key, "cluster").agg(F.min(F.struct((F.col("ref") != default).alias("other"), (-F.col("n")).alias("n"), "ref")).alias("b"))
    return c.join(best.select(F.col(key).alias("_k"), F.col("cluster").alias("_c"), F.col("b.ref").alias("ref")), F.col(key).eqNullSafe(F.col("_k")) & (F.col("cluster") == F.col("_c"))).drop("_k", "_c")


def tiles(c: DataFrame, default: str, read_len: int, total: int, extend: bool = False) -> DataFrame:
    """(key, a, b, ref, name): tiles ref:a-b, 1-based and inclusive, over [1, total]: each cluster from its first position to the end of
    its last read (or, with `extend`, to the next cluster's first position), the default in the gaps between. Clusters have numbers, so
    neighbours are joined by them. Clusters without a reference leave a gap."""
    c = written(c, "clusters")
    key = c.columns[0]
    d = written(chosen(c, default).withColumn("_o", F.col("cluster")), "chosen")
    if c.where(F.size("refs") == 0).limit(1).count():  # neighbours are those that are left
        d = ranked(d.drop("_o"), key, "cluster", name="_o")
    beside = lambda d, by, x, name: d.join(d.select(F.col(key).alias("_k"), (F.col("_o") - by).alias("_n"), F.col(x).alias(name)), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_o") == F.col("_n")), "left").drop("_k", "_n")
    d = beside(d, 1, "first_pos", "_next")
    end = F.coalesce(F.col("_next") - 1, F.lit(total)) if extend else F.least(F.coalesce(F.col("_next") - 1, F.lit(total)), F.col("last_pos") + read_len - 1)
    d = written(d.withColumn("_end", F.least(end, F.lit(total))), "ends")
    d = beside(d, -1, "_end", "_before").withColumn("_gap", F.coalesce(F.col("_before"), F.lit(0)) + 1).withColumn("_last", F.col("_next").isNull())
    own = d.select(key, F.col("first_pos").alias("a"), F.col("_end").alias("b"), "ref")
    gaps = d.where(F.col("_gap") < F.col("first_pos")).select(key, F.col("_gap").alias("a"), (F.col("first_pos") - 1).alias("b"), F.lit(default).alias("ref"))
    tail = d.where(F.col("_last") & (F.col("_end") < total)).select(key, (F.col("_end") + 1).alias("a"), F.lit(total).cast("bigint").alias("b"), F.lit(default).alias("ref"))
    return own.unionByName(gaps).unionByName(tail).select(key, "a", "b", "ref", F.format_string("%s:%d-%d", "ref", "a", "b").alias("name"))
