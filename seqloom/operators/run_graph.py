"""The graph of runs: an edge from each run to the one whose sample precedes its predecessor's end;
its path cover; long walks by pointer doubling.

An edge has a cost, what a position moves ahead of the sample, and a limit, how far it may be ahead to
take the edge. Edges compose: (c1, l1) then (c2, l2) is (c1 + c2, min(l1, l2 - c1)).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.tables import as_of, ranked, written

MIN_PATH = 16


def edges(runs: DataFrame, n: int) -> DataFrame:
    """(run, next, cost, limit) for each run > 0: its predecessor's last sample falls behind the start sample
    of `next`, by `cost`; `limit` is the distance from the own start sample to the next larger one (1 for the largest)."""
    starts = written(runs.select("run", "first_tpos", "last_tpos"), "starts")
    order = ranked(starts.select("run", "first_tpos"), "first_tpos", name="i")
    up = order.select((F.col("i") - 1).alias("i"), F.col("first_tpos").alias("larger"))
    limits = order.join(up, "i", "left").select("run", F.coalesce(F.col("larger") - F.col("first_tpos"), F.lit(1)).alias("limit"))
    ends = starts.select((F.col("run") + 1).alias("of"), F.col("last_tpos").alias("x"))
    # a sample before all starts follows the largest one, around the end of the text
    largest = starts.agg(F.max(F.struct("first_tpos", "run")).alias("m")).select(F.col("m.run").alias("next"), (F.col("m.first_tpos") - n).alias("first_tpos"))
    target = as_of(ends, starts.select(F.col("run").alias("next"), "first_tpos").unionByName(largest), "x", "first_tpos")
    return target.join(limits, target["of"] == limits["run"]).select(F.col("of").alias("run"), "next", (F.col("x") - F.col("first_tpos")).alias("cost"), "limit")


def roots(e: DataFrame) -> DataFrame:
    """Runs that no edge enters."""
    return e.select("run").join(e.select(F.col("next").alias("run")).distinct(), "run", "left_anti")


def path_cover(e: DataFrame, least: int = MIN_PATH) -> DataFrame:
    """(root, place, run): from each root in order, along the edges, until run 0, or a run that a smaller root's walk
    holds. Paths of at least `least` runs stay. Every run belongs to the smallest root that reaches
    it; ownership is settled by doubling, in log2 of the longest walk's rounds."""
    own = written(e.select("run", "next").join(roots(e).withColumn("root", F.col("run")), "run", "left").select("run", "next", "root", F.when(F.col("root").isNotNull(), 0).alias("place")), "walk")
    # jump tables: 2**k steps ahead
    jump, k = own.select("run", F.col("next").alias("to")), 0
    reach = own.where("root is not null").select("run", "root", F.lit(0).cast("bigint").alias("place"))
    while True:
        more = reach.join(jump, "run").where("to > 0").select(F.col("to").alias("run"), "root", (F.col("place") + (1 << k)).alias("place"))
        both = reach.unionByName(more).groupBy("run").agg(F.min(F.struct("root", "place")).alias("m")).select("run", "m.root", "m.place")
        both = written(both, "reach")
        if both.count() == reach.count() and both.exceptAll(reach).isEmpty():
            break
        reach = both
        j2 = jump.withColumnRenamed("to", "mid").join(jump.select(F.col("run").alias("mid"), "to"), "mid").select("run", "to")
        jump, k = written(j2, "jump"), k + 1
    size = reach.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return reach.join(size, "root").select("root", "place", "run")


def compose(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of a followed by those of b, as one edge each."""
    a = a.select("run", F.col("next").alias("mid"), F.col("cost").alias("c1"), F.col("limit").alias("l1"))
    b = b.select(F.col("run").alias("mid"), "next", F.col("cost").alias("c2"), F.col("limit").alias("l2"))
    return a.join(b, "mid").select("run", "next", (F.col("c1") + F.col("c2")).alias("cost"), F.least(F.col("l1"), F.col("l2") - F.col("c1")).alias("limit"))


def doubled(e: DataFrame, levels: int) -> list[DataFrame]:
    """Edges of 1, 2, 4 ... steps."""
    out = [written(e, "level")]
    for _ in range(levels - 1):
        out.append(written(compose(out[-1], out[-1]), "level"))
    return out


def walk(queries: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(q, run, ahead, steps): from each (q, run, ahead, want), as many of the wanted steps as the limits
    allow, largest jumps first. Taking an edge moves `ahead` by its cost, and needs ahead < limit."""
    d = queries.select("q", "run", "ahead", "want", F.lit(0).cast("bigint").alias("steps"))
    for k in range(len(levels) - 1, -1, -1):
        lv = levels[k].select(F.col("run").alias("_r"), "next", "cost", "limit")
        d = d.join(lv, F.col("run") == F.col("_r"), "left")
        take = F.col("_r").isNotNull() & (F.col("ahead") < F.col("limit")) & (F.col("steps") + (1 << k) <= F.col("want"))
        d = d.select("q", F.when(take, F.col("next")).otherwise(F.col("run")).alias("run"), F.when(take, F.col("ahead") + F.col("cost")).otherwise(F.col("ahead")).alias("ahead"), "want", F.when(take, F.col("steps") + (1 << k)).otherwise(F.col("steps")).alias("steps"))
        d = written(d, "walk")
    return d.select("q", "run", "ahead", "steps")


def trees(paths: DataFrame) -> DataFrame:
    """(path, node, level, cost, limit, run): a balanced tree over each path (path, place, run, cost, limit). Nodes are numbered as in a heap: 1
    is the root of 2**level leaves, 2k and 2k + 1 are below k, and place p of a path whose tree has height h is node 2**h + p. A node above
    others is their edges as one: its cost is their sum, and a walk may take it if its cost so far is at most `limit`. Nodes that are not full
    are left out. A level is one grouping of the level below."""
    sizes = paths.groupBy("path").agg((F.max("place") + 1).alias("n"))
    height = F.ceil(F.log2(F.col("n").cast("double"))).cast("int")  # exact for the numbers that a path can have
    d = paths.join(sizes.select("path", height.alias("h")), "path")
    d = d.select("path", (F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("h")) + F.col("place")).alias("node"), F.lit(0).alias("level"), "cost", "limit", "run")
    out = level = written(d, "tree")
    while True:
        pair = level.groupBy("path", F.shiftright("node", 1).alias("up")).agg(F.count("*").alias("n"), F.min(F.struct("node", "cost", "limit")).alias("a"), F.max(F.struct("node", "cost", "limit")).alias("b"), F.first("level").alias("level"))
        pair = pair.where("n = 2").select("path", F.col("up").alias("node"), (F.col("level") + 1).alias("level"), (F.col("a.cost") + F.col("b.cost")).alias("cost"), F.least(F.col("a.limit"), F.col("b.limit") - F.col("a.cost")).alias("limit"), F.lit(None).cast(paths.schema["run"].dataType).alias("run"))
        level = written(pair, "tree")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def tree_walk(queries: DataFrame, tree: DataFrame) -> DataFrame:
    """(q, run, steps, cost): walks (q, path, place, cost, distance) along the leaves: a step needs its leaf's limit to be at least the cost so far, and adds the leaf's
    cost; at most `distance` steps, and not beyond the last leaf. All queries climb level by level, taking the node that begins
    where they stand if it is a right child and they can, and then descend, taking nodes as they fit: two joins a level."""
    leaves = tree.where("level = 0")
    sizes = leaves.groupBy("path").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    top = tree.agg(F.max("level")).first()[0] or 0
    d = queries.join(sizes, "path").where((F.col("place") >= 0) & (F.col("first") + F.col("place") <= F.col("last")))
    left = F.greatest(F.lit(0), F.least(F.col("distance").cast("bigint"), F.col("last") - F.col("first") - F.col("place")))
    d = d.select("q", "path", "first", (F.col("first") + F.col("place")).alias("leaf"), F.col("cost").cast("bigint").alias("cost"), left.alias("left"), left.alias("want"), F.lit(99).alias("stop"))
    for k, up in [*((k, True) for k in range(top + 1)), *((k, False) for k in range(top, -1, -1))]:
        size = 1 << k
        nodes = tree.where(F.col("level") == k).select(F.col("path").alias("_p"), F.col("node").alias("_n"), F.col("cost").alias("_c"), F.col("limit").alias("_l"))
        aligned = F.pmod(F.col("leaf") - F.col("first"), F.lit(size)) == 0
        right = F.pmod(F.col("leaf") - F.col("first"), F.lit(2 * size)) == size
        here = (F.col("stop") == 99) & right if up else (F.col("stop") > k) & aligned
        d = d.join(nodes, (F.col("path") == F.col("_p")) & (F.shiftright("leaf", k) == F.col("_n")), "left")
        take = here & F.col("_n").isNotNull() & (F.col("left") >= size) & (F.col("_l") >= F.col("cost"))
        cols = {"leaf": F.when(take, F.col("leaf") + size).otherwise(F.col("leaf")), "cost": F.when(take, F.col("cost") + F.col("_c")).otherwise(F.col("cost")), "left": F.when(take, F.col("left") - size).otherwise(F.col("left"))}
        if up:
            cols["stop"] = F.when(here & ~F.coalesce(take, F.lit(False)), F.lit(k)).otherwise(F.col("stop"))
        d = written(d.select("q", "path", "first", *[cols.get(c, F.col(c)).alias(c) for c in ("leaf", "cost", "left", "want", "stop")]), "tree-walk")
    at = leaves.select(F.col("path").alias("_p"), F.col("node").alias("_n"), "run")
    return d.join(at, (F.col("path") == F.col("_p")) & (F.col("leaf") == F.col("_n"))).select("q", "run", (F.col("want") - F.col("left")).alias("steps"), "cost")
