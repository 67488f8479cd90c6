"""Index views as tables: suffix array, Burrows-Wheeler transform, runs, samples, Phi, rank and select.

sa (rk, pos): rank and start of each suffix, the terminator's at rank 0. bwt (rk, c): the letter before
each suffix, None for the terminator. Positions and ranks count from 0; letters are code points, in binary order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.kmers import chunks
from seqloom.operators.resolve import sequence_index
from seqloom.tables import as_of, ranked, running_total, written

START = 16


def letters(seqs: DataFrame, span: int = 1) -> DataFrame:
    """(pos, c): each place of the concatenation with the `span` letters that begin there (fewer at its end).

    Most places find their letters within their own sequence, without a shuffle; only those of the
    last span - 1 places of each sequence are gathered from the sequences' ends and beginnings.
    """
    at = sequence_index(seqs).select("seq_id", "start", "len")
    joined = seqs.select("seq_id", "seq").join(at, "seq_id").select(F.struct("seq_id", "start", "len").alias("seq_id"), "seq")
    d = chunks(joined, span - 1).select("*", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("off"))
    d = d.select(F.col("seq_id.start").alias("start"), F.col("seq_id.len").alias("len"), (F.col("base") + F.col("off")).alias("o"), F.substring("chunk", F.col("off") + 1, F.lit(span)).alias("c"))
    inner = d.where(F.col("o") + span <= F.col("len")).select((F.col("start") + F.col("o")).alias("pos"), "c")
    if span == 1:
        return inner
    near = d.where((F.col("o") < span - 1) | (F.col("o") + span > F.col("len")))
    near = near.select((F.col("start") + F.col("o")).alias("pos"), F.substring("c", 1, 1).alias("c"), (F.col("o") + span > F.col("len")).alias("edge"))
    spread = near.select("edge", F.explode(F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda k: F.struct((F.col("pos") - k).alias("pos"), k.alias("k"), F.col("c").alias("c")))).alias("s"))
    gathered = spread.groupBy("s.pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s.k", "s.c"))), lambda x: x["c"]), "").alias("c"), F.max(F.col("edge") & (F.col("s.k") == 0)).alias("edge"))
    return inner.unionByName(gathered.where("edge").select("pos", "c"))


def suffix_array(seqs: DataFrame, start: int = START) -> DataFrame:
    """(rk, pos) by prefix doubling. The first ranks are those of `start` letters; each round joins
    ranks h places apart and ranks the pairs; only as many rounds as the longest repeat needs.
    Ranks are counts of smaller suffixes: distinct keys, counted, in sorted ranges."""
    first = written(letters(seqs, start).withColumnRenamed("c", "k"), "first-letters")
    n = first.count()
    end = first.sparkSession.createDataFrame([(n, "")], "pos long, k string")
    return doubled_ranks(first.unionByName(end), start).select("rk", "pos")


def doubled_ranks(first: DataFrame, span: int) -> DataFrame:
    """(pos, rk): the ranks of the suffixes of a sequence whose places (pos, k) are ordered by k as far as `span` places reach. Each
    round joins ranks h places apart and ranks the pairs."""
    n = first.count()
    r, h = written(_rank(first, "k"), "ranks"), span
    while r.select("rk").distinct().count() < n:
        ahead = r.select((F.col("pos") - h).alias("pos"), F.col("rk").alias("next"))
        pair = r.join(ahead, "pos", "left").select("pos", F.struct("rk", F.coalesce("next", F.lit(-1)).alias("next")).alias("k"))
        r, h = written(_rank(pair, "k"), "ranks"), 2 * h
    return r.select("pos", "rk")


def _rank(d: DataFrame, key: str) -> DataFrame:
    """(pos, rk): the number of rows with a smaller key."""
    keys = d.groupBy(key).agg(F.count("*").alias("n"))
    return d.join(running_total(keys, "n", key, name="rk").select(F.col(key).alias("_k"), "rk"), F.col(key) == F.col("_k")).select("pos", "rk")


def bwt(sa: DataFrame, text: DataFrame) -> DataFrame:
    """(rk, pos, c): text is letters(seqs)."""
    return sa.join(text.select((F.col("pos") + 1).alias("pos"), "c"), "pos", "left").select("rk", "pos", "c")


def runs_of(rows: DataFrame, order: str = "rk", value: str = "c", within: str | None = None) -> DataFrame:
    """rows with run: gaps and islands. Over `within`, or globally by ranges: a row begins a run if the row one place
    before holds another value, and the beginnings are counted up."""
    if within:
        w = Window.partitionBy(within).orderBy(order)
        new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
        return rows.withColumn("_n", new).withColumn("run", (F.sum("_n").over(w) - 1).cast("bigint")).drop("_n")
    before = rows.select((F.col(order) + 1).alias(order), F.col(value).alias("_v"), F.lit(True).alias("_has"))
    d = rows.join(before, order, "left").withColumn("_n", F.when(F.col("_has") & F.col("_v").eqNullSafe(F.col(value)), 0).otherwise(1)).drop("_v", "_has")
    return running_total(d, "_n", order, name="_b").withColumn("run", (F.col("_b") + F.col("_n") - 1).cast("bigint")).drop("_n", "_b")


def bwt_runs(b: DataFrame, n: int) -> DataFrame:
    """(run, head, lo, hi, len, first_tpos, last_tpos): samples are the text places of the letters at
    the run's ends, pos - 1 modulo n."""
    d = runs_of(b)
    tpos = F.pmod(F.col("pos") - 1, F.lit(n))
    g = d.groupBy("run").agg(F.min(F.struct("rk", "c", tpos.alias("t"))).alias("a"), F.max(F.struct("rk", tpos.alias("t"))).alias("z"))
    return g.select("run", F.col("a.c").alias("head"), F.col("a.rk").alias("lo"), F.col("z.rk").alias("hi"), (F.col("z.rk") - F.col("a.rk") + 1).alias("len"), F.col("a.t").alias("first_tpos"), F.col("z.t").alias("last_tpos"))


def c_array(text: DataFrame) -> DataFrame:
    """(c, cnt, c_before): how often each letter occurs, and how many smaller symbols there are, the
    terminator among them. One row a letter."""
    cnt = text.groupBy("c").agg(F.count("*").alias("cnt"))
    return cnt.withColumn("c_before", F.coalesce(F.sum("cnt").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)


def rank_select(rows: DataFrame, order: str, value: str, within: str | None = None) -> DataFrame:
    """rows with rank: how often their value stands before them (exclusive); place i of value v is the row
    with rank i (select, from 0)."""
    if within:
        return rows.withColumn("rank", (F.row_number().over(Window.partitionBy(within, value).orderBy(order)) - 1).cast("bigint"))
    # by value and order: the global row number minus that of the value's first row
    d = ranked(rows, value, order, name="_g")
    first = d.groupBy(value).agg(F.min("_g").alias("_f")).withColumnRenamed(value, "_v")
    return d.join(first, F.col(value).eqNullSafe(F.col("_v"))).withColumn("rank", F.col("_g") - F.col("_f")).drop("_g", "_f", "_v")


def lf(b: DataFrame, c: DataFrame) -> DataFrame:
    """(rk, lf): where the suffix one place to the left ranks. FL is the inverse: (lf, rk)."""
    r = rank_select(b.select("rk", "c"), "rk", "c")
    return r.join(c.select(F.col("c").alias("_c"), "c_before"), F.col("c") == F.col("_c"), "left").select("rk", F.when(F.col("c").isNull(), F.lit(0)).otherwise(F.col("c_before") + F.col("rank")).cast("bigint").alias("lf"))


def first_column(rk: DataFrame, c: DataFrame) -> DataFrame:
    """(rk, f): the first letter of each ranked suffix, by range over the C array; none for the terminator's."""
    d = as_of(rk.select("rk"), c.select("c", "c_before"), "rk", "c_before").select("rk", F.col("c").alias("f"))
    return d.unionByName(rk.where("rk = 0").select("rk", F.lit(None).cast("string").alias("f")))


def phi(sa: DataFrame) -> DataFrame:
    """(pos, phi): SA[k] to SA[k - 1]; none for SA[0]."""
    return sa.join(sa.select((F.col("rk") + 1).alias("rk"), F.col("pos").alias("phi")), "rk").select("pos", "phi")


def phi_by_samples(positions: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    """(pos, phi) by the sampled form: the nearest sampled run start at or before pos, circularly, plus the
    distance from it to the end of the run before. An as-of join on (first_tpos, last_tpos of run - 1)."""
    before = runs.select((F.col("run") + 1).alias("run"), F.col("last_tpos").alias("prev"))
    s = runs.join(before, "run").select(F.pmod(F.col("first_tpos") + 1, F.lit(n)).alias("s"), F.pmod(F.col("prev") + 1, F.lit(n)).alias("to"))
    return as_of(positions, s, "pos", "s").select("pos", F.pmod(F.col("to") + F.col("pos") - F.col("s"), F.lit(n)).alias("phi"))


def predecessor_circular(left: DataFrame, starts: DataFrame, at: str, start: str) -> DataFrame:
    """The strict predecessor of each `at`; where there is none, the last of all."""
    last = starts.agg(F.max(start).alias("_last"))
    return as_of(left, starts, at, start, strict=True, how="left").crossJoin(F.broadcast(last)).withColumn(start, F.coalesce(start, "_last")).drop("_last")


def build_stats(runs: DataFrame) -> DataFrame:
    """n, r, n / r, log2 r, log2 n/r."""
    a = runs.agg(F.sum("len").alias("n"), F.count("*").alias("r"))
    return a.select("n", "r", (F.col("n") / F.col("r")).alias("n_over_r"), F.log2("r").alias("log2_r"), F.log2(F.col("n") / F.col("r")).alias("log2_n_over_r"))


def decoded(runs: DataFrame, terminator: str = "$") -> DataFrame:
    """(bwt): the whole transform as one string; for texts that fit in a row."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("run", "head", "len"))), lambda x: F.repeat(F.coalesce(x["head"], F.lit(terminator)), x["len"].cast("int")))
    return runs.agg(F.array_join(parts, "").alias("bwt"))


def suffix_array_from_bwt(b: DataFrame, c: DataFrame) -> DataFrame:
    """(rk, pos) from the transform alone: a suffix's place is how many LF steps lead from it to the whole
    text. List ranking by pointer doubling, log2(n) rounds of one join."""
    step = lf(b, c)
    d = written(step.select("rk", F.when(F.col("lf") > 0, F.col("lf")).alias("to"), F.when(F.col("lf") > 0, 1).otherwise(0).cast("bigint").alias("pos")), "steps")
    while not d.where("to is not null").isEmpty():
        on = d.select(F.col("rk").alias("to"), F.col("to").alias("_to"), F.col("pos").alias("_pos"))
        d = written(d.join(on, "to", "left").select("rk", F.col("_to").alias("to"), (F.col("pos") + F.coalesce("_pos", F.lit(0))).alias("pos")), "steps")
    return d.select("rk", "pos")
