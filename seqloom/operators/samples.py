"""Questions to an index that is kept as runs and their samples: rank and select, backward search, suffix-array values, locate.

Neither the text, nor the transform letter by letter, nor the suffix array is read; everything is made of `index.bwt_runs`, r rows.

* Directory: runs in the order of their letters, with `lf`, how many letters stand before in that order. A letter's rank at a place
  is one as-of lookup among its runs.
* Sample graph: for each run the value `s` of the suffix array at its start and `to`, the one a rank before; so Phi of any value is one
  as-of lookup among r values. `next`, `cost` and `limit` are the graph of these steps: from d behind s one comes to cost + d behind the
  next one's s, if d < limit. Steps of 1, 2, 4 ... are composed of it, and a walk takes the longest ones its limits allow.

Steps go on in the tasks where the r rows are few by count (LIMIT); else each step is a sorted merge of the questions with the rows.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seqloom.operators.run_graph import doubled, walk
from seqloom.tables import as_of, if_small, ranked, running_total, written

#: Runs (of 32 bytes) that go to the tasks whole.
LIMIT = 4_000_000
#: Numbers that a graph of composed steps may have in a task.
LEVELS = 4_000_000


def directory(runs: DataFrame) -> DataFrame:
    """(c, lo, len, lf, sample): runs by letter; lf is the rank that the first letter of the run steps to, sample the last one's text place."""
    d = runs.select(F.col("head").alias("c"), "lo", "len", F.col("last_tpos").alias("sample"))
    return written(running_total(d, "len", F.col("c").asc_nulls_first(), "lo", name="lf"), "directory")


def letters(of: DataFrame) -> DataFrame:
    """(c, c_before, cnt) of a directory; a row a letter."""
    return of.where("c is not null").groupBy("c").agg(F.min("lf").alias("c_before"), F.sum("len").alias("cnt"))


def rank(questions: DataFrame, of: DataFrame) -> DataFrame:
    """questions (i, c, ...) with rank: how often c stands before place i (exclusive); 0 for a letter that is none."""
    d = as_of(questions, of.where("c is not null").select("c", F.col("lo").alias("_lo"), F.col("len").alias("_len"), F.col("lf").alias("_lf")), "i", "_lo", strict=True, by="c", how="left")
    first = letters(of).select(F.col("c").alias("_c"), "c_before")
    here = F.col("_lf") - F.col("c_before") + F.least(F.col("_len"), F.col("i") - F.col("_lo"))
    return d.join(if_small(first), F.col("c") == F.col("_c"), "left").withColumn("rank", F.coalesce(here, F.lit(0))).drop("_lo", "_len", "_lf", "_c", "c_before")


def select(questions: DataFrame, of: DataFrame) -> DataFrame:
    """questions (k, c, ...) with place: where the k-th c (from 0) stands; null if there are fewer."""
    first = letters(of).select(F.col("c").alias("_c"), "c_before")
    r = of.join(if_small(first), F.col("c") == F.col("_c")).select("c", (F.col("lf") - F.col("c_before")).alias("_k"), F.col("lo").alias("_lo"), F.col("len").alias("_len"))
    d = as_of(questions, r, "k", "_k", by="c", how="left")
    return d.withColumn("place", F.when(F.col("k") < F.col("_k") + F.col("_len"), F.col("_lo") + F.col("k") - F.col("_k"))).drop("_k", "_lo", "_len")


def runs_over(ranges: DataFrame, runs: DataFrame) -> DataFrame:
    """ranges (lo, hi, ...) with each run that they reach into, as run, head, run_lo, run_hi, last_tpos: run numbers follow each other, so a
    range has those from its first place's run to its last place's."""
    d = as_of(ranges.where("lo <= hi"), runs.select(F.col("run").alias("_a"), F.col("lo").alias("_at")), "lo", "_at").drop("_at")
    d = as_of(d, runs.select(F.col("run").alias("_z"), F.col("lo").alias("_at")), "hi", "_at").drop("_at")
    d = d.withColumn("run", F.explode(F.sequence("_a", "_z"))).drop("_a", "_z")
    return d.join(runs.select("run", "head", F.col("lo").alias("run_lo"), F.col("hi").alias("run_hi"), "last_tpos"), "run")


def break_ranges(ranges: DataFrame, runs: DataFrame) -> DataFrame:
    """(q, lo, hi): for each range (q, lo, hi, c) the maximal parts that hold c only. The runs of a letter are numbered, so a range meets only
    those of its own letter."""
    r = ranked(runs.where("head is not null").select(F.col("head").alias("c"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), "c", "_lo", name="_i")
    first = as_of(ranges.where("lo <= hi"), r.select("c", "_hi", F.col("_i").alias("_a")), "lo", "_hi", strict=True, by="c", how="left").drop("_hi")
    own = r.groupBy("c").agg(F.min("_i").alias("_first")).withColumnRenamed("c", "_c")
    first = first.join(if_small(own), F.col("c") == F.col("_c")).withColumn("_a", F.coalesce(F.col("_a") + 1, F.col("_first"))).drop("_c", "_first")
    both = as_of(first, r.select("c", "_lo", F.col("_i").alias("_z")), "hi", "_lo", by="c").drop("_lo")
    both = both.where("_a <= _z").withColumn("_i", F.explode(F.sequence("_a", "_z"))).drop("_a", "_z", "c")
    return both.join(r, "_i").select("q", F.greatest("lo", "_lo").alias("lo"), F.least("hi", "_hi").alias("hi"))


def closest_breaks(ranges: DataFrame, runs: DataFrame) -> DataFrame:
    """(q, place): of the places of c in a range (q, lo, hi, c) that stand beside another letter, the one nearest to lo; no row
    without a place."""
    parts = break_ranges(ranges, runs).join(ranges.select("q", F.col("lo").alias("_from")), "q")
    return parts.groupBy("q").agg(F.min(F.when(F.col("lo") > F.col("_from"), F.col("lo")).otherwise(F.col("hi"))).alias("place"))


class _Letters:
    """The directory in a task: arrays for each letter."""

    def __init__(self, rows: pa.Table) -> None:
        t = rows.filter(pa.compute.is_valid(rows.column("c"))).sort_by([("c", "ascending"), ("lo", "ascending")]).combine_chunks()
        self.of: dict[str, tuple[array, ...]] = {}
        if t.num_rows:
            code = t.column("c").combine_chunks().dictionary_encode()
            ends = [*(np.flatnonzero(np.diff(code.indices.to_numpy())) + 1).tolist(), t.num_rows]
            columns = [t.column(c).to_numpy() for c in ("lo", "len", "lf", "sample")]
            for first, end in zip([0, *ends], ends, strict=False):
                self.of[t.column("c")[first].as_py()] = tuple(array("q", x[first:end].astype(np.int64).tobytes()) for x in columns)

    def search(self, pattern: str, n: int, toehold: int) -> tuple[int, int, int] | None:
        lo, hi = 0, n - 1
        for c in reversed(pattern):
            if (own := self.of.get(c)) is None:
                return None
            los, lens, lfs, samples = own
            k = bisect_right(los, hi) - 1
            if k < 0:
                return None
            end = lfs[k] + min(lens[k], hi - los[k] + 1) - 1
            toehold = toehold - 1 if los[k] + lens[k] > hi else samples[k]
            k = bisect_left(los, lo) - 1
            lo, hi = (lfs[k] + min(lens[k], lo - los[k]) if k >= 0 else lfs[0]), end
            if lo > hi:
                return None
        return lo, hi, toehold % n


def backward_search(runs: DataFrame, reads: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(read_id, lo, hi, toehold): the range of ranks of each pattern (read_id, pattern), and the text place of its last suffix. A letter is two
    lookups among its runs: the last one that begins up to hi, and the last one before lo. The toehold
    steps one place back where the letter stands at hi; else it is a run's end, whose sample it takes. Patterns
    that do not occur have no row, nor do empty ones."""
    of = directory(runs)
    n, last, r = runs.agg(F.max("hi") + 1, F.max(F.struct("run", "last_tpos"))["last_tpos"] + 1, F.count("*")).first()
    n, last = n or 0, (last or 0) % max(n or 1, 1)
    kinds = StructType([reads.schema["read_id"], *[StructField(c, LongType()) for c in ("lo", "hi", "toehold")]])
    reads = reads.where("length(pattern) > 0").select("read_id", "pattern")
    if r <= limit:
        held = reads.sparkSession.sparkContext.broadcast(_Letters(of.toArrow()))

        def step(batches):
            for b in batches:
                found = [held.value.search(p, n, last) for p in b.column("pattern").to_pylist()]
                at = pa.array([i for i, x in enumerate(found) if x], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("read_id").take(at), *[pa.array([x[k] for x in found if x], pa.int64()) for k in range(3)]], names=kinds.names)

        return reads.mapInArrow(step, kinds)
    own, first = of.where("c is not null").withColumnRenamed("lo", "at"), letters(of).select("c", "c_before")
    longest = reads.agg(F.max(F.length("pattern"))).first()[0] or 0
    live, done = reads.select("*", *[F.lit(x).cast("bigint").alias(c) for c, x in (("lo", 0), ("hi", n - 1), ("toehold", last))]), None
    for i in range(longest):
        d = as_of(live.withColumn("c", F.substring("pattern", F.length("pattern") - i, F.lit(1))), own, "hi", "at", by="c")
        hold = F.when(F.col("at") + F.col("len") > F.col("hi"), F.col("toehold") - 1).otherwise(F.col("sample"))
        d = d.select("read_id", "pattern", "c", "lo", F.pmod(hold, F.lit(n)).alias("toehold"), (F.col("lf") + F.least(F.col("len"), F.col("hi") - F.col("at") + 1) - 1).alias("end"))
        d = as_of(d, own.drop("sample"), "lo", "at", strict=True, by="c", how="left").join(if_small(first), "c")
        d = d.withColumn("lo", F.coalesce(F.col("lf") + F.least(F.col("len"), F.col("lo") - F.col("at")), F.col("c_before")))
        live = written(d.where("lo <= end").select("read_id", "pattern", "lo", F.col("end").alias("hi"), "toehold"), "ranges")
        got = live.where(F.length("pattern") == i + 1).select(*kinds.names)
        done = got if done is None else done.unionByName(got)
        live = live.where(F.length("pattern") > i + 1)
    return done if done is not None else live.select(*kinds.names)


def sample_graph(runs: DataFrame, n: int) -> DataFrame:
    """(run, s, to, next, cost, limit): one row a run, numbered in the order of s."""
    before = runs.select((F.col("run") + 1).alias("run"), F.col("last_tpos").alias("prev"))
    # before the first run stands the last one, as ranks go round
    last = runs.agg(F.max(F.struct("run", "last_tpos"))["last_tpos"].alias("_last"))
    s = runs.select("run", "first_tpos").join(before, "run", "left").crossJoin(F.broadcast(last))
    s = s.select(F.pmod(F.col("first_tpos") + 1, F.lit(n)).alias("s"), F.pmod(F.coalesce("prev", "_last") + 1, F.lit(n)).alias("to"))
    d = written(ranked(s, "s", name="run"), "samples")
    ahead = d.select((F.col("run") - 1).alias("run"), F.col("s").alias("_next"))
    least = d.agg(F.min("s").alias("_least"))
    d = d.join(ahead, "run", "left").crossJoin(F.broadcast(least)).select("run", "s", "to", (F.coalesce("_next", F.col("_least") + n) - F.col("s")).alias("limit"))
    d = as_of(d, d.select(F.col("run").alias("next"), F.col("s").alias("_s")), "to", "_s", how="left")
    # a value before all samples lies behind the last one
    end = d.agg(F.max(F.struct(F.col("run").alias("next"), F.col("s").alias("_s"))).alias("_e"))
    d = d.crossJoin(F.broadcast(end)).select("run", "s", "to", F.coalesce("next", "_e.next").alias("next"), F.pmod(F.col("to") - F.coalesce("_s", "_e._s"), F.lit(n)).alias("cost"), "limit")
    return written(d, "sample-graph")


class _Steps:
    """The sample graph in a task, with its composed steps."""

    def __init__(self, rows: pa.Table, n: int, levels: int = LEVELS) -> None:
        at = np.argsort(rows.column("run").to_numpy())
        self.n, (self.s, nxt, cost, limit) = n, (rows.column(c).to_numpy()[at] for c in ("s", "next", "cost", "limit"))
        self.levels = [(nxt, cost, limit)]
        while len(self.levels) * len(at) < levels and 2 ** len(self.levels) < n:
            nxt, cost, limit = self.levels[-1]
            self.levels.append((nxt[nxt], cost + cost[nxt], np.minimum(limit, limit[nxt] - cost)))

    def walk(self, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        """d steps of Phi from each x."""
        x, d = x.copy(), d.copy()
        left = np.flatnonzero(d > 0)
        while len(left):
            # index -1 is the last sample, which values before all others lie behind
            run = (np.searchsorted(self.s, x[left], side="right") - 1) % len(self.s)
            ahead, todo = (x[left] - self.s[run]) % self.n, d[left]
            for k in range(len(self.levels) - 1, -1, -1):
                nxt, cost, limit = self.levels[k]
                take = (todo >> k > 0) & (ahead < limit[run])
                ahead[take] += cost[run[take]]
                run[take] = nxt[run[take]]
                todo[take] -= 1 << k
            x[left], d[left] = (self.s[run] + ahead) % self.n, todo
            left = left[todo > 0]
        return x


def phi_steps(questions: DataFrame, graph: DataFrame, n: int, limit: int = LIMIT) -> DataFrame:
    """questions (x, d, ...) with x taken d steps of Phi on. graph: sample_graph. Beyond `limit` rows of it, a walk finds its sample by a merge, takes the composed
    steps that its limits allow, and finds its sample anew."""
    if graph.count() <= limit:
        held = questions.sparkSession.sparkContext.broadcast(_Steps(graph.toArrow(), n))

        def step(batches):
            for b in batches:
                x = held.value.walk(*(b.column(c).to_numpy() for c in ("x", "d")))
                yield pa.RecordBatch.from_arrays([pa.array(x) if c == "x" else b.column(c) for c in b.schema.names], names=b.schema.names)

        return questions.mapInArrow(step, questions.schema)
    most = questions.agg(F.max("d")).first()[0] or 0
    levels = doubled(graph.select("run", "next", "cost", "limit"), max(1, int(most).bit_length()))
    todo, done = written(questions.select("x", "d", F.monotonically_increasing_id().alias("q"), F.struct(*questions.columns).alias("_row")), "steps"), None
    s = graph.select(F.col("run").alias("_run"), F.col("s").alias("_s"))
    end = s.agg(F.max(F.struct(F.col("_s").alias("s"), F.col("_run").alias("run"))).alias("_e"))
    while True:
        part = todo.where("d <= 0")
        done = part if done is None else done.unionByName(part)
        todo = todo.where("d > 0")
        if todo.isEmpty():
            break
        at = as_of(todo, s, "x", "_s", how="left").crossJoin(F.broadcast(end))
        at = written(at.select("q", "_row", F.coalesce("_run", "_e.run").alias("run"), F.pmod(F.col("x") - F.coalesce("_s", "_e.s"), F.lit(n)).alias("ahead"), F.col("d").alias("want")), "anchors")
        on = walk(at, levels).join(s, F.col("run") == F.col("_run")).select("q", F.pmod(F.col("_s") + F.col("ahead"), F.lit(n)).alias("x"), "steps")
        todo = written(at.select("q", "_row", "want").join(on, "q").select("x", (F.col("want") - F.col("steps")).alias("d"), "q", "_row"), "steps")
    return done.select(*[F.col("x") if c == "x" else F.col(f"_row.`{c}`") for c in questions.columns])


def suffix_array_at(ranks: DataFrame, runs: DataFrame, graph: DataFrame, n: int, limit: int = LIMIT) -> DataFrame:
    """ranks (rk, ...) with pos: from the sample at the end of the rank's run, as many steps of Phi as it lies before that."""
    r = runs.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.pmod(F.col("last_tpos") + 1, F.lit(n)).alias("x"))
    d = as_of(ranks, r, "rk", "_lo").withColumn("d", F.col("_hi") - F.col("rk")).drop("_lo", "_hi")
    return phi_steps(d, graph, n, limit).drop("d").withColumnRenamed("x", "pos")


def locate(ranges: DataFrame, runs: DataFrame, graph: DataFrame, n: int, max_hits: int | None = None, limit: int = LIMIT) -> DataFrame:
    """(read_id, nth, pos): the suffixes of each range (read_id, lo, hi, toehold) from the last rank down, max_hits of them at most. The
    toehold gives the last one. Each run that ends within the range has a sample there; so a hit is as many steps
    from a sample as it lies before its run's end, and a range with many hits is many rows from the start."""
    low = F.col("lo") if max_hits is None else F.greatest(F.col("lo"), F.col("hi") - (max_hits - 1))
    top = F.pmod(F.col("toehold") + 0, F.lit(n))
    d = runs_over(ranges.select("read_id", low.alias("lo"), "hi", top.alias("_top")), runs)
    first = F.least("hi", "run_hi")
    x = F.when(F.col("run_hi") <= F.col("hi"), F.pmod(F.col("last_tpos") + 1, F.lit(n))).otherwise(F.col("_top"))
    d = d.select("read_id", x.alias("x"), (F.col("hi") - first + 1).alias("_nth"), F.explode(F.sequence(F.lit(0).cast("bigint"), first - F.greatest("lo", "run_lo"))).alias("d"))
    d = d.select("read_id", (F.col("_nth") + F.col("d")).alias("nth"), "x", "d")
    return phi_steps(d, graph, n, limit).select("read_id", "nth", F.col("x").alias("pos"))
