"""Prefix-free parsing: runs of the transform and the suffix array from distinct phrases.

The concatenation is cut where the digest of `w` letters is a multiple of `p`. A phrase reaches from one cut to w letters behind the next, so no
phrase holds a cut's letters inside, and no suffix of more than w letters of a phrase is a proper prefix of another's. Hence

* suffixes of the text are in the order of their phrase's rest, and among equal rests in the order of what follows in the parse;
* a rest that always has the same letter before it is a stretch of one letter in the transform, as long as its phrases are often.

So the transform takes the letters of the distinct phrases, a suffix order of the parse, and single occurrences only of those rests that have
several letters before them. A collection of near copies costs little more than one of them.

The text may not hold 0x00, which ends the last phrase. Positions are code points, as in `index`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.index import doubled_ranks
from seqloom.operators.resolve import ends, following
from seqloom.tables import as_of, ranked, running_total, written

W, P = 8, 32
END = "\x00"


def cuts(codes: np.ndarray, own: int, w: int, p: int) -> np.ndarray:
    """The places below `own` where the digest of w code points is a multiple of p."""
    n = min(own, len(codes) - w + 1)
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(w):
        h = (h ^ codes[j : n + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.flatnonzero(h % np.uint64(p) == 0)


def parsed(seqs: DataFrame, w: int = W, p: int = P) -> tuple[DataFrame, DataFrame, int]:
    """(j, start, d), the parse; (d, phrase, n), the distinct phrases in their order; and the text's length. seqs: (seq_id, name, seq)."""
    seqs = seqs.select("seq_id", "name", F.coalesce("seq", F.lit("")).alias("seq"))
    d = seqs.select("seq_id", "seq").join(following(ends(seqs, w - 1), w - 1), "seq_id").select("start", "seq", "tail")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names=["start", "piece", "kind"])

        for b in batches:
            rows, size = [], 0
            for start, seq, tail in zip(*b.columns, strict=True):
                start, seq, tail = start.as_py(), seq.as_py(), tail.as_py()
                s = seq + tail
                at = cuts(np.frombuffer(s.encode("utf-32-le"), dtype="<u4"), len(seq), w, p).tolist()
                if not start and (not at or at[0]):
                    at = [0, *at] if seq else at  # the text begins a phrase
                lead = s[: at[0] + w] if at else seq
                if at and not start:
                    lead = ""
                if lead:
                    rows.append((start, lead, "closes" if at else "within"))
                for x, y in zip(at, at[1:], strict=False):
                    rows.append((start + x, s[x : y + w], "whole"))
                    size += y - x
                    if size > 2_000_000:
                        yield made(rows)
                        rows, size = [], 0
                if at:
                    rows.append((start + at[-1], seq[at[-1] :], "opens"))
                size += len(lead)
            if rows:
                yield made(rows)

    pieces = written(d.mapInArrow(cut, "start long, piece string, kind string"), "pieces")
    n = seqs.agg(F.sum(F.length("seq"))).first()[0] or 0
    # a phrase over several sequences: its pieces in order, the last of which closes it, or the text ends
    opens = pieces.where("kind = 'opens'").select(F.col("start").alias("open"), "piece")
    more = as_of(pieces.where("kind in ('closes', 'within')").withColumnRenamed("piece", "more"), opens.select("open"), "start", "open", strict=True)
    parts = opens.select("open", F.col("open").alias("start"), "piece", F.lit("opens").alias("kind")).unionByName(more.select("open", "start", F.col("more").alias("piece"), "kind"))
    over = parts.groupBy("open").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "piece"))).alias("x"))
    text = F.array_join(F.transform("x", lambda x: x["piece"]), "")
    over = over.select(F.col("open").alias("start"), F.when(F.exists("x", lambda x: x["kind"] == "closes"), text).otherwise(F.concat(text, F.lit(END))).alias("phrase"))
    phrases = written(pieces.where("kind = 'whole'").select("start", F.col("piece").alias("phrase")).unionByName(over), "phrases")
    if not n:
        phrases = seqs.sparkSession.createDataFrame([(0, END)], "start long, phrase string")
    distinct = written(ranked(phrases.groupBy("phrase").agg(F.count("*").alias("n")), "phrase", name="d"), "dictionary")
    parse = ranked(phrases.join(distinct.drop("n"), "phrase").select("start", "d"), "start", name="j")
    return written(parse, "parse"), distinct, n


def _ordered(seqs: DataFrame, w: int, p: int):
    """What both results are made of: rests (d, o, c, g, lo, mixed), occurrences (d, start, follows, before) and the length."""
    parse, words, n = parsed(seqs, w, p)
    order = doubled_ranks(parse.select(F.col("j").alias("pos"), F.struct(F.col("d").alias("rk"), F.lit(0).cast("bigint").alias("next")).alias("k")), 1)
    nxt = order.select((F.col("pos") - 1).alias("j"), F.col("rk").alias("follows"))
    ends = words.select(F.col("d").alias("_d"), F.substring("phrase", F.length("phrase") - w, F.lit(1)).alias("before"))
    last = parse.join(ends, F.col("d") == F.col("_d")).select((F.col("j") + 1).alias("j"), "before")
    occ = parse.join(nxt, "j", "left").join(last, "j", "left").select("d", "start", F.coalesce("follows", F.lit(-1)).alias("follows"), "before")
    occ = written(occ, "occurrences")
    size = F.length("phrase") - F.when(F.col("phrase").endswith(END), F.lit(0)).otherwise(F.lit(w))
    rests = words.select("d", "n", "phrase", F.explode(F.sequence(F.lit(0), size - 1)).alias("o"))
    rests = written(rests.select("d", "n", "o", F.expr("substring(phrase, o + 1)").alias("rest"), F.when(F.col("o") > 0, F.substring("phrase", F.col("o"), F.lit(1))).alias("c")), "rests")
    groups = rests.groupBy("rest").agg(F.sum("n").alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("o").alias("o0"))
    groups = running_total(groups, "m", "rest", name="lo").select(F.col("rest").alias("_rest"), "lo", "m", ((F.col("o0") == 0) | (F.col("c0") != F.col("c1"))).alias("mixed"))
    rests = rests.join(groups, F.col("rest") == F.col("_rest")).select("d", "o", "c", "lo", "m", "mixed")
    return written(rests, "rests-in-order"), occ, n


def _placed(rests: DataFrame, occ: DataFrame) -> DataFrame:
    """(rk, pos, c) of every occurrence of the rests."""
    d = rests.select(F.col("d").alias("_d"), "o", "c", "lo").join(occ, F.col("_d") == F.col("d"))
    d = d.select("lo", "follows", (F.col("start") + F.col("o")).alias("pos"), F.coalesce("c", "before").alias("c"))
    d = ranked(d, "lo", "follows", name="_i")
    d = written(d, "in-order")
    first = d.groupBy("lo").agg(F.min("_i").alias("_first")).withColumnRenamed("lo", "_lo")
    return d.join(first, F.col("lo") == F.col("_lo")).select((F.col("lo") + F.col("_i") - F.col("_first")).alias("rk"), "pos", "c")


def suffix_array(seqs: DataFrame, w: int = W, p: int = P) -> DataFrame:
    """(rk, pos), as index.suffix_array has it: one sort of all places."""
    rests, occ, _ = _ordered(seqs, w, p)
    return _placed(rests, occ).select("rk", "pos")


def bwt_runs(seqs: DataFrame, w: int = W, p: int = P) -> DataFrame:
    """The runs of the transform with their samples, as index.bwt_runs has them, without the transform: rests with one letter before them
    are stretches at once, whose first and last suffix are those of the least and the greatest of what follows their phrases."""
    rests, occ, n = _ordered(seqs, w, p)
    t = lambda x: F.pmod(x - 1, F.lit(n + 1))
    ends = occ.groupBy("d").agg(F.min(F.struct("follows", "start")).alias("a"), F.max(F.struct("follows", "start")).alias("z")).withColumnRenamed("d", "_d")
    easy = rests.where("not mixed").join(ends, F.col("d") == F.col("_d"))
    side = lambda e: F.struct(F.col(f"{e}.follows").alias("follows"), (F.col(f"{e}.start") + F.col("o")).alias("pos"))
    easy = easy.groupBy("lo").agg(F.first("m").alias("m"), F.first("c").alias("c"), F.min(side("a")).alias("a"), F.max(side("z")).alias("z"))
    easy = easy.select("lo", (F.col("lo") + F.col("m") - 1).alias("hi"), "c", F.col("a.pos").alias("first"), F.col("z.pos").alias("last"))
    hard = _placed(rests.where("mixed"), occ).select(F.col("rk").alias("lo"), F.col("rk").alias("hi"), "c", F.col("pos").alias("first"), F.col("pos").alias("last"))
    pieces = written(ranked(easy.unionByName(hard), "lo", name="_i"), "stretches")
    before = pieces.select((F.col("_i") + 1).alias("_i"), F.col("c").alias("_c"), F.lit(True).alias("_has"))
    new = F.when(F.col("_has") & F.col("c").eqNullSafe(F.col("_c")), 0).otherwise(1)
    d = running_total(pieces.join(before, "_i", "left").withColumn("_new", new), "_new", "_i", name="_run").withColumn("run", (F.col("_run") + F.col("_new") - 1).cast("bigint"))
    g = d.groupBy("run").agg(F.min(F.struct("lo", "c", "first")).alias("a"), F.max(F.struct("hi", "last")).alias("z"))
    return g.select("run", F.col("a.c").alias("head"), F.col("a.lo").alias("lo"), F.col("z.hi").alias("hi"), (F.col("z.hi") - F.col("a.lo") + 1).alias("len"), t(F.col("a.first")).alias("first_tpos"), t(F.col("z.last")).alias("last_tpos"))
