"""Suffix-array deduplication: a logarithmic family of sparse suffix indexes.

Wanted: every byte that lies in a string of `least` (400) bytes that also starts anywhere else; and, reported beside it, how
many words lie in a passage of over 50 words that also stands in another document.

Sparse suffixes. Sorting all suffixes of a corpus is more than needed. Each `least`-unit string (units are bytes, or
digests of words for the passages) chooses one of its `gram`-unit substrings, the one with the smallest digest, the leftmost of
equals; a choice that depends on its units alone. Consecutive strings mostly choose the same one. So a text
has about one anchor per (least - gram) / 2 units, each with the range [lo, hi] of the string starts that chose it, and
two equal strings choose the same place in themselves: they lie in ranges of anchors with equal grams.
An anchor is (key, run): a digest of the gram there and one of the whole stretch [lo, hi + least) with the
anchor's place in it. A suffix array is the batch's keys in order; the order is that of the digests rather than of their
bytes, which serves equally: what is needed of the order is that equal strings stand together.

Index family (`IndexFamily`), kept in a folder of tables. `add` makes the array of a new batch, merge-scans it against
every level for keys that both hold (and against itself for keys it holds twice), writes these matches, and then merges levels
that hold as many batches each; n batches leave at most log2(n) + 1 levels, and each entry is
rewritten as often. Arrays are bucketed by key, so that scans and merges of levels are joins of buckets, without a
shuffle. A manifest is written last, so a family can be opened again after a lost driver, and added to.

Spans. Anchors whose key is among the matches, of whichever batch, are judged:
- a run seen twice (a run of words: in two documents): all its strings repeat;
- a key with one run, seen once: none does;
- else (the edges of repeated stretches) the strings in the range are compared one by one, by digests made
  in a second pass over those texts, against one holder of each other run of the key; a slice of the keys after the
  other, so that the digests of one slice alone are in shuffle files at once.
Digests of runs have 128 bits with the key, those of single strings 95.

A key is one row of an array, however often it stands in the texts; everything is counted before the shuffle, no group meets
in one task, and the joins of anchors are equi-joins that Spark can split where a key is hot.

Defined cases: null text is empty; texts shorter than `least` keep all; equal rows are copies of
each other; each input row gets a result row; an empty table gives an empty result; other
columns are not read. Texts of any length are read whole, a stretch of them at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm._common import drop, new_path, release, written
from seqloom.tables import if_small

LEAST, GRAM, BATCHES = 400, 200, 3
#: Passages: words of a string, of its grams.
PASSAGE, PASSAGE_GRAM = 51, 16
#: Units of a text that are in hand at once; longer words have a digest of their own kind.
STRETCH, LONG_WORD = 1 << 20, 4096
_POS = 24
#: Slices of the keys at the edges of runs; equal strings have equal keys.
SLICES = 3
#: Units, and at the edges the words of a run that stands in several documents itself.
BYTES, WORDS, ACROSS = 0, 1, 2


@cache
def _tables(n: int = STRETCH + 4 * LONG_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte value; powers of an odd base, and of its inverse, mod 2**64."""
    values = np.random.default_rng(8).integers(0, 2**64, 256, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    power = lambda b: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64))))
    return values, power(base), power(pow(base, -1, 2**64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Digests:
    """Digests of any substring of a stretch of numbers, from one running sum."""

    def __init__(self, numbers: np.ndarray) -> None:
        _, self._powers, self._inverse = _tables()
        self._sums = np.zeros(len(numbers) + 1, dtype=np.uint64)
        np.cumsum(numbers * self._powers[: len(numbers)], out=self._sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self._sums[end] - self._sums[begin]) * self._inverse[begin])

    def all(self, n: int) -> np.ndarray:
        k = len(self._sums) - n
        return _mixed((self._sums[n:] - self._sums[:k]) * self._inverse[:k])


def byte_numbers(data: bytes) -> tuple[int, Callable[[int, int], np.ndarray]]:
    """How many bytes, and the numbers of any stretch of them."""
    whole, values = np.frombuffer(data, dtype=np.uint8), _tables()[0]
    return len(whole), lambda a, b: values[whole[a:b]]


def word_numbers(data: bytes, stretch: int = STRETCH) -> tuple[int, Callable[[int, int], np.ndarray]]:
    """How many words (runs of what is not ASCII white space), and the numbers of any stretch of them, their digests."""
    whole = np.frombuffer(data, dtype=np.uint8)
    space = np.concatenate(([True], (whole == 32) | ((whole >= 9) & (whole <= 13)), [True]))
    change = np.flatnonzero(space[1:] != space[:-1])
    begin, end = change[::2], change[1::2]
    out, values = np.empty(len(begin), dtype=np.uint64), _tables()[0]
    long = np.flatnonzero(end - begin > LONG_WORD)
    at = 0
    while at < len(begin):
        to = int(np.searchsorted(begin, begin[at] + stretch))
        first = int(begin[at])
        d = Digests(values[whole[first : first + stretch + LONG_WORD]])
        out[at:to] = d.of(begin[at:to] - first, np.minimum(end[at:to], begin[at:to] + LONG_WORD) - first)
        at = to
    for i in long.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]], digest_size=8).digest(), "little")
    return len(out), lambda a, b: out[a:b]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """min(v[i : i + w]) for every i, by running minima of blocks from both sides."""
    x = np.concatenate((v, np.full(-len(v) % w, 2**64 - 1, dtype=np.uint64))).reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(v) - w + 1], ahead[w - 1 : len(v)])


def anchors(n: int, numbers: Callable[[int, int], np.ndarray], least: int = LEAST, gram: int = GRAM, stretch: int = STRETCH) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, run, lo, hi) of the anchors of a text of n units, as arrays, stretch by stretch."""
    for base in range(0, n - least + 1, stretch):
        d = Digests(part := numbers(base, min(n, base + stretch + least - 1)))
        h = d.all(gram)
        v = ((h >> np.uint64(_POS)) << np.uint64(_POS)) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_min(v, least - gram + 1) & np.uint64((1 << _POS) - 1)).astype(np.int64)
        cut = np.flatnonzero(at[1:] != at[:-1])
        lo, hi = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(at) - 1]))
        m = at[lo]
        place = ((m - lo) * (least + 1) + (hi - lo)).astype(np.uint64)
        assert len(part) == len(at) + least - 1
        yield h[m].view(np.int64), _mixed(d.of(lo, hi + least) + place * np.uint64(0x94D049BB133111EB)).view(np.int64), lo + base, hi + base


#: (unit, numbers, least, gram) of what is indexed.
Units = tuple[tuple[int, Callable, int, int], ...]


def units(least: int = LEAST, gram: int = GRAM, passage: int = PASSAGE, passage_gram: int = PASSAGE_GRAM) -> Units:
    return ((BYTES, byte_numbers, least, gram), (WORDS, word_numbers, passage, passage_gram))


ANCHORS = "d long, t long, u byte, key long, run long, lo int, hi int"


def _anchor_rows(of: Units):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, size = [], 0
            for d, t, text in zip(b["d"], b["t"], b["text"], strict=True):
                data = text.encode()
                for u, numbers, least, gram in of:
                    for key, run, lo, hi in anchors(*numbers(data), least, gram):
                        out.append((d, t, u, key, run, lo, hi))
                        size += len(key)
                if size > 200_000:
                    yield _frame(out)
                    out, size = [], 0
            if out:
                yield _frame(out)

    return rows


def _frame(parts: list[tuple]) -> pd.DataFrame:
    n = [len(p[3]) for p in parts]
    cols = {c: np.repeat(np.array([p[i] for p in parts], dtype=np.int8 if c == "u" else np.int64), n) for i, c in enumerate("dtu")}
    return pd.DataFrame(cols | {c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(("key", "run", "lo", "hi"), 3)})


class IndexFamily:
    """Levels of 1, 2, 4 ... batches in a folder: arrays (key, n) bucketed by key, beside the anchors of each batch and the
    keys that its scans have matched."""

    def __init__(self, spark: SparkSession, path: str, of: Units | None = None, buckets: int | None = None) -> None:
        self.spark, self.path, self.of = spark, path, of or units()
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.batches, self.levels = 0, []  # (size, name of its folder)
        self._tables: dict[str, str] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str, of: Units | None = None) -> IndexFamily:
        """The family as its last manifest has it."""
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        names = [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
        last = max(int(n.split("-")[1]) for n in names if n.startswith("manifest-"))
        said = json.loads(spark.read.text(f"{path}/manifest-{last}").first()[0])
        family = cls(spark, path, of, said["buckets"])
        family.batches, family.levels = said["batches"], [tuple(x) for x in said["levels"]]
        return family

    def _level(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = f"seqloom_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self._tables[name]} (key BIGINT, n BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(self._tables[name])

    def _store(self, array: DataFrame, name: str) -> None:
        """An array as a table in buckets of its keys, each sorted."""
        self._forget(name)
        table = f"seqloom_{uuid.uuid4().hex}"
        array.write.mode("overwrite").bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.path}/{name}").saveAsTable(table)
        self._tables[name] = table

    def _forget(self, *names: str) -> None:
        for name in names:
            if table := self._tables.pop(name, None):
                self.spark.sql(f"DROP TABLE {table}")

    def add(self, texts: DataFrame) -> DataFrame:
        """A batch of texts (d, t, text); returns (key), what it has matched: keys that it holds twice, or with a level."""
        k = self.batches
        texts.select("d", "t", "text").mapInPandas(_anchor_rows(self.of), ANCHORS).write.mode("overwrite").parquet(f"{self.path}/anchors-{k}")
        # the counts are dealt out by key already, in as many partitions as there are buckets
        self._store(self.anchors(k).groupBy("key").agg(F.count("*").alias("n")), f"level-{k}")
        array = self._level(f"level-{k}")
        matched = array.where("n > 1").select("key")
        for _, name in self.levels:
            matched = matched.unionByName(array.join(self._level(name).hint("merge"), "key", "left_semi").select("key"))
        matched.write.mode("overwrite").parquet(f"{self.path}/matches-{k}")
        # levels of as many batches merge
        size, merged, levels = 1, [f"level-{k}"], list(self.levels)
        while levels and levels[-1][0] == size:
            name = levels.pop()[1]
            both = array.withColumnRenamed("n", "_n").join(self._level(name).hint("merge"), "key", "full")
            self._store(both.select("key", (F.coalesce("_n", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n")), f"level-{k}-{2 * size}")
            merged += [name, f"level-{k}-{2 * size}"]
            size, array = 2 * size, self._level(f"level-{k}-{2 * size}")
        self.levels, self.batches = [*levels, (size, merged[-1])], k + 1
        said = json.dumps({"buckets": self.buckets, "batches": self.batches, "levels": self.levels})
        self.spark.range(1, numPartitions=1).select(F.lit(said).alias("value")).write.mode("overwrite").text(f"{self.path}/manifest-{self.batches}")
        gone = [n for n in merged[:-1] if n not in {x for _, x in self.levels}]
        self._forget(*gone)
        drop(self.spark, *(f"{self.path}/{n}" for n in gone), f"{self.path}/manifest-{k}")
        return self.matches(k)

    def _tables_of(self, kind: str, schema: str, batch: int | None) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}-{k}" for k in (range(self.batches) if batch is None else [batch])])

    def anchors(self, batch: int | None = None) -> DataFrame:
        """Of one batch, or of all."""
        return self._tables_of("anchors", ANCHORS, batch)

    def matches(self, batch: int | None = None) -> DataFrame:
        """(key), of the scans of one batch, or of all."""
        return self._tables_of("matches", "key long", batch)

    def array(self) -> DataFrame:
        """(key, n) over all levels."""
        names = [f"{self.path}/{name}" for _, name in self.levels]
        return self.spark.read.schema("key long, n long").parquet(*names).groupBy("key").agg(F.sum("n").alias("n"))

    def drop_arrays(self) -> None:
        """The anchors and matches alone stay; nothing can be added any more."""
        self._forget(*list(self._tables))
        drop(self.spark, *(f"{self.path}/{name}" for _, name in self.levels))

    def close(self, drop_files: bool = True) -> None:
        self._forget(*list(self._tables))
        if drop_files:
            drop(self.spark, self.path)


def _string_digests(of: Units, stretch: int = STRETCH):
    """For each range of a text: a digest for every string that starts in it."""
    by = {u: (numbers, least) for u, numbers, least, _ in of}
    by[ACROSS] = by[WORDS]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, size = {c: [] for c in ("d", "t", "u", "key", "lo", "h")}, 0
            for doc, t, text, ranges in zip(b["d"], b["t"], b["text"], b["ranges"], strict=True):
                data, last = text.encode(), None
                for u, lo, hi, key in sorted(map(tuple, np.asarray(ranges, dtype=np.int64).reshape(-1, 4).tolist())):
                    if u != last:
                        (n, numbers), least, last, d = by[u][0](data), by[u][1], u, None
                    if d is None or hi + least > base + stretch + least:
                        base = lo
                        d = Digests(numbers(base, min(n, base + stretch + least)))
                    p = np.arange(lo - base, hi - base + 1)
                    out["h"].append(d.of(p, p + least).view(np.int64))
                    for c, v in (("d", doc), ("t", t), ("u", u), ("key", key & 0x7FFFFFFF), ("lo", lo)):
                        out[c].append(v)
                    size += len(p)
                if size > 500_000:
                    yield pd.DataFrame(out)
                    out, size = {c: [] for c in out}, 0
            if out["t"]:
                yield pd.DataFrame(out)

    return rows


def _flat(*columns: str):
    """Distinct tuples of the columns in one flat array, which goes to numpy as it is."""
    return F.flatten(F.transform(F.collect_set(F.struct(*columns)), lambda x: F.array(*[x[c].cast("bigint") for c in columns])))


def _edges_of_runs(places: str, side: int):
    """Of a sorted array of places those without a neighbour one to the side."""
    near = F.col(places)
    return F.filter(near, lambda x, j: ~F.coalesce(F.get(near, j + side) == x + side, F.lit(False)))


def _across(unit, d_low, d_high):
    """Bytes repeat anywhere, passages of words in another document."""
    return (unit == BYTES) | (d_low != d_high)


def _runs_of_strings(edge: DataFrame) -> tuple[DataFrame, str]:
    """(_rid, r): for ranges of edges that hold all strings of their keys, the places [a, z] in a range whose strings repeat; and where that is written."""
    each = lambda of_unit, *more: edge.where(of_unit).select("key", F.explode("h").alias("h"), *more).groupBy("key", "h")
    twice = each(F.col("u") == BYTES).agg(F.count("*").alias("n")).where("n > 1").select("key", "h")
    words = each(F.col("u") != BYTES, "d", "u").agg(F.count("*").alias("n"), F.min("d").alias("d0"), F.max("d").alias("d1"), F.max("u").alias("u"))
    twice = twice.unionByName(words.where(f"n > 1 and (d0 <> d1 or u = {ACROSS})").select("key", "h"))
    twice, p_twice = written(twice.select(F.col("key").alias("_key"), F.col("h").alias("_h")), "repeated-strings")
    release(edge.sparkSession)
    # only a row number and a place travel with each digest; the places of a range join to runs before they meet its text
    one = edge.select("rid", "key", F.posexplode("h").alias("i", "h")).join(twice, (F.col("h") == F.col("_h")) & (F.col("key") == F.col("_key"))).groupBy("rid").agg(F.sort_array(F.collect_list("i")).alias("i"))
    found = written(one.select(F.col("rid").alias("_rid"), F.explode(F.arrays_zip(_edges_of_runs("i", -1).alias("a"), _edges_of_runs("i", 1).alias("z"))).alias("r")), "string-runs")
    drop(edge.sparkSession, p_twice)
    release(edge.sparkSession)
    return found


def spans_of(family: IndexFamily, texts: DataFrame, close: bool = False) -> DataFrame:
    """(d, t, bytes, words): the ranges [lo, hi] of starts of repeated strings, of either unit, one number after the other, for
    all the texts (d, t, text) that the family was made of. What repeats depends on the text alone, so rows of
    equal d and t share their spans. With `close` the family's arrays are deleted at once, and the rest as soon as its matched anchors are at hand."""
    spark = family.spark
    if close:
        family.drop_arrays()
    held, p_held = written(family.anchors().join(family.matches(), "key", "left_semi"), "matched-anchors")
    if close:
        family.close()
    release(spark)
    who = F.xxhash64("d", "t", "lo")
    runs = held.groupBy("u", "key", "run").agg(F.count("*").alias("n"), F.min(who).alias("holder"), F.min("d").alias("d0"), F.max("d").alias("d1"))
    runs, p_runs = written(runs, "runs")
    many = runs.groupBy("key").agg(F.count("*").alias("runs")).where("runs > 1").select(F.col("key").alias("_key"))
    whole = (F.col("n") > 1) & _across(F.col("u"), F.col("d0"), F.col("d1"))
    known = runs.join(many, F.col("key") == F.col("_key"), "left").select(F.col("u").alias("_u"), F.col("key").alias("_k"), F.col("run").alias("_r"), "holder", whole.alias("whole"), F.col("_key").isNotNull().alias("more"))
    known, p_known = written(known.where("whole or more"), "known-runs")
    # the column that tells most rows apart comes first, so that sorts seldom look at the others
    hits = held.join(known, (F.col("run") == F.col("_r")) & (F.col("key") == F.col("_k")) & (F.col("u") == F.col("_u")))
    hits = hits.select("d", "t", "u", "key", "lo", "hi", "whole", (F.col("more") & (~F.col("whole") | (F.col("holder") == who))).alias("open"))
    hits, p_hits = written(hits.where("whole or open"), "hits")
    drop(spark, p_held, p_runs, p_known)
    release(spark)
    # the edges: one digest for each string there
    unit = F.when((F.col("u") == WORDS) & F.col("whole"), ACROSS).otherwise(F.col("u"))
    ranges = hits.where("open").withColumn("u", unit).groupBy(F.col("d").alias("_d"), F.col("t").alias("_t")).agg(_flat("u", "lo", "hi", "key").alias("ranges"))
    ranges, p_ranges = written(ranges, "ranges")
    edge = texts.join(if_small(ranges, size=8 * F.size("ranges")), (F.col("d") == F.col("_d")) & (F.col("t") == F.col("_t"))).select("d", "t", "text", "ranges")
    edge = edge.mapInPandas(_string_digests(family.of), "d long, t long, u byte, key int, lo int, h array<long>")
    edge, p_edge = written(edge.withColumns({"rid": F.monotonically_increasing_id(), "slice": F.pmod("key", F.lit(SLICES))}), "edges", "slice")
    drop(spark, p_ranges)
    release(spark)
    found = [_runs_of_strings(edge.where(F.col("slice") == i)) for i in range(SLICES)]
    one = reduce(DataFrame.unionByName, (x for x, _ in found))
    one = edge.select("rid", "d", "t", "u", "lo").join(one, F.col("rid") == F.col("_rid")).select("d", "t", "u", (F.col("lo") + F.col("r.a")).alias("lo"), (F.col("lo") + F.col("r.z")).alias("hi"))
    spans = hits.where("whole").select("d", "t", "u", "lo", "hi").unionByName(one).withColumns({"b0": F.when(F.col("u") == BYTES, F.struct("lo", "hi")), "w0": F.when(F.col("u") != BYTES, F.struct("lo", "hi"))})
    flat = lambda c: F.flatten(F.transform(F.collect_set(c), lambda x: F.array(x["lo"], x["hi"])))
    spans, _ = written(spans.groupBy("d", "t").agg(flat("b0").alias("bytes"), flat("w0").alias("words")), "spans")
    drop(spark, p_hits, p_edge, *(p for _, p in found))
    release(spark)
    return spans


def keyed(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, d, t, text): t a digest of the text; d may stand for a null doc_id as it is."""
    texts = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.withColumn("t", F.xxhash64("text"))


def indexable(texts: DataFrame, of: Units) -> DataFrame:
    """Those long enough for a string of some unit; a word and its gap have two bytes at least."""
    return texts.where(F.octet_length("text") >= min(least if u == BYTES else 2 * least - 1 for u, _, least, _ in of))


def repeated(docs: DataFrame, of: Units | None = None, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """(texts, spans) of docs, by a family that takes them in batches."""
    of = of or units()
    texts = keyed(docs)
    held = indexable(texts, of)
    family = IndexFamily(docs.sparkSession, new_path(docs.sparkSession, "family"), of)
    for i in range(batches):
        family.add(held.where(F.pmod("t", F.lit(batches)) == i))
        release(docs.sparkSession)
    return texts, spans_of(family, held, close=True)


def covered(starts, least: int) -> list[tuple[int, int]]:
    """Maximal [begin, end) that strings starting in the ranges cover, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(map(tuple, np.asarray(starts).reshape(-1, 2).tolist())):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi + least))
        else:
            out.append((lo, hi + least))
    return out


def without(texts: DataFrame, spans: DataFrame, of: Units | None = None, kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_passage_words, kept_sha256, and kept (what is left, binary) unless that is not asked for."""
    least = {u: n for u, _, n, _ in of or units()}
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "n_passage_words", "kept_sha256", "kept"]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            rows, size = [], 0
            for d, text, starts, words in zip(b["doc_id"], b["text"], b["bytes"], b["words"], strict=True):
                data, at, parts = text.encode(), 0, []
                gone = covered(starts, least[BYTES]) if starts is not None else []
                for begin, end in gone:
                    parts.append(data[at:begin])
                    at = end
                left = b"".join((*parts, data[at:]))
                passages = sum(e - s for s, e in covered(words, least[WORDS])) if words is not None else 0
                rows.append((d, len(data), len(data) - len(left), len(gone), passages, hashlib.sha256(left).hexdigest(), left if kept else None))
                size += len(left) if kept else 0
                if size > 8_000_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=columns)

    s = spans.select(F.col("d").alias("_d"), F.col("t").alias("_t"), "bytes", "words")
    s = if_small(s, size=4 * (F.size("bytes") + F.size("words")))
    joined = texts.join(s, (F.col("d") == F.col("_d")) & (F.col("t") == F.col("_t")), "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "bytes", "words")
    # as text, because pandas would make numbers with nulls among them floating
    out = joined.mapInPandas(cut, "doc_id string, n_bytes long, n_removed long, n_spans long, n_passage_words long, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).select(columns if kept else columns[:-1])


def deduplicated(docs: DataFrame, of: Units | None = None, batches: int = BATCHES, kept: bool = True) -> DataFrame:
    """docs (doc_id, text) without their repeated strings, as `without` gives them."""
    return without(*repeated(docs, of, batches), of, kept)


def suffix_report(docs: DataFrame) -> DataFrame:
    """The contract's columns, and n_passage_words: words in passages of over 50 words that also stand in another document."""
    return deduplicated(docs, kept=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")
