"""SimHash near-duplicates: byte-position inverted index with count filtering.

A fingerprint's bits are the majority bits of the XXH64 digests of its 3-word shingles. Two
fingerprints link at 2 or fewer differing bits; so of their 8 positional bytes at least 6 agree.

Index. A list for each single (position, byte) would hold a 256th of all fingerprints, and its pairs would grow
with the square of the corpus. So the single-byte lists are kept within the six lists of four positional bytes
each ("two of the four blocks of two bytes agree"): 2 differing bits touch 2 blocks at most, so a linked pair is in one
of these together. There each fingerprint is filed under each of its other four (position, byte); how many of these lists
a pair meets in is tallied, pairs of fewer than 4 + 2 shared positional bytes are dropped, and the rest are verified by
their differing bits.
Lists of four positional bytes with more than `dense` fingerprints are not paired, as their pairs grow with their square: there
each fingerprint is filed under itself and its 32 one-bit changes outside the list's blocks. Two
fingerprints are within 2 bits exactly if they meet under one of these, where no more than 33 can meet; each then links to
the least one there. So no link between different fingerprints is lost from the components.

Equal fingerprints are one node before any of this. Components: alternating large-star and
small-star steps over tables in the shared folder.

Defined cases: a null or wordless text has fingerprint zero, which links like any other; rows with
equal doc_id each get a row; null doc_ids stay, and count for no component's smallest id; an empty
table gives an empty result; other columns are not read. Texts of any length are taken whole; their shingles are
hashed in blocks, so memory is a few times the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm._common import drop, written

SEED, SHINGLE, MAX_BITS, DENSE = 42, 3, 2, 32
BLOCKS = list(combinations(range(4), 2))


def fingerprint(text: str, shingle: int = SHINGLE, block: int = 1 << 16) -> int:
    """64 bits, unsigned. bytes.lower and bytes.split know ASCII only, as wanted here."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    whole, n = b" ".join(words), max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    first, last = starts[:n].tolist(), (starts + lengths)[-n:].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, block):
        h = np.array([xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in zip(first[i : i + block], last[i : i + block], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """As signed 64-bit integers."""
    for s in texts:
        yield pd.Series(np.array([fingerprint(t) for t in s], dtype=np.uint64).view(np.int64))


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))


def _lists(fp: Column) -> Column:
    """The six lists that a fingerprint stands in."""
    return F.array(*[F.lit(n << 32).cast("long") + F.shiftleft(_block(fp, i), 16) + _block(fp, j) for n, (i, j) in enumerate(BLOCKS)])


def _other_bytes(fp: Column, tag: Column) -> Column:
    """(position << 8) + byte for the four positional bytes that are not in the blocks of a list with this tag."""
    of = F.array(*[F.array(*[F.lit(k) for k in range(8) if k // 2 not in b]) for b in BLOCKS])
    at = F.element_at(of, (tag + 1).cast("int"))
    return F.transform(at, lambda k: (k * 256 + F.call_function("shiftrightunsigned", fp, k * 8).bitwiseAND(F.lit(0xFF))).cast("int"))


def links(nodes: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b), a > b: links between distinct fingerprints (column fp) that connect all within MAX_BITS."""
    post = nodes.select("fp", F.explode(_lists(F.col("fp"))).alias("list"))
    sizes = post.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    post = post.join(sizes, "list")
    of = lambda x, y: F.struct(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    few = post.where(F.col("n") <= dense).select("list", "fp", F.explode(_other_bytes(F.col("fp"), F.shiftright("list", 32))).alias("at"))
    few = few.groupBy("list", "at").agg(F.collect_list("fp").alias("f")).where(F.size("f") > 1)  # at most `dense`
    pairs = F.flatten(F.transform("f", lambda x, i: F.transform(F.slice("f", i + 2, dense), lambda y: of(x, y))))
    tally = few.select("list", F.explode(pairs).alias("p")).groupBy("list", "p.a", "p.b").agg(F.count("*").alias("shared"))
    few = tally.where((F.col("shared") + 4 >= 8 - MAX_BITS) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")
    many = post.where(F.col("n") > dense).withColumn("tag", F.shiftright("list", 32))
    other = F.element_at(F.array(*[F.array(*[F.lit(k) for k in range(64) if k // 16 not in b]) for b in BLOCKS]), (F.col("tag") + 1).cast("int"))
    changed = F.concat(F.array("fp"), F.transform(other, lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    many = many.select("fp", "tag", F.explode(changed).alias("m")).groupBy("tag", "m").agg(F.sort_array(F.collect_list("fp")).alias("f")).where(F.size("f") > 1)  # at most 33
    many = many.select(F.get("f", F.lit(0)).alias("b"), F.explode(F.slice("f", 2, 64)).alias("a")).select("a", "b")
    return few.unionByName(many).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): b the smallest node that a reaches, for every node a that is not itself smallest.
    edges: a > b. Minima are aggregated before the shuffle, so a hub costs no more than its links."""
    spark = edges.sparkSession
    edges, path = written(edges, "edges")
    mark = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            return edges
        mark = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, middle = written(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(low, F.col("a") == F.col("k"))
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges, after = written(small, "small-star")
        drop(spark, path, middle)
        path = after


def near_duplicates(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of docs (doc_id, text)."""
    fps, _ = written(docs.select("doc_id", F.pandas_udf(_fingerprints, "long")(F.coalesce(F.col("text"), F.lit(""))).alias("fp")), "fingerprints")
    nodes, _ = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    root = components(links(nodes.select("fp"), dense)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    nodes = nodes.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    of = nodes.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
