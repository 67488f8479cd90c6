"""Target-distribution importance resampling: hashed n-gram features by a streaming CRC ring.

One scan per document. It keeps a ring of running CRC-32 states, one for each of the last n starts. A word extends each of
them by a space and the word's bytes, and begins a new one: so every run of 1 to n consecutive words is hashed
without its text ever being put together, and its bucket is emitted. The buckets of a document are written as one
array, beside the sums of the task; nothing is scanned twice.

Sums: each task counts its buckets in one array of as many numbers as there are buckets, given on in chunks, which Spark adds up.
Gains are one row per bucket, a number that is a parameter; they go back to the tasks as one array. The draw is by
global ranks, so no task sorts all documents.

Defined cases: null or wordless text has no features, weight 0, and is drawn only if `least_words` is 0; rows of equal doc_id each
get a row (equal scores follow doc_id, then any order); a null doc_id is digested as empty text and comes first among equal scores; an
empty table on either side has sums of 0, and an empty one of documents gives an empty result; other columns are not
read. A document's features are in memory at once, as numbers; texts of any length are taken whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm._common import UPPER, written
from seqloom.tables import ranked

N, BUCKETS, SHARE, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {ord(c): c.lower() for c in UPPER}
CHUNK = 4096
FEATURES = "doc_id long, n_words long, buckets array<int>, chunk int, sums array<long>"


def _words(text: str) -> list[str]:
    return WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER))


def ring(words: list[bytes], n: int) -> Iterator[int]:
    """The CRC-32 of every run of 1 to n consecutive words, joined by a space, in order of the runs' ends."""
    crc, states = zlib.crc32, []
    for w in words:
        spaced = b" " + w
        states = [crc(spaced, s) for s in states[-(n - 1) :]] if n > 1 else []
        states.append(crc(w))
        yield from states


def bucket_array(text: str, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """How many words a text has, and the buckets of its features."""
    words = _words(text)
    if n == 1:  # a ring of one state: a word has one hash wherever it stands
        hashes = np.fromiter(map(zlib.crc32, map(str.encode, words)), dtype=np.int64, count=len(words))
    else:
        hashes = np.fromiter(ring([w.encode() for w in words], n), dtype=np.int64)
    return len(words), hashes % buckets


def scanned(docs: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """FEATURES: a row for each document, and behind them the task's sums in chunks (doc_id null, chunk not)."""

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("buckets", pa.list_(pa.int32())), ("chunk", pa.int32()), ("sums", pa.list_(pa.int64()))])

    def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0), type=kind))

    def batch(ids, words, parts, chunks, sums) -> pa.RecordBatch:
        k, m = len(ids), len(chunks)
        b = lists([p.astype(np.int32) for p in parts] + [np.zeros(0, np.int32)] * m, pa.int32())
        s = lists([np.zeros(0, np.int64)] * k + sums, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ids + [None] * m, pa.int64()), pa.array(words + [None] * m, pa.int64()), b, pa.array([None] * k + chunks, pa.int32()), s], schema=schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for rows in batches:
            ids, words, parts, size = [], [], [], 0
            for id_, text in zip(rows.column("doc_id").to_pylist(), rows.column("text"), strict=True):
                w, b = bucket_array(text.as_py(), n, buckets)
                total += np.bincount(b, minlength=buckets)
                ids.append(id_)
                words.append(w)
                parts.append(b)
                size += len(b)
                if size > 1_000_000:
                    yield batch(ids, words, parts, [], [])
                    ids, words, parts, size = [], [], [], 0
            if ids:
                yield batch(ids, words, parts, [], [])
        if total.any():
            chunks = list(range(-(-buckets // CHUNK)))
            yield batch([], [], [], chunks, [total[c * CHUNK : (c + 1) * CHUNK] for c in chunks])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(scan, FEATURES)


def bucket_sums(features: DataFrame) -> DataFrame:
    """(bucket, n): sums over all tasks."""
    each = features.where("chunk is not null").select("chunk", F.posexplode("sums").alias("i", "n")).where("n > 0")
    return each.groupBy((F.col("chunk") * CHUNK + F.col("i")).alias("bucket")).agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket floor(1000 ln of the target's smoothed share over the source's). A row a bucket is collected."""
    both = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").collect()
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in both:
        s[r["bucket"]], t[r["bucket"]] = r["s"] or 0, r["t"] or 0
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of a document's features."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("buckets")
            ends = np.asarray(lists.offsets)
            n = np.diff(ends).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(gain[np.asarray(lists.values)])])
            sums = sums[ends[1:]] - sums[ends[:-1]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(n), pa.array(np.where(n > 0, sums // np.maximum(n, 1), 0))], schema=schema)

    return features.where("chunk is null").select("doc_id", "n_words", "buckets").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_features, weight, score, rank. Of those with least_words words the `share` percent of
    the highest scores are drawn: weight plus Gumbel noise by a digest of the doc_id. target: (text)."""
    features, _ = written(scanned(docs, n, buckets), "features")
    wanted, _ = written(scanned(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, buckets), "target-features")
    d = weighed(features, gains(bucket_sums(features), bucket_sums(wanted), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    d, _ = written(d.withColumn("score", F.col("weight") + noise), "weights")
    may = F.col("n_words") >= least_words
    drawn = d.where(may).count() * share // 100
    first = ranked(d.where(may).select("doc_id", "n_features", "weight", "score"), F.desc("score"), F.asc("doc_id"), name="rank").withColumn("rank", F.col("rank") + 1)
    first = first.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = d.where(~may).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return first.unionByName(rest)


def resampling_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The contract's columns."""
    return resampled(docs.select("doc_id", "text"), target.select("text"))


_W = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH RECURSIVE tab AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(0, 256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM tab WHERE k < 8),
tt AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_W} AS w FROM documents),
p AS (SELECT rid, unnest(w) AS w FROM d), b AS (SELECT unnest({_W}) AS w FROM benchmark),
u AS (SELECT w, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(w)), lambda i: ('0x' || substring(hex(encode(w)), (2 * i + 1)::INT, 2))::BIGINT)),
   lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000) AS bk FROM (SELECT w FROM p UNION SELECT w FROM b), tt),
s AS (SELECT bk, count(*) AS s FROM p JOIN u USING (w) GROUP BY bk), t AS (SELECT bk, count(*) AS t FROM b JOIN u USING (w) GROUP BY bk),
z AS (SELECT (SELECT count(*) FROM p)::DOUBLE AS sn, (SELECT count(*) FROM b)::DOUBLE AS tn),
g AS (SELECT bk, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sn + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (tn + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bk), z),
m AS (SELECT rid, count(*) AS n, sum(gain) AS g FROM p JOIN u USING (w) JOIN g USING (bk) GROUP BY rid),
v AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(g::DOUBLE / n), 0)::BIGINT AS weight, ('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT AS h FROM d LEFT JOIN m USING (rid)),
x AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score FROM v),
r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS k FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= (SELECT count(*) * 10 // 100 FROM x WHERE n_features >= 20) THEN k END AS rank FROM r
"""
