"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of 13 consecutive words (one shorter window if it has fewer). A
window is held to occur in a document exactly, so by the prefix principle one shingle of it is a
sufficient prefix: the shingles (up to 3 consecutive words) of each window are ordered by how
rare they are over all documents, and only the rarest is looked up. A document position with that
shingle fixes where the window would stand: it must lie within the document (position and length
bounds), and then the words there are compared with the window's.

Defined cases: a null or wordless text or item has no words, is not hit and has no windows; texts of any length are
searched whole, their words in one row; each input row of the documents gets one result row, repeated rows too; repeated items or windows count
per item_id; null item_ids are left out; an empty table on either side gives no hits; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm._common import ascii_lower, split_words, written
from seqloom.tables import blocks

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WINDOW, SHINGLE = 13, 3
#: Windows broadcast at once; more of them, or more than 64 MB of their words, are taken in blocks, each over all documents.
BLOCK = 100_000


def words(text: Column) -> Column:
    return split_words(ascii_lower(text), GAP)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(win_id, len, w, item_id): the distinct windows of every item. win_id is a digest of the words."""
    i = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - (window - 1)))
    i = i.select("item_id", "_w", F.explode(starts).alias("_s")).select("item_id", F.slice("_w", F.col("_s"), window).alias("w")).distinct()
    return i.select(F.sha2(F.array_join("w", " "), 256).alias("win_id"), F.size("w").alias("len"), "w", "item_id")


def _shingle(array: str, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(F.col(array), at + k) for k in range(n)])


def _positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each word position p of each document, and one more with p = n; the words stay
    in the row, which no exchange sees before the lookup."""
    d = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("p"))
    keys = [F.when(F.col("p") + s <= F.col("n"), _shingle("w", F.col("p"), s)) for s in sizes]
    if len(keys) == 1:
        return d.withColumn("h", keys[0])
    # the position behind the last word stands once
    return d.select("*", F.explode(F.when(F.col("p") < F.col("n"), F.array(*keys)).otherwise(F.array(F.lit(None).cast("bigint")))).alias("h"))


def occurrences(docs: DataFrame, windows: DataFrame, block: int = BLOCK) -> DataFrame | None:
    """(rid, doc_id, n, start, len, win_id): every occurrence of a window in a document, and a row
    with null start for every document. windows: distinct (win_id, len, w)."""
    spark = docs.sparkSession
    windows, _ = written(windows, "windows")
    sizes = sorted(r[0] for r in windows.select(F.least("len", F.lit(SHINGLE)).alias("s")).distinct().collect())  # three at most
    if not sizes:
        return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.size(words(F.col("text"))).alias("n"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("string").alias("win_id"))
    key = F.coalesce(*[F.when(F.least("len", F.lit(SHINGLE)) == s, _shingle("w", F.col("o"), s)) for s in sizes])
    shingles = windows.select("*", F.explode(F.sequence(F.lit(0), F.col("len") - F.least("len", F.lit(SHINGLE)))).alias("o")).withColumn("h", key)
    # how often each shingle of the windows occurs, over all documents; counted before the shuffle
    keys, _ = written(shingles.select(F.col("h").alias("k")).distinct(), "shingles")
    counts = None
    for b in blocks(keys, "k", block * WINDOW):
        p = _positions(docs, sizes).select("h").join(F.broadcast(b), F.col("h") == F.col("k")).groupBy("h").agg(F.count("*").alias("df"))
        counts = p if counts is None else counts.unionByName(p)
    # a window with a shingle that occurs nowhere cannot occur
    seen = shingles.join(counts, "h", "left").groupBy("win_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "o")).alias("m")).where("m.df > 0")
    prefix, _ = written(seen.select("win_id", F.col("m.h").alias("k"), F.col("m.o").alias("o")).join(windows, "win_id").withColumnRenamed("w", "ww"), "prefixes")
    at = F.col("p") - F.col("o")
    true_there = (F.col("h") == F.col("k")) & (at >= 0) & (at + F.col("len") <= F.col("n")) & (F.slice("w", at + 1, F.col("len")) == F.col("ww"))
    out = None
    for i, b in enumerate(blocks(prefix, "win_id", block, F.octet_length(F.array_join("ww", " ")))):
        found = _positions(docs, sizes).join(F.broadcast(b), true_there, "left").where(F.col("win_id").isNotNull() | ((F.col("p") == F.col("n")) & F.lit(i == 0)))
        found = found.select("rid", "doc_id", "n", F.when(F.col("win_id").isNotNull(), at).alias("start"), "len", "win_id")
        out = found if out is None else out.unionByName(found)
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Per input row of docs (doc_id, text): rid, doc_id, n_words, n_hit, n_items, items (sorted
    strings), contaminated.

    Documents are read twice and their texts never shuffled. What is broadcast is a block of the
    windows; what is shuffled is a row a document and a row an occurrence.
    """
    by_item, _ = written(item_windows(items, window), "item-windows")
    found, _ = written(occurrences(docs, by_item.select("win_id", "len", "w").dropDuplicates(["win_id"]), block), "occurrences")
    # spans come of the occurrences alone; items of each window that a document has, however often it stands there
    of = by_item.select(F.col("win_id").alias("_id"), F.col("item_id").cast("string").alias("item"))
    held = found.where("win_id is not null").select(F.col("rid").alias("_rid"), "win_id").distinct()
    held = held.join(of, F.col("win_id") == F.col("_id")).groupBy("_rid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    spans = F.sort_array(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", (F.col("start") + F.col("len")).alias("end")))))
    d = found.groupBy("rid", "doc_id", F.col("n").cast("bigint").alias("n_words")).agg(spans.alias("s"))
    d = d.join(held, F.col("rid") == F.col("_rid"), "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    # running sum over the sorted spans: what each adds beyond the furthest end so far
    first = F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).cast("bigint").alias("hit"), F.greatest(a["end"], x["end"]).alias("end"))
    d = d.select("rid", "doc_id", "n_words", F.aggregate("s", first, step, lambda a: a["hit"]).alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items")
    return d.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns."""
    d = contamination(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return d.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
p AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS s FROM d),
o AS (SELECT rid, s, z.n, array_to_string(w[s:s + z.n - 1], ' ') AS k FROM p, (SELECT DISTINCT n FROM v) z WHERE s + z.n - 1 <= len(w)),
h AS (SELECT rid, s, n, item_id FROM o JOIN v USING (n, k)),
c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS pos FROM (SELECT DISTINCT rid, s, n FROM h)) GROUP BY rid),
g AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM h) GROUP BY rid)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN g USING (rid)
"""
