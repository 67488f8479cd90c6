"""Phrase collocations: minimal perfect hashing of Apriori-safe candidates, counted by slot.

Levels, from words to phrases of `longest` words. What is frequent (f >= least) at one level leaves segments: maximal runs of
words in which every phrase of that level is frequent. A phrase of the next level can be frequent only within one,
so only there candidates are looked for; the segments shrink from level to level, and texts are read twice, for words.

Candidates of a level. Each task counts its phrases by hashed bucket, as bytes that stop at `least` (a sum of such bytes
reaches `least` exactly if the sum of the counts does). Phrases in buckets that stay below are left out, the others are the
candidates. Buckets are as many as the words ask for, up to a bound: more of them mean fewer candidates; they change no result.
Counts. A minimal perfect hash gives each candidate a slot, and the candidate itself is stored under it: a phrase that is
none is told by comparison, not by its hash. Each task counts its slots in a numpy array, arrays are added up in a
tree of at most FAN at a time, and the frequencies of a phrase's parts are read by their slots.

Bounds. Candidates, and frequent words and phrases, are taken in blocks of about BLOCK, each with its own hash, its own pass over the segments and its own broadcast
of a few dozen bytes a key; so what a task or the driver holds does not grow, but passes do, with the number of candidates.
64-bit hashes that two candidates share are no fault: the second is kept beside the hash.

Defined cases: null text is empty, null lang is `und`; repeated rows count each; an empty table or one without candidates gives an empty
result; texts of any length are taken whole, one at a time beside the arrays; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm._common import drop, written

LEAST, LONGEST, COVER, TOP = 30, 4, 80, 2000
BLOCK, BUCKETS, FAN = 1 << 22, 1 << 24, 256
#: Slots and buckets in a row of sums; words that a task looks at in one go, and in all (32 MB), where there are more than the cores have.
SLOTS, BYTES, STRETCH, SHARE = 2048, 16_384, 1 << 19, 1 << 23
#: Words that a bucket has in the mean, as long as there are no more than BUCKETS of them.
LOAD = 16
BREAK = b"\xff"  # no byte of UTF-8
_TABLE = bytes(BREAK[0] if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: str) -> list[bytes]:
    """Lower-cased words, with BREAK where a piece ends. Of the white space that bytes.split knows only blanks are left."""
    return text.encode().translate(_TABLE).replace(BREAK, b" \xff ").split()


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit numbers, well mixed."""
    x = x + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def phrase_hash(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of word numbers."""
    h = np.zeros(len(ids), dtype=np.uint64)
    for j in range(ids.shape[1]):
        h = mixed(h ^ ids[:, j].astype(np.uint64), j)
    return h


def word_hash(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit numbers: levels of bits, a number belonging to the first one where it fell
    alone; its slot is the number of bits before its own."""

    def __init__(self, h: np.ndarray) -> None:
        self.levels, before = [], 0
        while len(h):
            m = -(-2 * len(h) // 64) * 64
            at = mixed(h, len(self.levels)) % np.uint64(m)
            alone = np.bincount(at.astype(np.int64), minlength=m) == 1
            bits = np.packbits(alone, bitorder="little").view("<u8")
            counts = np.bitwise_count(bits).astype(np.int64)
            self.levels.append((m, bits, before + np.cumsum(counts) - counts))
            before += int(counts.sum())
            h = h[~alone[at.astype(np.int64)]]

    def slots(self, h: np.ndarray) -> np.ndarray:
        """-1 for some of the numbers that are not in it; others get any slot."""
        out, left = np.full(len(h), -1, dtype=np.int64), np.arange(len(h))
        for k, (m, bits, before) in enumerate(self.levels):
            if not len(left):
                break
            at = mixed(h[left], k) % np.uint64(m)
            word, bit = bits[(at >> np.uint64(6)).astype(np.int64)], at & np.uint64(63)
            here = (word >> bit) & np.uint64(1) > 0
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = (before[(at >> np.uint64(6)).astype(np.int64)] + below)[here]
            left = left[~here]
        return out


class Slots:
    """Distinct keys, each stored under its slot: rows of word numbers, or byte strings."""

    def __init__(self, keys, of=None) -> None:
        self.of = of or (phrase_hash if isinstance(keys, np.ndarray) else word_hash)
        h = self.of(keys)
        first = np.unique(h, return_index=True)[1]
        self.hash, self.size = PerfectHash(h[first]), len(keys)
        # keys whose hash another one has stand behind the slots of the hash
        order = np.concatenate([first, np.setdiff1d(np.arange(len(keys)), first)])
        place = np.concatenate([self.hash.slots(h[first]), np.arange(len(first), len(keys))])
        by = np.empty(len(keys), dtype=np.int64)
        by[place] = order
        self.keys = keys[by] if isinstance(keys, np.ndarray) else [keys[i] for i in by]
        self.rest = {self._plain(self.keys[i]): i for i in range(len(first), len(keys))}

    @staticmethod
    def _plain(key):
        return key if isinstance(key, bytes) else tuple(key.tolist())

    def find(self, keys) -> np.ndarray:
        """The slot of each key; -1 where the stored key is another."""
        s = self.hash.slots(self.of(keys))
        at = np.flatnonzero(s >= 0)
        if isinstance(keys, np.ndarray):
            same = (self.keys[s[at]] == keys[at]).all(axis=1)
        else:
            same = np.fromiter((self.keys[s[i]] == keys[i] for i in at), dtype=bool, count=len(at))
        s[at[~same]] = -1
        if self.rest:
            for i in np.flatnonzero(s < 0):
                s[i] = self.rest.get(self._plain(keys[i]), -1)
        return s


def windows(flat: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where k words follow each other without a break, and their numbers."""
    n = len(flat) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros((0, k), np.int32)
    ok = np.ones(n, dtype=bool)
    for j in range(k):
        ok &= flat[j : n + j] >= 0
    at = np.flatnonzero(ok)
    return at, np.stack([flat[at + j] for j in range(k)], axis=1)


def segments(flat: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Maximal runs of the places `at` of frequent phrases of k words, as words, -1 behind each; single places are left out."""
    if not len(at):
        return np.zeros(0, np.int32)
    cut = np.flatnonzero(np.diff(at) > 1)
    first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    first, last = first[last > first], last[last > first]
    n = last - first + k
    out = np.full(int(n.sum()) + len(n), -1, dtype=np.int32)
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.cumsum(n + 1) - n - 1, n) + inner] = flat[np.repeat(first, n) + inner]
    return out


def _id_rows(flat: np.ndarray, limit: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Words as rows of 32-bit numbers, cut behind breaks."""
    ends = np.flatnonzero(flat < 0) + 1
    if len(ends):
        ends = ends[np.concatenate([np.flatnonzero(np.diff(ends // limit)), [len(ends) - 1]])]
        rows = [x.astype("<i4").tobytes() for x in np.split(flat[: ends[-1]], ends[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Words in stretches of whole rows; rows end with a break, so a phrase lies within one."""
    held, size = [], 0
    for b in batches:
        for row in b.column("ids"):
            held.append(np.frombuffer(row.as_buffer(), dtype="<i4"))
            size += len(held[-1])
            if size >= STRETCH:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def dealt(ids: DataFrame) -> tuple[DataFrame, int]:
    """ids in fewer tasks where it is small, and how many words it has: each task has arrays of its own, and phrases that many tasks meet are named
    by each."""
    words = (ids.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // 4
    return ids.coalesce(max(ids.sparkSession.sparkContext.defaultParallelism, -(-words // SHARE))), words


# words


def word_counts(docs: DataFrame, most: int = 300_000) -> DataFrame:
    """(lang, w, n) of docs (lang, text). Tasks count first, and give on what they have when they hold `most` words."""
    schema = pa.schema([("lang", pa.string()), ("w", pa.string()), ("n", pa.int64())])

    def out(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in held.items():
            c.pop(BREAK, None)
            if c:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                held.setdefault(lang, Counter()).update(tokens(text.as_py()))
                if sum(map(len, held.values())) > most:
                    yield from out(held)
                    held = {}
        yield from out(held)

    return docs.mapInArrow(count, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))


def _key(lang: str, word: bytes) -> bytes:
    name = lang.encode()
    return b"%d:%s%s" % (len(name), name, word)


def _unkey(key: bytes) -> tuple[str, str]:
    n, _, rest = key.partition(b":")
    return rest[: int(n)].decode(), rest[int(n) :].decode()


def _blocks(table: DataFrame, make, block: int) -> Iterator:
    """What `make` makes of the rows of each block, in its task; one at a time comes to the driver."""
    spark, n = table.sparkSession, table.count()
    parts = -(-n // block)
    schema = pa.schema([("block", pa.int32()), ("data", pa.binary())])

    def build(rows: pa.Table) -> pa.Table:
        return pa.table([[rows.column("block")[0].as_py()], [pickle.dumps(make(rows))]], schema=schema)

    of = table.withColumn("block", F.pmod(F.xxhash64(*table.columns), F.lit(max(parts, 1))).cast("int"))
    built, _ = written(of.groupBy("block").applyInArrow(build, "block int, data binary"), "hashes")
    for i in range(parts):
        for row in built.where(F.col("block") == i).collect():  # one, or none where a small table leaves a block empty
            yield spark.sparkContext.broadcast(pickle.loads(row["data"]))


def _words_of(rows: pa.Table):
    keys = [_key(lang, w.encode()) for lang, w in zip(rows.column("lang").to_pylist(), rows.column("w").to_pylist(), strict=True)]
    s, n = Slots(keys), np.zeros(len(keys), np.int64)
    n[s.find(keys)] = rows.column("n").to_numpy()
    return s, n


def numbered(docs: DataFrame, blocks: list, most: int = 500_000) -> DataFrame:
    """(ids): segments of frequent words. blocks: (broadcast, first number) of Slots of words. More than one block: texts go along, and
    what one has found stays."""

    def number(one, first: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, dict[bytes, int]] = {}
            slots = one.value[0]

            def numbers(group: list[tuple]) -> list[np.ndarray]:
                """Words that the task has not met are looked up together."""
                nonlocal known
                if sum(map(len, known.values())) > most:
                    known = {}
                new = set()
                for lang, _, t, _ in group:
                    memo = known.setdefault(lang, {BREAK: -1})
                    new.update((lang, w) for w in set(t) if w not in memo)
                if new := list(new):
                    s = slots.find([_key(*x) for x in new])
                    for (lang, w), i in zip(new, np.where(s >= 0, s + first, -1).tolist(), strict=True):
                        known[lang][w] = i
                out = []
                for lang, _, t, had in group:
                    ids = np.fromiter(map(known[lang].__getitem__, t), dtype=np.int32, count=len(t))
                    out.append(ids if had is None else np.maximum(ids, np.frombuffer(had, dtype="<i4")))
                return out

            def give(group: list[tuple]) -> Iterator[pa.RecordBatch]:
                parts = numbers(group)
                if last:
                    flat = np.concatenate([x for p in parts for x in (p, [-1])]).astype(np.int32)
                    yield from _id_rows(segments(flat, np.flatnonzero(flat >= 0), 1))
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in group], pa.string()), pa.array([x[1] for x in group], pa.string()), pa.array([p.astype("<i4").tobytes() for p in parts], pa.binary())], names=["lang", "text", "ids"])

            for b in batches:
                group, size = [], 0
                for lang, text, had in zip(*(b.column(c) for c in ("lang", "text", "ids")), strict=True):
                    text = text.as_py()
                    group.append((lang.as_py(), text if not last else None, tokens(text), had.as_py()))
                    size += len(group[-1][2])
                    if size > STRETCH:
                        yield from give(group)
                        group, size = [], 0
                if group:
                    yield from give(group)

        return run

    d = docs.withColumn("ids", F.lit(None).cast("binary"))
    for one, first in blocks[:-1]:
        d, _ = written(d.mapInArrow(number(one, first, False), "lang string, text string, ids binary"), "numbered")
    one, first = blocks[-1]
    return written(d.mapInArrow(number(one, first, True), "ids binary"), "segments")[0]


# levels of phrases


def tree_sum(parts: DataFrame, most: int | None = None) -> DataFrame:
    """(chunk, data) of (part, chunk, data), arrays of whole numbers; at most FAN are added in one go, `most` is where sums stop."""
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("data", pa.binary())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for part, chunk, data in zip(*(b.column(c).to_pylist() for c in ("part", "chunk", "data")), strict=True):
                x = _unpacked(data)
                held[part, chunk] = held[part, chunk] + x if (part, chunk) in held else x
        for (part, chunk), x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([_packed(x, most)], pa.binary())], schema=schema)

    d, n, path = parts, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), None
    while True:
        # what a task has counted goes straight into the first round
        d = d.withColumn("part", F.expr(f"cast(part div {FAN} as int)"))
        d, now = written(d.repartition(n, "part", "chunk").mapInArrow(add, "part int, chunk int, data binary"), "sums")
        if path:
            drop(parts.sparkSession, path)
        if not d.agg(F.max("part")).first()[0]:
            return d.select("chunk", "data")
        path = now


def _packed(x: np.ndarray, most: int | None = None) -> bytes:
    """Whole numbers in as few bytes as the largest needs, which the first byte says."""
    x = x if most is None else np.minimum(x, most)
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"u{data[0]}", offset=1).astype(np.int64)


def _chunks(total: np.ndarray, length: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for c in range(-(-len(total) // length)):
        x = total[c * length : (c + 1) * length]
        if x.any():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([c], pa.int32()), pa.array([_packed(x, most)], pa.binary())], names=["part", "chunk", "data"])


def full_buckets(ids: DataFrame, k: int, least: int, buckets: int) -> np.ndarray:
    """Which buckets of phrases of k words reach `least`; a bit each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int32)
        for flat in _flat(batches):
            np.add.at(total, (phrase_hash(windows(flat, k)[1]) % np.uint64(buckets)).astype(np.int64), 1)
        yield from _chunks(total, BYTES, least)

    full = np.zeros(buckets, dtype=bool)
    for r in tree_sum(ids.mapInArrow(count, "part int, chunk int, data binary"), least).collect():  # a byte a bucket
        x = _unpacked(r["data"])
        full[r["chunk"] * BYTES : r["chunk"] * BYTES + len(x)] = x >= least
    return np.packbits(full, bitorder="little")


def candidates(ids: DataFrame, k: int, full, pending: int = 1 << 20) -> DataFrame:
    """(w0 ... ): the distinct phrases of k words in full buckets."""
    names = [f"w{j}" for j in range(k)]

    def distinct(x: np.ndarray) -> np.ndarray:
        h = phrase_hash(x)
        _, first, of = np.unique(h, return_index=True, return_inverse=True)
        other = (x[first][of] != x).any(axis=1)  # of equal hash, yet another phrase
        return np.concatenate([x[first], x[other]])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held = full.value, np.zeros((0, k), np.int32)
        out = lambda x: pa.RecordBatch.from_arrays([pa.array(x[:, j]) for j in range(k)], names=names)
        for flat in _flat(batches):
            x = windows(flat, k)[1]
            b = phrase_hash(x) % np.uint64(len(bits) * 8)
            x = x[bits[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8) & 1 > 0]
            held = distinct(np.concatenate([held, x]))
            if len(held) > pending:
                yield out(held)
                held = held[:0]
        if len(held):
            yield out(held)

    return ids.mapInArrow(look, ", ".join(f"{c} int" for c in names)).distinct()


def _phrases_of(rows: pa.Table) -> Slots:
    return Slots(np.stack([rows.column(c).to_numpy() for c in rows.column_names if c[0] == "w"], axis=1).astype(np.int32))


def _frequent_of(rows: pa.Table) -> tuple[Slots, np.ndarray]:
    """The frequent phrases of a level, with their counts by slot."""
    keys = np.stack([rows.column(c).to_numpy() for c in rows.column_names if c[0] == "w"], axis=1).astype(np.int32)
    s, n = Slots(keys), np.zeros(len(keys), np.int64)
    n[s.find(keys)] = rows.column("a").to_numpy()
    return s, n


def slot_counts(ids: DataFrame, k: int, one) -> DataFrame:
    """(chunk, data): how often the phrase of each slot occurs, SLOTS in a row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = one.value
        total = np.zeros(slots.size, dtype=np.int64)
        for flat in _flat(batches):
            s = slots.find(windows(flat, k)[1])
            total += np.bincount(s[s >= 0], minlength=slots.size)
        yield from _chunks(total, SLOTS)

    return tree_sum(ids.mapInArrow(count, "part int, chunk int, data binary"))


PHRASE = "k int, w0 int, w1 int, w2 int, w3 int, a long"
_WORDS = ["w0", "w1", "w2", "w3"]


def _frequent(counts: DataFrame, k: int, one, least: int) -> DataFrame:
    """PHRASE rows of the slots that reach `least`."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = one.value.keys
        for b in batches:
            for chunk, data in zip(b.column("chunk").to_pylist(), b.column("data").to_pylist(), strict=True):
                n = _unpacked(data)
                at = np.flatnonzero(n >= least)
                w = keys[chunk * SLOTS + at]
                cols = [pa.array(w[:, j]) if j < k else pa.nulls(len(at), pa.int32()) for j in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), *cols, pa.array(n[at])], names=["k", *_WORDS, "a"])

    return counts.mapInArrow(pick, PHRASE)


def narrowed(ids: DataFrame, k: int, blocks: list) -> DataFrame:
    """(ids): segments in which every phrase of k words is frequent. blocks: broadcasts of the frequent ones as (Slots, counts)."""

    def mark(one, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots = one.value[0]
            for b in batches:
                for row, had in zip(b.column("ids"), b.column("ok"), strict=True):
                    flat = np.frombuffer(row.as_buffer(), dtype="<i4")
                    ok = np.zeros(len(flat), dtype=bool) if not had.is_valid else np.frombuffer(had.as_buffer(), dtype=bool).copy()
                    at, x = windows(flat, k)
                    ok[at[slots.find(x) >= 0]] = True
                    if last:
                        yield from _id_rows(segments(flat, np.flatnonzero(ok), k))
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.binary()), pa.array([ok.tobytes()], pa.binary())], names=["ids", "ok"])

        return run

    d = ids.withColumn("ok", F.lit(None).cast("binary"))
    for one in blocks[:-1]:
        d, _ = written(d.mapInArrow(mark(one, False), "ids binary, ok binary"), "marked")
    return written(d.mapInArrow(mark(blocks[-1], True), "ids binary"), "segments")[0]


def with_cuts(phrases: DataFrame, words: list, levels: dict[int, list]) -> DataFrame:
    """phrases with lang, s0 ... s3 (words), l1 ... l3 and r1 ... r3: how often the first m words and the rest occur, read by slot."""
    sides = [f"{x}{m}" for x in "lr" for m in (1, 2, 3)]
    texts = ["lang", "s0", "s1", "s2", "s3"]
    kinds = PHRASE + "".join(f", {c} long" for c in sides) + "".join(f", {c} string" for c in texts)

    def read(one, j: int, first: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots, n = one.value
            for b in batches:
                col = {c: b.column(c) for c in b.schema.names}
                ks, w = col["k"].to_numpy(), np.stack([col[c].fill_null(-1).to_numpy() for c in _WORDS], axis=1)
                got = {c: col[c].to_numpy().copy() for c in sides}
                if j == 1:
                    strings = {c: col[c].to_pylist() for c in texts}
                    for i, row in enumerate((w - first).tolist()):
                        for p, s in enumerate(row):
                            if w[i, p] >= 0 and 0 <= s < slots.size:
                                lang, strings[f"s{p}"][i] = _unkey(slots.keys[s])
                                strings["lang"][i] = lang
                    col |= {c: pa.array(v, pa.string()) for c, v in strings.items()}
                for k in range(j + 1, 5):
                    at = np.flatnonzero(ks == k)
                    for side, x in ((f"l{j}", w[at, :j]), (f"r{k - j}", w[at, k - j : k])):
                        s = slots.find(x) if j > 1 else np.where((x[:, 0] >= first) & (x[:, 0] < first + slots.size), x[:, 0] - first, -1)
                        got[side][at[s >= 0]] = n[s[s >= 0]]
                col |= {c: pa.array(v, pa.int64()) for c, v in got.items()}
                yield pa.RecordBatch.from_arrays(list(col.values()), names=list(col))

        return run

    d = phrases.select("*", *[F.lit(0).cast("long").alias(c) for c in sides], *[F.lit(None).cast("string").alias(c) for c in texts])
    for j, blocks in {1: words, **{k: [(b, 0) for b in v] for k, v in levels.items() if k < LONGEST}}.items():
        for one, first in blocks:
            d, _ = written(d.mapInArrow(read(one, j, first), kinds), "cuts")
    return d


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block: int = BLOCK, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Phrases of 2 to `longest` words (4 at most) of docs (lang, text) with `a` >= least, as with_cuts gives them; and (lang, n), words in all."""
    spark: SparkSession = docs.sparkSession
    d = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts, _ = written(word_counts(d), "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    words, first = [], 0
    for one in _blocks(counts.where(F.col("n") >= least), _words_of, block):
        words.append((one, first))
        first += one.value[0].size
    found, levels = spark.createDataFrame([], PHRASE), {}
    ids, size = dealt(numbered(d, words)) if words else (None, 0)
    for k in range(2, longest + 1 if words else 2):
        full = spark.sparkContext.broadcast(full_buckets(ids, k, least, min(buckets, 1 << max(16, (size // LOAD).bit_length()))))
        safe, _ = written(candidates(ids, k, full), "candidates")
        full.unpersist()
        own = None
        for one in _blocks(safe, _phrases_of, block):
            part = _frequent(slot_counts(ids, k, one), k, one, least)
            own = part if own is None else own.unionByName(part)
        if own is None:
            break
        # from here on only what is frequent counts
        own, _ = written(own, "phrases")
        found = found.unionByName(own)
        levels[k] = list(_blocks(own.select(*_WORDS[:k], "a"), _frequent_of, block))
        if not levels[k]:
            break
        if k < longest:
            ids, size = dealt(narrowed(ids, k, levels[k]))
    return with_cuts(found, words, levels), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, top: int = TOP, block: int = BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: per lang the first `top` phrases by score, a and phrase. The cut with the lowest score
    counts. A phrase that stands within a longer one with `cover` percent of its occurrences is left out; as
    frequencies only fall with length, longer ones by a single word tell."""
    p, totals = frequent_phrases(docs, least, longest, block, buckets)
    # products in 38 digits
    score = lambda m: F.expr(f"(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div cast(l{m} + r{m} as decimal(19, 0))")
    cuts = F.array(*[F.when(F.col("k") > m, F.struct(score(m).alias("score"), F.lit(m).alias("m"), F.col(f"l{m}").alias("l"), F.col(f"r{m}").alias("r"))) for m in (1, 2, 3)])
    p = p.withColumn("cut", F.array_min(cuts))
    at = lambda i: F.array(*[F.col(f"w{j}") for j in range(i, i + 3)])
    part = lambda i: F.struct((F.col("k") - 1).alias("k"), F.slice(at(i), 1, F.col("k") - 1).alias("w"))
    longer = p.select(F.explode(F.array(part(0), part(1))).alias("of"), "a").groupBy("of").agg(F.max("a").alias("longer"))
    own = F.struct("k", F.slice(F.array(*_WORDS), 1, F.col("k")).alias("w"))
    p = p.withColumn("own", own).join(longer, F.col("own") == F.col("of"), "left")
    covered = F.expr(f"cast(longer as decimal(19, 0)) * 100 >= cast(a as decimal(19, 0)) * {int(cover)}")
    p = p.where(F.col("longer").isNull() | ~covered)
    p = p.select("lang", F.concat_ws(" ", "s0", "s1", "s2", "s3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    p = p.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return p.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocation_report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return collocations(docs.select("lang", "text"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM d),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
o AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) r(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, p, f, k, string_split(p, ' ') AS q FROM f WHERE k > 1),
v AS MATERIALIZED (SELECT lang, p, f AS a, m, array_to_string(q[:m], ' ') AS px, array_to_string(q[m + 1:], ' ') AS py FROM c, range(1, 4) s(m) WHERE m < k),
u AS (SELECT v.lang, v.p, a, m, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score FROM v JOIN f x ON x.lang = v.lang AND x.p = px JOIN f y ON y.lang = v.lang AND y.p = py),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, m) AS z FROM u),
g AS (SELECT lang, array_to_string(q[i:i + j - 1], ' ') AS p, max(f) AS f FROM c, range(2, 4) t(j), range(1, 4) z(i) WHERE j < k AND i + j - 1 <= k GROUP BY ALL),
e AS (SELECT b.lang, b.p AS phrase, a, l, r, score FROM b LEFT JOIN g ON g.lang = b.lang AND g.p = b.p WHERE z = 1 AND (g.f IS NULL OR 100 * g.f < 80 * a)),
h AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM e)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM h JOIN n USING (lang) WHERE rank <= 2000
"""
