"""Pattern packing: few-document length patterns fitted to the length histogram by non-negative
least squares, rounded, and the residual packed best fit first.

The integer step. The fitted counts are rounded, taken off the histogram, and what is left is fitted again with the
patterns of the lengths that are left, a few times; the rest is packed best fit first. Counts rounded down leave a rest that
packs well, counts rounded to the nearest leave a smaller one; which of them needs fewer sequences hangs on the
histogram. So a few roundings of the same fit are tried in a fixed order, until one needs no more sequences than the
tokens, or the pieces of over half a sequence, need anyway; else the best of them is taken.

Only the histogram (at most `size` lengths) comes to the driver; a plan of runs "this pattern, so
many times" goes back, a few thousand rows at any input size. Pieces find their place by their
rank among pieces of equal length: a rank within the task that made the piece, plus the counts of
the tasks before. No group of pieces meets in one task.

Defined cases: null text is empty and gives a piece of the end id alone; each input row has its
own pieces, repeated rows too; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm._common import written
from seqloom.llm.tokens import VOCABULARY, Encoder

SIZE, END_ID = 1024, 2


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: whole pieces, the rest first."""
    rest = n % size
    return ([(0, rest)] if rest else []) + [(s, size) for s in range(rest, n, size)]


def pieces(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; part and rk, the task and the rank within it among equal lengths."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder, part, seen, end = Encoder.of(vocabulary, fast=True), TaskContext.get().partitionId(), Counter(), end_id.to_bytes(4, "little")
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = encoder.ids(text, chunk=1 << 20) + end
                for k, (s, n) in enumerate(cuts(len(ids) // 4, size)):
                    rows.append((doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), part, seen[n]))
                    seen[n] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rk"])

    # ids go through Python as text: pandas would make numbers with nulls among them floating
    d = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long, part long, rk long")
    return d.withColumn("doc_id", F.col("doc_id").cast("long"))


def patterns(h: np.ndarray, size: int, triples: int = 8) -> list[tuple[int, ...]]:
    """Multisets of one to four present lengths that fill a sequence exactly: all of one and two; of three and four
    the completions of each length by its commonest partners. What no such pattern takes is left to the residual."""
    out = {tuple(sorted((a, size - a), reverse=True)) for a in range((size + 1) // 2, size) if h[a] and h[size - a]}
    if h[size]:
        out.add((size,))
    present = np.flatnonzero(h)
    present = present[present < size]
    common = present[np.argsort(-h[present], kind="stable")]
    for a in present.tolist():
        b = common[(common <= size - a - 1)]
        c = size - a - b
        score = np.minimum(h[b], h[c]) * (c > 0)
        for k in np.argsort(-score, kind="stable")[: 2 * triples]:
            if score[k]:
                out.add(tuple(sorted((a, int(b[k]), int(c[k])), reverse=True)))
        for second in common[:2].tolist():
            left = size - a - second
            if left > 1:
                b = common[common < left][: 64 * triples]
                score = np.minimum(h[b], h[left - b])
                for k in np.argsort(-score, kind="stable")[:2]:
                    if score[k]:
                        out.add(tuple(sorted((a, second, int(b[k]), int(left - b[k])), reverse=True)))
    return sorted(out)


def nnls(found: list[tuple[int, ...]], h: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths nearest to h: coordinate descent."""
    x, left = np.zeros(len(found)), h.astype(float).copy()
    parts = [list(Counter(p).items()) for p in found]
    norms = [sum(m * m for _, m in q) for q in parts]
    for _ in range(rounds):
        moved = 0.0
        for j, q in enumerate(parts):
            step = sum(m * left[i] for i, m in q) / norms[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for i, m in q:
                    left[i] -= m * step
        if moved < 0.5:
            break
    return x


def _fill(h: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit over the histogram: the longest piece, then the completion that leaves least of all, with
    the longest pieces that such a completion can have, taken as often as the counts allow. Every step
    uses up a length.

    reach[k] has bit s set if pieces of lengths from the k-th down can sum to s; a length's
    multiples are added by doubling.
    """
    lengths, left, runs = np.flatnonzero(h)[::-1].tolist(), h.tolist(), []
    for top in lengths:
        while left[top]:
            used, room = [top], size - top
            free = [(a, n) for a in lengths if a <= room and (n := left[a] - (a == top)) > 0]
            reach, mask = [1], (1 << (room + 1)) - 1
            for a, n in reversed(free):
                sums, n, step = reach[-1], min(n, room // a), 1
                while n > 0:
                    take = min(step, n)
                    sums |= (sums << (take * a)) & mask
                    n -= take
                    step *= 2
                reach.append(sums)
            reach.reverse()
            room = reach[0].bit_length() - 1
            for k, (a, n) in enumerate(free):
                n = min(n, room // a)
                while n and not reach[k + 1] >> (room - n * a) & 1:
                    n -= 1
                used += [a] * n
                room -= n * a
            need = Counter(used)
            times = min(left[a] // m for a, m in need.items())
            for a, m in need.items():
                left[a] -= m * times
            runs.append((tuple(used), times))
    return runs


#: Roundings of fitted counts x, in the order in which they are tried: floor(share * x + up).
ROUNDINGS = tuple((share, up) for up in (1e-9, 0.5) for share in (1.0, 0.95, 0.9, 0.8, 0.5))
REFITS = 2


def fitted(h: np.ndarray, size: int, share: float, up: float, refits: int = REFITS) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Runs (pattern, repeats) of the fit, and the histogram of what they leave."""
    left, runs = h.copy(), []
    for _ in range(refits):
        found = patterns(left, size)
        x = np.floor(share * nnls(found, left) + up).astype(np.int64) if found else np.zeros(0, np.int64)
        taken = 0
        for j in np.argsort(-x, kind="stable")[: int((x > 0).sum())]:
            need = Counter(found[j])
            n = min([int(x[j]), *(int(left[i]) // m for i, m in need.items())])
            if n > 0:
                runs.append((found[j], n))
                taken += n
                for i, m in need.items():
                    left[i] -= m * n
        if not taken:
            break
    return runs, left


def lower_bound(h: np.ndarray, size: int = SIZE) -> int:
    """Sequences that any plan needs: all tokens, and no two pieces of over half a sequence in one."""
    return max(-(-int((h * np.arange(size + 1)).sum()) // size), int(h[size // 2 + 1 :].sum()))


def plan(h: np.ndarray, size: int = SIZE) -> tuple[list[tuple[tuple[int, ...], int]], list[tuple[tuple[int, ...], int]]]:
    """Runs (pattern, repeats) of the fit, and those of the residual: together they hold every piece of the histogram h once."""
    best, fewest, least = ([], []), None, lower_bound(h, size)
    for share, up in ROUNDINGS:
        runs, left = fitted(h, size, share, up)
        rest = _fill(left, size)
        n = sum(n for _, n in runs) + sum(n for _, n in rest)
        if fewest is None or n < fewest:
            best, fewest = (runs, rest), n
        if fewest == least:
            break
    return best


def pack(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    made, _ = written(pieces(docs, size, end_id, vocabulary), "pieces")
    counts = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    h = np.zeros(size + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        h[r["length"]] = r["n"]
    slots, taken, sequence = [], Counter(), 0
    runs, rest = plan(h, size)
    for pattern, n in runs + rest:
        offset = 0
        for length in pattern:
            slots.append((length, taken[length], taken[length] + n, sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    places = spark.createDataFrame(slots, "length long, lo long, hi long, first long, offset long")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = made.join(before.drop("n"), ["part", "length"]).withColumn("rank", F.col("rk") + F.coalesce("before", F.lit(0))).alias("p")
    s = F.broadcast(places.withColumnRenamed("length", "_length"))  # runs of the plan: bounded by the number of lengths
    placed = ranked.join(s, (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
