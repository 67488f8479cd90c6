"""Matching statistics: for every place of a pattern the longest match in the texts that ends there, and how often it occurs.

Patterns are the smaller side. They are taken in blocks of a checked size; of a block each task makes a suffix automaton, whose
step for every state and letter, failures included, is one entry of a table. A task's texts run through it in many lanes at
once; lanes overlap by the longest pattern, so no match is cut. A task gives one row a state that it saw, which are merged by
state. So a block is one pass over the texts, however many segments its patterns fall into, and texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.tables import blocks, written

#: Letters times kinds of letters of a block; its table holds 16 bytes for each.
CELLS = 1 << 22
#: Letters that run through the automaton together, and the fewest of a lane.
BATCH, LANE = 1 << 20, 1024
#: Between texts and between patterns; no valid text holds it.
GAP = "\ud800"


def _codes(texts: list[str]):
    import numpy as np

    return np.frombuffer(GAP.join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


class _Automaton:
    """The suffix automaton of patterns, a gap between each: link and length of every state, the steps between them, and `ends`, the
    states of all prefixes of the joined patterns."""

    def __init__(self, patterns: list[str]):
        import numpy as np

        codes = _codes(patterns)
        self.kinds = np.unique(codes)
        self.length, self.link, steps, ends, last = [0], [-1], [{}], [], 0
        for c in np.searchsorted(self.kinds, codes).tolist():
            new = len(steps)
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            steps.append({})
            at, last = last, new
            while at >= 0 and c not in steps[at]:
                steps[at][c] = new
                at = self.link[at]
            if at >= 0:
                to = steps[at][c]
                if self.length[to] > self.length[at] + 1:
                    split = len(steps)
                    self.length.append(self.length[at] + 1)
                    self.link.append(self.link[to])
                    steps.append(dict(steps[to]))
                    self.link[to] = split
                    while at >= 0 and steps[at].get(c) == to:
                        steps[at][c] = split
                        at = self.link[at]
                    to = split
                self.link[new] = to
            ends.append(last)
        self.ends, self.steps = ends, steps
        self.order = sorted(range(len(steps)), key=self.length.__getitem__)

    def table(self):
        """(to, most, column): the state after (state, column) and the most letters of a match that go over; column 0 is any letter of no pattern."""
        import numpy as np

        kinds = [int(k) for k in self.kinds]
        column = np.zeros(0x110000, np.int32)
        letters = [i for i, k in enumerate(kinds) if k != ord(GAP)]
        own = {i: j + 1 for j, i in enumerate(letters)}
        column[[kinds[i] for i in letters]] = np.arange(1, len(letters) + 1)
        depth = [0] * len(self.steps)
        for v in self.order[1:]:
            depth[v] = depth[self.link[v]] + 1
        levels = [([], [], [], []) for _ in range(max(depth) + 1)]
        for v in self.order:
            rows, frm, by, to = levels[depth[v]]
            rows.append(v)
            for c, t in self.steps[v].items():
                if c in own:
                    frm.append(v)
                    by.append(own[c])
                    to.append(t)
        link, length = np.array(self.link), np.array(self.length, np.int32)
        after, most = np.zeros((len(link), len(letters) + 1), np.int32), np.full((len(link), len(letters) + 1), -1, np.int32)
        for d, (rows, frm, by, to) in enumerate(levels):  # what a state has no step for goes as from its link
            if d:
                after[rows], most[rows] = after[link[rows]], most[link[rows]]
            after[frm, by], most[frm, by] = to, length[frm]
        return after, most, column


def _run(after, most, letters, overlap: int):
    """The states and match lengths at all letters (columns of the table) behind the first `overlap` ones."""
    import numpy as np

    n, own = len(letters) - overlap, max(LANE, 4 * overlap)
    lanes, width = -(-n // own), after.shape[1]
    padded = np.zeros(overlap + lanes * own, np.int32)
    padded[: len(letters)] = letters
    by_step = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (overlap + own, lanes), (4, 4 * own)))
    flat, limit = after.ravel(), most.ravel()
    state, length = np.zeros(lanes, np.int64), np.zeros(lanes, np.int32)
    states, lengths = np.empty((own, lanes), np.int32), np.empty((own, lanes), np.int32)
    for i in range(overlap + own):
        cell = state * width + by_step[i]
        state = flat[cell].astype(np.int64)
        length = np.minimum(length, limit[cell]) + 1
        if i >= overlap:
            states[i - overlap], lengths[i - overlap] = state, length
    return states.ravel(), lengths.ravel()


def _batches(texts: Iterator[list[str]], column, overlap: int):
    """Columns of the texts' letters in batches, each led by the `overlap` letters before it."""
    import numpy as np

    tail = np.zeros(overlap, np.int32)
    gap = np.zeros(1, np.int32)
    for some in texts:
        codes = _codes(some)
        for at in range(0, len(codes), BATCH):
            part = codes[at : at + BATCH]
            own = np.where(part == ord(GAP), 0, column[np.where(part == ord(GAP), 0, part)])
            letters = np.concatenate([tail, own])
            yield letters
            tail = letters[len(letters) - overlap :]
        tail = np.concatenate([tail, gap])[1:] if overlap else tail


def _seen(seqs: DataFrame, patterns: list[str]) -> DataFrame:
    """(state, most, n, total) of a block: the longest match that ended in a state, how often it did, and how often any did."""
    overlap = max(map(len, patterns))

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        after, most, column = _Automaton(patterns).table()
        best, n, total = (np.zeros(len(after), np.int64) for _ in range(3))
        texts = ([x for x in b.column(0).to_pylist() if x] for b in batches)
        for letters in _batches((x for x in texts if x), column, overlap):
            states, lengths = _run(after, most, letters, overlap)
            hit = lengths > 0
            states, lengths = states[hit], lengths[hit]
            before = best.copy()
            np.maximum.at(best, states, lengths)
            n[best > before] = 0
            n += np.bincount(states[lengths == best[states]], minlength=len(best))
            total += np.bincount(states, minlength=len(best))
        some = np.flatnonzero(total)
        for at in range(0, len(some), 10_000):
            s = some[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(best[s].astype(np.int32)), pa.array(n[s]), pa.array(total[s])], names=["state", "most", "n", "total"])

    d = seqs.select("seq").mapInArrow(scan, "state int, most int, n long, total long")
    d = d.groupBy("state", "most").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return d.groupBy("state").agg(F.max(F.struct("most", "n")).alias("m"), F.sum("total").alias("total")).select("state", "m.most", "m.n", "total")


def _finished(patterns, seen):
    """A block's patterns with their statistics: matches of longer strings of a state's links are matches of the state, too."""
    import numpy as np
    import pandas as pd

    texts = sorted(patterns["pattern"])
    a = _Automaton(texts)
    best, n, below = [0] * len(a.link), [0] * len(a.link), [0] * len(a.link)
    for s, m, k, t in zip(seen["state"].dropna().astype(int), seen["most"], seen["n"], seen["total"], strict=False):
        best[s], n[s], below[s] = int(m), int(k), int(t)
    total, occ = below, [0] * len(a.link)
    under = [0] * len(a.link)
    for v in reversed(a.order[1:]):
        if under[v]:
            n[v] = n[v] if best[v] == a.length[v] else 0
            best[v] = a.length[v]
        occ[v] = n[v] + under[v]
        under[a.link[v]] += total[v] + under[v]
    near = [0] * len(a.link)
    for v in a.order[1:]:
        near[v] = v if best[v] else near[a.link[v]]
    ends, at = np.array([near[v] for v in a.ends]), 0
    best, occ = np.array(best), np.array(occ)
    out = []
    for t in texts:
        e = ends[at : at + len(t)]
        out.append((best[e], occ[e]))
        at += len(t) + 1
    return pd.DataFrame({"pattern": texts, "lengths": [x for x, _ in out], "occs": [y for _, y in out]})


def fits(pattern: str = "pattern"):
    """Whether a block can hold the pattern."""
    return F.length(pattern).cast("bigint") * (F.size(F.array_distinct(F.split(pattern, ""))) + 2) <= CELLS


def matching_statistics(seqs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, lengths, occs): for each distinct non-empty pattern that `fits`, and each of its places, the length of the longest
    match in the texts (seq_id, seq) that ends with it, and its occurrences, overlapping ones too (0 and 0 of a letter that
    no text has). Matches do not cross texts. Null and empty texts have none."""
    p = written(patterns.where((F.length("pattern") > 0) & fits()).select("pattern").distinct(), "patterns")
    kinds = p.select(F.explode(F.array_distinct(F.split("pattern", ""))).alias("c")).distinct().count() + 2
    out = None
    for block in blocks(p, "pattern", 50_000, (F.length("pattern") + 1).cast("bigint") * kinds, CELLS):
        texts = sorted(r["pattern"] for r in block.collect())  # a block, CELLS at most and a pattern more
        if not texts:
            continue
        seen = _seen(seqs, texts).withColumn("one", F.lit(1))
        one = seqs.sparkSession.createDataFrame([(1, t) for t in texts], "one int, pattern string")
        done = one.groupBy("one").cogroup(seen.groupBy("one")).applyInPandas(_finished, "pattern string, lengths array<bigint>, occs array<bigint>")
        done = written(done, "statistics")
        out = done if out is None else out.unionByName(done)
    return out if out is not None else p.select("pattern", F.array().cast("array<bigint>").alias("lengths"), F.array().cast("array<bigint>").alias("occs"))


def greedy(statistics: DataFrame) -> DataFrame:
    """(pattern, segment, seg_start, seg_end, occ): each pattern cut from the right into longest matches; the letter that stopped one is skipped."""

    def cut(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for pattern, lengths, occs in zip(b["pattern"], b["lengths"], b["occs"], strict=True):
                e, k = len(lengths), 0
                while True:
                    n, occ = (int(lengths[e - 1]), int(occs[e - 1])) if e else (0, 0)
                    rows.append((pattern, k, e - n, e - 1, occ))
                    if e - n == 0:
                        break
                    e, k = e - n - 1, k + 1
            yield pd.DataFrame(rows, columns=["pattern", "segment", "seg_start", "seg_end", "occ"])

    return statistics.mapInPandas(cut, "pattern string, segment int, seg_start bigint, seg_end bigint, occ bigint")
