"""Exact duplicates by Patricia-trie owners.

Texts are equal if all their bytes are, and that is settled in tries alone. A digest never joins two texts: it only deals
them out. A class is a length in bytes and a 64-bit content hash; a row that is alone in its class is its own owner, and
its text does not travel. All other rows go through tries.

1. Each task inserts the whole byte strings of its rows into a compressed radix trie. A terminal node holds the smallest
   identifier of its string (here: the first in the asked order), and how many rows have it. So a string that a third of all
   rows have leaves a task as one row.
2. Terminals are dealt out by class, and the tries of the partitions are merged from them, in the same way. A class with more
   than FAN terminals is dealt out over several tasks first, and again, until no task gets more than FAN of them.
3. Rows find their owner by the number of the terminal that their own task gave them.

Spill. A trie that outgrows `budget` bytes of labels gives up its heaviest subtree below the first fork: its terminals are written out
with their strings and dealt out again in the next round, and a stub is left behind that sends later
strings of the subtree the same way. Each task keeps a string at least, so rounds end.

Defined cases: null text is empty, and equal to empty text; a null doc_id owns a group only if all its rows have null
(keep_id is null then); rows of equal doc_id and text are copies of each other, of which `kept` is true for one; an empty
table gives an empty result; texts of any length are taken whole, one at a time beside the trie; other
columns pass through `deduplicated` and are not read by `owners`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm._common import written
from seqloom.tables import if_small

#: Bytes of labels that a trie may hold; terminals of a class that one task merges at most, where it has the choice.
BUDGET, FAN = 32_000_000, 64
ROW, FINAL, AGAIN, LINK = range(4)
OUT = "kind byte, node long, up long, len long, h long, text binary, id long, row long, n long, sha string"
_ARROW = pa.schema([("kind", pa.int8()), ("node", pa.int64()), ("up", pa.int64()), ("len", pa.int64()), ("h", pa.int64()), ("text", pa.binary()), ("id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("sha", pa.string())])


class Node:
    """label: the bytes on the edge into the node; held: what a terminal node holds; stub: a subtree that has gone."""

    __slots__ = ("children", "held", "label", "stub")

    def __init__(self, label: bytes = b"", held=None) -> None:
        self.label, self.children, self.held, self.stub = label, {}, held, False


def _shared(a: bytes, b: bytes, at: int) -> int:
    """How many first bytes of a stand in b from `at` on; by halving."""
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if b.startswith(a[lo:mid], at + lo):
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """A compressed radix trie of byte strings; size is the bytes of its labels."""

    def __init__(self) -> None:
        self.root, self.size = Node(), 0

    def terminal(self, key: bytes) -> Node | None:
        """The node where key ends, made if it is not there; None if it lies in a subtree that has gone."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.size += len(child.label)
                return child
            if child.stub:
                return None
            if not key.startswith(child.label, at):
                n = _shared(child.label, key, at)
                fork = node.children[key[at]] = Node(child.label[:n])
                child.label = child.label[n:]
                fork.children[child.label[0]] = child
                child = fork
            at += len(child.label)
            node = child
        return node

    def heaviest(self) -> tuple[Node, int, bytes] | None:
        """The parent, first byte and prefix of the heaviest subtree below the first fork of what is still here; None if
        there is no fork, so that something stays."""
        node, prefix = self.root, b""
        while True:
            live = [(b, c) for b, c in node.children.items() if not c.stub]
            if not live:
                return None
            if node.held is not None or len(live) > 1:
                return node, max(live, key=lambda x: sum(len(y.label) for y, _ in walk(x[1])))[0], prefix
            node = live[0][1]
            prefix += node.label

    def spill(self, stub: bool) -> list[tuple[Node, bytes]] | None:
        """Takes the heaviest subtree out: its terminals with their strings."""
        if (found := self.heaviest()) is None:
            return None
        node, first, prefix = found
        gone = node.children.pop(first)
        if stub:
            node.children[first] = left = Node()
            left.stub = True
        self.size -= sum(len(x.label) for x, _ in walk(gone))
        return [(x, s) for x, s in walk(gone, prefix) if x.held is not None]


def walk(top: Node, prefix: bytes | None = None) -> Iterator[tuple[Node, bytes | None]]:
    """All nodes from top on, with their strings if a prefix is given."""
    stack = [(top, None if prefix is None else prefix + top.label)]
    while stack:
        node, s = stack.pop()
        yield node, s
        stack += [(c, None if s is None else s + c.label) for c in node.children.values() if not c.stub]


def digests(top: Node) -> Iterator[tuple[Node, str]]:
    """Terminals with the SHA-256 of their strings, hashed along the edges."""
    stack = [(top, hashlib.sha256())]
    while stack:
        node, h = stack.pop()
        h.update(node.label)
        if node.held is not None:
            yield node, h.hexdigest()
        stack += [(c, h.copy()) for c in node.children.values() if not c.stub]


class _Out:
    """Rows of OUT, given on in batches of some bytes."""

    def __init__(self, limit: int = 4_000_000) -> None:
        self.rows, self.bytes, self.limit = [], 0, limit

    def add(self, kind: int, node: int, up=None, length=None, h=None, text=None, id=None, row=None, n=None, sha=None) -> None:
        self.rows.append((kind, node, up, length, h, text, id, row, n, sha))
        self.bytes += 100 + len(text or b"")

    def batches(self, end: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (end or self.bytes > self.limit):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*self.rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
            self.rows, self.bytes = [], 0


def _better(largest: bool):
    """Whether the owner (id, row) a goes before b: by id, nulls last, then by row."""
    if largest:
        return lambda a, b: (a[0] is not None, a[0] or 0, -a[1]) > (b[0] is not None, b[0] or 0, -b[1])
    return lambda a, b: (a[0] is None, a[0] or 0, a[1]) < (b[0] is None, b[0] or 0, b[1])


def _number(round_: int) -> Iterator[int]:
    """Numbers that no other task and round gives."""
    from pyspark import TaskContext

    return iter(range((round_ << 57) + (TaskContext.get().partitionId() << 33), (round_ << 57) + ((TaskContext.get().partitionId() + 1) << 33)))


def _inserted(largest: bool, budget: int):
    """The tries of the tasks that hold the rows (id, len, h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        better, number, trie, out = _better(largest), _number(0), Trie(), _Out()

        def give(node: Node, text: bytes) -> None:
            at, owner, n, h = node.held
            out.add(AGAIN, at, length=len(text), h=h, text=text, id=owner[0], row=owner[1], n=n)

        for b in batches:
            for id_, h, text in zip(*(b.column(c).to_pylist() for c in ("id", "h", "text")), strict=True):
                node = trie.terminal(text)
                row = next(number)
                own = (id_, row)
                if node.held is None:
                    node.held = [row, own, 1, h]
                else:
                    node.held[2] += 1
                    if better(own, node.held[1]):
                        node.held[1] = own
                out.add(ROW, node.held[0], id=id_, row=row)
                while trie.size > budget and (gone := trie.spill(stub=False)):
                    for x, s in gone:
                        give(x, s)
                        yield from out.batches()
                yield from out.batches()
        for x, s in walk(trie.root, b""):
            if x.held is not None:
                give(x, s)
                yield from out.batches()
        yield from out.batches(end=True)

    return run


def _merged(largest: bool, budget: int, round_: int):
    """The tries of the partitions that terminals (node, len, h, text, id, row, n, wide) are dealt to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        better, number, trie, out = _better(largest), _number(round_), Trie(), _Out()

        def again(node: Node, text: bytes) -> None:
            up, (nodes, owner, n, h, _) = next(number), node.held
            for x in nodes:
                out.add(LINK, x, up=up)
            out.add(AGAIN, up, length=len(text), h=h, text=text, id=owner[0], row=owner[1], n=n)

        names = ("node", "len", "h", "text", "id", "row", "n", "wide")
        for b in batches:
            for node, length, h, text, id_, row, n, wide in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                at = trie.terminal(text)
                if at is None:
                    out.add(AGAIN, node, length=length, h=h, text=text, id=id_, row=row, n=n)
                elif at.held is None:
                    at.held = [[node], (id_, row), n, h, wide]
                else:
                    at.held[0].append(node)
                    at.held[2] += n
                    if better((id_, row), at.held[1]):
                        at.held[1] = (id_, row)
                while trie.size > budget and (gone := trie.spill(stub=True)):
                    for x, s in gone:
                        again(x, s)
                        yield from out.batches()
                yield from out.batches()
        for x, s in walk(trie.root, b""):
            if x.held is not None and x.held[4]:
                again(x, s)
                x.held = None
                yield from out.batches()
        for x, sha in digests(trie.root):
            nodes, owner, n, _, _ = x.held
            for node in nodes:
                out.add(FINAL, node, id=owner[0], row=owner[1], n=n, sha=sha)
            yield from out.batches()
        yield from out.batches(end=True)

    return run


def owners(docs: DataFrame, keep: str = "smallest", budget: int = BUDGET, fan: int = FAN) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256. keep: "smallest" or "largest" doc_id."""
    largest = {"smallest": False, "largest": True}[keep]
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).select("id", F.octet_length("text").cast("long").alias("len"), F.xxhash64("text").alias("h"), "text")
    classes = d.groupBy("len", "h").agg(F.count("*").alias("c")).where("c > 1").select(F.col("len").alias("_len"), F.col("h").alias("_h"))
    classes, _ = written(classes, "classes")
    same, classes = (F.col("len") == F.col("_len")) & (F.col("h") == F.col("_h")), if_small(classes)
    lone = d.select("id", "len", "h", F.sha2("text", 256).alias("sha")).join(classes, same, "left_anti")
    lone = lone.select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    many = d.join(classes, same, "left_semi").select("id", "h", F.col("text").cast("binary").alias("text"))
    first, _ = written(many.mapInArrow(_inserted(largest, budget), OUT), "local-tries")
    todo, found, steps = first.where(F.col("kind") == AGAIN), [], 0
    while (total := todo.agg(F.count("*"), F.sum("len")).first())[0]:
        steps += 1
        wide = todo.groupBy("len", "h").agg(F.count("*").alias("c")).where(F.col("c") > fan)
        wide, _ = written(wide.select(F.col("len").alias("_len"), F.col("h").alias("_h"), F.ceil(F.col("c") / fan).alias("parts")), "wide-classes")
        salted = todo.join(if_small(wide), same, "left").withColumns({"wide": F.col("parts").isNotNull(), "salt": F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0))})
        n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * (total[1] or 0) // budget))
        # the round counts in the deal, so that what one task has spilled goes to several tasks
        dealt = salted.repartition(n, F.col("len"), F.col("h"), F.col("salt"), F.lit(steps)).select("node", "len", "h", "text", "id", "row", "n", "wide")
        got, _ = written(dealt.mapInArrow(_merged(largest, budget, steps), OUT), "merged-tries")
        found.append(got)
        todo = got.where(F.col("kind") == AGAIN)
    of = None
    for got in reversed(found):
        own = got.where(F.col("kind") == FINAL).select("node", "id", "row", "n", "sha")
        if of is not None:
            up = got.where(F.col("kind") == LINK).select(F.col("node").alias("_node"), F.col("up").alias("node"))
            own = own.unionByName(of).unionByName(up.join(of, "node").drop("node").withColumnRenamed("_node", "node"))
        of = own
    if of is None:
        return lone
    rows = first.where(F.col("kind") == ROW).select("node", F.col("id").alias("doc_id"), F.col("row").alias("_row"))
    return lone.unionByName(rows.join(of, "node").select("doc_id", F.col("id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("_row") == F.col("row")).alias("kept"), F.col("sha").alias("text_sha256")))


def deduplicated(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, with all their columns. What goes is a list of identifiers and digests, so texts travel only if it is long."""
    found, _ = written(owners(docs.select("doc_id", "text"), keep), "owners")
    gone, _ = written(found.where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.expr("doc_id <=> keep_id").alias("again")).distinct(), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))
    stay = rows.join(if_small(gone), same, "left_anti")
    # of rows equal in doc_id and text that own their group one stays
    one = rows.join(if_small(gone.where("again")), same, "left_semi").withColumn("id", F.col("row.doc_id")).dropDuplicates(["id", "sha"])
    return stay.select("row.*").unionByName(one.select("row.*"))


def exact_report(docs: DataFrame) -> DataFrame:
    """The contract's columns: of equal texts the largest doc_id stays."""
    return owners(docs.select("doc_id", "text"), "largest")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)
"""
