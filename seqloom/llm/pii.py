"""Personal data: base patterns, widened by bootstrapped contextual extraction.

Base. Emails, IPs, cards and phone numbers by their expressions, leftmost and non-overlapping for each
kind, matches that fail their test dropped.

Bootstrapping. An atom is a maximal run of identifier characters that holds a digit or an @; up to ATOMS atoms with
only blanks or brackets between are a candidate, so a number in groups is one instance as well as its
parts. Where a candidate stands gives it lexical patterns: its shape with the characters it touches;
that with the one and the two words before it; and, for the whole of a chain of atoms, the two words before it alone,
whatever its shape. Candidates that are base matches, and long hexadecimal strings, are seeds of their
kind; candidates that overlap a base match otherwise are fragments and are left out. Over the graph of patterns and
instances Spark iterates: a pattern's confidence for a kind is the mean confidence of all distinct
instances that it extracts (so those it extracts wrongly count against it), taken up from `support` instances
on; an instance's is one minus the product of its patterns' doubts. Confidences never fall, and the rounds end when
they no longer rise. Occurrences of patterns of at least `threshold` are added as spans of the kind, where no base
span lies; those that overlap become one, so that an identifier is found whole.

Every count covers the whole corpus. Pattern and instance counts are aggregated before they are
shuffled, and the graph has one edge per distinct pair. Nothing comes to the driver.

Defined cases: null text is empty; each input row gets a result row, repeated rows too, and
repeats add no support (instances are counted once); an empty table gives an empty result; other
columns are not read by `find`; `redact` carries them along. Texts of any length are read whole, contexts reach back as far
as the words are long, and instances of any length count.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm._common import drop, written
from seqloom.tables import if_small

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
THRESHOLD, SUPPORT = 0.8, 5
ATOMS, HEX = 5, 32

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A run of digits that is no match from its start is none from a later one; so starts within runs are not tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN_END = re.compile(r"[A-Za-z0-9._%+@-]*")
_TOKEN = frozenset(_LOCAL | {"@"})
_WORD = re.compile(r"\S+")
#: What may stand between two atoms of a candidate.
_GLUE = frozenset((" ", "-", "(", ")", " (", ") ", ")-", ") ("))
_HEX = re.compile(r"(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Local part, @, domain. Found from each @: the local part reaches back to the last match's end at most."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and (not digits or int(digits) <= 255)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


def atoms(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of token characters with a digit or an @, without marks at the ends; a plus sign may lead."""
    end = 0
    m = _MARK.search(text)
    while m:
        start = m.start()
        while start > end and text[start - 1] in _TOKEN:
            start -= 1
        end = _TOKEN_END.match(text, m.end()).end()
        a, b = start, end
        while a < b and text[a] in ".-+%":
            a += 1
        while b > a and text[b - 1] in ".-+%":
            b -= 1
        if a < b:
            yield a - (a > start and text[a - 1] == "+"), b
        m = _MARK.search(text, end)


def candidates(text: str, most: int = ATOMS) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole): runs of up to `most` atoms of a chain; whole if it is all of the chain."""
    chain: list[tuple[int, int]] = []

    def runs() -> Iterator[tuple[int, int, bool]]:
        for i in range(len(chain)):
            for j in range(i, min(len(chain), i + most)):
                yield chain[i][0], chain[j][1], i == 0 and j == len(chain) - 1

    for a in atoms(text):
        if chain and text[chain[-1][1] : a[0]] not in _GLUE:
            yield from runs()
            chain = []
        chain.append(a)
    yield from runs()


def shape(token: str) -> str:
    """Letters and digits by class. Plain, grouped and bracketed numbers keep how many digits stand together."""
    if _HEX.fullmatch(token) and len(token) >= HEX:
        return f"hex{len(token)}"
    counted = not re.search(r"[^0-9 ()+-]", token)
    return re.sub(r"[0-9]+", lambda m: f"9{{{len(m.group())}}}" if counted else "9", re.sub(r"[^\W\d_]+", "a", token))


class Words:
    """The words of a text, for the contexts of its candidates."""

    def __init__(self, text: str) -> None:
        self._text, self._spans = text, [m.span() for m in _WORD.finditer(text)]
        self._starts = [s for s, _ in self._spans]

    def before(self, start: int) -> list[str]:
        """The two words before a place, masked; of the word that the place is in, the part before it if that has a letter or digit."""
        k, out = bisect_left(self._starts, start), []
        while k and len(out) < 2:
            k -= 1
            word = self._text[self._spans[k][0] : min(start, self._spans[k][1])]
            if self._spans[k][1] <= start or any(map(str.isalnum, word)):
                out.append(_DIGIT.sub("0", word.lower()))
        return out[::-1]


def contexts(text: str, words: Words, start: int, end: int, whole: bool) -> list[str]:
    """Lexical patterns of an occurrence."""
    touch = text[start - 1 : start].strip() or "_"
    after = text[end : end + 1].strip() or "_"
    left = words.before(start)
    form = f"{touch}{shape(text[start:end])}{after}"
    out = [f"s {form}", *(f"{n} {' '.join(left[-n:])} {form}" for n in (1, 2) if len(left) >= n)]
    return [*out, f"c {' '.join(left)} {touch}"] if whole and len(left) == 2 else out


def instance(token: str) -> str:
    """What tells an instance: the token, or a digest of a long one."""
    token = token.lower()
    return token if len(token) <= 256 else hashlib.sha256(token.encode()).hexdigest()


def occurrences(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """The candidates of a text that are no fragments: start, end, instance, kind as a seed, free of base spans, patterns."""
    if not _MARK.search(text):
        return []
    taken, exact = sorted((s, e) for _, s, e in base), {(s, e): k for k, s, e in base}
    found, i, words = [], 0, None
    for s, e, whole in candidates(text):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        kind, j, over = exact.get((s, e)), i, False
        while kind is None and not over and j < len(taken) and taken[j][0] < e:
            over = taken[j][1] > s
            j += 1
        if over:
            continue
        words = words or Words(text)
        free = kind is None
        if free and shape(text[s:e]).startswith("hex"):
            kind = "secret"
        found.append({"start": s, "end": e, "instance": instance(text[s:e]), "kind": kind, "free": free, "patterns": contexts(text, words, s, e, whole)})
    return found


def analysed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["doc_id", "t", "base", "found"]
    for b in batches:
        rows, size = [], 0
        for doc, t, text in zip(b["doc_id"], b["t"], b["text"], strict=True):
            base = base_spans(text)
            found = occurrences(text, base)
            rows.append((doc, t, [{"kind": k, "start": s, "end": e} for k, s, e in base], found))
            size += len(found) + len(base)
            if size > 20_000:
                yield pd.DataFrame(rows, columns=columns)
                rows, size = [], 0
        yield pd.DataFrame(rows, columns=columns)


SPANS = "array<struct<kind:string,start:int,end:int>>"
ANALYSED = f"doc_id string, t long, base {SPANS}, found array<struct<start:int,end:int,instance:string,kind:string,free:boolean,patterns:array<string>>>"


def bootstrap(edges: DataFrame, seeds: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, confidence) of the accepted patterns.

    edges: distinct (pattern, instance); seeds: distinct (instance, kind).
    """
    spark = edges.sparkSession
    per, per_path = written(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support), "patterns")
    edges, edges_path = written(edges.join(per, "pattern"), "pattern-edges")
    known, before, old = seeds.withColumn("conf", F.lit(1.0)), None, [per_path]
    while True:
        score = edges.join(known, "instance").groupBy("pattern", "kind", "n").agg(F.sum("conf").alias("s"))
        score, score_path = written(score.select("pattern", "kind", F.round(F.least(F.lit(1.0), F.col("s") / F.col("n")), 6).alias("confidence")).where(F.col("confidence") >= threshold), "scores")
        drop(spark, *old)
        now = tuple(score.agg(F.count("*"), F.sum(F.xxhash64("pattern", "kind", "confidence").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            drop(spark, edges_path)
            return score
        before = now
        told = edges.select("pattern", "instance").join(score, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))).alias("conf"))
        known, path = written(told.unionByName(seeds.withColumn("conf", F.lit(1.0))).groupBy("instance", "kind").agg(F.max("conf").alias("conf")), "instances")
        old = [score_path, path]


def find(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """doc_id, t (digest of the text), base and added spans: one row per input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # ids go through Python as text: pandas would make numbers with nulls among them floating
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    seen = rows.mapInPandas(analysed, ANALYSED).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("rid", F.monotonically_increasing_id())
    seen, _ = written(seen, "analysed")  # rid is fixed from here on
    each = seen.select("rid", F.explode("found").alias("f")).select("rid", "f.*")
    edges = each.select("instance", F.explode("patterns").alias("pattern")).distinct()
    seeds = each.where("kind is not null").select("instance", "kind").distinct()
    accepted = bootstrap(edges, seeds, threshold, support).select("pattern", F.col("kind").alias("as"), "confidence")
    free = each.where("free").select("rid", "start", "end", F.explode("patterns").alias("pattern")).join(accepted, "pattern")
    best = free.groupBy("rid", "start", "end").agg(F.max(F.struct("confidence", "as")).alias("b"))
    # spans that overlap are one, of the kind that is surest
    w = Window.partitionBy("rid").orderBy("start", "end")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("new", F.when(F.col("start") < far, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    best = best.groupBy("rid", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("b").alias("b"))
    added = best.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(F.col("b.as").alias("kind"), "start", "end"))).alias("added"))
    return seen.select("rid", "doc_id", "t", "base").join(added, "rid", "left").select("doc_id", "t", "base", F.coalesce("added", F.array().cast(SPANS)).alias("added"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """The contract's columns, n_added and n_spans (base and added)."""
    d = find(docs.select("doc_id", "text"))
    order = F.create_map(*[F.lit(x) for k in enumerate(KINDS) for x in (k[1], k[0])])
    both = F.sort_array(F.transform(F.concat("base", "added"), lambda x: F.struct(order[x["kind"]].alias("o"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    of = lambda kind: lambda x: x["kind"] == kind
    counts = [F.size(F.filter("base", of(k))).cast("bigint").alias(f"n_{k}") for k in BASE]
    return d.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(both).alias("spans"), F.size("added").cast("bigint").alias("n_added"), (F.size("base") + F.size("added")).cast("bigint").alias("n_spans"))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each stretch that spans cover becomes [KIND] of the first of them."""
    out, at, i = [], 0, 0
    spans = sorted(spans)
    while i < len(spans):
        start, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join((*out, text[at:]))


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with the spans replaced in text, and n_chars, if there is one, as it is then.

    A row's spans depend on its text and the accepted patterns alone, so they meet their texts
    again by doc_id and the text's digest. Null texts stay null.
    """

    def replaced(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else redacted(t, [(x["start"], x["end"], x["kind"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    spans = find(docs, **options).select("doc_id", "t", F.concat("base", "added").alias("spans")).where(F.size("spans") > 0).dropDuplicates(["doc_id", "t"])
    spans = if_small(written(spans, "spans")[0], size=24 * F.size("spans"))  # most texts have none; they need not travel
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    both = rows.join(spans, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("digest") == F.col("t")), "left")
    both = both.select("row", "spans", F.pandas_udf(replaced, "string")("row.text", "spans").alias("new"))
    row = F.col("row").withField("text", F.col("new"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType)))
    return both.select(row.alias("row")).select("row.*")
