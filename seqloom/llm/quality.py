"""Quality rules: a threshold table compiled into one Spark projection.

Defined cases: a null text has no words (and so fails the base rule); repeated rows each
get their own result; an empty table gives an empty result; columns that the operator
does not name are carried along by `with_quality` and may not be called like its outputs
(an old column of such a name is replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm._common import SPACE, split_words

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in that is was for it with as on be at by this are from or an not have a "
    "de la le et les des en un du une que est pour qui dans sur par au avec "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine "
    "el y los del se las por con su para al lo como "
).split()


@dataclass(frozen=True)
class Rule:
    """A row of the table: the ratio measure / per must lie in [low, high] once a text has `words` words."""

    name: str
    measure: str
    per: str
    low: float | None = None
    high: float | None = None
    words: int = 0


#: Ratios are compared by cross multiplication in integers: low and high are given per 1000.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 1_500, 20_000),
    Rule("symbols_to_words", "n_symbols", "n_words", None, 500),
    Rule("stop_words", "n_stop", "n_words", 20, None, 50),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("pipe_words", "n_pipes", "n_words", None, 250),
)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop", "n_pipes")


def compiled(rules: tuple[Rule, ...], m: Column) -> Column:
    """One boolean expression over the measures m that is true where every rule holds."""
    verdict = F.lit(True)
    for r in rules:
        part, whole = m[r.measure] * 1000, m[r.per]
        holds = F.lit(True)
        if r.low is not None:
            holds = holds & (part >= whole * r.low)
        if r.high is not None:
            holds = holds & (part <= whole * r.high)
        verdict = verdict & ((m["n_words"] < r.words) | holds)
    return verdict


def _let(value: Column, body) -> Column:
    """body of value, which is evaluated once; the optimizer never spells it out again where a name recurs."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeats(digests: Column, window: int) -> Column:
    """Words within windows that occur twice or more, from the words' digests.

    The windows' 64-bit digests are tested for a duplicate with a hash set; only a text that has one
    sorts (digest, place) pairs and compares neighbours.
    """
    runs = lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, window)])), F.lit(1), F.greatest(F.lit(0), F.size(h) - (window - 1)))
    same = lambda e, other: F.coalesce(e["h"] == other["h"], F.lit(False))
    twice = lambda s: F.sort_array(F.transform(F.filter(s, lambda e, j: same(e, F.get(s, j - 1)) | same(e, F.get(s, j + 1))), lambda e: e["i"]))
    length = lambda p: F.aggregate(F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(window), F.get(p, j + 1) - x), F.lit(window))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    pairs = lambda g: F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    found = lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), _let(_let(pairs(g), twice), length)).otherwise(F.lit(0).cast("bigint"))
    return _let(digests, lambda h: _let(runs(h), found))


def measured(text: Column, rules: tuple[Rule, ...] = RULES, window: int = 5, stop_words=STOP_WORDS) -> Column:
    """All measures of a text, base_failed and kept, as one struct."""
    count = lambda t, c: F.length(F.regexp_replace(t, c, "")).cast("bigint")

    def of_parts(t: Column, w: Column, ls: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            count(t, f"{SPACE}+").alias("word_chars"),
            count(t, r"[^#*$%&|<>]+").alias("n_symbols"),
            F.size(ls).cast("bigint").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
            _repeats(F.transform(w, lambda x: F.xxhash64(x)), window).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*stop_words))).cast("bigint").alias("n_stop"),
            F.size(F.filter(w, lambda x: x == "|")).cast("bigint").alias("n_pipes"),
        )

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
        return F.struct(*[m[n].alias(n) for n in MEASURES], failed.alias("base_failed"), (~failed & compiled(rules, m)).alias("kept"))

    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}"))
    return _let(F.coalesce(text, F.lit("")), lambda t: _let(_let(F.struct(split_words(t, SPACE).alias("w"), lines(t).alias("l")), lambda p: of_parts(t, p["w"], p["l"])), judged))


def with_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, window: int = 5, stop_words=STOP_WORDS) -> DataFrame:
    """docs with the measures, base_failed and kept. Narrow: no shuffle, no user function."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (*MEASURES, "base_failed", "kept")])
    return docs.select(others.alias("row"), measured(F.col("text"), rules, window, stop_words).alias("q")).select("row.*", "q.*")


def quality_report(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the measures of the further rules."""
    return with_quality(docs.select("doc_id", "text")).drop("text")


def _sql_rules() -> str:
    parts = []
    for r in RULES:
        low = f"{r.measure} * 1000 >= {r.per} * {r.low}" if r.low is not None else "true"
        high = f"{r.measure} * 1000 <= {r.per} * {r.high}" if r.high is not None else "true"
        parts.append(f"(n_words < {r.words} OR ({low} AND {high}))")
    return " AND ".join(parts)


ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
p AS (SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
d AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS c FROM p) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM d, range(0, 5) g(k) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda x: list_contains({STOP_WORDS!r}, lower(x))))::BIGINT AS n_stop,
        len(list_filter(ws, lambda x: x = '|'))::BIGINT AS n_pipes
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT *, (NOT base_failed AND {_sql_rules()}) AS kept FROM b
"""
