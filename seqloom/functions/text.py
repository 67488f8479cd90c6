"""Scalar functions over texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_upper(text: Column) -> Column:
    """a-z to A-Z; all other characters stay (upper() would turn one sharp s into two letters)."""
    return F.when(F.octet_length(text) == F.length(text), F.upper(text)).otherwise(F.translate(text, LOWER, LOWER.upper()))


def has_reserved(text: Column) -> Column:
    """Whether a text holds one of the two bytes kept for the terminator."""
    return text.contains("\x00") | text.contains("\x01")


def checked(text: Column) -> Column:
    """The text; an error if it holds a reserved byte."""
    return F.when(has_reserved(text), F.raise_error(F.lit("text holds a reserved byte (0x00 or 0x01)")).cast("string")).otherwise(text)


def acgt_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^ACGT]", "")


def hamming(a: Column, b: Column) -> Column:
    """Differing characters over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(0)).otherwise(F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))))


def common_suffix(a: Column, b: Column) -> Column:
    """Length of the longest common suffix."""
    n = F.least(F.length(a), F.length(b))
    ra, rb = F.reverse(a), F.reverse(b)
    first = F.get(F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(ra, i, F.lit(1)) != F.substring(rb, i, F.lit(1))), F.lit(0))
    return F.coalesce(first - 1, n)


def bit_size(x: Column) -> Column:
    """Bits needed for x; 1 for 0."""
    return F.when(x == 0, F.lit(1)).otherwise(F.length(F.bin(x)))


def duration(seconds: Column) -> Column:
    """'N seconds. (Hh Mm Ss)'"""
    s = seconds.cast("bigint")
    return F.format_string("%d seconds. (%dh %dm %ds)", s, (s / 3600).cast("bigint"), ((s % 3600) / 60).cast("bigint"), s % 60)


def cigar(start: Column, end: Column, m: Column) -> Column:
    """Clips and match of a segment [start, end] of a read of length m; clips of length 0 are left out."""
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    return F.concat(clip(start), (end - start + 1).cast("string"), F.lit("M"), clip(m - end - 1))


def aligned_length(cigar_text: Column) -> Column:
    """Sum of the M operations; 0 for '*'."""
    return F.aggregate(F.regexp_extract_all(cigar_text, F.lit(r"(\d+)M"), 1), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def leading_clip(cigar_text: Column) -> Column:
    found = F.regexp_extract(cigar_text, r"^(\d+)S", 1)
    return F.when(found == "", F.lit(0)).otherwise(found.cast("bigint"))


def header_field(line: Column, name: str) -> Column:
    """A number from a pattern file's header: number= or length=."""
    found = F.regexp_extract(line, rf"{name}=(\d+)", 1)
    return F.when(found != "", found.cast("bigint"))


def wrapped(text: Column, width: int = 60) -> Column:
    """The text without its own line ends, and one after every `width` characters but the last."""
    return F.regexp_replace(F.replace(text, F.lit("\n"), F.lit("")), rf"(.{{{width}}})(?=.)", "$1\n")


def region(seq: Column, first: Column, last: Column) -> Column:
    """1-based inclusive slice."""
    return F.substring(seq, first, last - first + 1)


def random_dna(length: Column, seed: Column) -> Column:
    """A letter for each place from a digest of seed and place: the same in every run, and in other engines."""
    letters = F.array(*[F.lit(x) for x in "ACGT"])
    digit = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), i.cast("string"))), 1, 1), 16, 10).cast("int")
    return F.array_join(F.transform(F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>")), lambda i: F.get(letters, F.pmod(digit(i), F.lit(4)))), "")
