"""Readers of sequence, pattern and alignment files. All but binary files (see ranges) go through Spark's sources,
so any file system that Spark knows will do; gzip is read as it is."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.text import ascii_upper, header_field
from seqloom.sources.ranges import byte_ranges
from seqloom.tables import written

SEQUENCES = "file string, ord long, name string, seq string, qual string"


def sequences(spark: SparkSession, path: str, upper: bool = False) -> DataFrame:
    """(file, ord, name, seq, qual) of FASTA and FASTQ files: name is the first token; sequences may
    span lines; qual is null for FASTA. A file is read by one task, record by record, as its format
    asks for; many files make many tasks."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, text in zip(b["file"], b["value"], strict=True):
                yield pd.DataFrame([(file, i, *r) for i, r in enumerate(records(text))], columns=["file", "ord", "name", "seq", "qual"])

    d = files.mapInPandas(parsed, SEQUENCES)
    return d.withColumn("seq", ascii_upper(F.col("seq"))) if upper else d


def fasta(spark: SparkSession, path: str, upper: bool = False) -> DataFrame:
    """(file, name, seq) of plain FASTA files of any size: a record is a row of the text source, which cuts files at line
    ends before '>', so that many tasks read one file. Not for gzip, which has no places to cut at."""
    d = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"^>|\r", "").alias("value"))
    head = F.substring_index("value", "\n", 1)
    seq = F.replace(F.substring("value", F.length(head) + 2, F.length("value")), F.lit("\n"), F.lit(""))
    d = d.where(head != "").select("file", F.substring_index(F.trim(head), " ", 1).alias("name"), seq.alias("seq"))
    return d.withColumn("seq", ascii_upper(F.col("seq"))) if upper else d


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, name, seq, qual) of FASTQ files of any size whose records have four lines each: many tasks read one file.

    A line's letters tell nothing of where a record begins, as a quality line may begin with @; its number does. Lines are counted for each
    byte range that Spark has cut, and these counts added up, a row a range. Each task then knows the number of its first line, puts its
    records together, and gives on the lines of those that are cut; they alone are shuffled. Gzip has no places to cut at: such a
    file is one range. Files whose records are no four lines each raise an error."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    counts = written(lines.groupBy("file", "block").agg(F.count("*").alias("n")), "line-counts")
    before = counts.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = written(before.select(F.col("file").alias("_f"), F.col("block").alias("_b"), "first"), "first-lines")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, names = None, [], ["file", "ord", "line", "lines"]
        for b in batches:
            out = []
            for file, block, first, value in zip(*(b.column(c).to_pylist() for c in ("file", "block", "first", "value")), strict=True):
                if at is None or at[:2] != (file, block):
                    out += [(at[0], n // 4, n % 4, [x]) for n, x in part]
                    at, number, part = (file, block), first, []
                if number % 4 == 0 and part:
                    out += [(file, n // 4, n % 4, [x]) for n, x in part]
                    part = []
                part.append((number, value.removesuffix("\r")))
                if len(part) == 4:
                    out.append((file, number // 4, 0, [x for _, x in part]))
                    part = []
                number += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if part:
            out = [(at[0], n // 4, n % 4, [x]) for n, x in part]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    kinds = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()))
    # a join that moved lines would lose their order; there is one count for each task of the read, and the driver holds a list of these anyway
    numbered = lines.join(F.broadcast(before), (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b"))).select("file", "block", "first", "value")
    d = written(numbered.mapInArrow(put, "file string, ord long, line int, lines array<string>"), "fastq")
    cut = d.where(F.size("lines") < 4).groupBy("file", "ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "lines"))), lambda x: x["lines"][0]).alias("lines"))
    # empty lines at a file's end are none
    cut = cut.where(F.exists("lines", lambda x: x != ""))
    d = d.where(F.size("lines") == 4).select("file", "ord", "lines").unionByName(cut)
    line = lambda i: F.get("lines", F.lit(i))
    right = (F.size("lines") == 4) & line(0).startswith("@") & line(2).startswith("+") & (F.length(line(1)) == F.length(line(3)))
    name = F.substring_index(F.trim(F.translate(F.substring(line(0), F.lit(2), F.length(line(0))), "\t", " ")), " ", 1)
    return d.select("file", "ord", F.when(right, name).otherwise(F.raise_error(F.lit("not a FASTQ file of four lines a record")).cast("string")).alias("name"), line(1).alias("seq"), line(3).alias("qual"))


def records(text: str) -> Iterator[tuple[str, str, str | None]]:
    """(name, seq, qual) of each record; quality lines are counted, as they may begin with @ or >. Blanks in lines stay."""
    lines = (x.removesuffix("\r") for x in text.split("\n"))
    line = next(lines, None)
    while line is not None:
        if not line.startswith((">", "@")):
            line = next(lines, None)
            continue
        name = (line[1:].split() or [""])[0]
        seq, line = [], next(lines, None)
        while line is not None and not line.startswith((">", "@", "+")):
            seq.append(line)
            line = next(lines, None)
        whole = "".join(seq)
        if line is None or not line.startswith("+"):
            yield name, whole, None
            continue
        qual, n = [], 0
        while n < len(whole) and (line := next(lines, None)) is not None:
            qual.append(line)
            n += len(qual[-1])
        yield name, whole, "".join(qual)
        line = next(lines, None)


def first_records(d: DataFrame, n: int) -> DataFrame:
    return d.where(F.col("ord") < n)


def plain_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq): a file is one text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("seq"))


def bwt_file(spark: SparkSession, path: str, **cut: int) -> DataFrame:
    """(rk, c) of a raw transform: a byte a row; bytes 0 and 1 are the terminator (null). Bytes are read as Latin-1. Many tasks
    read one file, in ranges (`task`, `row`: bytes of each)."""
    d = byte_ranges(spark, path, **cut).select("start", F.decode("content", "ISO-8859-1").alias("t"))
    d = d.select("start", F.posexplode(F.split("t", "")).alias("at", "c")).where("c <> ''")
    return d.select((F.col("start") + F.col("at")).alias("rk"), F.when(F.ascii("c") > 1, F.col("c")).alias("c"))


def _five(at) -> "F.Column":
    """A little-endian number of five bytes at a 1-based place."""
    byte = lambda k: F.conv(F.hex(F.substring("content", at + k, F.lit(1))), 16, 10).cast("bigint")
    return byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216 + byte(4) * 4294967296


def sample_file(spark: SparkSession, path: str, n: int, **cut: int) -> DataFrame:
    """(run, rk, tpos) of a file of pairs of five-byte numbers, a run's place and its suffix y; the letter's place
    is y - 1, or n - 1 for 0. Many tasks read one file, in ranges that begin with a pair; an incomplete pair at the end is none."""
    d = byte_ranges(spark, path, record=10, **cut).where(F.length("content") >= 10)
    d = d.select("start", "content", F.explode(F.sequence(F.lit(0), F.floor(F.length("content") / 10).cast("int") - 1)).alias("i"))
    y = _five(F.col("i") * 10 + 6)
    return d.select(F.floor(F.col("start") / 10 + F.col("i")).alias("run"), _five(F.col("i") * 10 + 1).alias("rk"), F.when(y == 0, F.lit(n) - 1).otherwise(y - 1).alias("tpos"))


def sequence_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, start) of a sequence index: white-space separated pairs."""
    d = spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("p"))
    return d.select(F.col("p")[0].alias("name"), F.col("p")[1].cast("bigint").alias("start"))


def fai(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, len) of a FASTA index, in file order."""
    d = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.split("value", "\t").alias("p"))
    return d.select("ord", F.col("p")[0].alias("name"), F.col("p")[1].cast("bigint").alias("len"))


def pattern_file(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, pattern) of a pattern file: a header with number= and length=, then patterns of that
    length, one after the other or a line each (a line end behind a pattern is skipped)."""
    d = spark.read.text(path, wholetext=True)
    end = F.locate("\n", F.col("value"))
    head = F.substring("value", F.lit(1), end)
    d = d.select(header_field(head, "number").alias("n"), header_field(head, "length").cast("int").alias("m"), F.substring("value", end + 1, F.length("value")).alias("body"))
    step = F.when(F.substring("body", F.col("m") + 1, F.lit(1)) == "\n", F.col("m") + 1).otherwise(F.col("m"))
    d = d.withColumn("step", step).where("n > 0").select("m", "step", "body", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("read_id"))
    return d.select(F.col("read_id").cast("bigint"), F.substring("body", F.col("read_id") * F.col("step") + 1, F.col("m")).alias("pattern"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records; header lines are left out. Further tags stay in tags."""
    p = F.split("value", "\t", 12)
    d = spark.read.text(path).where(~F.col("value").startswith("@")).select(p.alias("p"))
    name = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "tags")
    kind = {"flag": "int", "pnext": "int", "tlen": "int"}
    return d.select(*[F.get("p", F.lit(i)).cast(kind.get(c, "string")).alias(c) for i, c in enumerate(name)])


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").startswith("@"))


def population(spark: SparkSession, path: str) -> DataFrame:
    """Sample metadata: a tab-separated table with a header."""
    return spark.read.csv(path, sep="\t", header=True)
