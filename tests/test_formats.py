"""Files, records, mosaics, small functions."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from seqloom.functions import text as T
from seqloom.operators import mosaic, neighbors, resolve, sam
from seqloom.sources import readers, writers
from seqloom.streaming.search import search_stream


def test_sequence_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nacgt\nAC\n\n>two\n>three x\nß\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@r1 x\nACGT\n+\n@>~~\n@r2\nAC\nGT\n+r2\n~~\n~~\n")
    got = sorted((os.path.basename(r.file), r.ord, r.name, r.seq, r.qual) for r in readers.sequences(spark, str(tmp_path / "*"), upper=True).collect())
    assert got == [("a.fa", 0, "one", "ACGTAC", None), ("a.fa", 1, "two", "", None), ("a.fa", 2, "three", "ß", None), ("b.fq.gz", 0, "r1", "ACGT", "@>~~"), ("b.fq.gz", 1, "r2", "ACGT", "~~~~")]
    assert readers.first_records(readers.sequences(spark, str(tmp_path / "a.fa")), 1).count() == 1
    assert readers.plain_text(spark, str(tmp_path / "a.fa")).first().seq.startswith(">one")


def test_fastq_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a", "ACGT"), ("b", "é")], "name string, seq string")
    writers.write_lines(writers.fastq(d), str(tmp_path / "q"))
    assert sorted((r.name, r.seq, r.qual) for r in readers.sequences(spark, str(tmp_path / "q/part*")).collect()) == [("a", "ACGT", "~~~~"), ("b", "é", "~")]
    long = spark.createDataFrame([("x", "A" * 130)], "name string, seq string")
    assert writers.fasta(long).first().value == ">x\n" + "A" * 60 + "\n" + "A" * 60 + "\n" + "A" * 10


def test_binary_samples_and_bwt(spark, tmp_path):
    five = lambda x: x.to_bytes(5, "little")
    pairs = [(0, 6), (1, 0), (3_000_000_000, 1_099_511_627_775)]
    (tmp_path / "x.ssa").write_bytes(b"".join(five(a) + five(b) for a, b in pairs))
    got = readers.sample_file(spark, str(tmp_path / "x.ssa"), 7).orderBy("run").collect()
    assert [(r.rk, r.tpos) for r in got] == [(0, 5), (1, 6), (3_000_000_000, 1_099_511_627_774)]
    (tmp_path / "x.bwt").write_bytes(b"AN\x00\x01\xff")
    assert [r.c for r in readers.bwt_file(spark, str(tmp_path / "x.bwt")).orderBy("rk").collect()] == ["A", "N", None, None, "ÿ"]


@pytest.mark.parametrize("sep", ["", "\n"])
def test_pattern_file(spark, tmp_path, sep):
    (tmp_path / "p").write_text("# number=3 length=4 file=x forbidden=\n" + sep.join(["ACGT", "TTTT", "GGGA"]) + sep)
    assert [r.pattern for r in readers.pattern_file(spark, str(tmp_path / "p")).orderBy("read_id").collect()] == ["ACGT", "TTTT", "GGGA"]


def test_sam_and_index_files(spark, tmp_path):
    d = spark.createDataFrame([("q", 0, "r", "5", "255", "3M", "*", 0, 0, "ACG", "~~~", "NH:i:1 \tXX:i:2")], "qname string, flag int, rname string, pos string, mapq string, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags string")
    head = sam.header(spark.createDataFrame([(0, "r", 9)], "ord long, name string, len long")).select("value")
    writers.write_lines(head.unionByName(sam.as_lines(d)), str(tmp_path / "s"))
    assert readers.sam(spark, str(tmp_path / "s")).collect() == d.collect() and readers.sam_header(spark, str(tmp_path / "s")).count() == 2
    i = spark.createDataFrame([("a", 0), ("b", 9)], "name string, start long")
    writers.write_lines(writers.sequence_index_lines(i), str(tmp_path / "i"))
    assert sorted(readers.sequence_index(spark, str(tmp_path / "i")).collect()) == sorted(i.collect())
    writers.save_index(str(tmp_path / "x"), sequences=i)
    assert writers.load_index(spark, str(tmp_path / "x"), "sequences").count() == 2
    (tmp_path / "f.fai").write_text("c1\t100\t5\nc2\t50\t9\n")
    assert [(r.name, r.len) for r in readers.fai(spark, str(tmp_path / "f.fai")).orderBy("ord").collect()] == [("c1", 100), ("c2", 50)]
    (tmp_path / "pop").write_text("sample\tpop\ns1\tX\n")
    assert readers.population(spark, str(tmp_path / "pop")).first().pop == "X"
    lines = writers.occurrence_lines(spark.createDataFrame([(7,), (3,)], "pos long")).collect()
    assert [r.value for r in lines] == ["3", "7"]


def test_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(T.ascii_upper(lit("straße é"))) == "STRAßE é"
    assert [one(T.hamming(lit(a), lit(b))) for a, b in (("abc", "abd"), ("ab", "b"), ("", "x"), ("é", "e"))] == [1, 1, 0, 1]
    assert [one(T.common_suffix(lit(a), lit(b))) for a, b in (("xbc", "abc"), ("a", "b"), ("", "b"), ("bc", "abc"))] == [2, 0, 0, 2]
    assert [one(T.bit_size(lit(x).cast("bigint"))) for x in (0, 1, 2, 255, 256)] == [1, 1, 2, 8, 9]
    assert one(T.duration(lit(3725))) == "3725 seconds. (1h 2m 5s)"
    assert one(T.cigar(lit(2), lit(5), lit(9))) == "2S4M3S" and one(T.aligned_length(lit("2S4M1I10M"))) == 14
    assert one(T.leading_clip(lit("12S4M"))) == 12 and one(T.leading_clip(lit("4M"))) == 0
    assert len(one(T.random_dna(lit(50), lit(1)))) == 50 and set(one(T.random_dna(lit(200), lit(1)))) == set("ACGT")
    with pytest.raises(Exception, match="reserved"):
        one(T.checked(lit("a\x01")))


def test_neighbourhood_sizes(spark):
    for n, d, size in ((3, 1, 10), (3, 2, 37), (3, 3, 64), (5, 1, 16), (5, 2, 106), (5, 3, 376), (4, 0, 1)):
        r = neighbors.neighbourhood(spark.createDataFrame([("ACGTA"[:n],)], "word string"), d).collect()
        assert len(r) == len({x.neighbour for x in r}) == size


def test_clusters_and_tiles(spark):
    p = spark.createDataFrame([(10, ["A", "B"]), (20, ["A"]), (30, ["B", "C"]), (40, ["C"])], "pos long, refs array<string>")
    c = mosaic.clusters(p)
    assert [(r.first_pos, r.last_pos, r.n_pos, r.refs) for r in c.orderBy("cluster").collect()] == [(10, 20, 2, ["A"]), (30, 40, 2, ["C"])]
    t = mosaic.tiles(c, "Z", 5, 60).orderBy("a").collect()
    assert [r.name for r in t] == ["Z:1-9", "A:10-24", "Z:25-29", "C:30-44", "Z:45-60"]
    assert [r.name for r in mosaic.tiles(c, "Z", 5, 60, extend=True).orderBy("a").collect()] == ["Z:1-9", "A:10-29", "C:30-60"]
    keyed = mosaic.clusters(p.withColumn("chrom", F.when(F.col("pos") < 25, "x").otherwise("y")), "chrom")
    assert sorted((r.chrom, r.cluster, r.n_pos) for r in keyed.collect()) == [("x", 0, 2), ("y", 0, 2)]


def test_repeat_groups_in_file_order(spark):
    rows = [(0, "a", 0), (1, "a", 256), (2, "b", 0), (3, "b", 0), (4, "a", 0)]
    d = spark.createDataFrame(rows, "i long, qname string, flag int")
    assert sorted(r.i for r in sam.without_repeats(d, order="i").collect()) == [0, 1, 4]
    assert sorted(r.i for r in sam.without_repeats(d).collect()) == []


def test_fastq_of_any_cut(spark, tmp_path):
    """One file, cut every few bytes: quality lines that begin with @ and +, line ends of two letters, a second file, gzip."""
    recs = [(f"r{i} x", "ACGT"[: i % 5] + "é" * (i % 2), "@+~é"[: i % 5] + "@" * (i % 2)) for i in range(40)]
    text = "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in recs)
    (tmp_path / "a.fq").write_text(text)
    (tmp_path / "b.fq").write_text(text.replace("\n", "\r\n") + "\n\n")
    with gzip.open(tmp_path / "c.fq.gz", "wt") as f:
        f.write(text.removesuffix("\n"))
    want = sorted((f, i, n.split()[0], s, q) for f in ("a.fq", "b.fq", "c.fq.gz") for i, (n, s, q) in enumerate(recs))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("37", "301", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = readers.fastq(spark, str(tmp_path / "*"))
            assert sorted((os.path.basename(r.file), r.ord, r.name, r.seq, r.qual) for r in got.collect()) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.fq").write_text("@a\nAC\nGT\n+\n~~~~\n")
    with pytest.raises(Exception, match="four lines"):
        readers.fastq(spark, str(tmp_path / "bad")).collect()


def test_offsets(spark):
    i = spark.createDataFrame([(0, "a", 0, 4), (1, "e", 4, 0), (2, "b", 4, 5), (3, "c", 9, 3)], "seq_id long, name string, start long, len long")
    for bucket in (1, 4, 1 << 20):
        got = {r.x: (r.name, r.off) for r in resolve.resolve(spark.createDataFrame([(x,) for x in (0, 3, 4, 5, 9, 10, 12)], "x long"), i, bucket).collect()}
        assert got == {0: ("a", 0), 3: ("a", 3), 4: ("b", 0), 5: ("b", 1), 9: ("c", 0), 10: ("c", 1), 12: (None, None)}
    assert sorted(tuple(r) for r in resolve.names_and_lengths(i.where("len > 0"), 12).collect()) == [("a", 4), ("b", 5), ("c", 3)]
    a = spark.createDataFrame([("q", 0, "all", "5"), ("r", 4, "*", "*")], "qname string, flag int, rname string, pos string")
    n = spark.createDataFrame([(0, "a", 4), (1, "b", 5)], "ord long, name string, len long")
    assert sorted((r.qname, r.rname, r.pos) for r in resolve.to_chromosome(a, n).collect()) == [("q", "b", "1"), ("r", "*", "*")]
    assert {r.qname: (r.rname, r.pos) for r in resolve.to_chromosome(a, n, one_based=False).collect()}["q"] == ("b", "1")


def test_pattern_stream(spark, tmp_path):
    spark.createDataFrame([(1, "AN"), (2, "ZZ")], "read_id long, pattern string").write.parquet(str(tmp_path / "in"))
    seqs = spark.createDataFrame([(0, "BANANA")], "seq_id long, seq string")
    found = []
    q = search_stream(spark.readStream.schema("read_id long, pattern string").parquet(str(tmp_path / "in")), seqs, lambda df, i: found.extend(map(tuple, df.collect())), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(found) == [(1, 0, 1), (1, 0, 3)]


def test_fasta_is_cut_at_records(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\r\nac gt\r\nAC\r\n\n>two\n>three x\nß>x\n" + "".join(f">n{i}\n{'ACGT' * 40}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    got = readers.fasta(spark, str(tmp_path / "a.fa"), upper=True)
    parts, rows = got.rdd.getNumPartitions(), got.collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert parts > 1 and len(rows) == 503
    assert {r.name: r.seq for r in rows} == {"one": "AC GTAC", "two": "", "three": "ß>X"} | {f"n{i}": "ACGT" * 40 for i in range(500)}


def test_binary_files_are_read_by_many_tasks(spark, tmp_path):
    """Every cut gives the same rows; ranges of a sample file begin with a pair."""
    letters = bytes([65, 1, 10, 13, 255, 66, 0]) * 31 + b"C"
    (tmp_path / "x.bwt").write_bytes(letters)
    want = [(i, None if b < 2 else chr(b)) for i, b in enumerate(letters)]
    for task, row in ((1 << 20, 1 << 20), (50, 7), (64, 64), (1, 1)):
        d = readers.bwt_file(spark, str(tmp_path / "x.bwt"), task=task, row=row)
        assert [tuple(r) for r in d.orderBy("rk").collect()] == want
        if task == 50:
            assert d.rdd.getNumPartitions() == -(-len(letters) // 50)
    pairs = [(i * 3, (i * 7_000_000_019) % (1 << 40)) for i in range(101)]
    (tmp_path / "x.ssa").write_bytes(b"".join(x.to_bytes(5, "little") for p in pairs for x in p) + b"abc")
    want = [(i, x, y - 1 if y else 999) for i, (x, y) in enumerate(pairs)]
    for task, row in ((1 << 20, 1 << 20), (105, 33), (10, 10), (3, 3)):
        d = readers.sample_file(spark, "file://" + str(tmp_path / "x.ssa"), 1000, task=task, row=row)
        assert [tuple(r) for r in d.orderBy("run").collect()] == want


def test_a_binary_file_may_be_longer_than_a_row_can_hold(spark, tmp_path):
    """A file of over 2 GB, nearly all of it a hole: its ranges, and a row far behind."""
    from pyspark.sql import functions as F

    from seqloom.sources.ranges import byte_ranges

    size = (1 << 31) + 12345
    with open(tmp_path / "long", "wb") as f:
        f.truncate(size - 3)
        f.seek(size - 3)
        f.write(b"end")
    d = byte_ranges(spark, str(tmp_path / "long"), row=1 << 24, task=1 << 28)
    got = d.agg(F.sum(F.length("content").cast("bigint")), F.max(F.struct("start", F.substring("content", -3, 3).alias("last")))).first()
    assert got[0] == size and bytes(got[1]["last"]) == b"end"


def test_an_empty_binary_file_and_a_missing_one(spark, tmp_path):
    (tmp_path / "none").write_bytes(b"")
    assert readers.bwt_file(spark, str(tmp_path / "none")).collect() == readers.sample_file(spark, str(tmp_path / "none"), 1).collect() == []
    with pytest.raises(Exception, match="missing"):
        readers.bwt_file(spark, str(tmp_path / "missing")).collect()
