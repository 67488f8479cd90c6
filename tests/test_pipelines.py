from seqloom.plans import pipelines


def test_mosaic_from_reads(spark):
    a, b = "ACGTTGCAAGCTTACGGATTCAGGCATTAGCCATGACT", "ACGTTGCAAGCTTACGGATTCAGCCTTTAGCCATGTTA"
    seqs = spark.createDataFrame([(0, "a", a), (1, "b", b)], "seq_id long, name string, seq string")
    reads = spark.createDataFrame([(i, f"r{i}", s, "~" * 8) for i, s in enumerate((a[2:10], b[20:28], "GGGGGGGG"))], "read_id long, qname string, seq string, qual string")
    r = {x.qname: (x.flag, x.rname, x.pos) for x in pipelines.aligned(seqs, reads).where("flag <> 256").collect()}
    assert r["r1"] == (0, "b", "21") and r["r2"] == (4, "*", "*") and r["r0"][0] == 0
    tiles = pipelines.mosaic_tiles(seqs, reads, "a", 8, len(a), min_length=8)
    got = pipelines.mosaic_fasta(tiles, seqs, "m").first().value
    assert got == ">m\n" + a[:20] + b[20:28] + a[28:]


def test_consensus(spark):
    seqs = spark.createDataFrame([("c", "AAAAA")], "name string, seq string")
    v = spark.createDataFrame([("c", 2, "C", "s", 1), ("c", 5, "G", "s", 1), ("c", 1, "T", "s", 2)], "name string, pos int, alt string, sample string, haplotype int")
    assert {(x.sample, x.haplotype): x.seq for x in pipelines.consensus(seqs, v).collect()} == {("s", 1): "ACAAG", ("s", 2): "TAAAA"}


def test_pieces_are_records(spark):
    seqs = spark.createDataFrame([(0, "s", "ACGTACGTTACG")], "seq_id long, name string, seq string")
    reads = spark.createDataFrame([(1, "r", "ACGTXTTAC", "~" * 9)], "read_id long, qname string, seq string, qual string")
    got = sorted((x.flag, x.pos, x.cigar, x.tags) for x in pipelines.aligned_pieces(seqs, reads).collect())
    assert got == [(0, "1", "4M5S", "NH:i:2 "), (0, "8", "5S4M", "NH:i:1 "), (256, "5", "4M5S", "NH:i:2 ")]
    assert sorted(x.flag for x in pipelines.aligned_pieces(seqs, reads, 1).collect()) == [0, 4]
