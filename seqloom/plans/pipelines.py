"""Composed plans: from reads to a mosaic of reference regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.text import cigar, region, wrapped
from seqloom.operators import match, mosaic, resolve, sam
from seqloom.sources import readers
from seqloom.tables import if_small, written


def aligned(seqs: DataFrame, reads: DataFrame, max_range: int | None = None) -> DataFrame:
    """Alignment records of reads (read_id, qname, seq, qual) in seqs (seq_id, name, seq)."""
    hits = match.with_range(match.locate(seqs, reads.select("read_id", F.col("seq").alias("pattern"))), max_range)
    named = sam.numbered(hits.join(seqs.select("seq_id", F.col("name").alias("rname")), "seq_id"))
    named = named.select("read_id", "rname", F.col("pos").alias("off"), "nh", "nth", F.lit(None).cast("string").alias("cigar"))
    return sam.records(reads, named)


def aligned_fastq(spark: SparkSession, path: str, seqs: DataFrame, max_range: int | None = None) -> DataFrame:
    """Alignment records of the reads of FASTQ files; a read is told by its file and its place there."""
    reads = readers.sequences(spark, path).select(F.struct("file", "ord").alias("read_id"), F.col("name").alias("qname"), "seq", "qual")
    return aligned(seqs, written(reads, "reads"), max_range)


def aligned_to_chromosomes(seqs: DataFrame, reads: DataFrame, max_range: int | None = None) -> DataFrame:
    """Records against the concatenation of seqs (name 'all'), taken back to its sequences."""
    index = written(resolve.sequence_index(seqs), "sequence-index")
    found = aligned(seqs, reads, max_range).join(index.select(F.col("name").alias("rname"), "start"), "rname", "left")
    whole = found.withColumns({"pos": F.coalesce((F.expr("try_cast(pos as bigint)") + F.col("start")).cast("string"), "pos"), "rname": F.when(F.col("start").isNotNull(), F.lit("all")).otherwise(F.col("rname"))}).drop("start")
    return resolve.to_chromosome(whole, index.select(F.col("seq_id").alias("ord"), "name", "len"))


def aligned_pieces(seqs: DataFrame, reads: DataFrame, max_range: int | None = None) -> DataFrame:
    """Records of the reads' greedy segments, with clips in their CIGAR; a row for each hit of each segment,
    and one of flag 4 for a segment without a hit that may be shown."""
    m = F.length("seq")
    d = match.piecewise_locate(seqs, reads.select("read_id", F.col("seq").alias("pattern")), max_range).join(reads, "read_id").join(seqs.select("seq_id", F.col("name").alias("rname")), "seq_id", "left")
    part = F.row_number().over(Window.partitionBy("read_id", "segment").orderBy("seq_id", "pos"))
    d = d.select(F.struct("read_id", "segment").alias("read_id"), "qname", "seq", "qual", "rname", F.col("pos").alias("off"), "nh", part.alias("nth"), cigar(F.col("seg_start"), F.col("seg_end"), m).alias("cigar"))
    own = d.where("nth = 1").select("read_id", "qname", "seq", "qual")
    return sam.records(own, d.select("read_id", "rname", "off", "nh", "nth", "cigar"))


def mosaic_tiles(seqs: DataFrame, reads: DataFrame, default: str, read_len: int, total: int, max_range: int = 200, min_length: int = 21, haplotype: str | None = None) -> DataFrame:
    """Align, filter, cluster and tile in one plan."""
    records = sam.filtered(aligned(seqs, reads, max_range), None, min_length)
    return mosaic.tiles(mosaic.clusters(sam.unique_position_refs(records, haplotype)), default, read_len, total)


def mosaic_parts(tiles: DataFrame, seqs: DataFrame) -> DataFrame:
    """(a, b, ref, part): each tile's region of its sequence, as far as that goes. Tiles are counted, and broadcast if they are few."""
    t = written(tiles.select("a", "b", "ref"), "tiles")
    return seqs.select("name", "seq").join(if_small(t), F.col("name") == F.col("ref")).select("a", "b", "ref", region(F.col("seq"), F.col("a").cast("int"), F.col("b").cast("int")).alias("part"))


def mosaic_fasta(tiles: DataFrame, seqs: DataFrame, name: str, width: int = 60) -> DataFrame:
    """The tiles' regions in order, as one FASTA record. One sequence, so one row."""
    whole = mosaic_parts(tiles, seqs).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", "part"))), lambda x: x["part"]), "").alias("seq"))
    return whole.select(F.concat(F.lit(f">{name}\n"), wrapped(F.col("seq"), width)).alias("value"))


def consensus(seqs: DataFrame, variants: DataFrame) -> DataFrame:
    """(sample, haplotype, name, seq): each sequence with each sample haplotype's substitutions put in.
    variants: (name, pos from 1, alt, sample, haplotype); one letter each, later ones of a place win."""
    last = F.row_number().over(Window.partitionBy("sample", "haplotype", "name", "pos").orderBy(F.desc("alt")))
    v = variants.withColumn("_r", last).where("_r = 1").groupBy("sample", "haplotype", "name").agg(F.sort_array(F.collect_list(F.struct("pos", "alt"))).alias("v"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, x: F.struct(F.concat(s["out"], F.substring("seq", s["at"] + 1, x["pos"] - 1 - s["at"]), x["alt"]).alias("out"), x["pos"].alias("at"))
    folded = F.aggregate("v", start, step, lambda s: F.concat(s["out"], F.substring("seq", s["at"] + 1, F.length("seq"))))
    return v.join(seqs.select("name", "seq"), "name").select("sample", "haplotype", "name", folded.alias("seq"))
