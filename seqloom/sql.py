"""Search from SQL: the operators of a collection and its patterns as views and table functions of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from seqloom.operators import match, resolve
from seqloom.tables import written


@F.udtf(returnType="seq_id string, pos bigint")
class Locate:
    """locate(TABLE(sequences), pattern): every occurrence of one pattern, overlapping ones too."""

    def eval(self, row: Row, pattern: str):
        seq = row["seq"]
        if seq and pattern:
            at = seq.find(pattern)
            while at >= 0:
                yield str(row["seq_id"]), at
                at = seq.find(pattern, at + 1)


def register(spark: SparkSession, seqs: DataFrame, patterns: DataFrame, prefix: str = "", suffixes: bool = False) -> None:
    """Views and functions over seqs (seq_id, name, seq) and patterns (read_id, pattern), each name led by `prefix`; those there are
    under these names are replaced. A view is worked out where it is used, but for the index and, if `suffixes` asks for it, pattern_suffixes.

    Views: sequences; patterns; sequence_index (seq_id, name, start, len); pattern_hits (read_id, seq_id, pos); pattern_counts
    (read_id, occ), 0 included; pattern_suffixes (read_id, match_len, occ), the longest suffix of each that occurs. Table
    functions: locate(TABLE(sequences), pattern) of one pattern, its seq_id as a string; sequence_at(x), the sequence (seq_id, name, off) at a place
    of the concatenation, which has no row behind its end. Null and empty patterns are in pattern_counts with 0, and have neither hits nor suffixes.
    """
    view = lambda name, d: d.createOrReplaceTempView(prefix + name)
    some = patterns.where("pattern <> ''")
    index = written(resolve.sequence_index(seqs.where("seq is not null")), "index")
    view("sequences", seqs)
    view("patterns", patterns)
    view("sequence_index", index)
    view("pattern_hits", match.locate(seqs, some))
    if suffixes:
        view("pattern_suffixes", match.longest_suffix(seqs, some))
    view("pattern_counts", spark.sql(f"SELECT read_id, count(h.seq_id) AS occ FROM (SELECT DISTINCT read_id FROM {prefix}patterns) p LEFT JOIN {prefix}pattern_hits h USING (read_id) GROUP BY read_id"))
    spark.udtf.register(prefix + "locate", Locate)
    kind = index.schema["seq_id"].dataType.simpleString()
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {prefix}sequence_at(x BIGINT) RETURNS TABLE(seq_id {kind}, name STRING, off BIGINT)
        RETURN SELECT i.seq_id, i.name, x - i.start FROM {prefix}sequence_index i WHERE i.start <= x AND x < i.start + i.len""")
