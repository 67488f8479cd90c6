"""Patterns as a stream against a static text collection: a stateless stream-static join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators.match import count, locate


def search_stream(patterns: DataFrame, seqs: DataFrame, sink, checkpoint: str, counts: bool = False) -> StreamingQuery:
    """Each micro-batch of patterns (read_id, pattern) is searched in seqs; sink(df, batch_id) takes
    the hits. A batch that is run again gives the same rows, so an idempotent sink gets each once."""

    def one(batch: DataFrame, batch_id: int) -> None:
        sink((count if counts else locate)(seqs, batch), batch_id)

    return patterns.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def seed_stream(patterns: DataFrame, kmer_index: DataFrame, k: int) -> DataFrame:
    """A streaming DataFrame: first k characters of each pattern against a prepared index (kmer, seq_id, pos)."""
    return patterns.withColumn("kmer", F.substring("pattern", 1, k)).join(kmer_index, "kmer")
