"""The registered queries of this package, and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import chat, decontam, exact, packing, phrases, pii, quality, resampling, simhash, suffix, tokens, urls, warc
from seqloom.tables import spread


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


QUERIES = {
    "op1_url_filters": lambda s, d: urls.url_report(_read(s, d, "pages")),
    "op2_chat_formatting": lambda s, d: chat.chat_report(_read(s, d, "conversations")),
    "op3_decontamination": lambda s, d: decontam.decontamination_report(_read(s, d, "documents"), _read(s, d, "benchmark")),
    "op4_best_fit_packing": lambda s, d: packing.pack(_read(s, d, "documents")),
    "op5_token_counts": lambda s, d: tokens.count_tokens(_read(s, d, "documents")),
    "op6_warc": lambda s, d: warc.warc_report(_read(s, d, "pages")),
    "op7_pii": lambda s, d: pii.pii_report(_read(s, d, "documents")),
    "op8_suffix_dedup": lambda s, d: suffix.suffix_report(_read(s, d, "documents")),
    "op9_simhash": lambda s, d: simhash.near_duplicates(_read(s, d, "documents")),
    "op10_quality_rules": lambda s, d: quality.quality_report(_read(s, d, "documents")),
    "op11_exact_dedup": lambda s, d: exact.exact_report(_read(s, d, "documents")),
    "op12_resampling": lambda s, d: resampling.resampling_report(_read(s, d, "documents"), _read(s, d, "benchmark")),
    "op13_phrases": lambda s, d: phrases.collocation_report(_read(s, d, "documents")),
}

ORACLES = {
    "op1_url_filters": urls.ORACLE,
    "op2_chat_formatting": chat.ORACLE,
    "op3_decontamination": decontam.ORACLE,
    "op6_warc": warc.ORACLE,
    "op10_quality_rules": quality.ORACLE,
    "op11_exact_dedup": exact.ORACLE,
    "op12_resampling": resampling.ORACLE,
    "op13_phrases": phrases.ORACLE,
}
