"""What the operators share: words of a text, and the tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from seqloom.tables import drop, new_path
from seqloom.tables import stored as written

__all__ = ["SPACE", "UPPER", "ascii_lower", "drop", "ended", "new_path", "release", "split_words", "written"]

#: ASCII white space, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays. ASCII texts take the JVM's fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column, gap: str) -> Column:
    """Maximal runs of what the class `gap` does not match; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{gap}+"), lambda x: x != "")


def ended(spark: SparkSession, path: str) -> bool:
    """Whether a table under path has been written to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffle files of plans that have been written out and dropped."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
