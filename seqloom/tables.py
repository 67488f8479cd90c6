"""Sessions, tables in the shared folder, and global orders that no single task has to hold."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine is tuned for."""
    b = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder of a local session, deleted as the process ends. Other
    masters must have it set, as their executors share no temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="seqloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/seqloom-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, *by: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, in folders by the columns `by`, read again, and its path: lineage ends
    there, so a lost executor costs a read, not a recomputation, and row ids are fixed."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, what: str = "table") -> DataFrame:
    return stored(df, what)[0]


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores. A table that has fewer files, and by its size fewer splits, than there are cores (one
    file with one row group, say) would be worked on by a few tasks; it is dealt out once. All
    other tables are left as they are read."""
    spark = df.sparkSession
    n = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * n) if size < n * split and 0 < len(df.inputFiles()) < n else df


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """df range-partitioned and sorted, with _part and _at: the partition, and the place in it."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return written(df.withColumns({"_part": F.shiftright("_id", 33).cast("int"), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"), "ordered")


def _before(df: DataFrame, value: Column) -> DataFrame:
    """(_of_part, _before_part), names that no table has: totals of the partitions before each; one row a partition."""
    sums = df.groupBy(F.col("_part").alias("_of_part")).agg(F.sum(value).alias("_v"))
    return sums.select("_of_part", F.coalesce(F.sum("_v").over(Window.orderBy("_of_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before_part"))


def ranked(df: DataFrame, *order: Column | str, name: str = "rk") -> DataFrame:
    """df with its global 0-based row number under a total order: sorted ranges, and one count per range."""
    d = in_order(df, *order)
    return d.join(F.broadcast(_before(d, F.lit(1))), F.col("_part") == F.col("_of_part")).withColumn(name, F.col("_before_part") + F.col("_at")).drop("_part", "_at", "_of_part", "_before_part")


def running_total(df: DataFrame, value: str, *order: Column | str, name: str = "before") -> DataFrame:
    """df with the sum of `value` over all rows before, under a total order."""
    d = in_order(df, *order)
    local = F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_local", F.coalesce(local, F.lit(0)))
    return d.join(F.broadcast(_before(d, F.col(value))), F.col("_part") == F.col("_of_part")).withColumn(name, F.col("_before_part") + F.col("_local")).drop("_part", "_at", "_of_part", "_before_part", "_local")


def if_small(df: DataFrame, limit: int = 500_000, size: Column | None = None, limit_bytes: int = 1 << 26) -> DataFrame:
    """df marked for broadcast if it holds at most `limit` rows, and limit_bytes by the column size; else as it is, for a
    shuffled join. df should be a written table: its rows are counted, not estimated."""
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if size is None else size), F.lit(0))).first()
    return F.broadcast(df) if n <= limit and total <= limit_bytes else df


def blocks(df: DataFrame, key: str, limit: int, size: Column | None = None, limit_bytes: int = 1 << 26) -> list[DataFrame]:
    """df in parts of at most `limit` rows, and of limit_bytes by the column size (and one row more), so that each may be
    broadcast, in the order of `key`. Rows are counted, not estimated; rows of one key are dealt out like others."""
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if size is None else size), F.lit(0))).first()
    if n <= limit and total <= limit_bytes:
        return [df]
    # what a row takes of a part, of a million
    share = F.greatest(F.lit(-(-1_000_000 // limit)), F.lit(0) if size is None else F.ceil(size.cast("bigint") * 1_000_000 / limit_bytes)).cast("bigint")
    d = running_total(df.withColumns({"_share": share, "_m": F.monotonically_increasing_id()}), "_share", key, "_m", name="_taken")
    d = written(d.withColumn("_block", F.floor(F.col("_taken") / 1_000_000).cast("int")).drop("_share", "_m", "_taken"), "blocks")
    return [d.where(F.col("_block") == i).drop("_block") for i in range(d.agg(F.max("_block")).first()[0] + 1)]


def as_of(left: DataFrame, right: DataFrame, at: str, start: str, strict: bool = False, by: str | None = None, how: str = "inner") -> DataFrame:
    """left with the right row of the greatest `start` <= its `at` (< if strict), of those with an equal `by` if that is given.

    Both sides are put in one order, in sorted ranges, and each left row takes the last right row before it; the last one of a
    range goes on to the ranges behind, a row a range. So a row costs its sort, however dense or sparse the starts are, and
    rows of one place are dealt out like others. A null place has no match.
    """
    spark = left.sparkSession
    if by:
        right = right.withColumnRenamed(by, "_by")
    row = lambda d: F.struct(*[F.col(f"`{c}`") for c in d.columns])
    kind = lambda d, k, own, x: d.select(own, F.lit(k).alias("k"), F.col(x).alias("x"), *([F.col(by if k == "l" else "_by").alias("by")] if by else []))
    u = kind(left, "l", row(left).alias("l"), at).unionByName(kind(right.where(F.col(start).isNotNull()), "r", row(right).alias("r"), start), allowMissingColumns=True)
    order = [*(["by"] if by else []), "x", F.col("k").asc() if strict else F.col("k").desc(), "_m"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    u = u.withColumn("_m", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    kinds = StructType([StructField("l", u.schema["l"].dataType), StructField("r", u.schema["r"].dataType), StructField("part", IntegerType()), StructField("carry", BooleanType())])

    def fill(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        names = ["l", "r", "part", "carry"]
        for b in batches:
            starts = np.array(b.column("k").to_pylist(), dtype=object) == "r"
            r = b.column("r")
            before = np.maximum.accumulate(np.where(starts, np.arange(len(starts)) + 1, 0))
            mine = np.flatnonzero(~starts)
            source = pa.concat_arrays([last if last is not None else pa.nulls(1, r.type), r])
            yield pa.RecordBatch.from_arrays([b.column("l").take(pa.array(mine)), source.take(pa.array(before[mine])), pa.array(np.full(len(mine), part, np.int32)), pa.array(np.zeros(len(mine), bool))], names=names)
            if starts.any():
                last = r.take(pa.array([int(np.flatnonzero(starts)[-1])]))
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.struct(kind_of["l"])), last, pa.array([part], pa.int32()), pa.array([True])], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind_of = {"l": list(to_arrow_type(u.schema["l"].dataType))}
    d = written(u.select("l", "r", "k").mapInArrow(fill, kinds), "as-of")
    ends = spark.range(n).select(F.col("id").cast("int").alias("_p")).join(d.where("carry").select("part", "r"), F.col("_p") == F.col("part"), "left")
    ends = ends.select("_p", F.last("r", ignorenulls=True).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_r"))
    d = d.where("not carry").join(F.broadcast(ends), F.col("part") == F.col("_p"), "left").select("l", F.coalesce("r", "_r").alias("r"))
    if by:
        d = d.withColumn("r", F.when(F.col(f"l.`{by}`") == F.col("r._by"), F.col("r")))
    if how == "inner":
        d = d.where("r is not null")
    return d.select("l.*", *[F.col(f"r.`{c}`") for c in right.columns if c != "_by"])
