"""Durable intermediate tables.

Intermediates that are read more than once are written as Parquet below ``spark.checkpoint.dir``, which every
executor can reach, so that a lost executor costs a re-read and never a recomputation from the sources.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only in a local session where that is unset (tests), one of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="checkpoint-"))
    return _OWN[0]


def shared_path(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once and return the table read back: cuts lineage and fixes every value."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote. Only for tables of which every reader has been written in its turn."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the driver let go of what finished jobs leave: executors keep shuffle files until the driver's objects for them are collected, which in a
    long chain of jobs with a large heap may come late."""
    gc.collect()
    spark._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str | None]:
    """Tell rows with the same id apart: ``df`` with one more column and its name, or ``df`` and None if no row needs it.

    The number is 0 where no other row has the id. Rows that share an id, and rows without one, get different numbers from 1, in the order of a
    hash of their text; they are written once, so that every reader sees the same numbers. Only ids are grouped if all are different.
    """
    one = F.col(id_col)
    repeated = stored(df.groupBy(one.alias("_i")).count().where("count > 1 OR _i IS NULL").select("_i"), "repeated-ids")
    if repeated.isEmpty():
        discard(repeated)
        return df, None
    name = free_name(df, "_row")
    on = df[id_col].eqNullSafe(repeated["_i"])
    some = df.join(repeated, on, "left_semi").orderBy(one, F.xxhash64(F.col(text_col)))
    some = stored(some.withColumn(name, F.monotonically_increasing_id() + 1), "numbered-rows")
    return df.join(repeated, on, "left_anti").withColumn(name, F.lit(0).cast("long")).unionByName(some), name
