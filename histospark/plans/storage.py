"""Tables that cut the lineage of loops, in the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only in a local session where that is unset (tests), a temporary one of this process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="tables-"))
    return _OWN[0]


def table(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once and read back."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df``, for joins by pixel, object or node. Such rows are some ten times larger in memory than in files, from whose size Spark would take those of whole
    images for small enough to be joined by way of the driver."""
    return df.hint("merge")


def discard(df: DataFrame) -> None:
    """Delete a table that ``table`` wrote, once all that is made of it is written in its turn."""
    if path := getattr(df, "stored_at", None):
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
