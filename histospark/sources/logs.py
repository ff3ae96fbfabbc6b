"""Sinks of event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.eventlog import session_lines

VERSION = "v2.1"


def write_log(log: DataFrame, path: str) -> None:
    """One CSV line per session, after a line with the version, first start and last end. All processes' sessions are one write; nothing is gathered
    by hand."""
    head = log.agg(F.min("start_us").alias("a"), F.max("end_us").alias("b"))
    line = F.concat_ws(",", F.lit(VERSION), F.col("a").cast("string"), F.col("b").cast("string"))
    body = session_lines(log).select(F.lit(1).alias("_o"), "session", F.concat_ws(",", "session", "line").alias("value"))
    whole = head.select(F.lit(0).alias("_o"), F.lit("").alias("session"), line.alias("value")).unionByName(body)
    whole.orderBy("_o", "session").select("value").write.mode("overwrite").text(path)


def append_csv(values: DataFrame, path: str) -> None:
    """Append rows of named values as CSV with a header."""
    values.write.mode("append").option("header", True).csv(path)
