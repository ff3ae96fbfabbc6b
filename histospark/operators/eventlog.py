"""Summaries of event logs (session, name, type, start_us, end_us)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Event types.
TYPES = {
    "COMPUTE": 0, "MEM_IO": 11, "GPU_MEM_IO": 12, "NETWORK_IO": 21, "NETWORK_WAIT": 22, "NETWORK_IO_NB": 23, "FILE_I": 31, "FILE_O": 32,
    "ADIOS_INIT": 41, "ADIOS_OPEN": 42, "ADIOS_ALLOC": 43, "ADIOS_WRITE": 44, "ADIOS_CLOSE": 45, "ADIOS_FINALIZE": 46,
    "ADIOS_BENCH_OPEN": 52, "ADIOS_BENCH_ALLOC": 53, "ADIOS_BENCH_WRITE": 54, "ADIOS_BENCH_CLOSE": 55, "OTHER": -1,
}


def event(id_: Column, name: Column, start_us: Column, end_us: Column, annotation: Column, type_name: str) -> list[Column]:
    """The columns of an event of one of TYPES: id, name, type, start_us, end_us, annotation."""
    return [id_.alias("id"), name.alias("name"), F.lit(TYPES[type_name]).alias("type"), start_us.cast("long").alias("start_us"), end_us.cast("long").alias("end_us"), annotation.alias("annotation")]


def duration() -> Column:
    """Both ends count."""
    return F.col("end_us") - F.col("start_us") + 1


def summary(log: DataFrame, by: str = "name", keys: list[str] | None = None) -> DataFrame:
    """Per session (or ``keys``) and ``by`` (name or type): count, mean and stdev of durations; population stdev, -1 of a single event."""
    d = duration()
    s = log.groupBy(*(["session"] if keys is None else keys), by).agg(F.count(F.lit(1)).alias("count"), F.sum(d).alias("_s"), F.sum(d * d).alias("_ss"))
    n = F.col("count")
    # n * sum of squares - square of the sum is an integer, so equal durations have exactly no deviation.
    spread = F.sqrt(n * F.col("_ss") - F.col("_s") * F.col("_s")) / n
    return s.select(*[c for c in s.columns if c[0] != "_"], (F.col("_s") / n).alias("mean"), F.when(n == 1, F.lit(-1.0)).otherwise(spread).alias("stdev"))


def wide_summary(log: DataFrame, by: str, values: list) -> DataFrame:
    """One row per session with ``<value> count``, ``<value> mean``, ``<value> stdev`` for each of ``values``."""
    s = summary(log, by)
    kinds = ("count", "mean", "stdev")
    wide = s.groupBy("session").pivot(by, values).agg(*[F.first(k).alias(k) for k in kinds])
    return wide.select("session", *[F.col(f"`{v}_{k}`").alias(f"{v} {k}") for v in values for k in kinds])


def session_lines(log: DataFrame, origin_us: Column | int = 0) -> DataFrame:
    """(session, line): the events of a session in order of start, as ``name,type,start,end`` relative to the log's origin, counted from 1. A session is
    one line by definition; its events meet in one row."""
    offset = lambda c: (F.col(c) - origin_us + 1).cast("string")
    event = F.struct("start_us", "end_us", "name", F.concat_ws(",", "name", F.col("type").cast("string"), offset("start_us"), offset("end_us")).alias("text"))
    return log.groupBy("session").agg(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(event)), lambda e: e["text"])).alias("line"))


def elapsed(marks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """For rows (session, ts, kind) with kinds log, start and t0: microseconds since the last ``log`` row, the last ``start`` and the last ``t0``; 0
    where there is none."""
    keys = keys or ["session"]
    before = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda kind: F.last(F.when(F.col("kind") == kind, F.col("ts")), ignorenulls=True).over(before)
    return marks.select("*", *[F.coalesce(F.col("ts") - last(kind), F.lit(0)).alias(f"since_{kind}") for kind in ("log", "start", "t0")])
