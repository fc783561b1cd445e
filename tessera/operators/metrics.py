"""Metrics over time-stamped values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import written


def metric_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, min, max, avg, p95, p99); percentile q is the value at place floor(n q) from 0, the greatest beyond.

    Equal values are counted first, then put in ranges over all keys, so that a key with most of
    the rows is spread too; a place is a range's start, from the counts of the ranges before it,
    and the running count within it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    # written, as the bounds of ranges may differ when they are computed again
    counts = written(counts.repartitionByRange(parts, key, "_v").withColumn("_p", F.spark_partition_id()), "metric-counts")
    spread = Window.partitionBy("_k").orderBy("_p")
    ranges = counts.groupBy(F.col(key).alias("_k"), "_p").agg(F.sum("_c").alias("_m"))  # a row for each key and range
    ranges = ranges.withColumns({"_before": F.sum("_m").over(spread) - F.col("_m"), "_n": F.sum("_m").over(Window.partitionBy("_k"))}).withColumnRenamed("_p", "_q")
    placed = counts.join(ranges.drop("_m"), (F.col(key).eqNullSafe(F.col("_k"))) & (F.col("_p") == F.col("_q")))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy("_p", key).orderBy("_v"))
    placed = placed.withColumn("_upto", upto)
    at = lambda q: F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("_n") * q), F.col("_n") - 1), F.col("_v")))
    total = F.sum("_c").alias("n")
    return placed.groupBy(key).agg(total, F.min("_v").alias("min"), F.max("_v").alias("max"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("avg"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def top(df: DataFrame, by: str, n: int, key: str) -> DataFrame:
    return df.orderBy(F.desc(by), key).limit(n)


def slowest(df: DataFrame, id_: str, elapsed: str) -> DataFrame:
    return df.agg(F.max_by(id_, F.struct(F.col(elapsed), -F.col(id_))).alias(id_), F.max(elapsed).alias(elapsed))


def slow_log(df: DataFrame, elapsed: str, threshold: float, keep: int, time: str) -> DataFrame:
    """The last ``keep`` entries above the threshold."""
    return df.where(F.col(elapsed) > threshold).orderBy(F.desc(time)).limit(keep)


def health(cpu: Column, memory: Column) -> Column:
    return F.when((cpu > 90) | (memory > 8000), "unhealthy").when((cpu > 70) | (memory > 6000), "degraded").otherwise("healthy")


def retained(df: DataFrame, time: str, now: str, hours: int) -> DataFrame:
    return df.where(F.col(time) > F.lit(now).cast("timestamp_ntz") - F.make_interval(hours=F.lit(hours)))


def counters(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias("total"))


def gauges(df: DataFrame, key: str, value: str, time: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, time).alias("current"))


def tumbling(df: DataFrame, time: str, width: str, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(F.window(time, width).alias("_w"), *keys).agg(*aggregates).select(F.col("_w.start").alias("window_start"), *keys, *[c for c in df.groupBy(*keys).agg(*aggregates).columns if c not in keys])


def sessions(df: DataFrame, key: str, time: str, gap_seconds: int) -> DataFrame:
    """(key, session_start, session_end, n): runs of rows no further apart than the gap."""
    w = Window.partitionBy(key).orderBy(time)
    near = F.col(time) <= F.lag(time).over(w) + F.make_interval(secs=F.lit(gap_seconds))
    rows = df.withColumn("_new", F.when(near, 0).otherwise(1)).withColumn("_s", F.sum("_new").over(w))
    return rows.groupBy(key, "_s").agg(F.min(time).alias("session_start"), F.max(time).alias("session_end"), F.count("*").alias("n")).drop("_s")
