"""Windowed aggregation over streams; times without a zone are read as UTC for watermarks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed(stream: DataFrame, time: str, late: str, width: str, keys: Sequence[str], *aggregates: Column, slide: str | None = None) -> DataFrame:
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return timed(stream, time, late).groupBy(w.alias("window"), *keys).agg(*aggregates)


def sessions(stream: DataFrame, time: str, late: str, gap: str, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    return timed(stream, time, late).groupBy(F.session_window(time, gap).alias("session"), *keys).agg(*aggregates)


def deduplicated(stream: DataFrame, time: str, late: str, keys: Sequence[str]) -> DataFrame:
    return timed(stream, time, late).dropDuplicatesWithinWatermark(list(keys))
