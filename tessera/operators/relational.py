"""Joins, grouping, windows, ordering and set operations; everything is left to Catalyst."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.sources.shared import written

JOINS = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full", "CROSS": "cross", "SEMI": "left_semi", "ANTI": "left_anti"}
STRATEGIES = {"hash": "shuffle_hash", "merge": "merge", "broadcast": "broadcast", "nested_loop": "shuffle_replicate_nl"}
AGGREGATES = {
    "count": lambda c: F.count("*") if c is None else F.count(c),
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "stddev": F.stddev_samp,
    "count_distinct": F.count_distinct,
}
#: Of a band join: rows of either side that meet at once, pairs to a partition, and partitions at most.
SIDE, PIECE, MOST_PARTS = 2000, 1_000_000, 20_000
UNBOUNDED = (Window.unboundedPreceding, Window.unboundedFollowing)


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[f"{prefix}_{c}" for c in df.columns])


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "INNER", *, prefixes: tuple[str, str] | None = None, strategy: str | None = None, nulls_match: bool = True) -> DataFrame:
    """Equi-join; nulls match each other unless told otherwise. how: a key of JOINS, any case.

    prefixes name the two sides' columns apart. strategy hints at an algorithm; without one the
    sizes decide, at run time too.
    """
    if how.upper() not in JOINS:
        raise ValueError(f"unknown join type: {how}")
    how = JOINS[how.upper()]
    if prefixes:
        left, right = prefixed(left, prefixes[0]), prefixed(right, prefixes[1])
        on = [(f"{prefixes[0]}_{a}", f"{prefixes[1]}_{b}") for a, b in on]
    if strategy:
        right = right.hint(STRATEGIES[strategy])
    if how == "cross":
        return left.crossJoin(right)
    same = (left[a].eqNullSafe(right[b]) if nulls_match else left[a] == right[b] for a, b in on)
    return left.join(right, reduce(lambda x, y: x & y, same), how)


def join_using(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "INNER") -> DataFrame:
    return left.join(right, list(columns), JOINS[how.upper()])


def band_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], value: tuple[str, str], width: float) -> DataFrame:
    """Inner equi-join of the rows whose values lie within width of the left one's; nulls match nothing.

    Right rows go by keys and the bin of their value, left rows to each bin that their band
    touches. In a bin each side is dealt by hash into groups of about SIDE rows, and each pair of
    groups is joined apart, in as many partitions as the pairs ask for: no task has more than its
    share, however frequent a key or a value is (rows equal in all columns stay together).
    """
    names = [f"_k{i}" for i in range(len(on))]
    keys, lv, rv = [*names, "_bin"], F.col(value[0]), F.col(value[1])
    low, high, own = (F.floor(x / F.lit(float(width))) for x in (lv - width, lv + width, rv))
    a = left.withColumns({n: F.col(x) for n, (x, _) in zip(names, on, strict=True)} | {"_bin": F.explode(F.sequence(low, high))})
    b = right.withColumns({n: F.col(y) for n, (_, y) in zip(names, on, strict=True)} | {"_bin": own})
    cells = written(a.groupBy(*keys).agg(F.count("*").alias("_a")).join(b.groupBy(*keys).agg(F.count("*").alias("_b")), keys), "cells")
    parts = max(1, min(MOST_PARTS, math.ceil((cells.agg(F.sum(F.col("_a").cast("double") * F.col("_b") + F.col("_a") + F.col("_b"))).first()[0] or 0) / PIECE)))

    def dealt(rows: DataFrame, columns: Sequence[str], mine: str, other: str) -> DataFrame:
        groups = {n: F.ceil(F.col(n) / SIDE) for n in ("_a", "_b")}
        rows = rows.join(cells, keys).withColumn(f"_in{mine}", F.pmod(F.xxhash64(*[F.col(c) for c in columns]), groups[mine]))
        return rows.withColumn(f"_in{other}", F.explode(F.sequence(F.lit(0).cast("long"), groups[other] - 1))).drop("_a", "_b").repartition(parts, *keys, "_in_a", "_in_b")

    both = dealt(a, left.columns, "_a", "_b").join(dealt(b, right.columns, "_b", "_a"), [*keys, "_in_a", "_in_b"])
    return both.where(rv.between(lv - width, lv + width)).select(*left.columns, *right.columns)


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, value: str, out: str) -> DataFrame:
    """left with the value of the latest right row at or before each row's time, by one sort of both sides."""
    keys = [*by, time]
    a = left.withColumns({"_right": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(*keys, F.lit(0).alias("_right"), F.col(value).alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(time, "_right").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_right = 1").drop("_right", "_v")


def aggregate(df: DataFrame, keys: Sequence[str], items: Sequence[tuple[str, str, str | None]], having: Column | None = None) -> DataFrame:
    """items: (alias, function, column or None). Without keys one row, for empty input too."""
    made = []
    for alias, name, column in items:
        f = AGGREGATES.get(name.lower())
        if f is None:
            raise ValueError(f"unknown aggregate: {name}")
        made.append(f(column).alias(alias))
    out = df.groupBy(*keys).agg(*made) if keys else df.agg(*made)
    return out if having is None else out.where(having)


def window_spec(partition: Sequence[str], order: Sequence[tuple[str, bool]] = (), frame: tuple[str, int, int] | None = None) -> WindowSpec:
    """order: (column, ascending); nulls come first in either. frame: ("rows" or "range", from, to)."""
    spec = Window.partitionBy(*partition)
    spec = spec.orderBy(*sort_keys(order)) if order else spec.orderBy(F.lit(1))
    if frame:
        spec = spec.rowsBetween(*frame[1:]) if frame[0] == "rows" else spec.rangeBetween(*frame[1:])
    return spec


def window(df: DataFrame, alias: str, name: str, partition: Sequence[str] = (), order: Sequence[tuple[str, bool]] = (), *, column: str | None = None, offset: int = 1, frame: tuple[str, int, int] | None = None) -> DataFrame:
    """df with one window function's value on each row; first and last span the partition unless a frame is given."""
    ranked = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank}
    name = name.lower()
    if name == "row_number" and order and not partition:
        return numbered(df, alias, order)
    if name in ranked:
        value = ranked[name]().over(window_spec(partition, order))
    elif name == "ntile":
        value = F.ntile(offset).over(window_spec(partition, order))
    elif name in ("lag", "lead"):
        value = getattr(F, name)(column, offset).over(window_spec(partition, order))
    elif name in ("first_value", "last_value"):
        value = getattr(F, name)(column).over(window_spec(partition, order, frame or ("rows", *UNBOUNDED)))
    elif name in AGGREGATES:
        value = AGGREGATES[name](column).over(window_spec(partition, order, frame) if order or frame else Window.partitionBy(*partition))
    else:
        raise ValueError(f"unknown window function: {name}")
    return df.withColumn(alias, value)


def sort_keys(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.asc_nulls_first(c) if up else F.desc_nulls_first(c) for c, up in order]


def numbered(df: DataFrame, alias: str, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """df with each row's number in the order over all rows: ranges of it are numbered beside each other, from the counts of those before."""
    spark, keys = df.sparkSession, sort_keys(order)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, as the bounds of ranges may differ when they are computed again
    rows = written(df.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    before, n = [], 0
    for part, size in sorted(rows.groupBy("_range").count().collect()):  # a row for each range
        before.append((part, n))
        n += size
    starts = F.broadcast(spark.createDataFrame(before, "_range int, _before long"))
    out = rows.join(starts, "_range").withColumn(alias, F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*keys)))
    return out.drop("_range", "_before")


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], *aggregates: Column) -> DataFrame:
    """Groups by each of the sets of columns, null where a set lacks one."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(*aggregates)


def ordered(df: DataFrame, order: Sequence[tuple[str, bool]] = (), limit: int | None = None, offset: int | None = None) -> DataFrame:
    if order:
        df = df.orderBy(*sort_keys(order))
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def union(frames: Sequence[DataFrame], *, distinct: bool = False) -> DataFrame:
    out = reduce(lambda a, b: a.unionByName(b), frames)
    return out.distinct() if distinct else out


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def scalar(df: DataFrame) -> Column:
    """A one-column frame as a scalar subquery: null for no row; more than one fails."""
    return df.scalar()


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)
