"""Column statistics, estimates, sharding arithmetic and membership filters."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULTS = {"eq": 0.1, "range": 0.33, "like": 0.1, "in": 0.1, "between": 0.05, "null": 0.01}


def column_stats(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(F.count_if(c.isNull()).alias("nulls"), F.count_distinct(c).alias("ndv"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"), F.avg(F.length(c.cast("string"))).alias("avg_len"))


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    """(lower, upper, rows, ndv, density) of buckets of equal width."""
    lower = F.floor(F.col(column) / width) * width
    return df.where(F.col(column).isNotNull()).groupBy(lower.cast("double").alias("lower")).agg((F.min(lower) + width).cast("double").alias("upper"), F.count("*").alias("rows"), F.count_distinct(column).alias("ndv")).withColumn("density", bucket_density(F.col("rows"), F.col("ndv")))


def bucket_density(rows: Column, ndv: Column) -> Column:
    return F.when(ndv == 0, 0.0).otherwise(rows / ndv)


def cardinality(buckets: DataFrame, value: float) -> DataFrame:
    """(estimate) of the first bucket that holds the value."""
    hit = buckets.where((F.col("lower") <= value) & (F.col("upper") >= value)).orderBy("lower").limit(1)
    return hit.select(F.floor(F.col("rows") / F.greatest("ndv", F.lit(1))).cast("long").alias("estimate"))


def selectivity(kind: str, *, ndv: int | None = None, buckets: int | None = None, values: int = 1, nulls: int | None = None, rows: int | None = None) -> float:
    if kind == "eq" and ndv:
        return 1 / ndv
    if kind == "range" and buckets:
        return 1 / buckets
    if kind == "in" and ndv:
        return values / ndv
    if kind == "null" and nulls is not None and rows:
        return nulls / rows
    return DEFAULTS[kind]


def output_rows(rows: int, parts: Sequence[float]) -> int:
    return math.ceil(rows * math.prod(parts))


def predicate_order(parts: Mapping[str, float]) -> list[str]:
    return sorted(parts, key=lambda p: (parts[p], p))


def suggest_indexes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, ndv): columns with more distinct values than a tenth of the rows."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_distinct(c).alias(c) for c in columns])
    pairs = F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in columns])))
    return counts.select("_rows", pairs.alias("column", "ndv")).where(F.col("ndv") > F.col("_rows") / 10).select("column", "ndv")


def djb2(key: Column) -> Column:
    """h = 33 h + byte from 5381, modulo 2 ** 32."""
    codes = F.split(F.decode(key.cast("binary"), "ISO-8859-1"), "")  # a character for each byte
    return F.when(F.octet_length(key) == 0, F.lit(5381).cast("long")).otherwise(F.aggregate(codes, F.lit(5381).cast("long"), lambda h, b: (h * 33 + F.ascii(b)) % 4294967296))


def _djb2(key: str) -> int:
    h = 5381
    for b in key.encode():
        h = (h * 33 + b) % 4294967296
    return h


def ring(nodes: Sequence[str], virtual: int = 16) -> list[tuple[int, str]]:
    """(hash, node) in order; of equal hashes the node placed last stays."""
    return sorted({_djb2(f"{n}:{i}"): n for n in nodes for i in range(virtual)}.items())


def node_at(h: Column, places: Sequence[tuple[int, str]]) -> Column:
    """First node at or behind the hash, else the first of all."""
    spots = F.array(*[F.struct(F.lit(x).cast("long").alias("h"), F.lit(n).alias("n")) for x, n in places])
    # bound once, as a filter would compute the hash again for every place
    found = F.transform(F.array(h), lambda y: F.get(F.filter(spots, lambda s: s["h"] >= y), F.lit(0))["n"])
    return F.coalesce(F.get(found, F.lit(0)), F.lit(places[0][1]))


def node_of(key: Column, places: Sequence[tuple[int, str]]) -> Column:
    """The node of the key's hash."""
    return node_at(djb2(key), places)


def in_range(key: Column, start: object | None, end: object | None) -> Column:
    """start <= key < end; None is open."""
    out = key.isNotNull()
    out = out if start is None else out & (key >= start)
    return out if end is None else out & (key < end)


def shard_by_length(key: Column, n: int) -> Column:
    return (F.octet_length(key) % n).cast("long")


def bloom_size(items: int, chance: float = 0.01) -> tuple[int, int]:
    """(bits, hashes)"""
    bits = max(8, int(items * abs(math.log(chance)) / math.log(2) ** 2))
    return bits, max(1, math.ceil(bits / max(items, 1) * math.log(2)))


def _bits(c: Column, bits: int, hashes: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(c, F.lit(i)), F.lit(bits)) for i in range(hashes)])


def bloom_filter(df: DataFrame, column: str, items: int | None = None, chance: float = 0.01) -> DataFrame:
    """(bit): the set bits of a Bloom filter, one row each. items: how many it is made for; counted if not said."""
    items = df.select(column).distinct().count() if items is None else items
    return df.where(F.col(column).isNotNull()).select(F.explode(_bits(F.col(column), *bloom_size(items, chance))).alias("bit")).distinct()


def bloom_members(df: DataFrame, column: str, bits_set: DataFrame, items: int, chance: float = 0.01) -> DataFrame:
    """Rows whose bits are all set: every member, and about ``chance`` of the others."""
    bits, hashes = bloom_size(items, chance)
    rows = df.select(F.col(column).alias("_v")).where("_v is not null").distinct()
    tested = rows.select("_v", F.explode(F.array_distinct(_bits(F.col("_v"), bits, hashes))).alias("bit"))
    gone = tested.join(bits_set, "bit", "left_anti").select("_v").distinct()
    return df.where(F.col(column).isNotNull()).join(gone, F.col(column) == F.col("_v"), "left_anti")
