"""Row changes as new snapshots, constraint checks and version visibility, all as queries."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LITERAL = re.compile(r"\s*(?:'((?:[^']|'')*)'|\"([^\"]*)\"|([^,()'\"]*?))\s*([,)])")


def literal(word: str) -> object:
    if word.upper() == "NULL":
        return None
    if word.lower() in ("true", "false"):
        return word.lower() == "true"
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            pass
    return word


def parse_values(text: str) -> list[list[object]]:
    """The rows of a VALUES list; a bare word is a string."""
    rows, at = [], 0
    while (at := text.find("(", at)) >= 0:
        row, at = [], at + 1
        while m := _LITERAL.match(text, at):
            quoted = m[1].replace("''", "'") if m[1] is not None else m[2]
            row.append(quoted if quoted is not None else literal(m[3]))
            at = m.end()
            if m[4] == ")":
                break
        else:
            raise ValueError(f"malformed VALUES at {at}")
        rows.append(row)
    return rows


def insert(df: DataFrame, rows: Sequence[Mapping[str, object]] | DataFrame, *, columns: Sequence[str] | None = None) -> DataFrame:
    """df with more rows; columns left out take the default in the field's metadata, else null."""
    if not isinstance(rows, DataFrame):
        names = list(columns or df.columns)
        made = []
        for r in rows:
            values = r if isinstance(r, Mapping) else dict(zip(names, r, strict=True))
            unknown = set(values) - set(df.columns)
            if unknown:
                raise ValueError(f"unknown columns: {sorted(unknown)}")
            made.append([values.get(f.name, f.metadata.get("default")) for f in df.schema.fields])
        kinds = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        rows = df.sparkSession.createDataFrame(made, kinds)
    return df.unionByName(rows, allowMissingColumns=True)


def update(df: DataFrame, values: Mapping[str, object], where: Column | None = None) -> DataFrame:
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    cell = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.withColumns({c: F.when(hit, cell(v)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()})


def delete(df: DataFrame, where: Column | None = None) -> DataFrame:
    return df.where(F.lit(False)) if where is None else df.where(~F.coalesce(where, F.lit(False)))


def primary_key_violations(df: DataFrame, key: str) -> DataFrame:
    """(key, rows): null keys and keys of several rows."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).where(F.col(key).isNull() | (F.col("rows") > 1))


def unique_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("rows")).where("rows > 1")


def foreign_key_violations(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    keys = parent.select(F.col(key).alias("_key")).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_key"), "left_anti")


def check_violations(df: DataFrame, check: Column) -> DataFrame:
    """Rows for which the check is false; null passes."""
    return df.where(~check)


def not_null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(" or ".join(f"`{c}` is null" for c in columns))


def _newest(versions: DataFrame, key: str, sequence: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(sequence))
    return versions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def visible(versions: DataFrame, reader: int, *, key: str = "row_id", sequence: str = "version_id") -> DataFrame:
    """Newest committed version of each row by a transaction up to the reader, not deleted."""
    return _newest(versions.where(F.col("committed") & (F.col("tx_id") <= reader) & F.col("deleted_tx").isNull()), key, sequence)


def own_writes(versions: DataFrame, tx: int, *, key: str = "row_id", sequence: str = "version_id") -> DataFrame:
    return _newest(versions.where((F.col("tx_id") == tx) & F.col("deleted_tx").isNull()), key, sequence)


def read_at(versions: DataFrame, tx: int, isolation: str, *, key: str = "row_id", sequence: str = "version_id") -> DataFrame:
    """read_uncommitted: the last version, deleted or not; else the last before the transaction, not deleted."""
    if isolation.lower() != "read_uncommitted":
        versions = versions.where((F.col("tx_id") < tx) & F.col("deleted_tx").isNull())
    return _newest(versions, key, sequence)


def conflicts(a: Column, b: Column) -> Column:
    """Whether two sets of rows meet."""
    return F.arrays_overlap(a, b)


def replay(log: DataFrame, *, key: str = "key", sequence: str = "lsn") -> DataFrame:
    """State after the committed entries of a write-ahead log; deletions drop the key."""
    return _newest(log.where("status = 'Committed'"), key, sequence).where("operation <> 'delete'")
