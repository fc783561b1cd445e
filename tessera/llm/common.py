"""Small helpers that the corpus operators share: table access, row keys, cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A null doc_id sorts first, as the least 64-bit integer.
NULL_ID = -(2**63)
#: A side of a join is broadcast up to so many rows of a few integers; beyond, the join shuffles.
SMALL_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one, in local mode only; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
        folder = folder.rsplit("/", 1)[0] if folder else None
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder, in parts by columns, read again: computed once, lineage cut, safe against lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def integral(docs: DataFrame, column: str = "doc_id") -> None:
    """The operators order documents by an integer; a TypeError says so where the column is anything else."""
    kind = docs.schema[column].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{column} must be an integer, not {kind.simpleString()}")


def row_key() -> Column:
    """Tells rows apart by identifier and text; rows equal in both count as one document."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def identified(docs: DataFrame) -> DataFrame:
    """(_k, _id, text): the row key, doc_id as a long (null: least), the text (null: empty); other columns are left out."""
    integral(docs)
    return docs.select(row_key().alias("_k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """(_row, _k, _id): each whole row beside its key, whatever its columns are called."""
    integral(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("_row"), row_key().alias("_k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"))


def small(df: DataFrame) -> DataFrame:
    """A written table of few columns, to be broadcast if it is counted to have SMALL_ROWS at most."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose (_k, _id) isn't in gone, columns unchanged; whole rows are shuffled only if gone is too large to broadcast."""
    gone = small(written(gone.select("_k", "_id").distinct(), "gone"))
    return keyed(docs).join(gone, ["_k", "_id"], "left_anti").select("_row.*")


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as tell it from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
