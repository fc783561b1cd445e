"""Readers and writers; formats are Spark's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def views(spark: SparkSession, folder: str) -> None:
    for name in TABLES:
        load(spark, folder, name).createOrReplaceTempView(name)


def read(spark: SparkSession, path: str, kind: str = "parquet", **options: object) -> DataFrame:
    return spark.read.format(kind).options(**options).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", *, mode: str = "errorifexists", partition: tuple[str, ...] = (), **options: object) -> None:
    out = df.write.format(kind).mode(mode).options(**options)
    (out.partitionBy(*partition) if partition else out).save(path)
