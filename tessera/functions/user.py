"""Functions of the user's own, by name: scalar, aggregate and table functions, on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def scalar(spark: SparkSession, name: str, f: Callable[[pd.Series], pd.Series], returns: str) -> Callable[..., Column]:
    """f: of whole columns. Known to SQL by the name too."""

    def run(*columns: pd.Series) -> pd.Series:
        return f(*columns)

    run.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    made = F.pandas_udf(run, returns)
    spark.udf.register(name, made)
    return made


def aggregate(spark: SparkSession, name: str, f: Callable[[pd.Series], object], returns: str) -> Callable[..., Column]:
    """f: of a group's column. A group is held by one task; built-in aggregates have no such bound."""

    def run(column: pd.Series) -> object:
        return f(column)

    kinds = {"double": float, "float": float, "long": int, "bigint": int, "int": int, "string": str, "boolean": bool}
    run.__annotations__ = {"column": pd.Series, "return": kinds[returns]}
    made = F.pandas_udf(run, returns)
    spark.udf.register(name, made)
    return made


def table(spark: SparkSession, name: str, handler: type, returns: str) -> object:
    """handler: a class whose eval() yields rows."""
    made = F.udtf(handler, returnType=returns)
    spark.udtf.register(name, made)
    return made
