"""Plans as rows: what Catalyst makes of a query, with its estimates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Cost of a byte that is read, moved between tasks, or sorted.
READ, MOVE, SORT = 1.0, 2.0, 1.5


def nodes(df: DataFrame) -> DataFrame:
    """(id, depth, operator, detail) of the physical plan, from the root down."""
    text = df._jdf.queryExecution().sparkPlan().toString()
    rows = []
    for line in text.splitlines():
        body = line.lstrip(" :+-|")
        if not body:
            continue
        rows.append((len(rows), (len(line) - len(body)) // 3, re.match(r"(?:\*\(\d+\) )?(\w+)", body)[1], body))
    return df.sparkSession.createDataFrame(rows, "id int, depth int, operator string, detail string")


def logical(df: DataFrame) -> DataFrame:
    """(id, depth, operator, rows, bytes) of the optimised logical plan; rows are null where Catalyst has no count."""
    out: list[tuple] = []

    def walk(node, depth: int) -> None:  # noqa: ANN001
        stats = node.stats()
        rows = stats.rowCount()
        out.append((len(out), depth, node.nodeName(), int(str(rows.get())) if rows.isDefined() else None, float(str(stats.sizeInBytes()))))
        it = node.children().iterator()
        while it.hasNext():
            walk(it.next(), depth + 1)

    walk(df._jdf.queryExecution().optimizedPlan(), 0)
    return df.sparkSession.createDataFrame(out, "id int, depth int, operator string, rows long, bytes double")


def cost(df: DataFrame) -> float:
    """An estimate for comparing plans: bytes read at the leaves, moved by joins and groupings, sorted by sorts and windows."""
    total = 0.0
    for r in logical(df).collect():  # a row for each node of the plan
        if r.operator in ("Join", "Aggregate", "Distinct", "RepartitionByExpression", "Intersect", "Except"):
            total += MOVE * r.bytes
        elif r.operator in ("Sort", "Window"):
            total += SORT * r.bytes
        elif r.operator in ("LogicalRelation", "Relation", "LocalRelation", "Range", "DataSourceV2Relation") or "Relation" in r.operator:
            total += READ * r.bytes
    return total


def cheapest(*plans: DataFrame) -> DataFrame:
    """Of several ways to the same rows the one of the least cost; the first of equals."""
    return min(plans, key=cost)


def text(df: DataFrame, mode: str = "formatted") -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
