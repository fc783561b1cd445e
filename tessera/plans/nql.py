"""The JSON command language: commands compile to DataFrames, or to changes of a Database."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import fulltext
from tessera.operators import graph, relational, vector
from tessera.plans import explain
from tessera.sources.database import Database, Exists, Missing

COMPARE = {
    "eq": lambda c, v: c.isNull() if v is None else c == v,
    "ne": lambda c, v: c.isNotNull() if v is None else c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "like": lambda c, v: c.like(v),
    "between": lambda c, v: c.between(*v),
}
ISOLATION = ("read_uncommitted", "read_committed", "repeatable_read", "serializable")
RANKING = ("row_number", "rank", "dense_rank", "lag", "lead", "first_value", "last_value", "ntile", "percent_rank")


class CommandError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def field(df: DataFrame, path: str, kind: str = "string") -> Column:
    """A column, or what a dotted path reaches inside a struct, a variant or JSON text, as a kind; null where it is of another."""
    if path in df.columns:
        return F.col(f"`{path}`")
    head, _, rest = path.partition(".")
    names = {f.name: f.dataType for f in df.schema.fields}
    if head in names and rest:
        if isinstance(names[head], T.StructType):
            return F.col(path)
        if isinstance(names[head], T.VariantType):
            return F.try_variant_get(F.col(head), f"$.{rest}", kind)
        return _json(F.col(head), rest, kind)
    if isinstance(names.get("data"), T.VariantType):
        return F.try_variant_get(F.col("data"), f"$.{path}", kind)
    raise CommandError("COLUMN_NOT_FOUND", path)


def _json(c: Column, path: str, kind: str) -> Column:
    text = F.get_json_object(c, f"$.{path}")
    return text if kind == "string" else F.from_json(text, kind) if kind.startswith("array") else text.try_cast(kind)


def _inside(df: DataFrame, path: str) -> bool:
    """Whether a path goes into a variant or JSON text, where types are each document's own."""
    if path in df.columns:
        return False
    names = {f.name: f.dataType for f in df.schema.fields}
    return not isinstance(names.get(path.partition(".")[0]), T.StructType)


def _kind(value: object) -> str:
    return "boolean" if isinstance(value, bool) else "double" if isinstance(value, (int, float)) else "string"


def where(df: DataFrame, tree: Mapping[str, object] | None) -> Column:
    if not tree:
        return F.lit(True)
    for word, fold in (("and", lambda a, b: a & b), ("or", lambda a, b: a | b)):
        if word in tree:
            return reduce(fold, [where(df, t) for t in tree[word]], F.lit(word == "and"))
    if "not" in tree:
        return ~where(df, tree["not"])
    if "field" not in tree:
        raise CommandError("INVALID_QUERY", f"no field in {dict(tree)}")
    path = str(tree["field"])
    c, inside = field(df, path), _inside(df, path)
    parts = []
    for op, value in tree.items():
        if op == "field":
            continue
        if op == "exists":
            parts.append(c.isNotNull() if value else c.isNull())
        elif op == "in":
            values = list(value)
            if isinstance(df.select(c).schema[0].dataType, T.ArrayType):
                parts.append(F.arrays_overlap(c, F.array(*map(F.lit, values))))
            elif inside:  # one of the values, or an array that holds one
                of = _kind(values[0]) if values else "string"
                held = field(df, path, f"array<{of}>")
                alone = field(df, path, of).isin([float(v) if of == "double" else v for v in values])
                parts.append(F.coalesce(alone, F.lit(False)) | F.coalesce(F.arrays_overlap(held, F.array(*[F.lit(float(v) if of == "double" else v) for v in values])), F.lit(False)))
            else:
                parts.append(c.isin(values))
        elif op in COMPARE:
            of = _kind(value[0] if op == "between" else value) if inside and value is not None and op != "like" else "string"
            parts.append(COMPARE[op](field(df, path, of) if of != "string" else c, value))
        else:
            raise CommandError("INVALID_QUERY", f"unknown operator {op}")
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _order(items: Sequence[Mapping[str, object]]) -> list[tuple[str, bool]]:
    return [(str(x["field"]), not x.get("desc", False)) for x in items or ()]


def select(df: DataFrame, command: Mapping[str, object]) -> DataFrame:
    df = df.where(where(df, command.get("where")))
    items = command.get("aggregate") or []
    windows = [x for x in items if x["func"] in RANKING]
    plain = [x for x in items if x["func"] not in RANKING]
    order = _order(command.get("order_by"))
    if plain:
        keys = list(command.get("group_by") or [])
        df = relational.aggregate(df, keys, [(x["as"], x["func"], x.get("field")) for x in plain])
        if command.get("having"):
            df = df.where(where(df, command["having"]))
    for x in windows:
        df = relational.window(df, x["as"], x["func"], list(x.get("partition_by") or ([] if plain else command.get("group_by") or [])), _order(x.get("order_by")) or order, column=x.get("field"), offset=x.get("offset", 1))
    columns = command.get("columns")
    made = [x["as"] for x in windows]
    df = relational.ordered(df, [] if command.get("limit") is None and command.get("offset") is None and not order else order)
    if columns and columns != ["*"]:
        df = df.select(*[field(df, c).alias(c) for c in columns], *[m for m in made if m not in columns])
    if command.get("distinct"):
        df = df.distinct()
    return relational.ordered(df, (), command.get("limit"), command.get("offset"))


def _search(db: Database, c: Mapping[str, object]) -> DataFrame:
    df = db.table(c["from"]) if "from" in c else db.documents(c["collection"])
    df = df.where(where(df, c.get("query")))
    if match := c.get("fulltext"):
        for term in str(match["match"]).lower().split():
            df = df.where(fulltext.term_count(field(df, match["field"]), term) > 0)
    return df if c.get("limit") is None else df.limit(c["limit"])


def execute(db: Database, command: Mapping[str, object]) -> DataFrame | int | None:
    """A DataFrame for queries, the number of rows for changes of rows, else None. Errors are CommandErrors."""
    try:
        return _execute(db, command)
    except CommandError:
        raise
    except Missing as e:
        raise CommandError("TABLE_NOT_FOUND", str(e)) from e
    except Exists as e:
        raise CommandError("ALREADY_EXISTS", str(e)) from e
    except AnalysisException as e:
        raise CommandError("COLUMN_NOT_FOUND" if "UNRESOLVED_COLUMN" in str(e) else "INVALID_QUERY", str(e).splitlines()[0]) from e
    except (KeyError, TypeError, ValueError) as e:
        raise CommandError("INVALID_QUERY", repr(e)) from e


def _execute(db: Database, c: Mapping[str, object]) -> DataFrame | int | None:
    op = c.get("op")
    if op == "select":
        return select(db.table(c["from"]), c)
    if op == "insert":
        if "collection" in c:
            document = dict(c["document"])
            if c["collection"] not in db.names("collection"):
                db.create_collection(c["collection"])
            db.put_documents(c["collection"], {str(document.get("id") or document.get("_id") or time.time_ns()): document})
            return 1
        return db.insert(c["into"], c["values"])
    if op == "update":
        return db.update(c["table"], c["set"], where(db.table(c["table"]), c["where"]) if c.get("where") else None)
    if op == "delete":
        return db.delete(c["from"], where(db.table(c["from"]), c["where"]) if c.get("where") else None)
    if op == "create_table":
        return db.create_table(c["name"], c["columns"])
    if op == "transaction":
        level = str(c.get("isolation", "serializable")).lower().replace(" ", "_")
        if level not in ISOLATION:
            raise CommandError("INVALID_QUERY", f"unknown isolation {level}")
        with db.transaction():  # one writer at a time: every level reads what was there at its start
            return sum(x for x in [_execute(db, x) for x in c["commands"]] if isinstance(x, int))
    if op == "search":
        return _search(db, c)
    if op == "explain":
        return explain.nodes(select(db.table(c["query"]["from"]), c["query"]))
    if op == "graph_add_node":
        n = c["node"]
        return db.add_nodes(c["graph"], [(n["id"], n.get("label", ""), n.get("properties", {}))])
    if op == "graph_add_edge":
        e = c["edge"]
        return db.add_edges(c["graph"], [(e["from"], e["to"], e.get("label", ""), e.get("properties", {}))])
    if op == "graph_traverse":
        return graph.shortest_path(db.edges(c["graph"]), c["start"], c["end"], c.get("max_depth", 3))
    if op == "vector_insert":
        v = c["vector"]
        return db.add_vectors(c["collection"], [(str(v.get("id") or v.get("text") or time.time_ns()), v["embedding"], v.get("metadata"))])
    if op == "vector_search":
        return vector.knn(db.vectors(c["collection"]), c.get("vector") or c["embedding"], c.get("limit") or c.get("k") or vector.DEFAULT_K, key="id", threshold=c.get("threshold"))
    raise CommandError("INVALID_QUERY", f"unknown op {op}")


def envelope(db: Database, command: Mapping[str, object]) -> dict[str, object]:
    """A command's answer as a plain dictionary; rows are collected."""
    began = time.perf_counter()
    try:
        out = execute(db, command)
        rows = [r.asDict(recursive=True) for r in out.collect()] if isinstance(out, DataFrame) else None
    except CommandError as e:
        return {"success": False, "error": {"code": e.code, "message": str(e)}}
    except PySparkException as e:  # what only the rows can show
        return {"success": False, "error": {"code": "EXECUTION_ERROR", "message": str(e).splitlines()[0]}}
    result = {"rows": rows, "row_count": len(rows)} if rows is not None else {"affected": out or 0}
    return {"success": True, "result": {**result, "execution_time_ms": (time.perf_counter() - began) * 1000}}


class SelectBuilder:
    def __init__(self, table: str):
        self._command: dict[str, object] = {"op": "select", "from": table}

    def columns(self, *names: str) -> SelectBuilder:
        self._command["columns"] = list(names)
        return self

    def where(self, name: str, op: str, value: object) -> SelectBuilder:
        return self.and_({"field": name, op: value})

    def and_(self, *trees: Mapping[str, object]) -> SelectBuilder:
        old = self._command.get("where")
        self._command["where"] = {"and": [*([old] if old else []), *trees]}
        return self

    def or_(self, *trees: Mapping[str, object]) -> SelectBuilder:
        old = self._command.get("where")
        self._command["where"] = {"or": [*([old] if old else []), *trees]}
        return self

    def order_by(self, name: str, *, desc: bool = False) -> SelectBuilder:
        self._command.setdefault("order_by", []).append({"field": name, "desc": desc})
        return self

    def limit(self, n: int) -> SelectBuilder:
        self._command["limit"] = n
        return self

    def offset(self, n: int) -> SelectBuilder:
        self._command["offset"] = n
        return self

    def build(self) -> dict[str, object]:
        return dict(self._command)
