"""Tables, document collections, graphs and vector collections as Parquet snapshots.

What is there is a list of segments, folders of Parquet that are never changed. Adding rows adds a
segment; of rows with one key those of the last segment count, so that adding is also replacing.
Other changes, and every SEGMENTS additions, write one new segment in place of all. The lists stand
in one small file, which a change replaces at its end: readers see all of it or nothing, and a lost
executor only repeats tasks of the write. A transaction stages its lists and replaces the file
once. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import dml
from tessera.sources.shared import shared_dir, written

TYPES = {
    "integer": T.LongType(), "int": T.LongType(), "bigint": T.LongType(), "real": T.DoubleType(), "float": T.DoubleType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "bool": T.BooleanType(),
    "string": T.StringType(), "text": T.StringType(), "blob": T.BinaryType(), "binary": T.BinaryType(), "json": T.StringType(), "timestamp": T.TimestampNTZType(), "vector": T.ArrayType(T.FloatType()),
}
DOCUMENTS = "doc_id string, data string, version long"
NODES, EDGES = "id string, label string, properties string", "src string, dst string, relation string, properties string"
VECTORS = "id string, embedding array<float>, metadata string"
#: The column by which rows replace each other.
KEYS = {"collection": "doc_id", "nodes": "id", "kv": "key"}
#: More segments than these become one.
SEGMENTS = 16


class Exists(ValueError):
    """Something of the name is there already."""


class Missing(LookupError):
    """Nothing has the name."""


class Database:
    """root: a folder that all executors share; by default one below spark.checkpoint.dir."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_dir(spark)}/database-{uuid.uuid4().hex}"
        self._fs, self._path = fs.FileSystem.from_uri(self.root if ":" in self.root else f"file://{self.root}")
        self._fs.create_dir(self._path, recursive=True)
        self._staged: dict | None = None
        self._views: dict[str, DataFrame] = {}

    # pointers

    def _read(self) -> dict:
        if self._staged is not None:
            return self._staged
        at = f"{self._path}/current.json"
        if self._fs.get_file_info(at).type == fs.FileType.NotFound:
            return {}
        with self._fs.open_input_stream(at) as f:
            return json.loads(f.read())

    def _swap(self, state: dict) -> None:
        if self._staged is not None:
            self._staged = state
            return
        new = f"{self._path}/{uuid.uuid4().hex}.json"
        with self._fs.open_output_stream(new) as f:
            f.write(json.dumps(state).encode())
        self._fs.move(new, f"{self._path}/current.json")

    @contextmanager
    def transaction(self) -> Iterator[Database]:
        """All changes inside become visible together, or none if the block raises."""
        if self._staged is not None:
            raise ValueError("a transaction is open")
        self._staged = json.loads(json.dumps(self._read()))
        try:
            yield self
            staged, self._staged = self._staged, None
            self._swap(staged)
        finally:
            self._staged = None

    def _put(self, kind: str, name: str, df: DataFrame, *, add: bool = False, **extra: object) -> None:
        """df as a new segment: beside the others if add, else in place of them."""
        state = self._read()
        key = f"{kind}:{name}"
        entry = state.get(key, {})
        path = f"{self.root}/{kind}-{name}-{uuid.uuid4().hex}"
        old = entry.get("segments", []) if add else []
        if len(old) >= SEGMENTS:
            df = self._merged([*(self._segment(entry, s) for s in old), df], self._key(kind, name))
            old = []
        df.write.parquet(path)
        state[key] = {**entry, **extra, "segments": [*old, path], "schema": df.schema.json()}
        self._swap(state)

    def _key(self, kind: str, name: str) -> str | None:
        return KEYS.get(kind) or self._read().get(f"{kind}:{name}", {}).get("key")

    def _segment(self, entry: Mapping[str, object], path: str) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(entry["schema"]))).parquet(path)

    @staticmethod
    def _merged(frames: Sequence[DataFrame], key: str | None) -> DataFrame:
        """All rows; of those with one key the last frame's."""
        if len(frames) == 1:
            return frames[0]
        if key is None:
            return reduce(DataFrame.unionByName, frames)
        rows = reduce(DataFrame.unionByName, [f.select(F.col(f"`{key}`").alias("_key"), F.struct(*[f"`{c}`" for c in f.columns]).alias("_row"), F.lit(i).alias("_n")) for i, f in enumerate(frames)])
        return rows.groupBy("_key").agg(F.max_by("_row", "_n").alias("_row")).select("_row.*")

    def _get(self, kind: str, name: str) -> DataFrame:
        entry = self._read().get(f"{kind}:{name}")
        if entry is None:
            raise Missing(name)
        return self._merged([self._segment(entry, s) for s in entry["segments"]], self._key(kind, name))

    def _create(self, kind: str, name: str, schema: T.StructType | str, **extra: object) -> None:
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"not a name: {name}")
        if f"{kind}:{name}" in self._read() or (kind == "table" and name in self._views):
            raise Exists(name)
        self._put(kind, name, self.spark.createDataFrame([], schema), **extra)

    def names(self, kind: str = "table") -> list[str]:
        return sorted({*(k.split(":", 1)[1] for k in self._read() if k.startswith(kind + ":")), *(self._views if kind == "table" else ())})

    # tables

    def create_table(self, name: str, columns: Sequence[Mapping[str, object]], *, checks: Mapping[str, str] | None = None, references: Sequence[tuple[str, str, str]] = ()) -> None:
        """columns: name, type, and nullable, default, unique, primary_key where they matter; the first is the key if none says so.

        checks: SQL conditions by name; references: (column, table, its column).
        """
        if not columns:
            raise ValueError("a table needs a column")
        keys = [c["name"] for c in columns if c.get("primary_key")] or [columns[0]["name"]]
        if len(keys) > 1:
            raise ValueError(f"several primary keys: {keys}")
        fields = [T.StructField(str(c["name"]), TYPES.get(str(c.get("type", "string")).lower(), T.StringType()), True, {k: c[k] for k in ("default", "dim") if k in c}) for c in columns]
        required = [keys[0], *(c["name"] for c in columns if c.get("nullable") is False and c["name"] != keys[0])]
        self._create("table", name, T.StructType(fields), key=keys[0], required=required, unique=[c["name"] for c in columns if c.get("unique")], checks=dict(checks or {}), references=[list(r) for r in references])

    def register(self, name: str, df: DataFrame) -> None:
        """df as a table, without copying it; the first change of its rows copies it. Its first column is the key."""
        if name in self.names("table"):
            raise Exists(name)
        self._views[name] = df

    def _own(self, name: str) -> None:
        """A registered table that is to be changed becomes one of ours."""
        if name in self._views:
            df = self._views.pop(name)
            self._put("table", name, df, key=df.columns[0], required=[], unique=[], checks={}, references=[])

    def table(self, name: str) -> DataFrame:
        return self._views[name] if name in self._views else self._get("table", name)

    def describe(self, name: str) -> list[dict[str, object]]:
        df = self.table(name)
        entry = self._read().get(f"table:{name}", {"key": df.columns[0]})
        return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.name not in entry.get("required", []), "primary_key": f.name == entry.get("key")} for f in df.schema.fields]

    def lookup(self, name: str, key: object) -> DataFrame:
        df = self.table(name)
        return df.where(F.col(self._read().get(f"table:{name}", {}).get("key", df.columns[0])) == key)

    def _check(self, name: str, changed: DataFrame, whole: DataFrame) -> None:
        """changed: the rows that are new; whole: the table as it is to be."""
        entry = self._read()[f"table:{name}"]
        required = entry.get("required", [])
        if required and not dml.not_null_violations(changed, required).isEmpty():
            raise ValueError(f"null in one of {required}")
        for label, condition in entry.get("checks", {}).items():
            if not dml.check_violations(changed, F.expr(condition)).isEmpty():
                raise ValueError(f"check {label} fails")
        for column, table, key in entry.get("references", []):
            if not dml.foreign_key_violations(changed, column, self.table(table), key).isEmpty():
                raise ValueError(f"{column} refers to no row of {table}")
        for column in entry.get("unique", []):
            if not dml.unique_violations(whole, [column]).isEmpty():
                raise ValueError(f"{column} isn't unique")

    def insert(self, name: str, rows: Sequence[Mapping[str, object]] | DataFrame) -> int:
        """Adds rows; those whose key is there already replace it. A key twice among the rows is an error."""
        self._own(name)
        old = self._get("table", name)
        new = dml.insert(old.limit(0), rows)
        new = written(new, f"insert-{name}") if isinstance(rows, DataFrame) else new
        key = self._key("table", name)
        if not new.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"{key} isn't unique among the rows")
        self._check(name, new, self._merged([old, new], key))
        self._put("table", name, new, add=True)
        return new.count()

    def update(self, name: str, values: Mapping[str, object], where: Column | None = None) -> int:
        """Changes rows and says how many; only they are written, unless their key changes."""
        self._own(name)
        old, key = self._get("table", name), self._key("table", name)
        hit = old if where is None else old.where(where)
        changed, whole = dml.update(hit, values), dml.update(old, values, where)
        if key in values and not whole.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"{key} isn't unique")
        n = hit.count()
        self._check(name, changed, whole)
        if key in values:
            self._put("table", name, whole)
        elif n:
            self._put("table", name, changed, add=True)
        return n

    def delete(self, name: str, where: Column | None = None) -> int:
        self._own(name)
        old = self._get("table", name)
        n = old.count() if where is None else old.where(where).count()
        self._put("table", name, dml.delete(old, where))
        return n

    def drop_table(self, name: str) -> None:
        if self._views.pop(name, None) is not None:
            return
        state = self._read()
        if state.pop(f"table:{name}", None) is None:
            raise Missing(name)
        self._swap(state)

    def sql(self, text: str) -> DataFrame:
        for name in self.names("table"):
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    # documents

    def create_collection(self, name: str) -> None:
        self._create("collection", name, DOCUMENTS)

    def put_documents(self, name: str, documents: Mapping[str, object]) -> None:
        """Insert or replace whole documents; a replaced one's version rises by one, what it was stays to be read by version."""
        old = self._get("collection", name)
        rows = self.spark.createDataFrame([(k, json.dumps(v)) for k, v in documents.items()], "doc_id string, data string")
        last = rows.join(old.select("doc_id", "version"), "doc_id", "left").select("doc_id", "data", (F.coalesce("version", F.lit(0)) + 1).alias("version"))
        new = written(last, "documents")
        self._put("collection", name, new, add=True)
        self._put("history", name, new.withColumn("at", F.current_timestamp()), add=True)

    def documents(self, name: str) -> DataFrame:
        """doc_id, data (a variant), version"""
        return self._get("collection", name).withColumn("data", F.parse_json("data"))

    def document(self, name: str, key: str, version: int | None = None) -> DataFrame:
        """One document as it is, or (doc_id, data, version, at) as it was in a version."""
        if version is None:
            return self.documents(name).where(F.col("doc_id") == key)
        self._get("collection", name)
        return self._get("history", name).where((F.col("doc_id") == key) & (F.col("version") == version)).withColumn("data", F.parse_json("data"))

    def delete_document(self, name: str, key: str) -> None:
        self._put("collection", name, self._get("collection", name).where(F.col("doc_id") != key))

    # graphs

    def create_graph(self, name: str) -> None:
        self._create("nodes", name, NODES)
        self._create("edges", name, EDGES)

    def add_nodes(self, graph: str, rows: Sequence[tuple[str, str, object]]) -> None:
        """A node that is there already is replaced."""
        last = {i: (i, label, json.dumps(p)) for i, label, p in rows}
        self._put("nodes", graph, self.spark.createDataFrame(list(last.values()), NODES), add=True)

    def node(self, graph: str, key: str) -> DataFrame:
        return self.nodes(graph).where(F.col("id") == key)

    def graphs(self) -> list[str]:
        return self.names("nodes")

    def add_edges(self, graph: str, rows: Sequence[tuple[str, str, str, object]]) -> None:
        self._put("edges", graph, self.spark.createDataFrame([(a, b, r, json.dumps(p)) for a, b, r, p in rows], EDGES), add=True)

    def nodes(self, graph: str) -> DataFrame:
        return self._get("nodes", graph)

    def edges(self, graph: str) -> DataFrame:
        return self._get("edges", graph)

    # vectors

    def create_vectors(self, name: str, dimension: int | None = None) -> None:
        self._create("vectors", name, VECTORS, dimension=dimension)

    def add_vectors(self, name: str, rows: Sequence[tuple[str, Sequence[float], object]]) -> None:
        dimension = self._read()[f"vectors:{name}"].get("dimension")
        if dimension and any(len(v) != dimension for _, v, _ in rows):
            raise ValueError(f"vectors of {name} have {dimension} elements")
        made = [(i, [float(x) for x in v], json.dumps(m)) for i, v, m in rows]
        self._put("vectors", name, self.spark.createDataFrame(made, VECTORS), add=True)

    def vectors(self, name: str) -> DataFrame:
        return self._get("vectors", name)

    # key-value tables

    def put(self, name: str, values: Mapping[str, object]) -> None:
        if f"kv:{name}" not in self._read():
            self._create("kv", name, "key string, value string")
        self._put("kv", name, self.spark.createDataFrame([(k, json.dumps(v)) for k, v in values.items()], "key string, value string"), add=True)

    def get(self, name: str, key: str) -> object | None:
        row = self._get("kv", name).where(F.col("key") == key).first()
        return None if row is None else json.loads(row["value"])

    def count(self, name: str) -> int:
        return self._get("kv", name).count()

    def scan(self, name: str, prefix: str = "") -> DataFrame:
        return self._get("kv", name).where(F.col("key").startswith(prefix))

    def remove(self, name: str, key: str) -> None:
        self._put("kv", name, self._get("kv", name).where(F.col("key") != key))

    def summary(self) -> DataFrame:
        kinds = {"tables": "table", "collections": "collection", "graphs": "nodes", "vector_collections": "vectors"}
        return self.spark.createDataFrame([{k: len(self.names(v)) for k, v in kinds.items()}])


class ResultCache:
    """Cached results by key: the least recently used goes first beyond capacity, and any after ttl seconds."""

    def __init__(self, capacity: int = 1000, ttl: float | None = None, clock: Callable[[], float] = time.monotonic):
        self.capacity, self.ttl, self._clock, self.hits, self.misses, self._kept, self._since = capacity, ttl, clock, 0, 0, {}, {}

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        if key in self._kept and self.ttl is not None and self._clock() - self._since[key] > self.ttl:
            self.drop(key)
        if key in self._kept:
            self.hits += 1
            self._kept[key] = self._kept.pop(key)
            return self._kept[key]
        self.misses += 1
        self._kept[key], self._since[key] = make().cache(), self._clock()
        while len(self._kept) > self.capacity:
            self.drop(next(iter(self._kept)))
        return self._kept[key]

    def drop(self, key: str) -> None:
        self._kept.pop(key).unpersist()

    def __len__(self) -> int:
        return len(self._kept)

    @property
    def hit_ratio(self) -> float:
        n = self.hits + self.misses
        return self.hits / n if n else 0.0
