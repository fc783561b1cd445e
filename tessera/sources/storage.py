"""Stores of values by key behind one set of methods: in memory, or Parquet segments that only grow until they are compacted."""

from __future__ import annotations

import json
import uuid
from abc import ABC, abstractmethod
from collections.abc import Mapping

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW = "key string, value string"


class Storage(ABC):
    @abstractmethod
    def put(self, values: Mapping[str, str]) -> None: ...

    @abstractmethod
    def get(self, key: str) -> str | None: ...

    @abstractmethod
    def delete(self, key: str) -> None: ...

    @abstractmethod
    def scan(self, prefix: str = "") -> DataFrame:
        """(key, value) of keys with the prefix."""

    def flush(self) -> None:
        """Makes what was put durable."""

    def compact(self) -> None:
        """Drops what was replaced or deleted."""

    def count(self) -> int:
        return self.scan().count()


class MemoryStorage(Storage):
    def __init__(self, spark: SparkSession):
        self.spark, self._kept = spark, {}

    def put(self, values: Mapping[str, str]) -> None:
        self._kept.update(values)

    def get(self, key: str) -> str | None:
        return self._kept.get(key)

    def delete(self, key: str) -> None:
        self._kept.pop(key, None)

    def scan(self, prefix: str = "") -> DataFrame:
        return self.spark.createDataFrame([x for x in self._kept.items() if x[0].startswith(prefix)], _ROW)


class ParquetStorage(Storage):
    """Segments in a shared folder; of a key's rows the last counts, a null value means deleted. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._fs, self._path = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        self._fs.create_dir(self._path, recursive=True)
        self._waiting: dict[str, str | None] = {}

    def _segments(self) -> list[str]:
        at = f"{self._path}/segments.json"
        if self._fs.get_file_info(at).type == fs.FileType.NotFound:
            return []
        with self._fs.open_input_stream(at) as f:
            return json.loads(f.read())

    def _swap(self, segments: list[str]) -> None:
        new = f"{self._path}/{uuid.uuid4().hex}.json"
        with self._fs.open_output_stream(new) as f:
            f.write(json.dumps(segments).encode())
        self._fs.move(new, f"{self._path}/segments.json")

    def _write(self, df: DataFrame) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        return name

    def put(self, values: Mapping[str, str]) -> None:
        self._waiting.update(values)

    def delete(self, key: str) -> None:
        self._waiting[key] = None

    def flush(self) -> None:
        if self._waiting:
            name = self._write(self.spark.createDataFrame(list(self._waiting.items()), _ROW))
            self._swap([*self._segments(), name])
            self._waiting = {}

    def _rows(self) -> DataFrame:
        frames = [self.spark.read.schema(_ROW).parquet(f"{self.folder}/{s}").withColumn("_n", F.lit(i)) for i, s in enumerate(self._segments())]
        frames.append(self.spark.createDataFrame(list(self._waiting.items()), _ROW).withColumn("_n", F.lit(len(frames))))
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def scan(self, prefix: str = "") -> DataFrame:
        rows = self._rows().where(F.col("key").startswith(prefix))
        return rows.groupBy("key").agg(F.max_by("value", "_n").alias("value")).where("value is not null")

    def get(self, key: str) -> str | None:
        row = self._rows().where(F.col("key") == key).orderBy(F.desc("_n")).first()
        return row["value"] if row else None

    def compact(self) -> None:
        self.flush()
        self._swap([self._write(self.scan())])
