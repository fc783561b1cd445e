"""Token identifiers as flat unsigned integer files with 64-bit document offsets.

Every task streams its documents' tokens into one file of the shared folder; a partition's base
is the sum of the tokens in the partitions before it, and a document's offset is base plus its
place in its partition. Offsets lie in a second file for each partition (little-endian, one more
than documents), so that both can be memory-mapped. A file's name is its call's and its attempt's
own, and only files that the committed rows name are listed in index.json; of the call's own files
the others are deleted, so that lost or repeated attempts leave nothing behind. The folder must
not hold anything before (else FileExistsError), and no file of another is ever touched.

Null texts count as empty: no tokens, an offset all the same. Very long texts are encoded whole.
Null identifiers, repeated rows and ties are rows like any other, in the order in which they were
read; doc_id may be of any type. Other columns, clashing names (part, start, n_tokens) included,
are ignored. An empty table gives an index without files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import VOCABULARY, opened, ship
from tessera.llm.common import shared_dir, written
from tessera.llm.text import buffers, slices

CHUNK = 3_000_000


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(docs: DataFrame, folder: str | None = None, *, vocabulary: str = VOCABULARY) -> tuple[DataFrame, str]:
    """(doc_id, part, start, n_tokens) of each document, and the folder of files; start counts from the first partition's first token."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    to, path = _open(folder)
    to.create_dir(path, recursive=True)
    if to.get_file_info(fs.FileSelector(path)):
        raise FileExistsError(f"{folder} holds files already")
    call, shipped = uuid.uuid4().hex, ship(docs.sparkSession, vocabulary)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = opened(shipped), TaskContext.get().partitionId()
        name, out, at, row = f"tokens-{call}-{part:06d}-{uuid.uuid4().hex}.bin", None, 0, 0
        try:
            for batch in batches:
                data, offsets = buffers(batch["text"])
                for lo, hi in slices(offsets, CHUNK):
                    ids, ends = enc.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    if out is None:
                        out_fs, out_path = _open(folder)
                        out = out_fs.open_output_stream(f"{out_path}/{name}")
                    out.write(pa.py_buffer(np.ascontiguousarray(ids)))
                    n = hi - lo
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, n), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), pa.array(at + ends[:-1]), pa.array(np.diff(ends)), pa.array([name] * n)], ["doc_id", "part", "row", "local", "n_tokens", "file"])
                    at, row = at + int(ends[-1]), row + n
        finally:
            if out is not None:
                out.close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = written(docs.select("doc_id", "text").mapInArrow(tokens, f"doc_id {kind}, part int, row long, local long, n_tokens long, file string"), "token-rows")
    parts = rows.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))  # a row for each partition
    bases = parts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.join(bases.select("part", "base"), "part").select("doc_id", "part", "row", (F.col("base") + F.col("local")).alias("start"), "n_tokens")

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_fs, out_path = _open(folder)
        part, name, out, end = None, None, None, 0

        def close() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.write(np.array([end], "<u8").tobytes())
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name])], ["part", "offsets"])

        for batch in batches:
            p, start, n = (batch[c].to_numpy() for c in ("part", "start", "n_tokens"))
            cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if p[lo] != part:
                    yield from close()
                    part = int(p[lo])
                    name = f"offsets-{call}-{part:06d}-{uuid.uuid4().hex}.u64"
                    out = out_fs.open_output_stream(f"{out_path}/{name}")
                out.write(start[lo:hi].astype("<u8").tobytes())
                end = int(start[hi - 1] + n[hi - 1])
        yield from close()

    shards = placed.repartition("part").sortWithinPartitions("part", "row").mapInArrow(offsets, "part int, offsets string")
    listed = sorted((r.asDict() for r in bases.join(written(shards, "token-offsets"), "part").collect()), key=lambda r: r["part"])
    keep = {r[k] for r in listed for k in ("file", "offsets")}
    with to.open_output_stream(f"{path}/index.json") as f:
        f.write(json.dumps({"dtype": np.dtype(opened(shipped).dtype).name, "parts": listed}).encode())
    for info in to.get_file_info(fs.FileSelector(path)):
        if call in info.base_name and info.base_name not in keep:
            to.delete_file(info.path)
    return placed.select("doc_id", "part", "start", "n_tokens"), folder


class Reader:
    """Memory-mapped access to documents by their number, on a file system that this machine mounts."""

    def __init__(self, folder: str):
        path = _open(folder)[1]
        with open(f"{path}/index.json") as f:
            index = json.load(f)
        self.parts = [(p["base"], np.memmap(f"{path}/{p['file']}", np.dtype(index["dtype"]), "r") if p["n"] else np.zeros(0, index["dtype"]), np.memmap(f"{path}/{p['offsets']}", "<u8", "r")) for p in index["parts"]]
        self.first = np.concatenate([[0], np.cumsum([p["docs"] for p in index["parts"]])]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.first[-1])

    def __getitem__(self, i: int) -> np.ndarray:
        if not 0 <= i < len(self):
            raise IndexError(i)
        p = int(np.searchsorted(self.first, i, "right")) - 1
        base, tokens, at = self.parts[p]
        k = i - int(self.first[p])
        return tokens[int(at[k]) - base : int(at[k + 1]) - base]
