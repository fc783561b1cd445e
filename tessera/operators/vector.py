"""Cosine distance and nearest neighbours over array columns.

A set of queries goes against all vectors in blocks: each task multiplies its vectors by a block
of queries and hands on the nearest of each batch, so that what is shuffled is a few rows for
each query and batch. Distances are held for QUERY_TILE queries by VECTOR_TILE vectors at once,
however many there are. An index of inverted lists narrows a search to the lists nearest to a query;
its distances are made in the same blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distance where there is no angle: another dimension, no elements, no length.
NO_ANGLE = 2.0
DEFAULT_K = 5
#: Queries that are sent to the tasks at once.
QUERY_BLOCK = 10_000
#: Queries and vectors whose distances a task holds at once.
QUERY_TILE, VECTOR_TILE = 256, 4096
#: Vectors that an index is fitted on, at most.
SAMPLE = 20_000


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    na, nb = norm(a), norm(b)
    good = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0)
    return F.when(good, 1 - _dot(a, b) / (na * nb)).otherwise(NO_ANGLE)


def knn(vectors: DataFrame, query: Sequence[float], k: int = DEFAULT_K, *, key: str = "vec_id", embedding: str = "embedding", threshold: float | None = None) -> DataFrame:
    """(key, distance) of the k nearest; ties by key. threshold: least cosine similarity."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = vectors.select(key, F.round(cosine_distance(F.col(embedding), q), 6).alias("distance"))
    if threshold is not None:
        out = out.where(1 - F.col("distance") >= threshold)
    return out.orderBy("distance", key).limit(k)


def _unit(column: pa.Array, width: int) -> np.ndarray:
    """Rows of length one; zeros where a vector has another dimension, a null or no length."""
    out = np.zeros((len(column), width))
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    mine = np.flatnonzero(size == width)
    if width and len(mine):
        out[mine] = np.nan_to_num(column.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, width)
        length = np.sqrt((out * out).sum(1, keepdims=True))
        out = np.divide(out, length, out=np.zeros_like(out), where=length > 0)
    return out


def _distances(q: np.ndarray, v: np.ndarray, probed: np.ndarray | None = None, lists: np.ndarray | None = None) -> np.ndarray:
    """Queries by vectors; infinite where a query doesn't probe a vector's list."""
    if probed is None:
        angle = (np.abs(q).sum(1) > 0)[:, None] & (np.abs(v).sum(1) > 0)[None, :]
        return np.round(np.where(angle, 1 - q @ v.T, NO_ANGLE), 6)
    out = np.full((len(q), len(v)), np.inf)
    for x in np.unique(lists):
        asked, mine = np.flatnonzero(probed[:, x]), np.flatnonzero(lists == x)
        out[np.ix_(asked, mine)] = _distances(q[asked], v[mine])
    return out


def _against(shipped, key: str, embedding: str, keep: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """Of each tile the pairs that keep (a mask of the distances, queries by vectors) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, groups = shipped.value
        for batch in batches:
            for lo in range(0, batch.num_rows, VECTOR_TILE):
                part = batch.slice(lo, VECTOR_TILE)
                for width, (where, q, probed) in groups.items():
                    v = _unit(part[embedding], width)
                    lists = None if probed is None else part["_list"].to_numpy()
                    for at in range(0, len(q), QUERY_TILE):
                        tile = slice(at, at + QUERY_TILE)
                        distance = _distances(q[tile], v, None if probed is None else probed[tile], lists)
                        i, j = np.nonzero(keep(distance) & (distance < np.inf))
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(where[tile][i])), part[key].take(pa.array(j)), pa.array(distance[i, j])], ["query", key, "distance"])

    return run


def _pairs(vectors: DataFrame, queries: DataFrame, key: str, embedding: str, keep: Callable[[np.ndarray], np.ndarray], near: Callable[[pa.Array], np.ndarray] | None = None) -> DataFrame:
    """near: of query vectors, which lists each of them probes (a mask); vectors then hold a _list."""
    rows = queries.select(key, embedding).toArrow().combine_chunks()  # a stated set of queries, sent on in blocks
    kind = vectors.schema[key].dataType.simpleString()
    # spread by key, as a table of vectors may be one file
    spread = vectors.select(key, embedding, *(["_list"] if near else [])).repartition(key)
    sc, out = vectors.sparkSession.sparkContext, None
    for lo in range(0, max(rows.num_rows, 1), QUERY_BLOCK):
        part = rows.slice(lo, QUERY_BLOCK)
        column = part[embedding].combine_chunks() if part.num_rows else pa.array([], pa.list_(pa.float32()))
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        probed, groups = near(column) if near else None, {}
        for w in np.unique(size):
            where = np.flatnonzero(size == w)
            groups[int(w)] = where, _unit(column.take(pa.array(where)), int(w)), None if probed is None else probed[where]
        found = spread.mapInArrow(_against(sc.broadcast((part[key].combine_chunks() if part.num_rows else part[key], groups)), key, embedding, keep), f"query {kind}, {key} {kind}, distance double")
        out = found if out is None else out.unionByName(found)
    return out


def _ranked(near: DataFrame, key: str, k: int) -> DataFrame:
    near = near.where(F.col("query") != F.col(key))
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("distance", key)).cast("long"))
    return ranked.where(F.col("place") <= k)


def _nearest(k: int) -> Callable[[np.ndarray], np.ndarray]:
    def keep(distance: np.ndarray) -> np.ndarray:  # one more, as a query may be among them
        n = distance.shape[1]
        return distance <= np.partition(distance, min(k, n - 1), axis=1)[:, min(k, n - 1)][:, None] if n else distance > 0

    return keep


def knn_of(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_K, *, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query, key, distance, place) of the k nearest of each query but itself; ties by key."""
    return _ranked(_pairs(vectors, queries, key, embedding, _nearest(k)), key, k)


def within(vectors: DataFrame, queries: DataFrame, similarity: float, *, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query, key, distance) of all vectors but the query itself of the least cosine similarity or more."""
    return _pairs(vectors, queries, key, embedding, lambda d: 1 - d >= similarity).where(F.col("query") != F.col(key))


class InvertedLists:
    """Every vector in the list of its nearest centre. Centres are fitted on SAMPLE vectors at most; every row is in the index."""

    def __init__(self, vectors: DataFrame, lists: int = 16, *, key: str = "vec_id", embedding: str = "embedding", rounds: int = 10):
        self.key, self.embedding = key, embedding
        first = vectors.select(embedding).orderBy(F.xxhash64(key), key).limit(SAMPLE).toArrow()[embedding].combine_chunks()
        width = int(pc.max(pc.list_value_length(first)).as_py() or 0) if len(first) else 0
        x = _unit(first, width)
        x = x[np.abs(x).sum(1) > 0]
        centres = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)] if len(x) else np.zeros((1, width))
        for _ in range(rounds):
            mine = (x @ centres.T).argmax(1) if len(x) else np.zeros(0, int)
            for c in range(len(centres)):
                if (mine == c).any():
                    m = x[mine == c].mean(0)
                    centres[c] = m / max(np.linalg.norm(m), 1e-12)
        self.centres = centres

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((_unit(batch[embedding], width) @ centres.T).argmax(1).astype(np.int32))], [key, embedding, "_list"])

        fields = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in (key, embedding))
        self.rows = vectors.select(key, embedding).mapInArrow(assign, f"{fields}, _list int")

    def search(self, queries: DataFrame, k: int = DEFAULT_K, *, probes: int = 6) -> DataFrame:
        """(query, key, distance, place) among the vectors of each query's nearest lists."""
        centres = self.centres

        def near(column: pa.Array) -> np.ndarray:
            lists = np.argsort(-(_unit(column, centres.shape[1]) @ centres.T), axis=1, kind="stable")[:, :probes]
            probed = np.zeros((len(column), len(centres)), bool)
            np.put_along_axis(probed, lists, True, axis=1)
            return probed

        return _ranked(_pairs(self.rows, queries, self.key, self.embedding, _nearest(k), near), self.key, k)


def wrong_dimension(vectors: DataFrame, dimension: int, embedding: str = "embedding") -> DataFrame:
    return vectors.where(F.coalesce(F.size(embedding), F.lit(-1)) != dimension)
