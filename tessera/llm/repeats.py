"""Where passages can repeat: text windows, partitioned by their minimizers.

A window is ``length`` consecutive words (runs between ASCII white space). The least hash
among the first ``length - SHINGLE + 1`` shingles of a window is its minimizer; equal windows
have equal minimizers, so windows of documents anywhere can be compared inside the partition
of their minimizer, and a minimizer that occurs once in the corpus rules its windows out.
Nothing that repeats is lost by this, and nothing needs all documents in one place.

Consecutive windows with one minimizer travel together as a *block*: the words from the first
window's start to the last one's end, each word as 48 bits of its hash.

A minimizer may stand in a third of all documents. Its places are counted by partial sums, never
in one task; its blocks are spread over parts of HOT blocks by document. What repeats within a
part is settled there; the windows that are first in their part are compared once more, spread by
the hash of all their words, of which each part sends one copy.

Null and empty texts and texts shorter than a window have no places; very long texts are cut into
blocks like any other; rows equal in doc_id and text are one document; an empty table has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import identified, written
from tessera.llm.text import U64, Words, buffers, combine, grams, ranges, slices, sliding_min, whole

#: Words of a shingle, of which minimizers are chosen.
SHINGLE = 8
#: Bytes of text that the kernels take at a time.
CHUNK = 2_000_000
#: Words whose windows are compared in one go, within a partition.
GROUP_WORDS = 1_500_000
#: A minimizer with more blocks is compared in parts of about so many.
HOT = 20_000

_PLACES = "_k long, _id long, _m long, _at int, _n int, _r boolean"
_BLOCKS = "_m long, _k long, _id long, _at int, _n int, _h boolean, _w binary, _x binary"
#: Spans, with where they were copied from; or (_m not null) windows that are first in their part.
_SPANS = "_k long, _id long, _from int, _to int, _sid long, _sat int, _m long, _w binary, _x binary"


def _minimizers(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimizer, whether it stands in the block more than
    once) of each block; windows by their first word."""
    w = length - SHINGLE + 1
    h = grams(words.hashes(), SHINGLE)
    if len(h) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    low = sliding_min(h, w)
    ok = whole(words.doc_words, length)
    low = low[: len(ok)]
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (low[1:] != low[:-1])
    new[np.intersect1d(words.doc_words[:-1], np.flatnonzero(ok))] = True
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(ok))
    good = np.concatenate([[0], np.cumsum(ok)])
    count = good[stop] - good[first]
    least, size = low[first], count + w - 1
    if not len(first):
        return first, count, least, np.zeros(0, bool)
    same = (h[ranges(first, size)] == np.repeat(least, size)).astype(np.int32)
    return first, count, least, np.add.reduceat(same, np.cumsum(size) - size) > 1


def _places(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch["text"])
            keys, ids = batch["_k"].to_numpy(zero_copy_only=False), batch["_id"].to_numpy(zero_copy_only=False)
            for lo, hi in slices(offsets, CHUNK):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                first, count, low, twice = _minimizers(words, length)
                doc = np.searchsorted(words.doc_words, first, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo:hi][doc]), pa.array(ids[lo:hi][doc]), pa.array(low.view(np.int64)), pa.array((first - words.doc_words[doc]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(twice)], ["_k", "_id", "_m", "_at", "_n", "_r"])

    return run


def _cells(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _blocks(length: int, hot: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch["text"])
            keys, ids = batch["_k"].to_numpy(zero_copy_only=False), batch["_id"].to_numpy(zero_copy_only=False)
            places = batch["_b"]
            cut = np.asarray(places.offsets)
            flat = places.flatten()
            at, n, m, c = (np.asarray(flat.field(i)) for i in range(4))
            cut = cut - cut[0]
            for lo, hi in slices(offsets, CHUNK):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                h = words.hashes()
                w, x = (h >> U64(32)).astype(np.uint32), (h & U64(0xFFFF)).astype(np.uint16)
                w[w == 0] = 1
                mine = slice(cut[lo], cut[hi])
                doc = np.repeat(np.arange(hi - lo), np.diff(cut[lo : hi + 1]))
                first, count, low = at[mine].astype(np.int64), n[mine].astype(np.int64), m[mine]
                many = c[mine] > hot
                if many.any():
                    parts = -(-c[mine][many] // hot)
                    part = (keys[lo:hi][doc[many]].view(np.uint64) >> U64(8)) % parts.astype(np.uint64)
                    low = low.copy()
                    low[many] = combine(low[many].view(np.uint64), part).view(np.int64)
                size = count + length - 1
                take = ranges(words.doc_words[doc] + first, size)
                ends = np.cumsum(size)
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(keys[lo:hi][doc]), pa.array(ids[lo:hi][doc]), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(many), _cells(w[take], ends), _cells(x[take], ends)], ["_m", "_k", "_id", "_at", "_n", "_h", "_w", "_x"])

    return run


class Group:
    """Blocks with all occurrences of their minimizers, or of parts of them, in the order of document and place.

    text: the blocks' words as 32 bits of their hashes, each block followed by a 0; more: 16 bits
    beyond. start: where each block starts in it. windows: where each window starts. owner: its
    block. Windows come in the order of their occurrence.
    """

    def __init__(self, t: pa.Table, length: int):
        t = t.combine_chunks()
        col = {c: t[c].to_numpy() for c in ("_m", "_k", "_id", "_at", "_n", "_h")}
        order = np.lexsort((col["_at"], col["_k"], col["_id"]))
        same = np.ones(len(order), bool)  # repeated rows are one document
        same[:1] = False
        for c in ("_k", "_id", "_at"):
            v = col[c][order]
            same[1:] &= v[1:] == v[:-1]
        self.order = order = order[~same]
        self.m, self.k, self.id, self.at, n, self.hot = (col[c][order] for c in ("_m", "_k", "_id", "_at", "_n", "_h"))
        raw, offsets = buffers(t["_w"].combine_chunks())
        size = np.diff(offsets)[order] // 4
        self.start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        total = int((size + 1).sum()) + length + 1
        self.text, self.more = np.zeros(total, np.uint32), np.zeros(total, np.uint16)
        to, source = ranges(self.start, size), ranges(offsets[:-1][order] // 4, size)
        if len(to):
            self.text[to] = raw.view(np.uint32)[source]
            self.more[to] = buffers(t["_x"].combine_chunks())[0].view(np.uint16)[source]
        self.size, self.n = size, n.astype(np.int64)
        self.windows = ranges(self.start, self.n)
        self.owner = np.repeat(np.arange(len(n)), self.n)

    def full(self) -> np.ndarray:
        """48 bits of each word's hash."""
        return (self.text.astype(np.uint64) << U64(16)) | self.more.astype(np.uint64)

    def spans(self, first: np.ndarray, last: np.ndarray, source: np.ndarray | None, length: int) -> pa.RecordBatch:
        """The words from each first window (by number) to the last one's end; source: the place in the text that the first was copied from."""
        block = self.owner[first]
        place = self.at[block] - self.start[block]
        if source is None:
            sid, sat = pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.int32())
        else:
            b = np.searchsorted(self.start, source, "right") - 1
            sid, sat = pa.array(self.id[b]), pa.array((self.at[b] + source - self.start[b]).astype(np.int32))
        made = [self.k[block], self.id[block], (place + self.windows[first]).astype(np.int32), (place + self.windows[last] + length).astype(np.int32)]
        rest = [pa.nulls(len(first), k) for k in (pa.int64(), pa.binary(), pa.binary())]
        return pa.RecordBatch.from_arrays([*map(pa.array, made), sid, sat, *rest], ["_k", "_id", "_from", "_to", "_sid", "_sat", "_m", "_w", "_x"])

    def alone(self, windows: np.ndarray, length: int) -> pa.RecordBatch:
        """Windows (by number) with all their words, by the hash of these."""
        block, at = self.owner[windows], self.windows[windows]
        place = (self.at[block] - self.start[block] + at).astype(np.int32)
        take = (at[:, None] + np.arange(length)).ravel()
        ends = np.arange(1, len(windows) + 1) * length
        h = grams(self.full(), length)[at]
        none = pa.nulls(len(windows), pa.int64()), pa.nulls(len(windows), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(self.k[block]), pa.array(self.id[block]), pa.array(place), pa.array((place + length).astype(np.int32)), *none, pa.array(h.view(np.int64)), _cells(self.text[take], ends), _cells(self.more[take], ends)], ["_k", "_id", "_from", "_to", "_sid", "_sat", "_m", "_w", "_x"])


def runs(group: Group, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) windows of the runs of a mask within a block."""
    begins = np.concatenate([[True], group.owner[1:] != group.owner[:-1]]) if len(group.owner) else np.zeros(0, bool)
    ends = np.append(begins[1:], True) if len(begins) else begins
    padded = np.concatenate([[False], on, [False]])
    return np.flatnonzero(on & (begins | ~padded[:-2])), np.flatnonzero(on & (ends | ~padded[2:]))


#: Of a group, (first, last window, source or None) of the spans that stand earlier, and the mask of the windows inside.
Judge = Callable[[Group, int], tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]]


def _compare(length: int, judged_by: Judge, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs over blocks sorted by minimizer and occurrence, some minimizers at a time. One too
    large for a group is compared piece by piece, each with the blocks before it that hold a first
    occurrence."""

    def judge(t: pa.Table, judged: int) -> tuple[list[pa.RecordBatch], pa.Table]:
        """Spans of all but the first rows, which have been judged, and first windows of hot minimizers' parts; the rows with first occurrences."""
        group = Group(t, length)
        first, last, source, mask = judged_by(group, length)
        new = group.order >= judged
        mine = new[group.owner[first]]
        out = [group.spans(first[mine], last[mine], None if source is None else source[mine], length)]
        fresh = np.flatnonzero(~mask & (new & group.hot)[group.owner])
        out += [group.alone(fresh[i : i + 20_000], length) for i in range(0, len(fresh), 20_000)]
        keep = np.zeros(len(group.order), bool)
        keep[group.owner[~mask]] = True
        return out, t.take(pa.array(np.sort(group.order[keep])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, judged = None, 0
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if held["_w"].nbytes // 4 < most:
                continue
            m = held["_m"].to_numpy()
            cut = int(np.flatnonzero(m != m[-1])[-1]) + 1 if m[0] != m[-1] else 0
            if cut:
                yield from judge(held.slice(0, cut), judged)[0]
                held, judged = held.slice(cut).combine_chunks(), 0
            if held["_w"].nbytes // 4 >= most:
                spans, held = judge(held, judged)
                judged = held.num_rows
                yield from spans
        if held is not None and held.num_rows:
            yield from judge(held, judged)[0]

    return run


def found(docs: DataFrame, length: int, judged_by: Judge, *, hot: int = HOT, group_words: int = GROUP_WORDS) -> DataFrame:
    """(_k, _id, _from, _to, _sid, _sat): spans of words [from, to) that have an earlier occurrence; the order of occurrences is by doc_id (null first), row key and place."""
    rows = identified(docs)
    places = rows.mapInArrow(_places(length), _PLACES)
    counts = places.groupBy("_m").agg(F.count("*").alias("_c"), F.max("_r").alias("_any")).where("_c > 1 or _any").select("_m", "_c")
    wanted = places.join(counts, "_m").groupBy("_k", "_id").agg(F.collect_set(F.struct("_at", "_n", "_m", "_c")).alias("_b"))
    blocks = rows.join(wanted, ["_k", "_id"]).select("_k", "_id", "text", "_b").mapInArrow(_blocks(length, hot), _BLOCKS)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    compare = _compare(length, judged_by, group_words)
    parts = written(blocks.repartition(n, "_m").sortWithinPartitions("_m", "_id", "_k", "_at").mapInArrow(compare, _SPANS), "repeat-parts")
    first = parts.where("_m is not null").select("_m", "_k", "_id", F.col("_from").alias("_at"), F.lit(1).alias("_n"), F.lit(False).alias("_h"), "_w", "_x")
    rest = first.repartition(n, "_m").sortWithinPartitions("_m", "_id", "_k", "_at").mapInArrow(compare, _SPANS)
    return parts.where("_m is null").unionByName(rest).drop("_m", "_w", "_x")


def repeats(docs: DataFrame, length: int, judged_by: Judge, **limits: int) -> DataFrame:
    """(_k, _id, _spans): for each document with repeats the merged spans of words [from, to), sorted."""
    return merged(found(docs, length, judged_by, **limits))


def merged(found: DataFrame) -> DataFrame:
    """Overlapping or adjoining spans of a document become one."""
    order = Window.partitionBy("_k", "_id").orderBy("_from", "_to")
    before = F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.withColumn("_new", F.coalesce((F.col("_from") > before).cast("int"), F.lit(1))).withColumn("_g", F.sum("_new").over(order))
    spans = spans.groupBy("_k", "_id", "_g").agg(F.min("_from").alias("start"), F.max("_to").alias("end"))
    return spans.groupBy("_k", "_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
