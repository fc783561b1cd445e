"""N-gram Jaccard join as a blocked sparse matrix product. No pair is lost.

Rows of the incidence matrix are documents, columns the distinct N-grams of words. Documents
with equal N-gram sets are one row, of their number's weight. Columns are ordered by the number
of rows that hold them, the rarest first. Two rows of n columns with a Jaccard similarity of t or
more share one of each row's first n - ceil(t n) + 1 columns, its prefix; so a row whose prefix
holds columns of its own only has no partner.

The least row (by hash) of all that hold a column is its leader. A block is a leader with a
magnitude of column counts; it holds every row that has such a column in its prefix. Rows that
share a prefix column meet in its block, a row alike to others in hundreds of columns is in a few
blocks only, and a pair counts in the least block that it shares. In a block the product of the
rows with their transpose, over slices of columns, accumulates the exact overlaps, and pairs below
the bound that their sizes imply are discarded. Columns held by SLICE rows or more make blocks
that are cut into slices of rows; two slices meet in one task. No pair is ever shuffled: a task
hands on each row's number of partners and one row that it is connected with.

A column that a third of all rows hold is no one task's: columns found frequent in every few
thousand rows are counted by groups of rows first, their leaders broadcast (FREQUENT bounds
their number), and their rows spread by row.

Words are the runs between ASCII white space; a text with fewer than N words has one N-gram of
all its words. Null texts and texts without words are in no pair, each a class of its own. Very
long texts are rows like any other, taken whole. Rows equal in doc_id and text count as one
document; ties don't matter, as a class is named by its least (doc_id, row key). A null doc_id is
kept as null and sorts first; doc_id must be an integer (else TypeError). Other columns, clashing
names included, are ignored by join and classes and kept by keep_first. An empty table gives an
empty result. Sets and columns are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID, identified, without, written
from tessera.llm.text import U64, Words, buffers, by_run, combine, grams, mix, ranges, slices, starts

N = 5
THRESHOLD = 0.4
CHUNK = 2_000_000
#: Columns that a task gathers before it hands on what it has.
HELD = 1_000_000
#: Columns that hold this share of some thousands of rows are counted apart. Of all columns at most (columns of a row) / FREQUENT are.
FREQUENT = 0.002
#: A block of columns held by twice as many rows or more is cut into slices of rows.
SLICE = 2048
#: Rows and columns of a dense slice of a block's matrix.
DENSE_ROWS, DENSE_COLUMNS = 1024, 8192
_LOW = U64((1 << 48) - 1)


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of each text's n-grams, one text after another; n_texts + 1 offsets)."""
    words = Words(data, offsets)
    h = words.hashes()
    g = grams(h, n)
    at = words.doc_words
    out, sizes = [], np.zeros(len(at) - 1, np.int64)
    for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if e - s >= n:
            x = np.sort(g[s : e - n + 1])
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif e > s:
            x = h[s : s + 1]
            for j in range(s + 1, e):
                x = combine(x, h[j : j + 1])
        else:
            continue
        out.append(x)
        sizes[i] = len(x)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def _chunks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns of each row, offsets, each row's hash)"""
    for batch in batches:
        data, offsets = buffers(batch["text"])
        for lo, hi in slices(offsets, CHUNK):
            g, at = gram_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
            size = np.diff(at)
            row, full = np.zeros(len(size), np.uint64), size > 0
            if full.any():
                row[full] = np.add.reduceat(combine(g, g >> U64(7)), at[:-1][full])
            yield batch.slice(lo, hi - lo), g, at, mix(row ^ size.astype(np.uint64))


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary cells of the values up to each end."""
    at = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


class _Held:
    """The distinct rows of some chunks, gathered up to HELD columns."""

    def __init__(self) -> None:
        self.g, self.size, self.row, self.seen, self.total = [], [], [], set(), 0

    def add(self, g: np.ndarray, at: np.ndarray, row: np.ndarray) -> None:
        size = np.diff(at)
        new = np.array([s > 0 and not (r in self.seen or self.seen.add(r)) for r, s in zip(row.tolist(), size.tolist(), strict=True)], bool)
        self.g.append(g[np.repeat(new, size)])
        self.size.append(size[new])
        self.row.append(row[new])
        self.total += int(size[new].sum())

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(columns, each row's number of them, rows' hashes)"""
        out = tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.g, self.size, self.row))
        self.__init__()
        return out


def _sets(n: int, share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(_k, _id, _n, _s, null) of each document, and (column, null, -1, least row, rows) of columns frequent in some thousands of rows."""

    def frequent(held: _Held) -> Iterator[pa.RecordBatch]:
        g, size, row = held.take()
        if not len(g):
            return
        s = np.repeat(row, size)
        order = np.argsort(g, kind="stable")
        at = starts(g[order])
        count = np.diff(np.append(at, len(g)))
        on = count >= max(8, share * len(row))
        least = np.minimum.reduceat(s[order], at)[on]
        m = int(on.sum())
        yield pa.RecordBatch.from_arrays([pa.array(g[order][at][on].view(np.int64)), pa.nulls(m, pa.int64()), pa.array(np.full(m, -1, np.int32)), pa.array(least.view(np.int64)), pa.array(count[on])], ["_k", "_id", "_n", "_s", "_c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch, g, at, row in _chunks(batches, n):
            held.add(g, at, row)
            size = np.diff(at)
            yield pa.RecordBatch.from_arrays([batch["_k"], batch["_id"], pa.array(size.astype(np.int32)), pa.array(row.view(np.int64)), pa.nulls(len(size), pa.int64())], ["_k", "_id", "_n", "_s", "_c"])
            if held.total > 3 * HELD:
                yield from frequent(held)
        yield from frequent(held)

    return run


_POSTINGS = "_p int, _f boolean, _s binary, _n binary, _m binary, _lo binary, _hi binary"


def _postings(n: int, parts: int, frequent: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Columns by partition, each row's together: rows' hashes, sizes and numbers of columns, and the columns' low 48 bits.
    Frequent ones (_f) by their place among them, in the partition of a chunk of rows."""

    def cells(to: np.ndarray, who: np.ndarray, row: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray, flag: bool) -> pa.RecordBatch:
        """Of columns sorted by partition (to) and row (who)."""
        each = starts(to, who)
        first = starts(to[each])
        ends = np.append(first[1:], len(each))
        columns = np.append(each, len(to))[ends]
        made = [_binary(row[who[each]], ends), _binary(size[who[each]].astype(np.int32), ends), _binary(np.diff(np.append(each, len(to))).astype(np.int32), ends), _binary(lo, columns), _binary(hi, columns)]
        return pa.RecordBatch.from_arrays([pa.array(to[each][first].astype(np.int32)), pa.array(np.full(len(first), flag)), *made], ["_p", "_f", "_s", "_n", "_m", "_lo", "_hi"])

    def flush(held: _Held) -> Iterator[pa.RecordBatch]:
        g, size, row = held.take()
        who = np.repeat(np.arange(len(row)), size)
        if len(frequent) and len(g):
            i = np.minimum(np.searchsorted(frequent, g), len(frequent) - 1)
            hot = frequent[i] == g
            if hot.any():
                yield cells(np.full(int(hot.sum()), int(row[0] % U64(parts))), who[hot], row, size, i[hot].astype(np.uint32), np.zeros(int(hot.sum()), np.uint16), True)
                g, who = g[~hot], who[~hot]
        if len(g):
            to = partition(g, parts)
            order = np.argsort(to, kind="stable")
            g = g[order]
            yield cells(to[order], who[order], row, size, (g & U64(0xFFFFFFFF)).astype(np.uint32), ((g >> U64(32)) & U64(0xFFFF)).astype(np.uint16), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for _, g, at, row in _chunks(batches, n):
            held.add(g, at, row)
            if held.total > HELD:
                yield from flush(held)
        yield from flush(held)

    return run


def partition(g: np.ndarray, parts: int) -> np.ndarray:
    """The partition of a column, by its high bits."""
    return ((g >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


_SHARED = "_s long, _n int, _w long, _g binary, _d binary, _l binary"


def _shared(columns: np.ndarray, counts: np.ndarray, leaders: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One partition's columns that several rows hold: for each row those columns, how many rows hold them, and their leaders."""

    def emit(s: np.ndarray, size: np.ndarray, g: np.ndarray, d: np.ndarray, leader: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of columns sorted by row."""
        at = np.append(starts(s), len(s))
        for lo in range(0, len(at) - 1, 20_000):
            e = at[lo : lo + 20_001]
            a, b, k = int(e[0]), int(e[-1]), len(e) - 1
            ends = e[1:] - a
            made = [_binary(v[a:b], ends) for v in (g, d.astype(np.uint32), leader)]
            yield pa.RecordBatch.from_arrays([pa.array(s[e[:-1]].view(np.int64)), pa.array(size[e[:-1]].astype(np.int32)), pa.nulls(k, pa.int64()), *made], ["_s", "_n", "_w", "_g", "_d", "_l"])

    def read(rows: list[dict]) -> tuple[np.ndarray, ...]:
        s, size, m, lo, hi = (np.frombuffer(b"".join(r[c] for r in rows), k) for c, k in (("_s", np.uint64), ("_n", np.int32), ("_m", np.int32), ("_lo", np.uint32), ("_hi", np.uint16)))
        return s, size, np.repeat(np.arange(len(s)), m), lo, hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["_f"]:
                    s, size, who, i, _ = read([r])
                    yield from emit(s[who], size[who], columns[i], counts[i], leaders[i])
                else:
                    held.setdefault(r["_p"], []).append(r)
        for p in list(held):
            s, size, who, lo, hi = read(held.pop(p))
            g = lo.astype(np.uint64) | (hi.astype(np.uint64) << U64(32))
            del lo, hi
            order = np.argsort(g, kind="stable")
            g, who = g[order], who[order]
            at = starts(g)
            per = np.diff(np.append(at, len(g)))
            own = s[who]
            least, most = np.minimum.reduceat(own, at), np.maximum.reduceat(own, at)
            on = np.repeat(least < most, per)  # copies in other chunks are the same row
            g, who, own = g[on], who[on], own[on]
            if not len(g):
                continue
            order = np.lexsort((own, g))
            once = order[starts(own[order], g[order])]
            g, who, own = g[once], who[once], own[once]
            at = starts(g)
            per = np.diff(np.append(at, len(g)))
            d, leader = np.repeat(per, per), np.repeat(own[at], per)
            order = np.argsort(own, kind="stable")
            yield from emit(own[order], size[who][order], (g | (U64(p) << U64(48)))[order], d[order], leader[order])

    return run


_BLOCKS = "_b long, _key long, _cut int, _s long, _n int, _w long, _g binary, _keys binary"


def _blocks(threshold: float, cut_at: int = SLICE) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows' shared columns, sorted by row: each row with a partner to be found, once for each of its blocks.
    _cut: twice its slice of the block, odd if the block is that slice alone. _keys: all its blocks."""
    base = cut_at.bit_length() - 1

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        s, n = t["_s"].to_numpy().view(np.uint64), t["_n"].to_numpy()
        at = starts(s)
        row = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(s))))
        weight = np.maximum.reduceat(t["_w"].fill_null(0).to_numpy(), at)
        s, n = s[at], np.maximum.reduceat(n, at).astype(np.int64)
        g, ends = buffers(t["_g"])
        (d, _), (leader, _) = buffers(t["_d"]), buffers(t["_l"])
        g, d, leader = g.view(np.uint64), d.view(np.uint32), leader.view(np.uint64)
        row = np.repeat(row, np.diff(ends) // 8)
        order = np.lexsort((g, d, row))
        g, d, leader, row = g[order], d[order], leader[order], row[order]
        count = np.bincount(row, minlength=len(s))
        first = np.cumsum(count) - count
        prefix = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1 - (n - count)  # columns of its own come first
        on = np.arange(len(row)) - first[row] < prefix[row]
        if not on.any():
            return
        level = np.maximum(np.log2(d[on]).astype(np.int64), base)
        key, who = combine(leader[on], level.astype(np.uint64)), row[on]
        order = np.lexsort((key, who))
        once = order[starts(who[order], key[order])]
        key, who, level = key[once], who[once], level[once]
        per = np.bincount(who, minlength=len(s))
        keys = _binary(key, np.cumsum(per))
        by_row = np.lexsort((g, row))
        sets = _binary(g[by_row], np.cumsum(count))
        cuts = np.left_shift(1, level - base)
        mine = np.where(cuts > 1, (s[who] >> U64(20)) % cuts.astype(np.uint64), 0).astype(np.int64)
        copy = np.repeat(np.arange(len(who)), cuts)
        other = ranges(np.zeros(len(cuts), np.int64), cuts)
        a, b = np.minimum(mine[copy], other), np.maximum(mine[copy], other)
        block = combine(key[copy], (a.astype(np.uint64) << U64(32)) | b.astype(np.uint64))
        for lo in range(0, len(copy), 2000):
            c = copy[lo : lo + 2000]
            w = who[c]
            take = pa.array(w)
            cut = (2 * mine[c] + (a[lo : lo + 2000] == b[lo : lo + 2000])).astype(np.int32)
            made = [block[lo : lo + 2000].view(np.int64), key[c].view(np.int64), cut, s[w].view(np.int64), n[w].astype(np.int32), weight[w]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, made), sets.take(take), keys.take(take)], ["_b", "_key", "_cut", "_s", "_n", "_w", "_g", "_keys"])

    return lambda batches: by_run(batches, "_s", flush)


def similar(g: np.ndarray, at: np.ndarray, n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(overlaps, whether the pair's similarity is the threshold or more) of all pairs of some rows, each once, in the upper triangle.

    g, at: the columns of each row that others may hold; n: how many it has altogether.
    """
    m = len(n)
    row = np.repeat(np.arange(m), np.diff(at))
    order = np.argsort(g, kind="stable")
    x = g[order]
    new = starts(x)
    count = np.diff(np.append(new, len(x)))
    keep = np.repeat(count > 1, count)  # the others add nothing
    column = np.repeat(np.cumsum(count > 1) - 1, count)[keep]
    row = row[order][keep]
    columns = int((count > 1).sum())
    total = np.zeros((m, m), np.int32)
    edges = np.searchsorted(column, np.arange(0, columns + DENSE_COLUMNS, DENSE_COLUMNS))
    for c, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if lo == hi:
            continue
        live, r = np.unique(row[lo:hi], return_inverse=True)
        k = column[lo:hi] - c * DENSE_COLUMNS
        for i in range(0, len(live), DENSE_ROWS):
            for j in range(i, len(live), DENSE_ROWS):
                parts = []
                for start in (i, j):
                    mine = (r >= start) & (r < start + DENSE_ROWS)
                    part = np.zeros((min(DENSE_ROWS, len(live) - start), min(DENSE_COLUMNS, columns - c * DENSE_COLUMNS)), np.float32)
                    part[r[mine] - start, k[mine]] = 1
                    parts.append(part)
                total[np.ix_(live[i : i + DENSE_ROWS], live[j : j + DENSE_ROWS])] += (parts[0] @ parts[1].T).astype(np.int32)
    good = np.triu(total >= threshold / (1 + threshold) * (n[:, None] + n[None, :]) - 1e-9, 1)
    return total, good


def _linked(keys: np.ndarray, at: np.ndarray, key: int, m: int) -> np.ndarray | None:
    """Which pairs of rows share a block with a lesser key; None if no pair does."""
    row = np.repeat(np.arange(m), np.diff(at))
    less = keys < key
    row, k = row[less], keys[less]
    order = np.argsort(k, kind="stable")
    row, k = row[order], k[order]
    new = starts(k)
    count = np.diff(np.append(new, len(k)))
    if not (count > 1).any():
        return None
    out = np.zeros((m, m), bool)
    for a, c in zip(new[count > 1].tolist(), count[count > 1].tolist(), strict=True):
        rows = row[a : a + c]
        out[np.ix_(rows, rows)] = True
    return out


_LINKS = "_s long, _root long, _c long"
_PAIRS = "_s long, _t long, _o int, _n int, _m int"


def _products(threshold: float, *, pairs: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by block. pairs: every pair; else for each row with partners the first of those that the block connects it with, and the partners' weight."""

    def block(s: np.ndarray, n: np.ndarray, w: np.ndarray, cut: np.ndarray, g: np.ndarray, at: np.ndarray, keys: np.ndarray, kat: np.ndarray, key: int) -> list[np.ndarray] | None:
        m = len(s)
        total, good = similar(g, at, n, threshold)
        if not good.any():
            return None
        met = _linked(keys, kat, key, m)
        if met is not None:
            good &= ~met
        if not cut[0] & 1:  # two slices: rows of one slice meet elsewhere
            good &= cut[:, None] != cut[None, :]
        if not good.any():
            return None
        if pairs:
            a, b = np.nonzero(good)
            return [s[a], s[b], total[a, b], n[a], n[b]]
        good |= good.T
        links = good.astype(np.float64) @ w
        root = np.full(m, -1)
        for i in np.flatnonzero(good.any(1)).tolist():
            if root[i] < 0:
                root[i] = i
                edge = np.array([i])
                while len(edge):
                    edge = np.flatnonzero(good[edge].any(0) & (root < 0))
                    root[edge] = i
        on = np.flatnonzero(root >= 0)
        return [s[on], s[root[on]], links[on].astype(np.int64)]

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        b, key, cut, n, w = (t[c].to_numpy() for c in ("_b", "_key", "_cut", "_n", "_w"))
        s, key = t["_s"].to_numpy(), key.view(np.uint64)
        (g, at), (keys, kat) = buffers(t["_g"]), buffers(t["_keys"])
        g, at, keys, kat = g.view(np.uint64), at // 8, keys.view(np.uint64), kat // 8
        bounds = np.append(starts(b), len(b))
        found = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo > 1 and (x := block(s[lo:hi], n[lo:hi].astype(np.int64), w[lo:hi], cut[lo:hi], g[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], keys[kat[lo] : kat[hi]], kat[lo : hi + 1] - kat[lo], key[lo])) is not None:
                found.append(x)
        if found:
            columns = [np.concatenate(x) for x in zip(*found, strict=True)]
            names = ["_s", "_t", "_o", "_n", "_m"] if pairs else ["_s", "_root", "_c"]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32) if c in ("_o", "_n", "_m") else x) for c, x in zip(names, columns, strict=True)], names)

    return lambda batches: by_run(batches, "_b", flush)


def _matrix(docs: DataFrame, n: int, threshold: float, *, pairs: bool, share: float = FREQUENT, cut_at: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """((_k, _id, _n, _s) of each document, what _products finds)"""
    rows = identified(docs)
    sc, parts = docs.sparkSession.sparkContext, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = written(rows.mapInArrow(_sets(n, share), "_k long, _id long, _n int, _s long, _c long"), "gram-sets")
    members = sets.where("_n >= 0").select("_k", "_id", "_n", "_s").dropDuplicates(["_k", "_id"])
    weights = members.where("_n > 0").groupBy("_s").agg(F.max("_n").alias("_n"), F.count("*").alias("_w"))
    total = sets.where("_n > 0").count()
    frequent = sets.where("_n < 0").groupBy("_k").agg(F.sum("_c").alias("_c"), F.min("_s").alias("_s"))
    frequent = frequent.where(F.col("_c") >= share / 2 * total).toArrow()  # at most 2 / share times the mean columns of a row
    columns = frequent["_k"].to_numpy().view(np.uint64)
    order = np.argsort(columns)
    columns, counts, leaders = columns[order], frequent["_c"].to_numpy()[order], frequent["_s"].to_numpy()[order].view(np.uint64)
    known = sc.broadcast((columns, counts, leaders))
    postings = rows.mapInArrow(lambda b: _postings(n, parts, known.value[0])(b), _POSTINGS).repartitionById(parts, "_p")
    shared = postings.mapInArrow(lambda b: _shared(*known.value)(b), _SHARED)
    none = F.lit(None).cast("binary")
    shared = shared.unionByName(weights.select("_s", "_n", "_w", none.alias("_g"), none.alias("_d"), none.alias("_l")))
    blocks = shared.repartition(parts, "_s").sortWithinPartitions("_s").mapInArrow(_blocks(threshold, cut_at), _BLOCKS)
    found = blocks.repartition(parts, "_b").sortWithinPartitions("_b").mapInArrow(_products(threshold, pairs=pairs), _PAIRS if pairs else _LINKS)
    return members, found


def join(docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD, **limits: float) -> DataFrame:
    """(doc_a, doc_b, jaccard): every pair of the threshold or more between documents with different N-gram sets, each by the first document that has it; doc_a comes first. classes() says which documents share a set."""
    members, found = _matrix(docs, n, threshold, pairs=True, **limits)
    first = members.where("_n > 0").groupBy("_s").agg(F.min(F.struct("_id", "_k")).alias("f"))
    a, b = first.select("_s", F.col("f").alias("a")), first.select(F.col("_s").alias("_t"), F.col("f").alias("b"))
    both = found.join(a, "_s").join(b, "_t")
    ids = [F.when(x["_id"] != NULL_ID, x["_id"]) for x in (F.least("a", "b"), F.greatest("a", "b"))]
    return both.select(ids[0].alias("doc_a"), ids[1].alias("doc_b"), F.round(F.col("_o") / (F.col("_n") + F.col("_m") - F.col("_o")), 6).alias("jaccard"))


def _classes(docs: DataFrame, n: int, threshold: float, **limits: float) -> DataFrame:
    """(_k, _id, _first, _c): the first document (struct _id, _k) of each document's class, and how many documents it is linked with; classes are connected by links."""
    members, found = _matrix(docs, n, threshold, pairs=False, **limits)
    members, found = written(members, "gram-members"), written(found, "gram-links")
    links = found.groupBy("_s").agg(F.sum("_c").alias("_c"))
    label = connected(found.where("_s <> _root").select(F.col("_s").alias("u"), F.col("_root").alias("v")))
    sets = members.where("_n > 0").groupBy("_s").agg(F.count("*").alias("_w"), F.min(F.struct("_id", "_k")).alias("_f"))
    sets = sets.join(label.select(F.col("u").alias("_s"), F.col("v").alias("_root")), "_s", "left").withColumn("_root", F.coalesce("_root", "_s")).join(links, "_s", "left")
    sets = written(sets.select("_s", "_root", "_f", (F.coalesce("_c", F.lit(0)) + F.col("_w") - 1).alias("_c")), "gram-classes")
    first = sets.groupBy("_root").agg(F.min("_f").alias("_first"))
    named = members.where("_n > 0").join(sets.join(first, "_root").select("_s", "_first", "_c"), "_s").select("_k", "_id", "_first", "_c")
    return named.unionByName(members.where("_n = 0").select("_k", "_id", F.struct("_id", "_k").alias("_first"), F.lit(0).cast("long").alias("_c")))


def classes(docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD, **limits: float) -> DataFrame:
    """(doc_id, class_id, n_links): for each document the first doc_id of its class, and with how many other documents it is linked, copies included. Documents linked directly or through others are a class."""
    found = _classes(docs, n, threshold, **limits)
    shown = [F.when(c != NULL_ID, c) for c in (F.col("_id"), F.col("_first._id"))]
    return found.select(shown[0].alias("doc_id"), shown[1].alias("class_id"), F.col("_c").alias("n_links"))


def connected(edges: DataFrame) -> DataFrame:
    """(u, v): every vertex and the least vertex of its component, by alternating large and small stars."""
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = written(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).select("u", "v").distinct(), "edges")
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = mark(edges)
    while True:
        near = both(edges)
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        pairs = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = written(pairs, "edges")
        now = mark(new)
        if now == before:
            return new
        edges, before = new, now


def keep_first(docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, its first by (doc_id, row key), columns unchanged; documents in no pair stay, repeated rows too."""
    return without(docs, _classes(docs, n, threshold).where("_k <> _first._k or _id <> _first._id"))
