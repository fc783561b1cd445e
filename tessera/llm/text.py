"""Vectorised text kernels shared by the corpus operators.

Everything works on byte buffers of whole Arrow batches: words are found and hashed for
thousands of documents in a handful of numpy calls, so that no operator loops over words
in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2, _ADD = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53), U64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)

#: Words are the runs between ASCII white space and control bytes.
NOT_SPACE = np.arange(256) > 0x20
#: Words are runs of ASCII letters and digits and of all bytes beyond ASCII.
ALNUM = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> U64(33)
    h *= _M1
    h ^= h >> U64(29)
    h *= _M2
    h ^= h >> U64(32)
    return h


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two hash columns."""
    return mix((a * _M2 + _ADD) ^ (b * _M1))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets into them) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if large else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, target: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about target bytes; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + target, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """The words of some documents: where they start and end, and to which document they belong.

    start, end: byte offsets. doc_words: for n documents n + 1 offsets into the words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE):
        n = len(data)
        self.data = np.concatenate([data, np.zeros(16, np.uint8)])
        self.offsets = offsets
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = kind[data]
        first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        full = offsets[:-1][offsets[1:] > offsets[:-1]]
        if n:
            first[full] = inside[1:-1][full]
            ends = np.append(full[1:], n) - 1
            last[ends] = inside[1:-1][ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc_words = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """The number of each word's document."""
        return np.repeat(np.arange(len(self.doc_words) - 1), np.diff(self.doc_words))

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words' bytes, eight bytes a round; never 0."""
        length = self.end - self.start
        out = mix(length.astype(np.uint64) + _ADD)
        view = np.ndarray((max(len(self.data) - 7, 0),), "<u8", self.data.tobytes(), strides=(1,))
        live, at, left = slice(None), self.start, length
        while len(at):
            out[live] = combine(out[live], view[at] & _MASKS[np.minimum(left, 8)])
            more = left > 8
            live = np.flatnonzero(more) if isinstance(live, slice) else live[more]
            at, left = at[more] + 8, left[more] - 8
        out[out == 0] = 1
        return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams that start at each position; the last k - 1 are left out."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, done, step, power = None, 0, 1, h
    while step <= k:
        if k & step:
            part = power[done : len(h) - k + done + 1]
            out = part.copy() if out is None else combine(out, part)
            done += step
        step *= 2
        if step <= k:
            power = combine(power[: len(power) - step // 2], power[step // 2 :])
    return out


def whole(doc_words: np.ndarray, k: int) -> np.ndarray:
    """Of the windows of k words, as grams() numbers them, those that lie within one document."""
    n = int(doc_words[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.zeros(int(doc_words[-1]) + 1, np.int32)
    size = np.diff(doc_words)
    long = size >= k
    np.add.at(ok, doc_words[:-1][long], 1)
    np.add.at(ok, doc_words[1:][long] - k + 1, -1)
    return np.cumsum(ok)[:n] > 0


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of the w values that start at each position; the last w - 1 are left out."""
    step, low = 1, h
    while step * 2 <= w:
        low = np.minimum(low[: len(low) - step], low[step:])
        step *= 2
    return np.minimum(low[: len(h) - w + 1], low[w - step : len(h) - step + 1]) if w > step else low[: len(h) - w + 1]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1 ... for each pair, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(out)


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def by_run(batches: Iterator[pa.RecordBatch], name: str, flush: Callable[[pa.Table], Iterator[pa.RecordBatch]], most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """flush, of some megabytes of rows sorted by a column at a time, no value in two of them."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size > most:
            t = pa.Table.from_batches(held).combine_chunks()
            v = t[name].to_numpy()
            cut = int(np.searchsorted(v, v[-1]))
            if cut:
                yield from flush(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held) if cut else 0
    if held:
        yield from flush(pa.Table.from_batches(held).combine_chunks())
