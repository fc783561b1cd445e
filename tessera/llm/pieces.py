"""Sampled SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is cut into units, each a run of spaces with the run of other characters behind it. The
pieces that match inside a unit form its lattice; a byte piece may stand for any byte, so that
every text has a segmentation. A piece weighs (its merge rank + OFFSET) ** -alpha, a byte piece
BYTE_WEIGHT. The forward pass sums the weights of all segmentations of each prefix, once for
each distinct unit; the backward pass draws each occurrence's last piece in proportion to the
segmentations that end with it, then goes on in front of it. Draws are hashes of (seed,
doc_id, unit, step): the same rows give the same segmentations wherever they run. With
sample=False the draws are replaced by the heaviest last piece of the forward sums.

Decoding joins the pieces' bytes: the space mark is a space, and a text's own U+2581 is spelt in
byte pieces, so decode(encode(text)) is the text, whatever it holds.

Units of LONG bytes or more (a text without spaces is one) go side by side, character by
character; their lattices keep only what matches, found along the beginnings of pieces.

Null text gives null; empty text an empty list; very long texts are encoded whole. Rows with equal
doc_id and text, repeated or tied ones too, give equal lists; a null doc_id counts as the least
integer; doc_id must be an integer (else TypeError). Other columns are kept; text and one named as
the output are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID, fresh, integral
from tessera.llm.text import U64, buffers, combine, mix, ranges, slices, starts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
OFFSET = 2.7
BYTE_WEIGHT = 1e-6
CHUNK = 3_000_000
#: Longer units, in bytes, go character by character.
LONG = 64
#: Cells of the lattices that are computed at a time.
CELLS = 3_000_000
#: Every byte of a segmentation counts so much more; it keeps the sums in range and changes no draw.
_SCALE = 30.0
_BASE = U64(0x9E3779B97F4A7C15)
_BITS = 18


@dataclass
class Vocabulary:
    """Pieces as bytes (one after another, offsets at), their weights, and the byte pieces' identifiers."""

    data: np.ndarray
    at: np.ndarray
    weight: np.ndarray
    byte_ids: np.ndarray
    longest: int
    tables: list[tuple[int, np.ndarray]]
    keys: np.ndarray
    #: Hashes of all beginnings of pieces, in whole characters, and which piece each is (-1: none).
    prefix_keys: np.ndarray
    prefix_ids: np.ndarray

    def find(self, key: np.ndarray) -> np.ndarray:
        """Identifiers of the pieces with these hashes, -1 where there is none."""
        out = np.full(key.shape, -1, np.int32)
        for shift, table in self.tables:
            slot = table[((key >> U64(shift)) & U64((1 << _BITS) - 1)).astype(np.int64)]
            hit = self.keys[slot] == key
            out[hit] = slot[hit]
        return out


def _key(prefix: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        power = U64(pow(int(_BASE), length, 1 << 64))
        return mix((prefix - start * power) ^ (U64(length) << U64(56)))


def load(model: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    pieces, weight, byte_ids = [b""] * n, np.zeros(n), np.zeros(256, np.int32)
    scores = sorted({sp.get_score(i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}, reverse=True)
    rank = {s: r for r, s in enumerate(scores)}
    for i in range(n):
        if sp.is_byte(i):
            b = int(sp.id_to_piece(i)[3:5], 16)
            pieces[i], byte_ids[b], weight[i] = bytes([b]), i, BYTE_WEIGHT
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[i] = sp.id_to_piece(i).replace("▁", " ").encode()
            weight[i] = (rank[sp.get_score(i)] + OFFSET) ** -alpha
    size = np.array([len(p) for p in pieces])
    at = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    keys = np.zeros(n, np.uint64)
    known = [i for i in range(n) if pieces[i] and not sp.is_byte(i)]
    for i in known:
        h = 0
        for b in pieces[i]:
            h = (h * int(_BASE) + b + 1) % (1 << 64)
        keys[i] = _key(np.array([h], np.uint64), np.zeros(1, np.uint64), len(pieces[i]))[0]
    tables, left = [], np.array(known)
    for shift in (46, 28, 10, 37, 19, 1):
        if not len(left):
            break
        table = np.zeros(1 << _BITS, np.int32)
        slot = ((keys[left] >> U64(shift)) & U64((1 << _BITS) - 1)).astype(np.int64)
        table[slot[::-1]] = left[::-1]
        tables.append((shift, table))
        left = left[table[slot] != left]
    assert not len(left), "the pieces' hashes collide"
    begun: dict[int, int] = {}
    for i in known:
        h, text = 0, pieces[i]
        for j, b in enumerate(text, 1):
            h = (h * int(_BASE) + b + 1) % (1 << 64)
            if j == len(text) or text[j] & 0xC0 != 0x80:
                key = int(mix(np.array([h ^ (j << 56)], np.uint64))[0])
                begun[key] = i if j == len(text) else begun.get(key, -1)
    prefix_keys = np.array(sorted(begun), np.uint64)
    return Vocabulary(data, at, weight, byte_ids, int(size.max()), tables, keys, prefix_keys, np.array([begun[x] for x in sorted(begun)], np.int32))


@lru_cache(maxsize=4)
def _cached(model: str, alpha: float) -> Vocabulary:
    return load(model, alpha)


def _uniform(key: np.ndarray, unit: np.ndarray, step: int) -> np.ndarray:
    return (combine(key, (unit.astype(np.uint64) << U64(20)) + U64(step & 0xFFFFF)) >> U64(11)).astype(np.float64) * 2.0**-53


def _lattice(v: Vocabulary, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """text: rows of bytes of units of one length class, 0 beyond the end. For each row, end and
    piece length: the running sum of the weights of the segmentations that end so, and the piece."""
    n, size = text.shape
    most = min(v.longest, size)
    prefix = np.zeros((size + 1, n), np.uint64)
    for j in range(size):
        prefix[j + 1] = prefix[j] * _BASE + text[:, j] + U64(1)
    alpha = np.zeros((size + 1, n))
    alpha[0] = 1
    sums = np.zeros((size + 1, most, n))
    ids = np.zeros((size + 1, most, n), np.int32)
    for j in range(1, size + 1):
        total = np.zeros(n)
        for length in range(1, min(most, j) + 1):
            found = v.find(_key(prefix[j], prefix[j - length], length))
            w = np.where(found >= 0, v.weight[found], 0.0) * _SCALE**length
            if length == 1:
                byte = v.byte_ids[text[:, j - 1]]
                alone = found < 0
                w[alone] = BYTE_WEIGHT * _SCALE
                found[alone] = byte[alone]
            total = total + alpha[j - length] * w
            sums[j, length - 1], ids[j, length - 1] = total, found
        sums[j, min(most, j) :] = total
        alpha[j] = total
    return sums, ids


_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


def _edges(v: Vocabulary, data: np.ndarray, begins: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first character, character behind, piece, log weight) of all matches; piece -1: a character's bytes.
    begins: where characters begin, and the end; last: the end of each character's unit, in characters."""
    n = len(begins) - 1
    power = np.cumprod(np.concatenate([[U64(1)], np.full(len(data), _BASE)]))
    scaled = (data.astype(np.uint64) + U64(1)) * np.cumprod(np.full(len(data), _INVERSE))
    sums = np.concatenate([[U64(0)], np.cumsum(scaled)])
    log = np.log(np.maximum(v.weight, 1e-300))
    out = []
    live, step = np.arange(n), 0
    single = np.zeros(n, bool)
    while len(live):
        step += 1
        a, b = begins[live], begins[live + step]
        key = mix(((sums[b] - sums[a]) * power[b]) ^ ((b - a).astype(np.uint64) << U64(56)))
        at = np.minimum(np.searchsorted(v.prefix_keys, key), len(v.prefix_keys) - 1)
        hit = v.prefix_keys[at] == key
        live, piece = live[hit], v.prefix_ids[at[hit]]
        on = piece >= 0
        out.append((live[on], live[on] + step, piece[on], log[piece[on]]))
        if step == 1:
            single[live[on]] = True
        live = live[live + step + 1 <= last[live]]
    size = np.diff(begins)
    spelt = np.flatnonzero(~single | (size > 1))
    out.append((spelt, spelt + 1, np.full(len(spelt), -1, np.int32), size[spelt] * math.log(BYTE_WEIGHT)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _long_units(v: Vocabulary, data: np.ndarray, size: np.ndarray, draw: Callable[[np.ndarray, int], np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of all units, one after another; how many each has). data: the units' bytes, one after another;
    draw: the uniforms of some units at a step, or None for the heaviest."""
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    ends = np.cumsum(size)
    bound = np.concatenate([[0], np.searchsorted(begins, ends)])
    chars = np.diff(bound)
    begins = np.append(begins, len(data))
    first, behind, piece, weight = _edges(v, data, begins, np.repeat(bound[1:], chars))
    owner = np.repeat(np.arange(len(size)), chars)[first]
    # the longest units first, so that those still going on are the first
    rank = np.empty(len(size), np.int64)
    rank[np.argsort(-chars, kind="stable")] = np.arange(len(size))
    place = behind - bound[owner]
    order = np.lexsort((behind - first, rank[owner], place))
    first, behind, piece, weight, owner, place = (x[order] for x in (first, behind, piece, weight, owner, place))
    node = behind + owner  # a node more than characters for each unit
    source = first + owner
    groups = starts(node)
    edge = np.append(groups, len(node))
    target = node[groups]
    alpha = np.full(len(begins) - 1 + len(size), -np.inf)
    alpha[bound[:-1] + np.arange(len(size))] = 0
    steps = np.append(starts(place[groups]), len(groups))
    for lo, hi in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
        a, b = edge[lo], edge[hi]
        x = alpha[source[a:b]] + weight[a:b]
        at = groups[lo:hi] - a
        top = np.maximum.reduceat(x, at)
        x -= np.repeat(top, np.diff(edge[lo : hi + 1]))
        alpha[target[lo:hi]] = top + np.log(np.add.reduceat(np.exp(x), at))
    group_of = np.empty(len(alpha), np.int64)
    group_of[target] = np.arange(len(groups))
    live = np.flatnonzero(chars > 0)
    here = bound[1:][live] + live
    who, picked, step = [], [], 0
    while len(live):
        g = group_of[here]
        per = edge[g + 1] - edge[g]
        e = ranges(edge[g], per)
        at = np.cumsum(per) - per
        p = np.exp(alpha[source[e]] + weight[e] - np.repeat(alpha[here], per))
        u = draw(live, step)
        if u is None:
            best = p == np.repeat(np.maximum.reduceat(p, at), per)
            pick = np.minimum.reduceat(np.where(best, e, len(node)), at)
        else:
            c = np.cumsum(p)
            c -= np.repeat(c[at] - p[at], per)
            pick = edge[g] + np.minimum(np.add.reduceat((c <= np.repeat(u * c[at + per - 1], per)).astype(np.int64), at), per - 1)
        who.append(live)
        picked.append(pick)
        here = source[pick]
        more = here > bound[live] + live
        live, here = live[more], here[more]
        step += 1
    if not who:
        return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
    turn = np.repeat(np.arange(step), [len(x) for x in who])
    who, picked = np.concatenate(who), np.concatenate(picked)
    order = np.lexsort((-turn, who))
    who, picked = who[order], picked[order]
    a = first[picked]
    spelt = piece[picked] < 0
    per = np.where(spelt, begins[a + 1] - begins[a], 1)
    out = np.repeat(piece[picked], per)
    on = np.repeat(spelt, per)
    out[on] = v.byte_ids[data[ranges(begins[a[spelt]], per[spelt])]]
    return out.astype(np.int32), np.bincount(who, per, len(size)).astype(np.int64)


def encode_buffers(v: Vocabulary, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, *, sample: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(identifiers of all texts' pieces, one text after another; n_texts + 1 offsets)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    space = data == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], n)
    size = end - start
    doc_units = np.searchsorted(start, offsets)
    per = np.diff(doc_units)
    key = np.repeat(seeds, per)
    unit = ranges(np.zeros(len(per), np.int64), per)
    padded = np.concatenate([data, np.zeros(LONG + 8, np.uint8)])
    view = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    h = mix(size.astype(np.uint64) + _BASE)
    at, live, left = start, np.arange(len(start)), size
    masks = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
    while len(live):
        h[live] = combine(h[live], view[at] & masks[np.minimum(left, 8)])
        more = (left > 8) & (size[live] <= LONG)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    who, step_of, piece = [], [], []
    count = np.zeros(len(start), np.int64)
    long = np.flatnonzero(size > LONG)
    edges = np.concatenate([[0], np.cumsum(size[long])])
    for lo, hi in slices(edges, CHUNK):
        mine = long[lo:hi]
        ids, per = _long_units(v, data[ranges(start[mine], size[mine])], size[mine], (lambda i, s, mine=mine: _uniform(key[mine[i]], unit[mine[i]], s)) if sample else (lambda i, s: None))
        count[mine] = per
        who.append(np.repeat(mine, per))
        step_of.append(np.repeat(np.cumsum(per), per) - 1 - np.arange(len(ids)))
        piece.append(ids)
    short = np.flatnonzero(size <= LONG)
    order = short[np.lexsort((h[short], size[short]))]
    ho, so = h[order], size[order]
    new = np.flatnonzero(np.concatenate([[True], (ho[1:] != ho[:-1]) | (so[1:] != so[:-1])])) if len(order) else np.zeros(0, np.int64)
    bounds = np.append(new, len(order))
    lo = 0
    while lo < len(new):
        length = int(so[new[lo]])
        stop = int(np.searchsorted(so[new], length, "right"))
        hi = min(stop, lo + max(64, CELLS // (length * min(v.longest, length) + 1)))
        first = start[order[new[lo:hi]]]
        sums, ids = _lattice(v, padded[first[:, None] + np.arange(length)])
        occ = order[bounds[lo] : bounds[hi]]
        row = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
        pos = np.full(len(occ), length)
        step = 0
        while len(occ):
            cell = sums[pos, :, row]
            if sample:
                r = _uniform(key[occ], unit[occ], step) * cell[:, -1]
                pick = np.minimum((cell <= r[:, None]).sum(axis=1), np.minimum(pos, cell.shape[1]) - 1)
            else:
                pick = np.argmax(np.diff(cell, axis=1, prepend=0), axis=1)
            who.append(occ)
            step_of.append(np.full(len(occ), step))
            piece.append(ids[pos, pick, row])
            pos = pos - pick - 1
            step += 1
            done = pos == 0
            count[occ[done]] = step
            occ, row, pos = occ[~done], row[~done], pos[~done]
        lo = hi
    ends = np.cumsum(count)
    out = np.zeros(int(ends[-1]), np.int32)
    for w, s, p in zip(who, step_of, piece, strict=True):
        out[ends[w] - 1 - s] = p
    return out, np.concatenate([[0], ends])[doc_units]


def decode_buffers(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n_texts + 1 offsets)."""
    size = np.diff(v.at)[ids]
    return v.data[ranges(v.at[ids], size)], np.concatenate([[0], np.cumsum(size)])[offsets]


def _strings(data: np.ndarray, at: np.ndarray, valid: pa.Array) -> pa.Array:
    out = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())
    return pc.if_else(valid, out, None) if len(out) else out


def encode(docs: DataFrame, *, model: str = MODEL, alpha: float = ALPHA, seed: int = 0, sample: bool = True, column: str = "ids") -> DataFrame:
    """docs with the pieces' identifiers in ``column`` (array<int>) in place of the text and any column of that name."""
    integral(docs)
    vocabulary = docs.sparkSession.sparkContext.broadcast(_cached(model, alpha))
    keep = [c for c in docs.columns if c.lower() not in ("text", column.lower())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            data, offsets = buffers(batch[text])
            seeds = mix(batch[key].to_numpy(zero_copy_only=False).view(np.uint64) + U64(seed) * _BASE)
            for lo, hi in slices(offsets, CHUNK):
                ids, at = encode_buffers(v, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], seeds[lo:hi], sample=sample)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                part = batch.slice(lo, hi - lo)
                lists = pc.if_else(part[text].is_valid(), lists, None)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), lists], [*keep, column])

    text, key = fresh(docs, "_text"), fresh(docs, "_seed")
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(text), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias(key))
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return given.mapInArrow(run, ", ".join([*fields, f"`{column}` array<int>"]))


def decode(encoded: DataFrame, *, model: str = MODEL, column: str = "ids") -> DataFrame:
    """encoded with the text in place of the pieces' identifiers and of any column of that name."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(_cached(model, ALPHA))
    keep = [c for c in encoded.columns if c.lower() not in ("text", column.lower())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                lists = part[column]
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                data, at = decode_buffers(v, lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), _strings(data, at, lists.is_valid())], [*keep, "text"])

    fields = [f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep]
    return encoded.mapInArrow(run, ", ".join([*fields, "text string"]))
