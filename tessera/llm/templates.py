"""Benchmark decontamination by template canonicalisation.

Words (runs of letters and digits, lower-cased) become template symbols. A word with a digit is a
number, with the digit groups behind it (1,000 or 2.5) and a unit right behind it (5 km); a
capitalised word that isn't a common opener is a name, with the names behind it. Each kind is one
typed placeholder, its words the slot's value; other words are literal. A document and a benchmark
item that share windows of WINDOW symbols are joined by the windows' hashes. Along a common
alignment every value of the item must stand for one value of the document and the other way
round; else the match is dropped, as the item's parameters then play different parts.

The documents pass a bitmap of fixed size first, of all the items' windows, so the join sees
hits only; the items' windows are broadcast if they are counted to be few.

Verbatim copies have a second, exact key: windows of the lower-cased words themselves, whatever
kinds they are of. They add to an alignment what they cover, unless its templates contradict them.

A document is contaminated by an item if consistent windows cover at least COVERAGE of the
item's words. Items shorter than a window are matched as one window of their full length: verbatim
at any length, as a template when they have MIN_ITEM symbols. Windows of templates must hold
MIN_LITERAL literal words.

Null or empty texts and items match nothing; very long texts are scanned whole. Null identifiers
are kept as null; repeated rows of either side count once, and of items tied in text each is
found. doc_id and item_id must be integers (else TypeError). Other columns, clashing names
included, are ignored (find) or kept (clean). An empty table or benchmark gives no match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID, identified, small, without, written
from tessera.llm.text import ALNUM, U64, Words, buffers, by_run, grams, mix, ranges, slices, starts, whole

WINDOW = 10
MIN_LITERAL = 5
MIN_ITEM = 6
COVERAGE = 0.4
#: Buckets of the bitmap that documents pass before the join.
BITMAP_BITS = 22
CHUNK = 2_000_000
#: Units, where they stand right behind a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mi mg g kg gram grams kilogram kilograms kilo kilos ton tons tonne tonnes lb lbs pound pounds oz ounce ounces "
    "ml cl l liter liters litre litres gallon gallons pint pints cup cups s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent kmh mph kph kw kwh w watt watts v volt volts hz khz mhz ghz kb mb gb tb degree degrees celsius fahrenheit kelvin"
).split()
#: Capitalised words that aren't names.
OPENERS = (
    "a an the this that these those there here it he she they we you i his her its their our your my who whom whose which what when where why how if is are was were be do does did can could would should "
    "will may might must has have had in on at by for from of to with without and or but as so then than not no yes all each every some any both one two three find calculate compute solve given suppose let "
    "consider determine write name add subtract explain describe state show prove evaluate estimate choose complete after before during while since because although der die das ein eine wie was wer wenn le la les un une el los las"
).split()
#: Hashes that stand for the placeholders number and name.
NUMBER, NAME = U64(0xA1B2C3D4E5F60711), U64(0xB1B2C3D4E5F60713)
#: Tells the hashes of verbatim windows from those of templates.
EXACT = U64(0xD1B2C3D4E5F60719)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _pairs() -> tuple[np.ndarray, np.ndarray]:
    """Of letters of two bytes in UTF-8: whether they are capitals, and the two bytes of their small ones."""
    capital, low = np.zeros(1 << 16, bool), np.arange(1 << 16, dtype=np.uint32)
    for i in range(0x80, 0x800):
        c, s = chr(i), chr(i).lower()
        if c != s and len(s.encode()) == 2:
            at = int.from_bytes(c.encode(), "big")
            capital[at], low[at] = c.isupper(), int.from_bytes(s.encode(), "big")
    return capital, low


_CAPITAL, _SMALL = _pairs()


def _hash(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    return Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), ALNUM).hashes()


class Templates:
    """The words of some texts, and their template symbols.

    value: the hash of each lower-cased word. first: the first word of each symbol; symbol: its
    hash, that of the placeholder for a slot; slot: the hash of its words, 0 for literal ones.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lower = _LOWER[data]
        both = np.zeros(len(data), np.uint32)
        both[:-1] = (data[:-1].astype(np.uint32) << 8) | data[1:]
        large = np.flatnonzero((data >= 0xC2) & (data < 0xE0) & _CAPITAL[both])
        lower[large], lower[large + 1] = _SMALL[both[large]] >> 8, _SMALL[both[large]] & 255
        self.words = words = Words(lower, offsets, ALNUM)
        self.value = words.hashes()
        n = len(words)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        number = digits[words.end] > digits[words.start]
        name, unit, new = np.zeros(n, bool), np.zeros(n, bool), np.ones(n, bool)
        if n:
            is_large = np.zeros(len(data) + 2, bool)
            is_large[large] = True
            is_large[:-2] |= (data >= 65) & (data <= 90)
            behind = words.start + np.where(data[words.start] >= 0xC2, 2, 1)
            shout = (behind < words.end) & is_large[behind]  # in running capitals a capital marks no name
            name = is_large[words.start] & ~shout & ~number & ~np.isin(self.value, _OPENER_HASHES)
            fresh = np.zeros(n + 1, bool)
            fresh[words.doc_words[:-1]] = True
            gap = np.append(0, words.start[1:] - words.end[:-1])
            between = np.append(0, data[words.end[:-1]] if n > 1 else [])
            same = ~fresh[:n]
            before = lambda x: np.append(False, x[:-1])
            group = same & number & before(number) & (gap == 1) & ((between == 44) | (between == 46))
            unit[1:] = np.isin(self.value[1:], _UNIT_HASHES) & number[:-1] & same[1:] & (gap[1:] == 1)
            new = ~(group | unit | (same & name & before(name) & (gap == 1) & (between == 32)))
        self.first = np.flatnonzero(new)
        inside = np.arange(n) - self.first[np.cumsum(new) - 1] if n else np.zeros(0, np.int64)
        whole_value = np.add.reduceat(mix(self.value ^ (inside.astype(np.uint64) * EXACT)), self.first) if n else self.value
        slot = (number | name)[self.first]
        self.slot = np.where(slot, whole_value | U64(1), U64(0))
        self.symbol = self.value[self.first]
        self.symbol[number[self.first]] = NUMBER
        self.symbol[name[self.first]] = NAME
        self.literal = np.concatenate([[0], np.cumsum(~slot)])
        self.doc_symbols = np.searchsorted(self.first, words.doc_words)

    def windows(self, length: int, literals: int, *, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first symbol, or word where exact, and hash) of the windows that lie in one text and hold enough literal words."""
        h = grams(self.value if exact else self.symbol, length)
        ok = whole(self.words.doc_words if exact else self.doc_symbols, length)
        if not len(ok):
            return np.zeros(0, np.int64), h[:0]
        if not exact:
            ok &= self.literal[length : len(ok) + length] - self.literal[: len(ok)] >= literals
        at = np.flatnonzero(ok)
        return at, mix((h[at] ^ EXACT if exact else h[at]) + U64(length))


_UNIT_HASHES, _OPENER_HASHES = _hash(UNITS), _hash(OPENERS)
#: _at: the window's first symbol. _from, _to: its words. _size: the text's words. _values: the slots of its symbols, 0 for literal ones.
_HITS = "_w long, _k long, _id long, _at int, _from int, _to int, _size int, _values binary, _n int, _exact boolean"


def _emit(t: Templates, at: np.ndarray, h: np.ndarray, length: int, keys: np.ndarray, ids: np.ndarray, *, exact: bool) -> pa.RecordBatch:
    """One row for each window."""
    ends = np.append(t.first, len(t.words))
    if exact:
        symbol, last = np.searchsorted(t.first, at, "right") - 1, np.searchsorted(ends, at + length, "right") - 1
        lo = np.searchsorted(t.first, at)  # symbols that lie in the window whole
        hi, word, stop = np.maximum(last, lo), at, at + length
    else:
        symbol, lo, hi, word, stop = at, at, at + length, t.first[at], ends[at + length]
    doc = np.searchsorted(t.words.doc_words, word, "right") - 1
    base, per = t.words.doc_words[doc], hi - lo
    packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(per * 8)]).astype(np.int32)), pa.py_buffer(t.slot[ranges(lo, per)])])
    whole_numbers = [symbol - t.doc_symbols[doc], word - base, stop - base, np.diff(t.words.doc_words)[doc]]
    made = [pa.array(h.view(np.int64)), pa.array(keys[doc]), pa.array(ids[doc]), *(pa.array(x.astype(np.int32)) for x in whole_numbers), packed, pa.array(np.full(len(at), length, np.int32)), pa.array(np.full(len(at), exact))]
    return pa.RecordBatch.from_arrays(made, ["_w", "_k", "_id", "_at", "_from", "_to", "_size", "_values", "_n", "_exact"])


def _scan(lengths: list[tuple[int, bool]], bitmap: np.ndarray | None, *, items: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch["text"])
            keys, ids = batch["_k"].to_numpy(zero_copy_only=False), batch["_id"].to_numpy(zero_copy_only=False)
            for lo, hi in slices(offsets, CHUNK):
                t = Templates(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for n, exact in lengths:
                    edges = t.words.doc_words if exact else t.doc_symbols
                    at, h = t.windows(n, MIN_LITERAL, exact=exact)
                    if items and len(at):  # a shorter window only where it is the whole item
                        mine = (np.diff(edges)[np.searchsorted(edges, at, "right") - 1] == n) | (n >= WINDOW)
                        at, h = at[mine], h[mine]
                    if bitmap is not None and len(at):
                        b = (h >> U64(64 - BITMAP_BITS)).astype(np.int64)
                        mine = (bitmap[b >> 3] >> (b & 7).astype(np.uint8)) & 1 > 0
                        at, h = at[mine], h[mine]
                    if exact and not items and n < WINDOW and len(at):  # the whole item: one place of a document is enough
                        doc = np.searchsorted(edges, at, "right") - 1
                        order = np.lexsort((at, h, doc))
                        mine = np.sort(order[starts(doc[order], h[order])])
                        at, h = at[mine], h[mine]
                    if len(at):
                        yield _emit(t, at, h, n, keys[lo:hi], ids[lo:hi], exact=exact)

    return run


def _unlike(group: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of n groups, those in which some a goes with several b."""
    out = np.zeros(n, bool)
    order = np.lexsort((b, a, group))
    g, a, b = group[order], a[order], b[order]
    out[g[1:][(g[1:] == g[:-1]) & (a[1:] == a[:-1]) & (b[1:] != b[:-1])]] = True
    return out


_PAIR = "_pair long, _k long, _id long, _item long, _at int, _item_at int, _item_from int, _item_to int, _item_size int, _values binary, _item_values binary, _exact boolean"


def _judge(coverage: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of hits sorted by pair of document and item: the share of the item's words that alignments with consistent slots cover."""

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        col = {c: t[c].to_numpy() for c in ("_pair", "_k", "_id", "_item", "_at", "_item_at", "_item_from", "_item_to", "_item_size")}
        exact = t["_exact"].to_numpy(zero_copy_only=False).astype(bool)
        first = starts(col["_pair"])
        pair = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(exact))))
        shift = col["_at"].astype(np.int64) - col["_item_at"]
        order = np.lexsort((shift, pair))
        alignment = np.empty(len(exact), np.int64)
        new = np.zeros(len(exact), np.int64)
        new[starts(pair[order], shift[order])] = 1
        alignment[order] = np.cumsum(new) - 1
        m = int(new.sum())
        (ours, _), (theirs, at) = buffers(t["_values"]), buffers(t["_item_values"])
        per = np.diff(at) // 8
        v = theirs.view(np.uint64)
        w = v.copy()  # what is verbatim stands for itself
        there = ~np.repeat(exact, per)
        mine, oat = ours.view(np.uint64), buffers(t["_values"])[1] // 8
        w[there] = mine[ranges(oat[:-1][~exact], per[~exact])]
        row = np.repeat(np.arange(len(exact)), per)
        slot = v != 0
        v, w, row, there = v[slot], w[slot], row[slot], there[slot]
        bad = [_unlike(alignment[row[on]], v[on], w[on], m) | _unlike(alignment[row[on]], w[on], v[on], m) for on in (np.ones(len(row), bool), there)]
        counts = np.where(exact, ~bad[0][alignment], ~bad[1][alignment])
        size = col["_item_size"][first].astype(np.int64)
        base = np.cumsum(size + 1) - size - 1
        marks = np.zeros(int((size + 1).sum()) + 1, np.int32)
        np.add.at(marks, base[pair[counts]] + col["_item_from"][counts], 1)
        np.add.at(marks, base[pair[counts]] + col["_item_to"][counts], -1)
        share = np.add.reduceat((np.cumsum(marks) > 0).astype(np.int64), base) / np.maximum(size, 1)
        on = np.flatnonzero(share >= coverage)
        yield pa.RecordBatch.from_arrays([*(pa.array(col[c][first[on]]) for c in ("_k", "_id", "_item")), pa.array(share[on])], ["_k", "_id", "_item", "covered"])

    return lambda batches: by_run(batches, "_pair", flush)


def matches(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE) -> DataFrame:
    """(_k, _id, _item, covered): pairs of document and item, and the share of the item's words in consistent windows."""
    items = identified(benchmark.select(F.col("item_id").alias("doc_id"), "text")).dropDuplicates(["_k", "_id"])
    theirs = items.mapInArrow(_scan([(n, False) for n in range(MIN_ITEM, WINDOW + 1)] + [(n, True) for n in range(1, WINDOW + 1)], None, items=True), _HITS)
    theirs = written(theirs, "benchmark-windows")
    bucket = F.shiftrightunsigned("_w", 64 - BITMAP_BITS).cast("int")
    known = theirs.select(bucket.alias("b"), "_n", "_exact").distinct().toArrow()  # at most 2 ** BITMAP_BITS for each length and kind
    bits = np.zeros(1 << BITMAP_BITS, np.uint8)
    bits[known["b"].to_numpy()] = 1
    shipped = docs.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))
    lengths = sorted(set(zip(known["_n"].to_pylist(), known["_exact"].to_pylist(), strict=True)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scan(lengths, shipped.value, items=False)(batches)

    ours = identified(docs).mapInArrow(scan, _HITS).select("_w", "_k", "_id", "_at", "_values", "_n", "_exact")
    theirs = theirs.select("_w", F.col("_k").alias("_item_key"), F.col("_id").alias("_item"), *(F.col(c).alias(f"_item{c}") for c in ("_at", "_from", "_to", "_size", "_values")), "_n", "_exact")
    pairs = ours.join(small(theirs), ["_w", "_n", "_exact"]).withColumn("_pair", F.xxhash64("_k", "_id", "_item", "_item_key"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.selectExpr(*[x.split()[0] for x in _PAIR.split(", ")]).repartition(parts, "_pair").sortWithinPartitions("_pair")
    return pairs.mapInArrow(_judge(coverage), "_k long, _id long, _item long, covered double")


def find(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, covered) of each contaminated document and item."""
    shown = [F.when(F.col(c) != NULL_ID, F.col(c)).alias(name) for c, name in (("_id", "doc_id"), ("_item", "item_id"))]
    return matches(docs, benchmark, coverage=coverage).select(*shown, F.round("covered", 6).alias("covered"))


def clean(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE) -> DataFrame:
    """The documents that no item contaminates, columns unchanged."""
    return without(docs, matches(docs, benchmark, coverage=coverage))
