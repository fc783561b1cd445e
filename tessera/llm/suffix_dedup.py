"""Suffix-array deduplication: passages of LENGTH words or more that occur before, by two-stage sorting.

Suffixes that aren't smaller than their successor's bucket are sorted directly; all others
are induced by scanning the buckets in order. The common prefixes of neighbours in the suffix
array then show which windows of words are equal; all but the first occurrence repeat.

A window repeats if the same words, in the same order, stand earlier in the corpus: in a
document with a smaller doc_id (null first), or earlier in the same document. Words are the
runs between ASCII white space, so line breaks and spacing don't matter. Null and empty texts
and texts shorter than a window have no repeats; very long texts are taken whole. Rows equal in
doc_id and text count as one document; of texts tied at one doc_id the one with the lesser row
key comes first. doc_id must be an integer (else TypeError). Other columns, clashing names
included, are ignored (find) or kept (remove). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import NULL_ID, keyed
from tessera.llm.repeats import Group, repeats, runs
from tessera.llm.text import NOT_SPACE, U64, Words, grams

#: Words of the shortest passage that counts as repeated.
LENGTH = 40


def direct_sort(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Suffixes at these positions (ascending), sorted by their first words; ties stay in order.

    Two words a round, and only within what is still tied; a tie of suffixes whose windows are
    equal throughout is left alone.
    """
    pair = np.ndarray((len(text) - 1,), "<u8", text, strides=(4,))
    full = grams(text.astype(np.uint64), length)

    def key(p: np.ndarray) -> np.ndarray:
        v = pair[p]
        return (v << U64(32)) | (v >> U64(32))

    k = key(at)
    order = np.argsort(k, kind="stable")
    at, k = at[order], k[order]
    group = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])]) if len(at) else np.zeros(0, np.int64)
    slot = np.arange(len(at))
    for depth in range(2, length, 2):
        if not len(slot):
            break
        p = at[slot]
        w = full[np.minimum(p, len(full) - 1)]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        mixed = np.add.reduceat(np.concatenate([[False], w[1:] != w[:-1]]) & np.concatenate([[False], group[1:] == group[:-1]]), starts) > 0
        live = np.repeat(mixed, np.diff(np.append(starts, len(slot))))
        slot, p, group = slot[live], p[live], group[live]
        if not len(slot):
            break
        k = key(np.minimum(p + depth, len(pair) - 1))
        order = np.lexsort((k, group))
        p, k, group = p[order], k[order], group[order]
        at[slot] = p
        group = np.concatenate([[0], np.cumsum((group[1:] != group[:-1]) | (k[1:] != k[:-1]))])
    return at


def suffix_array(text: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """The windows' positions in the order of the suffixes that start there, to ``length`` words.

    Buckets go by a word's leading byte. A suffix whose bucket lies above its successor's is
    induced: once the successor's bucket is in order, so is the order of those before it.
    """
    bucket = (text >> np.uint32(24)).astype(np.uint8)
    induced = np.append(bucket[:-1] > bucket[1:], False)
    needed = np.zeros(len(text), bool)
    needed[windows] = True
    step = windows
    while len(step):
        step = step[induced[step]] + 1
        step = step[~needed[step]]
        needed[step] = True
    placed = direct_sort(text, np.flatnonzero(needed & ~induced), length)
    edges = np.searchsorted(bucket[placed], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for b in range(256):
        part = placed[edges[b] : edges[b + 1]]
        if waiting[b]:
            mine = np.concatenate(waiting[b])
            both = np.concatenate([mine, part])
            rank = text[both].astype(np.uint64) << U64(1)
            rank[len(mine) :] |= U64(1)
            part = both[np.argsort(rank, kind="stable")]
        out.append(part)
        before = part[part > 0] - 1
        before = before[needed[before] & induced[before]]
        if len(before):
            to = bucket[before]
            order = np.argsort(to, kind="stable")
            counts = np.bincount(to, minlength=256)
            for c, chunk in zip(np.flatnonzero(counts), np.split(before[order], np.cumsum(counts[counts > 0])[:-1]), strict=True):
                waiting[c].append(chunk)
    order = np.concatenate(out)
    starts = np.zeros(len(text), bool)
    starts[windows] = True
    return order[starts[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Words that each suffix shares with the one before it in the array, ``length`` at most."""
    out = np.zeros(len(order), np.int32)
    live = np.arange(1, len(order))
    for depth in range(length):
        live = live[text[order[live] + depth] == text[order[live - 1] + depth]]
        out[live] += 1
    return out


def earlier(group: Group, length: int) -> tuple[np.ndarray, np.ndarray, None, np.ndarray]:
    """Runs of the group's windows whose words stand earlier, and their mask."""
    out = np.zeros(len(group.windows), bool)
    if len(group.windows) > 1:
        order = suffix_array(group.text, group.windows, length)
        group_of = np.cumsum(common_prefixes(group.text, order, length) < length)
        h = grams(group.full(), length)[order]  # neighbours alike in 32 bits of every word must be so in 48
        order = order[np.lexsort((order, h, group_of))]
        h = grams(group.full(), length)[order]
        new = np.append(True, (np.diff(group_of) != 0) | (h[1:] != h[:-1]))
        first = np.minimum.reduceat(order, np.flatnonzero(new))
        again = order != np.repeat(first, np.diff(np.append(np.flatnonzero(new), len(order))))
        out[np.searchsorted(group.windows, order[again])] = True
    first, last = runs(group, out)
    return first, last, None, out


def find(docs: DataFrame, *, length: int = LENGTH, **limits: int) -> DataFrame:
    """(doc_id, spans, n_words): each document with repeats, the spans of words [start, end) and their total."""
    found = repeats(docs, length, earlier, **limits)
    total = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.when(F.col("_id") != NULL_ID, F.col("_id")).alias("doc_id"), F.col("_spans").alias("spans"), total.alias("n_words"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the spans; the white space before a span stays, that behind it goes."""
    for batch in batches:
        texts, spans = batch["_text"].to_pylist(), batch["_spans"].to_pylist()
        for i, s in enumerate(spans):
            if s:
                raw = texts[i].encode()
                words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), NOT_SPACE)
                keep, done = [], 0
                for x in s:
                    keep.append(raw[done : words.start[x["start"]]])
                    done = words.start[x["end"]] if x["end"] < len(words) else len(raw)
                texts[i] = b"".join([*keep, raw[done:]]).decode()
        yield pa.RecordBatch.from_arrays([batch["_row"], pa.array(texts, pa.string())], ["_row", "_text"])


def remove(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """docs without their repeated passages; documents of which no word is left go. n_chars, where there is one, is set anew."""
    found = repeats(docs, length, earlier)
    out = keyed(docs).join(found, ["_k", "_id"], "left").withColumn("_text", F.col("_row.text"))
    cut = out.where("_spans is not null").select("_row", "_text", "_spans").mapInArrow(_cut, T.StructType([out.schema["_row"], out.schema["_text"]]))
    new = {"text": F.col("_text"), "n_chars": F.length("_text")}
    cells = [(new[c] if c in new else F.col("_row").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns]
    return out.where("_spans is null").select("_row.*").union(cut.where(r"_text rlike '\\S'").select(*cells))
