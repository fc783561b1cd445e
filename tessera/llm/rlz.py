"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is all text before a document, and before a place within it. It is indexed in
groups of blocks with common minimizers (see repeats.py): a suffix array over all words of a
group. Every place's longest match is with one of its two neighbours in the array among the
suffixes that stand earlier in the corpus. The parse of a block is greedy: from each place on the
longest match is a factor, a match shorter than LEAST words a literal. A factor that ends at the
edge of a block goes on in the next one where both copy from the same place on.

Factors of LENGTH words or more become spans, joined where they touch. At the end of every factor
the matches that straddle it are checked too, so that no long match is lost between two factors.
A text region whose minimizer occurs once in the corpus can't hold a long match: it stays literal
without being parsed.

What counts as a repeat is as in suffix_dedup.py: a span is covered by windows of LENGTH words
that stand earlier, by (doc_id with null first, row key, place). Null and empty texts and texts
shorter than a window have no spans; very long texts are taken whole. Rows equal in doc_id and
text count as one document. doc_id must be an integer (else TypeError). Other columns, clashing
names included, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import NULL_ID
from tessera.llm.repeats import Group, found, merged
from tessera.llm.text import ranges

#: Words of the shortest factor that counts as a duplicate.
LENGTH = 40
#: Words of the shortest factor that isn't left as literals.
LEAST = 8


def ranks(words: np.ndarray) -> list[np.ndarray]:
    """By prefix doubling: for each k the rank of the 2 ** k words from each place on, until all differ. 0 matches nothing, itself included."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    new = np.append(True, (words[order][1:] != words[order][:-1]) | (words[order][1:] == 0))
    rank = np.empty(n, np.int64)
    start = np.flatnonzero(new)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    out = [rank.astype(np.int32)]
    live = order[np.repeat(np.diff(np.append(start, n)) > 1, np.diff(np.append(start, n)))]  # places whose rank others have
    depth = 1
    while len(live) and depth < n:
        behind = np.minimum(live + depth, n - 1)
        key = (rank[live].astype(np.uint64) << np.uint64(32)) | rank[behind].astype(np.uint64)
        o = np.argsort(key, kind="stable")
        live, key = live[o], key[o]
        high = key >> np.uint64(32)
        group = np.append(True, high[1:] != high[:-1])
        new = np.append(True, key[1:] != key[:-1])
        base = np.maximum.accumulate(np.where(group, np.arange(len(live)), 0))
        start = np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))
        rank = rank.copy()
        rank[live] = high.astype(np.int64) + start - base
        out.append(rank.astype(np.int32))
        size = np.diff(np.append(np.flatnonzero(new), len(live)))
        live = live[np.repeat(size > 1, size)]
        depth *= 2
    return out


def nearest(time: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it in order with less time; -1 if there is none."""
    t = np.append(time[order], -1)  # the last stands for none
    n = len(order)
    to = np.arange(-1, n - 1)
    to[0] = n
    to = np.append(to, n)
    live = np.flatnonzero(t[to[:n]] >= t[:n])
    while len(live):
        to[live] = to[to[live]]
        live = live[t[to[live]] >= t[live]]
    out = np.full(n, -1)
    has = to[:n] < n
    out[order[has]] = order[to[:n][has]]
    return out


def longest(group: Group) -> tuple[np.ndarray, np.ndarray]:
    """(words, source) of the longest earlier match from each place of the group's text on; time goes by document and place, so that a block doesn't match its own overlap with the next."""
    words = group.full()
    n = len(words)
    level = ranks(words)
    doc = np.zeros(len(group.k), np.int64)
    o = np.lexsort((group.k, group.id))
    doc[o] = np.cumsum(np.append(False, (group.k[o][1:] != group.k[o][:-1]) | (group.id[o][1:] != group.id[o][:-1])))
    time = np.full(n, np.iinfo(np.int64).max)
    inside = ranges(group.start, group.size)
    time[inside] = np.repeat((doc << 32) + group.at - group.start, group.size) + inside
    order = np.argsort(level[-1], kind="stable")
    best, source = np.zeros(n, np.int64), np.full(n, -1)
    for near in (nearest(time, order), nearest(time, order[::-1])):
        at = np.flatnonzero((near >= 0) & (words != 0))
        other, size = near[at], np.zeros(len(at), np.int64)
        for k in range(len(level) - 1, -1, -1):
            same = level[k][np.minimum(at + size, n - 1)] == level[k][np.minimum(other + size, n - 1)]
            size[same] += 1 << k
        more = size > best[at]
        best[at[more]], source[at[more]] = size[more], other[more]
    return best, source


def factors(group: Group, best: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(place, words) of the factors of the greedy parse; all blocks advance at once, a factor a round."""
    n = len(best)
    matched = best >= least
    following = np.minimum.accumulate(np.where(matched, np.arange(n), n)[::-1])[::-1]  # the next place with a match
    following = np.append(following, n)
    end = group.start + group.size
    cursor, out = following[group.start], []
    live = np.flatnonzero(cursor < end)
    cursor = cursor[live]
    while len(live):
        size = best[cursor]
        out.append((cursor, size))
        cursor = following[np.minimum(cursor + size, n)]
        more = cursor < end[live]
        live, cursor = live[more], cursor[more]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def parsed(group: Group, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last window, source) of the long factors and of what straddles factors' ends, and the mask of the windows inside."""
    best, source = longest(group)
    place, size = factors(group, best)
    long = size >= length
    place, size = place[long], size[long]
    inside = np.zeros(len(best) + 1, np.int32)
    np.add.at(inside, place, 1)
    np.add.at(inside, place + size - length + 1, -1)
    inside = np.cumsum(inside)[group.windows] > 0
    # the windows that no factor holds whole: those that match all the same straddle a factor's end
    straddling = ~inside & (best[group.windows] >= length)
    place = np.concatenate([place, group.windows[straddling]])
    size = np.concatenate([size, best[group.windows[straddling]]])
    first = np.searchsorted(group.windows, place)
    last = first + size - length
    return first, last, source[place], inside | straddling


def factored(docs: DataFrame, *, length: int = LENGTH, **limits: int) -> DataFrame:
    """(_k, _id, _from, _to, _sid, _sat): the long factors, each with the doc_id and place that it copies; those that go on from block to block are one."""
    parts = found(docs, length, parsed, **limits)
    order = Window.partitionBy("_k", "_id", "_sid", F.col("_from") - F.col("_sat")).orderBy("_from", "_to")
    before = F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_new", F.coalesce((F.col("_from") > before).cast("int"), F.lit(1))).withColumn("_g", F.sum("_new").over(order))
    return parts.groupBy("_k", "_id", "_sid", (F.col("_from") - F.col("_sat")).alias("_shift"), "_g").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.min("_sat").alias("_sat")).drop("_shift", "_g")


def find(docs: DataFrame, *, length: int = LENGTH, **limits: int) -> DataFrame:
    """(doc_id, spans, factors, n_words): each document with duplicate factors: their spans of words [start, end), joined; the factors with the document and word that each copies; the words in spans."""
    parts = factored(docs, length=length, **limits)
    named = parts.groupBy("_k", "_id").agg(F.sort_array(F.collect_set(F.struct(F.col("_from").alias("start"), F.col("_to").alias("end"), F.when(F.col("_sid") != NULL_ID, F.col("_sid")).alias("source_id"), F.col("_sat").alias("source_start")))).alias("factors"))
    total = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return merged(parts).join(named, ["_k", "_id"]).select(F.when(F.col("_id") != NULL_ID, F.col("_id")).alias("doc_id"), F.col("_spans").alias("spans"), "factors", total.alias("n_words"))
