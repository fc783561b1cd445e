"""Language-model scoring with class-based bigrams after Brown et al., classes by exchange clustering.

All documents are counted: first words, then pairs of neighbours. Every word that occurs twice or
more is in the vocabulary, which grows with the corpus. Its CLUSTERED most frequent words are
clustered by exchange; their keys and classes are all that is broadcast. The other words, held in
a table by hash, take the class that makes the contexts before them most likely; as a context they
are one class of their own, *rare*. Words that occur once are of the class *unknown*, whose
emissions are even over its words. A document begins in a class of its own.

Exchange clustering moves words to the class with the greatest gain in the likelihood of the
class bigrams. A round evaluates every word of one half of the clustered words against the counts
before the round (in parallel over a table of each word's neighbours, written once, a part for
each half) and then moves them together; the counts change by the moved words' pairs. It ends when two rounds, one for each half, have raised the likelihood by
less than TOLERANCE of it; the best state is kept. The state between rounds is a class for
each clustered word and a matrix of classes by classes.

P(word | before) = P(class | context before) P(word | class). Transitions are smoothed towards the
class unigrams (a Dirichlet prior of weight PRIOR), these by one count for each class; so
every probability is positive. Perplexity is exp(-mean log P) over a document's words.

Words are runs of ASCII letters and digits and of all bytes beyond ASCII, lower-cased in ASCII.
Texts without words, null and empty ones included, have 0 words and a null perplexity; very long
texts are read whole. Repeated rows count each; of words tied in count the one with the lesser hash
is the more frequent. doc_id may be of any type, nulls are kept; other columns, clashing names
(n_words, perplexity) included, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.text import ALNUM, U64, Words, buffers, by_run, ranges, slices, starts

#: So many words, the most frequent, are clustered; the others find their class when these are settled.
CLUSTERED = 131_072
CLASSES = 32
#: Two rounds that gain less than this part of the likelihood are the last.
TOLERANCE = 1e-4
PRIOR = 5.0
CHUNK = 3_000_000
#: Words or pairs that a task counts before it hands on their counts.
HELD = 3_000_000
#: So many words' neighbours are one row of the table that the rounds read.
BLOCK = 32
#: The greatest count in 16 bits.
TOP = 65_535
#: Marks a neighbour that stands before the word.
BEFORE = 1 << 31

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Model:
    """keys: sorted hashes of the clustered words; kind: each one's class, then those of rare or unknown words and of the beginning, as contexts; log-probabilities.

    emission: of the clustered words. transition: of classes (columns; the last but one is unknown)
    after contexts. size: words of each class. rare: (h, kind, n) of the other words that occur
    more than once. unknown: words that occur once.
    """

    keys: np.ndarray
    kind: np.ndarray
    emission: np.ndarray
    transition: np.ndarray
    size: np.ndarray
    rare: DataFrame
    unknown: int
    rounds: int


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(_LOWER[data], offsets, ALNUM)
    return words.hashes(), words.doc_words


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = buffers(batch["text"])
        for lo, hi in slices(offsets, CHUNK):
            yield batch.slice(lo, hi - lo), *word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _merged(held: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and the sums of their counts."""
    x, n = np.concatenate(held), np.concatenate(counts)
    order = np.argsort(x)
    x, n = x[order], n[order]
    at = starts(x)
    return x[at], np.add.reduceat(n, at, dtype=np.int64) if len(at) else n


def _counted(parts: Iterator[np.ndarray], name: str) -> Iterator[pa.RecordBatch]:
    """Distinct values and their counts, merged within the task as far as HELD goes."""
    held, counts, size = [], [], 0
    for part in parts:
        u, n = np.unique(part, return_counts=True)
        held.append(u)
        counts.append(n)
        size += len(u)
        if size > HELD:
            x, n = _merged(held, counts)
            if len(x) > HELD // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n)], [name, "n"])
                held, counts, size = [], [], 0
            else:
                held, counts, size = [x], [n], len(x)
    if held:
        x, n = _merged(held, counts)
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n)], [name, "n"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _counted((h for _, h, _ in _chunks(batches)), "h")


def identify(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in the vocabulary; len(keys) for unknown words."""
    if not len(keys):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, len(keys))


def _before(ids: np.ndarray, doc_words: np.ndarray, begin: int) -> np.ndarray:
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    first = doc_words[:-1][doc_words[1:] > doc_words[:-1]]
    out[first] = begin
    return out


def _seats(w: np.ndarray) -> np.ndarray:
    """Where words sit: BLOCK places in each block, blocks of even and of odd words in turns."""
    return (w // (2 * BLOCK) * 2 + w % 2) * BLOCK + w % (2 * BLOCK) // 2


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.append(0, ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _split(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts above 0 in 16 bits: (rows, counts); a greater count is several of the same row."""
    times = -(-n // TOP)
    row = np.repeat(np.arange(len(n)), times)
    out = np.full(len(row), TOP, np.uint16)
    out[np.cumsum(times) - 1] = n - (times - 1) * TOP
    return row, out


def _sent(seat: np.ndarray, o: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row for each block: how many entries each of its words has, their neighbours and counts."""
    row, n = _split(n)
    order = np.argsort(seat[row].astype(np.uint32))
    row = row[order]
    seat = seat[row].astype(np.int64)
    at = starts(seat // BLOCK)
    ends = np.append(at, len(seat))[1:]
    per = np.bincount(np.repeat(np.arange(len(at)), ends - at) * BLOCK + seat % BLOCK, minlength=len(at) * BLOCK).astype(np.int32)
    columns = _binary(per, np.arange(1, len(at) + 1) * BLOCK), _binary(o[row].astype(np.uint32), ends), _binary(n[order], ends)
    return pa.RecordBatch.from_arrays([pa.array((seat[at] // BLOCK).astype(np.int32)), *columns], ["block", "per", "o", "n"])


def _bigrams(shipped) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """Both words' neighbours in the pairs that the task counts: those behind a word, and, with BEFORE set, those before it, without itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shipped.value

        def pairs() -> Iterator[np.ndarray]:
            for _, h, at in _chunks(batches):
                ids = identify(keys, h)
                yield (_before(ids, at, len(keys) + 1).astype(np.uint64) << U64(32)) | ids.astype(np.uint64)

        for counted in _counted(pairs(), "p"):
            p, n = counted["p"].to_numpy(), counted["n"].to_numpy()
            a, b = p >> 32, p & 0xFFFFFFFF
            yield _sent(_seats(a), b, n)
            apart = a != b
            yield _sent(_seats(b[apart]), a[apart] | BEFORE, n[apart])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by block one row for each: per word how many words stand behind and before it and how often it follows itself; the neighbours and counts."""
    block, held, counts, size, least = -1, [], [], 0, HELD

    def row() -> pa.RecordBatch:
        x, n = _merged(held, counts)
        seat, o = block * BLOCK + (x >> U64(32)).astype(np.int64), (x & U64(0xFFFFFFFF)).astype(np.int64)
        place = seat % BLOCK
        own = np.zeros(BLOCK, np.int64)
        itself = _seats(o & ~BEFORE) == seat
        own[place[itself]] = n[itself]
        place, o = place[~itself], o[~itself]
        i, n = _split(n[~itself])
        place, o = place[i], o[i]
        per = np.bincount(place * 2 + (o >= BEFORE), minlength=2 * BLOCK).astype(np.int32)
        columns = [_binary(v, np.array([len(v)])) for v in (per, own, (o & ~BEFORE).astype(np.int32), n)]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([block % 2], pa.int32()), *columns], ["block", "half", "per", "own", "o", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch["block"].to_numpy()
        o, at = buffers(batch["o"])
        n = buffers(batch["n"])[0].view(np.uint16)
        place = np.repeat(np.tile(np.arange(BLOCK, dtype=np.uint64), len(blocks)), buffers(batch["per"])[0].view(np.int32))
        x = place << U64(32) | o.view(np.uint32)
        first = starts(blocks)
        for lo, hi in zip(at[first] // 4, at[np.append(first[1:], len(blocks))] // 4):
            now = blocks[first[0]]
            first = first[1:]
            if now != block:
                if held:
                    yield row()
                block, held, counts, size, least = int(now), [], [], 0, HELD
            held.append(x[lo:hi])
            counts.append(n[lo:hi])
            size += hi - lo
            if size > least:
                held, counts = ([v] for v in _merged(held, counts))
                size = len(held[0])
                least = 2 * size + HELD
    if held:
        yield row()


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, entries of each behind and before it, how often it follows itself, neighbours, counts) of the words below most."""
    for batch in batches:
        o, at = buffers(batch["o"])
        o, n, at = o.view(np.int32), buffers(batch["n"])[0].view(np.uint16), at // 4
        pers, owns = (buffers(batch[c])[0].view(t).reshape(batch.num_rows, -1) for c, t in (("per", np.int32), ("own", np.int64)))
        for i, block in enumerate(batch["block"].to_pylist()):
            w = (block // 2 * BLOCK + np.arange(BLOCK)) * 2 + block % 2
            w = w[w < most]
            per = pers[i].reshape(BLOCK, 2)[: len(w)]
            end = at[i] + int(per.sum())
            if len(w):
                yield w, per, owns[i, : len(w)], o[at[i] : end], n[at[i] : end]


def _sides(per: np.ndarray, o: np.ndarray, n: np.ndarray, kind: np.ndarray, k: int) -> np.ndarray:
    """Of words the counts of the classes behind (0) and before (1) them."""
    cell = np.repeat(np.arange(per.size) * k, per.ravel())
    cell += kind[o]
    return np.bincount(cell, n, per.size * k).reshape(len(per), 2, k)


def _cells(total: np.ndarray) -> pa.RecordBatch:
    on = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(np.rint(total.ravel()[on]).astype(np.int64))], ["c", "n"])


def _matrix(shipped, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """Class bigram counts of the task's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = shipped.value.astype(np.int64)
        total = np.zeros((k, k))
        for w, per, own, o, n in _blocks(batches, len(kind)):
            np.add.at(total, kind[w], _sides(per, o, n, kind, k)[:, 0])
            np.add.at(total, (kind[w], kind[w]), own)
        yield _cells(total)

    return run


def _shifts(shipped, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """What the moves of the task's words change in the class bigram counts; a pair of two moved words is counted with the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new = (x.astype(np.int64) for x in shipped.value)
        total = np.zeros((k, k))
        for w, per, own, o, n in _blocks(batches, len(old)):
            moved = np.flatnonzero(old[w] != new[w])
            if not len(moved):
                continue
            size = per.sum(1)
            take = ranges((np.cumsum(size) - size)[moved], size[moved])
            w, per, own, o, n = w[moved], per[moved], own[moved], o[take], n[take]
            before = np.repeat(np.tile([False, True], len(w)), per.ravel())
            n = np.where(before & (old[o] != new[o]), 0, n)
            for kind, sign in ((old, -1), (new, 1)):
                sides = sign * _sides(per, o, n, kind, k)
                np.add.at(total, kind[w], sides[:, 0])
                np.add.at(total.T, kind[w], sides[:, 1])
                np.add.at(total, (kind[w], kind[w]), sign * own)
        yield _cells(total)

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    y = np.maximum(x, 1.0)
    np.log(y, out=y)
    y *= x
    return y


def likelihood(matrix: np.ndarray) -> float:
    """Log-likelihood of the class bigrams, up to a term that classes don't change."""
    m = matrix.astype(np.float64)
    return float(_xlogx(m).sum() - _xlogx(m.sum(1)).sum() - _xlogx(m.sum(0)).sum())


def gains(matrix: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """For words (rows) and classes the likelihood with the word in the class, less that with it in none.

    right, left: counts of the classes behind and before each word, without the word itself;
    own: how often it follows itself. kind: its present class.
    """
    m, k = right.shape
    i = np.arange(m)
    n = np.repeat(matrix[None].astype(np.float64), m, 0)
    n[i, kind] -= right
    n[i, :, kind] -= left
    n[i, kind, kind] -= own
    c = np.arange(k)
    now = np.repeat(_xlogx(matrix.astype(np.float64))[None], m, 0)  # of n, which differs from the matrix in one row and column
    now[i, kind] = _xlogx(n[i, kind])
    now[i, :, kind] = _xlogx(n[i, :, kind])
    rows = _xlogx(n + right[:, None, :])
    rows -= now
    columns = _xlogx(n + left[:, :, None])
    columns -= now
    diagonal = n[:, c, c]
    gain = rows.sum(2) - rows[:, c, c] + columns.sum(1) - columns[:, c, c]
    gain += _xlogx(diagonal + right + left + own[:, None]) - _xlogx(diagonal)
    for marginal, size in ((n.sum(2) + left, right.sum(1) + own), (n.sum(1) + right, left.sum(1) + own)):
        gain -= _xlogx(marginal + size[:, None]) - _xlogx(marginal)
    return gain


def _moves(shipped, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """(w, c): the better classes of the task's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, matrix = shipped.value
        kind = kind.astype(np.int64)
        step = max(1, min(BLOCK, 200_000 // k**2))
        for w, per, own, o, n in _blocks(batches, len(kind) - 2):
            sides = _sides(per, o, n, kind, k)
            now = kind[w]
            gain = np.concatenate([gains(matrix, *sides[lo : lo + step].swapaxes(0, 1), own[lo : lo + step], now[lo : lo + step]) for lo in range(0, len(w), step)])[:, : k - 2]
            best = gain.argmax(1)
            i = np.arange(len(w))
            go = gain[i, best] > gain[i, now] + 1e-6
            if go.any():
                yield pa.RecordBatch.from_arrays([pa.array(w[go].astype(np.int32)), pa.array(best[go].astype(np.int32))], ["w", "c"])

    return run


def _contexts(shipped, begin: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """(h, c): each rare word with its context's class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, kind = shipped.value
        for _, h, at in _chunks(batches):
            ids = identify(keys, h)
            on = np.flatnonzero(ids == len(keys))
            context = kind[_before(ids, at, len(keys) + 1)[on]]
            yield pa.RecordBatch.from_arrays([pa.array(h[on].view(np.int64)), pa.array(context.astype(np.int32))], ["h", "c"])

    return run


def _settle(weight: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rare words' contexts sorted by word: (h, kind, n, null) of each word, its class the best by weight (contexts by the classes it may take),
    and (null, kind, n, context) sums of the task."""
    k = len(weight)
    total = np.zeros((k, k), np.int64)

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h, c = t["h"].to_numpy(), t["c"].to_numpy()
        at = starts(h)
        row = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(h))))
        n = np.bincount(row, minlength=len(at))
        seen = np.bincount(row * k + c, minlength=len(at) * k).reshape(len(at), k)
        kind = np.where(n > 1, (seen @ weight).argmax(1), k - 2)
        np.add.at(total, (c, kind[row]), 1)
        yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(kind.astype(np.int32)), pa.array(n), pa.nulls(len(at), pa.int32())], ["h", "kind", "n", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total[:] = 0
        yield from by_run(batches, "h", flush)
        c, kind = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(c), pa.int64()), pa.array(kind.astype(np.int32)), pa.array(total[c, kind]), pa.array(c.astype(np.int32))], ["h", "kind", "n", "c"])

    return run


def train(docs: DataFrame, *, clustered: int = CLUSTERED, classes: int = CLASSES, tolerance: float = TOLERANCE, prior: float = PRIOR) -> Model:
    sc = docs.sparkSession.sparkContext
    texts = docs.select("text")
    counts = texts.mapInArrow(_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counts.where("n > 1").orderBy(F.desc("n"), "h").limit(clustered).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    v, k = len(h), classes + 2
    keys = h[order]
    kind = np.empty(v + 2, np.uint16)
    kind[:v] = np.arange(v)[order] % classes
    n = n[order]
    kind[v:] = [classes, classes + 1]

    shipped = sc.broadcast(keys)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = texts.mapInArrow(_bigrams(shipped), "block int, per binary, o binary, n binary").repartition(parts, "block").sortWithinPartitions("block")
    near = written(sent.mapInArrow(_neighbours, "block int, half int, per binary, own binary, o binary, n binary"), "neighbours", "half")

    def cells(rows: DataFrame, each: Callable) -> np.ndarray:
        got = rows.mapInArrow(each, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(k * k, np.int64)
        out[got["c"].to_numpy()] = got["n"].to_numpy()
        return out.reshape(k, k)

    matrix = cells(near, _matrix(sc.broadcast(kind), k))
    best = (likelihood(matrix), kind, matrix)
    rounds = idle = 0
    while idle < 2:
        mine = near.where(F.col("half") == rounds % 2)
        got = mine.mapInArrow(_moves(sc.broadcast((kind, matrix)), k), "w int, c int").toArrow()  # a row for each clustered word at most
        rounds, idle = rounds + 1, idle + 1
        if got.num_rows:
            old, kind = kind, kind.copy()
            kind[got["w"].to_numpy()] = got["c"].to_numpy()
            matrix = matrix + cells(mine, _shifts(sc.broadcast((old, kind)), k))
            now = likelihood(matrix)
            if now > best[0] + tolerance * abs(best[0]):
                idle = 0
            best = max(best, (now, kind, matrix), key=lambda x: x[0])
    _, kind, matrix = best
    # the column of rare words, in which the clustering held them together, goes to the classes that they settle in
    size = np.bincount(kind[:v], n, k) if v else np.zeros(k)
    seen = matrix.copy()
    seen[:, classes:] = 0
    weight = np.log((seen + prior / k) / (seen.sum(0) + prior))
    contexts = texts.mapInArrow(_contexts(sc.broadcast((keys, kind)), v + 1), "h long, c int")
    settled = written(contexts.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_settle(weight[:, :classes]), "h long, kind int, n long, c int"), "rare-words")
    got = settled.where("h is null").groupBy("c", "kind").agg(F.sum("n")).toArrow()  # classes by classes
    c, to, m = (x.to_numpy() for x in got.columns)
    np.add.at(seen, (c, to), m)
    np.add.at(size, to, m)
    rare = settled.where("h is not null and n > 1").select("h", "kind", "n")
    unknown = settled.where("n = 1 and h is not null").count()
    unigram = (seen.sum(0) + 1) / (seen.sum() + k)
    transition = np.log((seen + prior * unigram) / (seen.sum(1, keepdims=True) + prior))
    emission = np.log(n / np.maximum(size[kind[:v]], 1))
    return Model(keys, kind, emission, transition, size, rare, unknown, rounds)


_PARTS = "r long, {}, n_words long, known double, h long, c int"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, perplexity)"""
    shipped = docs.sparkSession.sparkContext.broadcast((model.keys, model.kind, model.emission, model.transition))  # some bytes for each clustered word
    name = "doc_id " + docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with what the clustered words give, and one for each rare word with its context."""
        keys, kind, emission, transition = shipped.value
        emission = np.append(emission, 0)
        row = TaskContext.get().partitionId() << 40
        for batch, h, at in _chunks(batches):
            ids = identify(keys, h)
            context = kind[_before(ids, at, len(keys) + 1)]
            known = ids < len(keys)
            logs = np.where(known, transition[context, kind[ids]] + emission[ids], 0.0)
            size = np.diff(at)
            full = size > 0
            sums = np.zeros(len(size))
            sums[full] = np.add.reduceat(logs, at[:-1][full]) if full.any() else 0
            names = ["r", "doc_id", "n_words", "known", "h", "c"]
            m = len(size)
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(m)), batch["doc_id"], pa.array(size), pa.array(sums), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())], names)
            on = np.flatnonzero(~known)
            owner = row + np.repeat(np.arange(m), size)[on]
            i = len(on)
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.nulls(i, batch["doc_id"].type), pa.nulls(i, pa.int64()), pa.nulls(i, pa.float64()), pa.array(h[on].view(np.int64)), pa.array(context[on].astype(np.int32))], names)
            row += m

    # written, as row numbers are the tasks' own
    parts = written(docs.select("doc_id", "text").mapInArrow(run, _PARTS.format(name)), "scored-parts")
    k = len(model.transition)
    table = F.array(*[F.lit(float(x)) for x in model.transition.ravel()])
    size = F.array(*[F.lit(float(x)) for x in np.log(np.maximum(model.size, 1))])
    kind = F.coalesce("kind", F.lit(k - 2))
    own = F.when(F.col("kind").isNull() | (F.col("kind") == k - 2), -float(np.log(max(model.unknown, 1)))).otherwise(F.log("n") - F.get(size, kind))
    rare = parts.where("h is not null").select("r", "h", "c").join(model.rare, "h", "left").select("r", (F.get(table, F.col("c") * k + kind) + own).alias("_l"))
    sums = rare.groupBy("r").agg(F.sum("_l").alias("_l"))
    total = F.col("known") + F.coalesce("_l", F.lit(0.0))
    return parts.where("h is null").join(sums, "r", "left").select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.exp(-total / F.col("n_words"))).alias("perplexity"))


def perplexities(docs: DataFrame, **parameters: float) -> DataFrame:
    """(doc_id, n_words, perplexity) of each document under the model of all documents."""
    return score(docs, train(docs, **parameters))
