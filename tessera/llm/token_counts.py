"""Edit-aware token counts: pre-token segment trees, re-encoded only where edits touch them.

trees() builds a segment tree for every document: its leaves are blocks of BLOCK pre-tokens with
their widths (in characters) and token counts, its inner nodes sums of both. The tree is stored
beside the text, in packed columns, and opened without being built again. recount() applies a log
of edits in order and reads the new total off the root: an edit finds its place by descending the
sums, re-encodes from the last pre-token that it can't reach (the pattern looks LOOK characters
ahead) to the first boundary behind it where old and new pre-tokens meet again, and updates the
sums on the way up. The edited text and tree come out, so that the next log starts from them.

An edit (start, end, insert) replaces the characters [start, end) of the text as it stands then;
places beyond the end mean the end, negative ones 0, an end before the start the start, nulls 0
or empty; a null edit does nothing. Null texts have null counts and trees and take no edits; empty
texts have 0 tokens and can be inserted into; very long texts are one tree each. Repeated and tied
rows are counted each; doc_id may be of any type, or missing. Other columns are kept, those named
as an output column are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import PATTERN, VOCABULARY, Encoder, Leaves, opened, ship
from tessera.llm.text import buffers, ranges, slices

CHUNK = 3_000_000
#: Pre-tokens of a leaf of the tree.
BLOCK = 64
#: Characters behind a pre-token that its extent may depend on.
LOOK = 2
Edit = tuple[int, int, str]


def build(widths: np.ndarray, tokens: np.ndarray, words: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(pre-tokens of each block, sums) of several texts' trees; words: n_texts + 1 offsets into the pre-tokens.

    sums: for a tree of 2 ** k blocks 2 ** (k + 1) widths and as many counts, the root at 1, the children of i at 2 i and 2 i + 1.
    """
    per = np.diff(words)
    n = np.maximum(1, -(-per // BLOCK))
    ends = np.cumsum(n)
    leaves = np.full(int(ends[-1]) if len(ends) else 0, BLOCK, np.uint32)
    if len(ends):
        leaves[ends - 1] = per - (n - 1) * BLOCK
    cut = np.concatenate([[0], np.cumsum(leaves, dtype=np.int64)])
    low = [np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[cut]) for x in (widths, tokens)]
    size = 1 << np.ceil(np.log2(n)).astype(np.int64)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(per)
    for s in np.unique(size).tolist():
        mine = np.flatnonzero(size == s)
        tree = np.zeros((len(mine), 2, 2 * s), np.int64)
        row, col = np.repeat(np.arange(len(mine)), n[mine]), ranges(np.zeros(len(mine), np.int64), n[mine])
        at = ranges(ends[mine] - n[mine], n[mine])
        tree[row, 0, s + col], tree[row, 1, s + col] = low[0][at], low[1][at]
        level = s
        while level > 1:
            tree[:, :, level // 2 : level] = tree[:, :, level : 2 * level : 2] + tree[:, :, level + 1 : 2 * level : 2]
            level //= 2
        for i, x in zip(mine.tolist(), tree.reshape(len(mine), 4 * s), strict=True):
            out[i] = x
    return np.split(leaves, ends[:-1]) if len(ends) else [], out


class Tree:
    """A stored segment tree over blocks of pre-tokens; only blocks that edits touch are taken out of its arrays."""

    def __init__(self, text: str, widths: np.ndarray, tokens: np.ndarray, leaves: np.ndarray, sums: np.ndarray, enc: Encoder):
        import regex

        self.enc, self.find = enc, regex.compile(PATTERN).finditer
        self.reencoded = 0
        self._open(text, widths, tokens, leaves, sums)

    def _open(self, text: str, widths: np.ndarray, tokens: np.ndarray, leaves: np.ndarray, sums: np.ndarray) -> None:
        self.base, self.widths, self.tokens, self.leaves = text, widths, tokens, leaves
        self.size = len(sums) // 4
        self.at = np.concatenate([[0], np.cumsum(leaves, dtype=np.int64)])
        self.start = np.concatenate([[0], np.cumsum(sums[self.size : self.size + len(leaves)])])
        self.width, self.count = sums[: 2 * self.size].tolist(), sums[2 * self.size :].tolist()
        self.changed: dict[int, tuple[str, list[int], list[int]]] = {}

    def block(self, b: int) -> tuple[str, list[int], list[int]]:
        if b in self.changed:
            return self.changed[b]
        if b >= len(self.leaves):
            return "", [], []
        mine = slice(int(self.at[b]), int(self.at[b + 1]))
        return self.base[self.start[b] : self.start[b + 1]], self.widths[mine].tolist(), self.tokens[mine].tolist()

    def _sum(self, i: int) -> None:
        self.width[i] = self.width[2 * i] + self.width[2 * i + 1]
        self.count[i] = self.count[2 * i] + self.count[2 * i + 1]

    def _set(self, b: int, block: tuple[str, list[int], list[int]]) -> None:
        self.changed[b] = block
        i = self.size + b
        self.width[i], self.count[i] = len(block[0]), sum(block[2])
        while i > 1:
            i //= 2
            self._sum(i)

    def _descend(self, at: int) -> tuple[int, int]:
        """(block, its first character) that holds character ``at``; the last one with text if none does."""
        i, base = 1, 0
        while i < self.size:
            i *= 2
            if at - base >= self.width[i] and self.width[i + 1]:
                base += self.width[i]
                i += 1
        return i - self.size, base

    def _pieces(self, text: str) -> list[int]:
        return [m.end() - m.start() for m in self.find(text)]

    def packed(self) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, widths, tokens, pre-tokens of each block, sums) as the edits left them; what they didn't touch is copied in one go."""
        texts, arrays, leaves, done, n = [], ([], []), self.leaves.astype(np.uint32), 0, len(self.leaves)
        if (most := max(self.changed, default=-1) + 1) > n:
            leaves = np.concatenate([leaves, np.zeros(most - n, np.uint32)])
        for b in [*sorted(self.changed), None]:
            upto = n if b is None else min(b, n)
            if upto > done:
                texts.append(self.base[self.start[done] : self.start[upto]])
                for to, x in zip(arrays, (self.widths, self.tokens), strict=True):
                    to.append(x[self.at[done] : self.at[upto]])
            if b is not None:
                t, w, c = self.changed[b]
                texts.append(t)
                arrays[0].append(np.array(w, np.uint32))
                arrays[1].append(np.array(c, np.uint32))
                leaves[b] = len(w)
                done = max(done, b + 1)
        widths, tokens = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in arrays)
        return "".join(texts), widths, tokens, leaves, np.array(self.width + self.count, np.int64)

    def edit(self, start: int | None, end: int | None, insert: str | None) -> None:
        total = self.width[1]
        start = min(max(start or 0, 0), total)
        end = min(max(end or 0, start), total)
        first, base = self._descend(max(start - LOOK, 0))
        if first and base > max(start - LOOK, 0) - 1:  # the pre-token before may look into the edit
            first, base = self._descend(base - 1)
        last, last_base = self._descend(end)
        text, widths, tokens = "", [], []
        for b in range(first, last + 1):
            t, w, c = self.block(b)
            text, widths, tokens = text + t, widths + w, tokens + c
        # what ends LOOK characters before the edit or earlier stays
        keep, at = 0, 0
        while keep < len(widths) and at + widths[keep] + LOOK <= start - base:
            at += widths[keep]
            keep += 1
        more = last + 1
        while True:
            new = text[at : start - base] + (insert or "") + text[end - base :]
            complete = more >= self.size or base + len(text) >= total
            shift = len(insert or "") - (end - start)
            old = {}  # the old boundaries behind the edit, where they are now
            p = 0
            for k, w in enumerate(widths):
                if p >= end - base:
                    old[p - at + shift] = k
                p += w
            pieces, p, meet = self._pieces(new), 0, None
            done = start - base - at + len(insert or "")
            kept = []
            for w in pieces:
                if p >= done and p in old:
                    meet = old[p]
                    break
                if p + w + LOOK > len(new) and not complete:
                    break
                kept.append(w)
                p += w
            if meet is not None or (complete and p == len(new)):
                break
            t, w, c = self.block(more)
            text, widths, tokens = text + t, widths + w, tokens + c
            more += 1
        middle = new[:p]
        raw = np.frombuffer(middle.encode(), np.uint8)
        ends, where = np.cumsum(kept), [len(x) for x in (middle[a : a + w].encode() for a, w in zip(np.cumsum([0, *kept]).tolist(), kept, strict=False))]
        leaves = Leaves.__new__(Leaves)
        leaves.data = np.concatenate([raw, np.zeros(16, np.uint8)])
        leaves.end = np.cumsum(where, dtype=np.int64)
        leaves.start = leaves.end - np.array(where, np.int64)
        fresh = self.enc.counts(leaves).tolist() if len(ends) else []
        self.reencoded += len(kept)
        tail = len(widths) if meet is None else meet
        behind = new[p:]
        block = (text[:at] + middle + behind, widths[:keep] + kept + widths[tail:], tokens[:keep] + fresh + tokens[tail:])
        for b in range(first + 1, min(more, self.size)):
            self._set(b, ("", [], []))
        self._set(first, block)
        if len(block[1]) > 16 * BLOCK:  # even blocks again
            text, widths, tokens, _, _ = self.packed()
            (leaves,), (sums,) = build(widths, tokens, np.array([0, len(widths)]))
            self._open(text, widths, tokens, leaves, sums)

    @property
    def total(self) -> int:
        return self.count[1]


def _others(docs: DataFrame, *names: str) -> list[str]:
    return [c for c in docs.columns if c.lower() not in names]


def _fields(df: DataFrame, keep: list[str], rest: str) -> str:
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), rest])


STORED = ("widths", "tokens", "leaves", "sums")
_STORED = "widths binary, tokens binary, leaves binary, sums binary"


def _cells(parts: list[np.ndarray] | np.ndarray, at: np.ndarray | None = None) -> pa.Array:
    """Binary cells: each part's bytes, or those of the values between offsets."""
    if at is None:
        at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        parts = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * parts.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(parts))]).cast(pa.binary())


def trees(docs: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with each text's tree: ``widths`` and ``tokens`` of its pre-tokens, ``leaves`` (pre-tokens of each block; packed 32-bit integers) and ``sums`` (64-bit)."""
    keep = _others(docs, *STORED)
    shipped = ship(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = opened(shipped)
        for batch in batches:
            data, offsets = buffers(batch["text"])
            for lo, hi in slices(offsets, CHUNK):
                words = Leaves(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                widths, tokens = words.characters.astype(np.uint32), enc.counts(words).astype(np.uint32)
                leaves, sums = build(widths, tokens, words.doc_words)
                part = batch.slice(lo, hi - lo)
                valid = part["text"].is_valid()
                made = [pc.if_else(valid, x, None) for x in (_cells(widths, words.doc_words), _cells(tokens, words.doc_words), _cells(leaves), _cells(sums))]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), *made], [*keep, *STORED])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, _fields(docs, keep, _STORED))


_PERSONAL = re.compile(r"(?P<EMAIL>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)|(?P<PHONE>\+\d{1,3} \(\d{3}\) \d{3}-\d{4})|(?P<CARD>(?<!\d)\d{16}(?!\d))|(?P<LINE>(?<=\n)(?P<line>[^\n]{20,}\n)(?=(?P=line)))")


def redactions(text: str) -> list[Edit]:
    """Personal data become placeholders; of lines that follow themselves one stays."""
    out, shift = [], 0
    for m in _PERSONAL.finditer(text) if "@" in text or "\n" in text or any(map(text.__contains__, "0123456789")) else ():
        insert = "" if m.lastgroup in ("LINE", "line") else f"<{m.lastgroup}>"
        out.append((m.start() + shift, m.end() + shift, insert))
        shift += len(insert) - (m.end() - m.start())
    return out


_COUNTS = ("n_tokens", "n_edits", "n_tokens_edited", "n_reencoded")


def recount(trees: DataFrame, editor: Callable[[str], list[Edit]] | None = None, *, vocabulary: str = VOCABULARY, keep_trees: bool = True) -> DataFrame:
    """trees' other columns with n_tokens, n_edits, n_tokens_edited and n_reencoded (pre-tokens), and (keep_trees) the edited text and tree for the next log.

    Edits come from the column ``edits`` (array<struct<start, end, insert>>), which goes, or from ``editor``.
    """
    keep = _others(trees, "text", "edits", *STORED, *_COUNTS)
    shipped = ship(trees.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = opened(shipped)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                n = batch.num_rows
                valid = batch["text"].is_valid()
                stored = [buffers(batch[c]) for c in STORED]
                (widths, wat), (tokens, tat), (leaves, lat), (sums, sat) = ((x.view(k), at // k().itemsize) for (x, at), k in zip(stored, (np.uint32, np.uint32, np.uint32, np.int64), strict=True))
                size = np.diff(sat) // 4
                before = np.where(size > 0, sums[np.minimum(sat[:-1] + 2 * size + 1, max(len(sums) - 1, 0))], 0) if len(sums) else np.zeros(n, np.int64)  # the roots
                after, done, again = before.copy(), np.zeros(n, np.int32), np.zeros(n, np.int32)
                texts = batch["text"].to_pylist()
                logs = None if editor else batch["edits"].to_pylist()
                changed: dict[int, tuple] = {}
                for i, t in enumerate(texts):
                    if t is None:
                        continue
                    log = editor(t) if editor else [(e["start"], e["end"], e["insert"]) for e in logs[i] or () if e is not None]
                    if log:
                        tree = Tree(t, widths[wat[i] : wat[i + 1]], tokens[tat[i] : tat[i + 1]], leaves[lat[i] : lat[i + 1]], sums[sat[i] : sat[i + 1]], enc)
                        for e in log:
                            tree.edit(*e)
                        after[i], done[i], again[i] = tree.total, len(log), tree.reencoded
                        if keep_trees:
                            changed[i] = tree.packed()
                made = [pc.if_else(valid, pa.array(x), None) for x in (before, done, after, again)]
                names = [*keep, *_COUNTS]
                if keep_trees:
                    parts = [[changed[i][j + 1] if i in changed else x[at[i] : at[i + 1]] for i in range(n)] for j, (x, at) in enumerate(((widths, wat), (tokens, tat), (leaves, lat), (sums, sat)))]
                    made += [pa.array([changed[i][0] if i in changed else t for i, t in enumerate(texts)], pa.string()), *(pc.if_else(valid, _cells(x), None) for x in parts)]
                    names += ["text", *STORED]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *made], names)

    cols = [*keep, "text", *STORED, *([] if editor else ["edits"])]
    rest = "n_tokens long, n_edits int, n_tokens_edited long, n_reencoded int" + (f", text string, {_STORED}" if keep_trees else "")
    return trees.select(*[F.col(f"`{c}`") for c in cols]).mapInArrow(run, _fields(trees, keep, rest))
