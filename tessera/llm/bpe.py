"""Vectorised byte-pair encoding: pre-tokens are found and looked up for whole batches at a time.

Pre-tokens follow the public byte-level pattern (contractions; runs of letters, of digits or of
other marks, each with one space before it; runs of white space without their last character).
A distinct pre-token is encoded once in a worker and found by its 64-bit hash from then on.
Tokens never cross pre-tokens, so this gives what encoding the whole text gives.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

from tessera.llm.text import U64, Words, ranges

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker forgets what it has encoded beyond so many distinct pre-tokens.
REMEMBERED = 500_000
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_SLOTS = 18


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    out = np.full(0x110000, _OTHER, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            out[i] = _LETTER
        elif c == "N":
            out[i] = _DIGIT
    out[_SPACES] = _SPACE
    return out


class Leaves(Words):
    """The pre-tokens of some texts; with the attributes of Words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = np.concatenate([data, np.zeros(16, np.uint8)])
        self.offsets = offsets
        place = np.flatnonzero((data & 0xC0) != 0x80)  # bytes that begin a character
        n = len(place)
        c = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind = _kinds()[c]
        opens = np.zeros(n + 1, bool)
        opens[np.searchsorted(place, offsets)] = True  # also one behind the end
        on = opens.copy()
        on[1:n] |= kind[1:] != kind[:-1]
        # the last white space before a word begins a pre-token, and takes the word if it is a plain space
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~opens[1:n]) if n else np.zeros(0, np.int64)
        on[last] = True
        on[last[c[last] == 32] + 1] = False
        marks = np.flatnonzero((c == 39) & on[:n])
        if len(marks):
            follows = np.concatenate([c, np.zeros(2, np.uint32)])
            shut = np.concatenate([opens, [True, True]])
            a, b = follows[marks + 1], follows[marks + 2]
            inside = ~shut[marks + 1]
            size = np.where(inside & np.isin(a, [ord(x) for x in "stmd"]), 1, 0)
            two = inside & ~shut[marks + 2] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
            size[two] = 2
            marks, size = marks[size > 0], size[size > 0]
            on[marks + 1] = False
            on[marks + size + 1] = True
        where = np.flatnonzero(on[:n])
        self.start = place[where]
        self.end = np.append(self.start[1:], len(data))
        self.doc_words = np.searchsorted(self.start, offsets)
        self.characters = np.diff(np.append(where, n))


class Encoder:
    """Token identifiers of texts; remembers the pre-tokens it has met."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.uint16 if max(ranks.values()) < 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.keys, self.slot = np.zeros(1 << _SLOTS, np.uint64), np.zeros(1 << _SLOTS, np.int64)
        self.flat, self.at = np.zeros(1 << 16, self.dtype), np.zeros(1 << 16, np.int64)

    def _room(self, name: str, need: int) -> np.ndarray:
        a = getattr(self, name)
        if need > len(a):
            a = np.concatenate([a, np.zeros(max(len(a), need - len(a)), a.dtype)])
            setattr(self, name, a)
        return a

    def _learn(self, leaves: Words, h: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Slots of these pre-tokens, encoding those not met before."""
        u, first, inverse = np.unique(h[where], return_index=True, return_inverse=True)
        known, data = self.known, leaves.data
        got = [known.get(x, -1) for x in u.tolist()]
        slots = np.array(got, np.int64)
        fresh = np.flatnonzero(slots < 0)
        if len(fresh):
            w = where[first[fresh]]
            raw = data.tobytes()
            lists = [self.encoding._encode_single_piece(raw[s:e]) for s, e in zip(leaves.start[w].tolist(), leaves.end[w].tolist(), strict=True)]
            n = len(known)
            at = self._room("at", n + len(fresh) + 1)
            at[n + 1 : n + len(fresh) + 1] = at[n] + np.cumsum([len(x) for x in lists])
            flat = self._room("flat", int(at[n + len(fresh)]))
            flat[at[n] : at[n + len(fresh)]] = [i for x in lists for i in x]
            slots[fresh] = np.arange(n, n + len(fresh))
            known.update(zip(u[fresh].tolist(), range(n, n + len(fresh)), strict=True))
        cell = (u >> U64(64 - _SLOTS)).astype(np.int64)
        self.keys[cell], self.slot[cell] = u, slots
        return slots[inverse]

    def slots(self, leaves: Words) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self._forget()
        h = leaves.hashes()
        cell = (h >> U64(64 - _SLOTS)).astype(np.int64)
        out = self.slot[cell]
        missed = np.flatnonzero(self.keys[cell] != h)
        if len(missed):
            out[missed] = self._learn(leaves, h, missed)
        return out

    def counts(self, leaves: Words) -> np.ndarray:
        """Tokens of each pre-token."""
        s = self.slots(leaves)
        return self.at[s + 1] - self.at[s]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(identifiers of all texts, one after another; n_texts + 1 offsets into them)."""
        leaves = Leaves(data, offsets)
        s = self.slots(leaves)
        size = self.at[s + 1] - self.at[s]
        return self.flat[ranges(self.at[s], size)], np.concatenate([[0], np.cumsum(size)])[leaves.doc_words]


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """An encoder by the vocabulary file, which this machine must hold."""
    with open(vocabulary, "rb") as f:
        return Encoder(f.read())


_OPENED: dict[str, Encoder] = {}


def ship(spark: SparkSession, vocabulary: str = VOCABULARY) -> Broadcast:
    """The vocabulary file (a megabyte or two), read by the driver alone, for opened()."""
    with open(vocabulary, "rb") as f:
        raw = f.read()
    return spark.sparkContext.broadcast((hashlib.sha256(raw).hexdigest(), raw))


def opened(shipped: Broadcast) -> Encoder:
    """The worker's own encoder by a shipped vocabulary."""
    name, raw = shipped.value
    if name not in _OPENED:
        _OPENED.clear()
        _OPENED[name] = Encoder(raw)
    return _OPENED[name]
