"""Full-text search: tokens, stems, postings, Boolean search and BM25. Tokens are made by built-in
expressions; those of a document are grouped into postings where they are, in Arrow batches.

One-off searches count their terms in the text, in one scan without arrays. An Index keeps
postings and lengths as tables; a search reads the postings of its terms only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import written

STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "is", "are")
K1, B = 1.5, 0.75
#: What stands between white space, without the marks at its ends; of two bytes or more.
TOKEN = r"[\p{L}\p{N}]\S*[\p{L}\p{N}]|[\p{L}\p{N}&&[^\x00-\x7F]]"
BUCKETS = 64
#: Tokens that are grouped into postings at once, and those of one document more.
TOKENS = 1_000_000


def tokens_of(text: Column) -> Column:
    """Lower-cased words without marks at their ends, of two bytes or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def stem(c: Column) -> Column:
    for suffix in ("s", "ed", "ing"):
        c = F.regexp_replace(c, f"({suffix})+$", "")
    return c


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def term_count(text: Column, term: str) -> Column:
    """How often a token is the term."""
    marks = r"[^\s\p{L}\p{N}]*"
    return F.regexp_count(F.lower(text), F.lit(rf"(?<!\S){marks}\Q{term.lower()}\E{marks}(?!\S)"))


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", *, stop: bool = False, stemmed: bool = False) -> DataFrame:
    """(key, position, term); positions count the tokens before stop words go."""
    out = docs.select(key, F.posexplode(tokens_of(F.col(text))).alias("position", "term")).withColumn("position", F.col("position").cast("long"))
    if stop:
        out = out.where(~F.col("term").isin(*STOP_WORDS))
    return out.withColumn("term", stem(F.col("term"))) if stemmed else out


def _grouped(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (key, _tokens) the postings of each row, of about TOKENS tokens at once."""

    def group(part: pa.RecordBatch, size: np.ndarray) -> pa.RecordBatch:
        words = part["_tokens"].flatten().dictionary_encode()
        row = np.repeat(np.arange(len(size)), size)
        position = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        code = row * max(len(words.dictionary), 1) + words.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        at, ends = pa.array(order[first]), np.append(first, len(order))
        positions = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(position[order]))
        return pa.RecordBatch.from_arrays([words.take(at).dictionary_decode(), part[key].take(pa.array(row[order[first]])), pa.array(np.diff(ends)), positions], ["term", key, "tf", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch["_tokens"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, lo = np.cumsum(size), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + TOKENS, "right")))
                if size[lo:hi].any():
                    yield group(batch.slice(lo, hi - lo), size[lo:hi])
                lo = hi

    return run


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key, tf, positions), made within each row; only where keys repeat are rows of a key put together by a shuffle."""
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, tokens_of(F.col(text)).alias("_tokens")).mapInArrow(_grouped(key), f"term string, `{key}` {kind}, tf long, positions array<long>")
    if docs.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
        return out
    return out.groupBy("term", key).agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


def search_all(docs: DataFrame, terms: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    found = [term_count(F.col(text), t) > 0 for t in terms]
    return docs.where(reduce(lambda a, b: a & b, found, F.lit(True))).select(key).distinct()


def search_any(docs: DataFrame, terms: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    found = [term_count(F.col(text), t) > 0 for t in terms]
    return docs.where(reduce(lambda a, b: a | b, found, F.lit(False))).select(key).distinct()


def idf(n: Column, total: Column) -> Column:
    return F.when(n == 0, 0.0).otherwise(F.log((total - n + 0.5) / (n + 0.5) + 1))


def bm25_term(tf: Column, size: Column, mean: Column, weight: Column, k1: float = K1, b: float = B) -> Column:
    return (k1 + 1) * tf / (tf + k1 * (1 - b + b * size / mean)) * weight


def _counted(docs: DataFrame, terms: Sequence[str], names: Sequence[str], key: str, text: str) -> DataFrame:
    """(key, _len, a column for each term): words and how often a token is the term, from one pass over the text."""
    plain = [t for t in terms if re.fullmatch(r"[^\W_](\S*[^\W_])?", t)]  # others can be more or less than one word
    marks = r"[^\s\p{L}\p{N}]*"
    either = "|".join(rf"\Q{t}\E" for t in plain)
    word = rf"{marks}({either}){marks}(?!\S)|\S+" if plain else r"()\S+"
    rows = docs.select(key, *([] if len(plain) == len(terms) else [text]), F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(1)).alias("_words"))  # empty for other words
    rows = rows.withColumns({"_len": F.array_size("_words").cast("long"), "_hits": F.array_remove("_words", "")})

    def count(term: str) -> Column:
        return F.array_size(F.filter("_hits", lambda w: w == term)) if term in plain else term_count(F.col(text), term)

    return rows.select(key, "_len", *(count(t).alias(n) for t, n in zip(terms, names, strict=True)))


def bm25(docs: DataFrame, terms: Sequence[str], key: str = "doc_id", text: str = "text", *, k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of the documents that hold any of the terms. The counts are written, as the whole table's and each document's are asked for."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    names = [f"_tf{i}" for i in range(len(terms))]
    counted = written(_counted(docs, terms, names, key, text), "counts")
    whole = counted.agg(F.count("*").alias("_total"), F.avg("_len").alias("_mean"), *(F.count_if(F.col(n) > 0).alias(f"_n{n}") for n in names))
    hits = counted.where(reduce(lambda x, y: x | y, [F.col(n) > 0 for n in names])).crossJoin(F.broadcast(whole))  # one row
    parts = [F.when(F.col(n) > 0, bm25_term(F.col(n), F.col("_len"), F.col("_mean"), idf(F.col(f"_n{n}"), F.col("_total")), k1, b)).otherwise(0.0) for n in names]
    return hits.select(key, reduce(lambda x, y: x + y, parts).alias("score"))


class Index:
    """Postings by term, in BUCKETS folders by the term's hash, beside the documents' lengths."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id"):
        self.spark, self.folder, self.key = spark, folder, key

    @staticmethod
    def bucketed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Postings with their bucket, shuffled once and sorted as they are written."""
        rows = postings(docs, key, text).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        return rows.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(16))).sortWithinPartitions("bucket", "term", key)

    @classmethod
    def build(cls, docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> Index:
        """Of documents with distinct keys."""
        cls.bucketed(docs, key, text).write.partitionBy("bucket").parquet(f"{folder}/postings")
        docs.select(key, word_count(F.col(text)).alias("size")).write.parquet(f"{folder}/lengths")
        return cls(docs.sparkSession, folder, key)

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """(term, key, tf, positions) of the terms; no other bucket's files are read."""
        terms = [t.lower() for t in terms]
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
        return self.spark.read.parquet(f"{self.folder}/postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).drop("bucket")

    def search(self, terms: Sequence[str], *, every: bool = True) -> DataFrame:
        """(key) of documents that hold every term, or any."""
        terms = {t.lower() for t in terms}
        return self.postings(sorted(terms)).groupBy(self.key).agg(F.count("*").alias("_n")).where(F.col("_n") >= (len(terms) if every else 1)).select(self.key)

    def bm25(self, terms: Sequence[str], *, k1: float = K1, b: float = B) -> DataFrame:
        """(key, score) of the documents that hold any of the terms."""
        lengths = self.spark.read.parquet(f"{self.folder}/lengths")
        hits = self.postings(sorted({t.lower() for t in terms}))
        whole = lengths.agg(F.count("*").alias("_total"), F.avg("size").alias("_mean"))
        weights = hits.groupBy("term").agg(F.count("*").alias("_n")).crossJoin(whole)  # a row for each term
        scored = hits.join(F.broadcast(weights), "term").join(lengths, self.key)
        return scored.groupBy(self.key).agg(F.sum(bm25_term(F.col("tf"), F.col("size"), F.col("_mean"), idf(F.col("_n"), F.col("_total")), k1, b)).alias("score"))
