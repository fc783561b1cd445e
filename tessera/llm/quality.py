"""Quality rules as a short-circuit cascade.

Each rule is a JVM-side predicate that is true for a document to reject. Cost and
selectivity of every rule are measured on a bounded sample; the rules then run in the order
of rejections per unit of cost inside one CASE, whose later branches are not evaluated for
documents that an earlier branch rejects. The order changes the time taken, never the result.

Toxicity has no fixed word list that would hold for every language, so a list of words and
word beginnings is learned from the labelled documents by greedy set cover.

judge() names the rule that rejected a document: the first of the order taken, so that where
several would reject it the name follows the measured costs; what is kept doesn't. cascade()
gives the order with the estimates.

Null or blank text is rejected by the rule ``empty``; very long texts are judged whole. A null or
tied doc_id, repeated rows and extra columns are kept as they are: each row is judged by its own
text alone; columns named as an output column are replaced. An empty table gives an empty table;
without toxic labels the rule ``toxic`` rejects nothing. To learn from labels doc_id must be an
integer on both sides (else TypeError).
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import integral, written

#: At most so many labelled documents teach the toxic word list.
LABELLED_ROWS = 20_000
#: About so many documents are sampled to estimate cost and selectivity.
SAMPLE_ROWS = 2_000
SYMBOLS = r"[!#$%&*+<=>@^_`~\\|{}]"
UPPER = r"[A-ZÀ-ÖØ-Þ]"


@dataclass(frozen=True)
class Rule:
    """reject: of a text column, true where the document is to go (never null)."""

    name: str
    reject: Column


@dataclass(frozen=True)
class Estimate:
    name: str
    cost: float
    selectivity: float

    @property
    def worth(self) -> float:
        return self.selectivity / max(self.cost, 1e-6)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: Frequent words of English, German, French, Spanish, Italian and Portuguese.
STOP = (
    "the of and to in is that it for on with as was are be by this from or an at not "
    "der die das und ist ein eine zu den von mit nicht auf le la les et des est une dans pour que qui el los de en un se con por para il di che per con non o e do da os as um uma"
).split()
LINK = r"https?://|www\."
#: Mail addresses, telephone and card numbers.
PERSONAL = r"[\w.+-]+@[\w-]+\.\w|\+\d{1,3} \(\d{3}\) \d{3}-\d{4}|(?<!\d)\d{16}(?!\d)"
BOILERPLATE = r"(?i)(?:all rights reserved|terms of (?:service|use)|privacy policy|cookie policy|we use cookies|subscribe to our|sign up for our|click here to|javascript is disabled|permission is hereby granted|licensed under the)"


def rules(
    toxic: list[str] | None = None,
    *,
    max_symbols: float = 0.06,
    max_upper: float = 0.5,
    max_repeated_lines: float = 0.4,
    min_distinct_words: float = 0.35,
    min_toxic: int = 1,
    max_links: float = 0.3,
    max_personal: float = 0.5,
    max_boilerplate: float = 0.6,
    max_word: int = 1000,
    stop_words: int = 200,
) -> list[Rule]:
    """The production rules. toxic: words, or beginnings of words that end in an asterisk.

    max_links, max_personal: of them for each space-separated word; max_boilerplate: phrases for
    each line. max_word: letters of ASCII in a row. stop_words: a text of so many words of small
    ASCII letters has one of STOP.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    lines, words = F.split(text, "\n", -1), F.split(F.lower(text), " ", -1)
    out = [
        Rule("empty", ~text.rlike(r"\S")),
        Rule("symbols", F.regexp_count(text, F.lit(SYMBOLS)) / size > max_symbols),
        Rule("shouting", F.regexp_count(text, F.lit(UPPER)) / size > max_upper),
        Rule("repeated_lines", _bound(lines, lambda x: 1 - F.size(F.array_distinct(x)) / F.size(x) > max_repeated_lines)),
        Rule("links", F.regexp_count(text, F.lit(LINK)) > max_links * F.size(F.split(text, " ", -1))),
        Rule("personal", F.regexp_count(text, F.lit(PERSONAL)) > max_personal * F.size(F.split(text, " ", -1))),
        Rule("boilerplate", F.regexp_count(text, F.lit(BOILERPLATE)) > max_boilerplate * F.size(F.split(text, "\n", -1))),
        Rule("run_on", text.rlike(rf"[A-Za-z]{{{max_word}}}")),
        Rule("language", ~text.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(STOP)})(?![\p{{L}}\p{{N}}])") & (F.regexp_count(text, F.lit(r"(?<![\p{L}\p{N}])[a-z]+(?![\p{L}\p{N}])")) >= stop_words)),
        Rule("repeated_words", _bound(words, lambda x: (F.size(x) >= 20) & (F.size(F.array_distinct(x)) / F.size(x) < min_distinct_words))),
    ]
    if toxic:
        stems = [re.escape(x[:-1]) for x in toxic if x.endswith("*")]
        whole = [re.escape(x) + r"(?![\p{L}\p{N}])" for x in toxic if not x.endswith("*")]
        first = "".join(sorted({re.escape(x[0]) for x in toxic}))
        pattern = rf"(?=[{first}])(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(stems + whole))})"
        lower = F.lower(text)
        out.append(Rule("toxic", lower.rlike(pattern) if min_toxic == 1 else F.regexp_count(lower, F.lit(pattern)) >= min_toxic))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's words of four letters or more, and their beginnings, once each."""
    find = re.compile(r"[^\W_]{4,}").findall
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [sorted({*(w := find(t)), *(x[:4] + "*" for x in w)}) for t in part["text"].to_pylist()]
            rows = np.repeat(np.arange(part.num_rows), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(rows)), part["_toxic"].take(pa.array(rows)), pa.array([f for x in found for f in x], pa.string())], ["doc_id", "_toxic", "_f"])


def learn_toxic(docs: DataFrame, labels: DataFrame, *, rows: int = LABELLED_ROWS, chance: float = 1e-3, precision: float = 0.98) -> list[str]:
    """Words and four-letter beginnings that mark toxic documents, by greedy set cover.

    Of at most ``rows`` labelled documents. A feature qualifies if ``precision`` of the
    documents that hold it are toxic and they are too many for any of the features to reach by
    ``chance``; each pick removes the toxic documents that hold it, so that words which merely
    accompany a toxic one in copies never follow. Labels that disagree about a document count
    as toxic; null labels are ignored.
    """
    integral(docs)
    integral(labels)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    known = F.broadcast(known)  # of at most ``rows`` rows
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, "doc_id").select("doc_id", "_toxic", F.coalesce(F.lower("text"), F.lit("")).alias("text"))
    pairs = written(picked.mapInArrow(_features, "doc_id long, _toxic int, _f string"), "toxic-features")
    labelled = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("_toxic"), F.lit(0)).alias("bad")).first()
    if not 0 < labelled["bad"] < labelled["n"]:
        return []
    by_feature = pairs.groupBy("_f").agg(F.sum("_toxic").alias("_hit"), F.count("*").alias("_all"))
    least = math.ceil(math.log(chance / max(by_feature.count(), 1)) / math.log(labelled["bad"] / labelled["n"]))
    stats = by_feature.where((F.col("_hit") >= least) & (F.col("_hit") >= precision * F.col("_all"))).select("_f")
    found = pairs.where("_toxic = 1").join(stats, "_f").select("doc_id", "_f").toArrow()
    holds: dict[str, set] = {}
    for d, f in zip(found["doc_id"].to_pylist(), found["_f"].to_pylist(), strict=True):
        holds.setdefault(f, set()).add(d)
    chosen: list[str] = []
    while holds:
        best = max(holds, key=lambda f: (len(holds[f]), f.endswith("*"), f))
        covered = holds.pop(best)
        if len(covered) < least:
            break
        chosen.append(best)
        holds = {f: left for f, s in holds.items() if len(left := s - covered) >= least}
    return chosen


def estimate(docs: DataFrame, cascade: list[Rule], *, rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Estimate]:
    """Seconds per document (above those of a rule that does nothing) and share rejected, on a sample."""
    spark, total = docs.sparkSession, docs.count()
    if not total:
        return [Estimate(r.name, 1.0, 0.0) for r in cascade]
    sample = docs.select("text").sample(fraction=min(1.0, rows / total), seed=seed).toArrow()
    local = spark.createDataFrame(sample).coalesce(1).cache()
    n = max(local.count(), 1)

    def timed(reject: Column) -> tuple[float, int]:
        best, hits = float("inf"), 0
        for _ in range(2):
            began = time.perf_counter()
            hits = local.agg(F.sum(reject.cast("int"))).first()[0] or 0
            best = min(best, time.perf_counter() - began)
        return best, hits

    idle, _ = timed(F.col("text").isNull())
    out = []
    for r in cascade:
        took, hits = timed(r.reject)
        out.append(Estimate(r.name, max(took - idle, 1e-4) / n, hits / n))
    local.unpersist()
    return out


def ordered(cascade: list[Rule], estimates: list[Estimate]) -> list[Rule]:
    """By rejections per cost, the most first; ties by cost, then by name."""
    by = {e.name: e for e in estimates}
    return sorted(cascade, key=lambda r: (-by[r.name].worth, by[r.name].cost, r.name))


def rejected(cascade: list[Rule]) -> Column:
    """Name of the first rule that rejects, null where all accept; later rules aren't evaluated."""
    out = None
    for r in cascade:
        out = F.when(r.reject, r.name) if out is None else out.when(r.reject, r.name)
    return F.lit(None).cast("string") if out is None else out


def _ordered(docs: DataFrame, labels: DataFrame | None, **limits: float) -> tuple[list[Rule], list[Estimate]]:
    known = rules(learn_toxic(docs, labels) if labels is not None else None, **limits)
    estimates = estimate(docs, known)
    return ordered(known, estimates), estimates


def judge(docs: DataFrame, labels: DataFrame | None = None, **limits: float) -> DataFrame:
    """docs with a boolean ``keep`` and the ``rule`` that rejected (null where kept)."""
    names = [c for c in docs.columns if c.lower() not in ("keep", "rule")]
    rule = rejected(_ordered(docs, labels, **limits)[0])
    return docs.select(*[F.col(f"`{c}`") for c in names], rule.alias("rule")).select(*[F.col(f"`{c}`") for c in names], F.col("rule").isNull().alias("keep"), "rule")


def cascade(docs: DataFrame, labels: DataFrame | None = None, **limits: float) -> DataFrame:
    """(place, rule, cost, selectivity, worth): the order in which the rules run, with their estimates."""
    chain, estimates = _ordered(docs, labels, **limits)
    by = {e.name: e for e in estimates}
    rows = [(i, r.name, by[r.name].cost, by[r.name].selectivity, by[r.name].worth) for i, r in enumerate(chain, 1)]
    return docs.sparkSession.createDataFrame(rows, "place int, rule string, cost double, selectivity double, worth double")


def keep_good(docs: DataFrame, labels: DataFrame | None = None, **limits: float) -> DataFrame:
    """The rows that every rule accepts, columns unchanged."""
    return docs.where(rejected(_ordered(docs, labels, **limits)[0]).isNull())
