"""Queries of the corpus operators and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import brown, chat, jaccard, pieces, quality, rlz, suffix_dedup, templates, token_counts, token_files
from tessera.llm.common import table


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "keep", "rule")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rlz.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("n_pieces", F.size("ids"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_counts.trees(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return token_counts.recount(docs, token_counts.redactions, keep_trees=False)


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.perplexities(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write(table(spark, sf_dir, "documents"))[0]


def op10_chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.format_pairs(chat.pairs(table(spark, sf_dir, "conversations")))
    shown = {c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",") for c in ("chosen_spans", "rejected_spans")}
    return out.withColumns(shown)


_CHAT_SQL = """
WITH c AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
t AS (SELECT conv_id, list(struct_pack(role := role, r := '<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10)) ORDER BY turn, role, text) AS l FROM c GROUP BY conv_id),
n AS (SELECT conv_id, l, row_number() OVER (ORDER BY conv_id) - 1 AS k, list_filter(range(1, len(l) + 1), lambda i: l[i].role = 'assistant') AS pos FROM t),
u AS (SELECT conv_id, k, pos, l[1:(pos[-1])] AS l FROM n WHERE len(pos) > 0),
o AS (SELECT conv_id, k, pos, l, coalesce(lead(l) OVER w, first_value(l) OVER w) AS ol, coalesce(lead(pos) OVER w, first_value(pos) OVER w) AS opos FROM u WINDOW w AS (PARTITION BY k // 64 ORDER BY k)),
p AS (SELECT conv_id, l AS a, list_concat(l[1:(pos[1 + k % len(pos)] - 1)], ol[(opos[least(1 + k % len(pos), len(opos))]):]) AS b FROM o),
q AS (SELECT conv_id, a, b, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS m FROM p WHERE a <> b)
SELECT conv_id AS pair_id, CAST(m AS INTEGER) AS prompt_turns, array_to_string(list_transform(a[1:m], lambda x: x.r), '') AS prompt,
  array_to_string(list_transform(a[m + 1:], lambda x: x.r), '') AS chosen, array_to_string(list_transform(b[m + 1:], lambda x: x.r), '') AS rejected,
  array_to_string(list_filter(list_transform(a[m + 1:], lambda y, i: CASE WHEN y.role = 'assistant' THEN (coalesce(list_sum(list_transform(a[m + 1:m + i - 1], lambda z: length(z.r))), 0) + 22)::BIGINT || '-' || (coalesce(list_sum(list_transform(a[m + 1:m + i - 1], lambda z: length(z.r))), 0) + length(y.r) - 1)::BIGINT END), lambda s: s IS NOT NULL), ',') AS chosen_spans,
  array_to_string(list_filter(list_transform(b[m + 1:], lambda y, i: CASE WHEN y.role = 'assistant' THEN (coalesce(list_sum(list_transform(b[m + 1:m + i - 1], lambda z: length(z.r))), 0) + 22)::BIGINT || '-' || (coalesce(list_sum(list_transform(b[m + 1:m + i - 1], lambda z: length(z.r))), 0) + length(y.r) - 1)::BIGINT END), lambda s: s IS NOT NULL), ',') AS rejected_spans
FROM q
"""

_JACCARD_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x00-\\x20]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 5], ' ') AS g FROM w, unnest(range(0, greatest(len(ws) - 4, 1))) AS t(i) WHERE len(ws) > 0),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
meets AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g AS a JOIN g AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM meets JOIN size AS x ON a = x.doc_id JOIN size AS y ON b = y.doc_id WHERE c / (x.n + y.n - c) >= 0.4),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT doc_id, b FROM reached JOIN link ON other = a),
class AS (SELECT doc_id, min(other) AS class_id FROM reached GROUP BY doc_id),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links FROM class LEFT JOIN degree ON doc_id = a
"""

#: Every window of 40 words, all but its first occurrence, merged where they overlap or adjoin.
_REPEATS_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x00-\\x20]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 40], ' ') AS g FROM w, unnest(range(0, len(ws) - 39)) AS t(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 40 THEN 0 ELSE 1 END AS fresh FROM again),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM marked)
SELECT doc_id, CAST(min(i) AS INTEGER) AS span_start, CAST(max(i) + 40 AS INTEGER) AS span_end FROM runs GROUP BY doc_id, r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op10_chat_pairs": _CHAT_SQL, "op9_ngram_jaccard": _JACCARD_SQL, "op2_suffix_dedup": _REPEATS_SQL, "op4_substring_dedup": _REPEATS_SQL}
