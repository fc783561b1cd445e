"""Preference formatting: one prompt and a masked pair of completions for each pair of conversations.

The longest common prefix of turns (equal role and text) is rendered once as the prompt; what is
left of either conversation becomes its completion. A completion's spans are the characters
[start, end) on which a loss is to be taken: the assistant's words and their end marks. Markers
that occur in a text are broken by a space, so that no text can open or close a turn.

Null roles count as "user", null texts as empty; very long texts are rendered whole. Two equal
conversations prefer nothing: the pair goes. Where one continues the other, the shorter has an
empty completion without spans. Null or empty conversations have no turns; pairs with null
identifiers, repeated or tied pairs and extra columns are kept (columns named as an output column
are replaced). An empty table gives an empty result. Identifiers may be of any type that has an
order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Neighbouring conversations lend each other turns within so many, by rank of identifier.
BLOCK = 64
_SPANS = "array<struct<start:int,end:int>>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order (null turn first; ties by role, then text); repeated rows count once, rows without conv_id make one conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_set(turn)).alias("_t"))
    return ordered.select("conv_id", F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def ranks(turns: DataFrame) -> tuple[DataFrame, int]:
    """((conv_id, _rank, _nth): each conversation's place in order of conv_id, null last, and that among the conversations with replies, null for the others; how many have replies)."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = turns.groupBy("conv_id").agg(F.max(F.coalesce(F.col("role") == "assistant", F.lit(False)).cast("long")).alias("_has"))
    # written, as the bounds of a range partition may differ when it is computed again
    ids = written(ids.repartitionByRange(parts, F.col("conv_id").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "conversation-ranks")
    sizes = sorted(ids.groupBy("_part").agg(F.count("*"), F.sum("_has")).collect())  # a row for each partition
    before, n, m = [], 0, 0
    for part, rows, replies in sizes:
        before.append((part, n, m))
        n, m = n + rows, m + replies
    starts = F.broadcast(turns.sparkSession.createDataFrame(before, "_part int, _n long, _m long"))
    w = Window.partitionBy("_part").orderBy(F.col("conv_id").asc_nulls_last())
    ids = ids.withColumn("_row", F.row_number().over(w)).withColumn("_replies", F.sum("_has").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ids = ids.join(starts, "_part").select("conv_id", (F.col("_n") + F.col("_row") - 1).alias("_rank"), F.when(F.col("_has") == 1, F.col("_m") + F.col("_replies") - 1).alias("_nth"))
    return ids, m


def pairs(turns: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(pair_id, chosen, rejected): a conversation up to its last reply, and the same up to one of its replies, going on as the next conversation of its block does.

    They part at the first, second ... reply, in turn by rank; the other conversation is taken up
    at its reply of that number, or its last, to its own last reply. So they part early or late,
    with one or several turns left on either side.

    Blocks are of so many conversations in order of conv_id, however far apart the identifiers are.
    The next after the last of a block is its first; one alone in its block takes the next
    of all, after the last the first. One without a reply, and a single one with a reply, gives no pair.
    """
    rows = conversations(turns).withColumn("_at", F.expr("filter(sequence(1, size(turns)), i -> get(turns, i - 1).role = 'assistant')")).where("size(_at) > 0")
    rows = rows.select("conv_id", F.slice("turns", F.lit(1), F.element_at("_at", -1)).alias("chosen"), "_at")
    rows = rows.withColumn("_mine", F.struct("chosen", "_at"))
    order, count = ranks(turns)
    rows = rows.join(order.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    w = Window.partitionBy(F.floor(F.col("_rank") / block)).orderBy("_rank")
    rows = rows.withColumn("_other", F.coalesce(F.lead("_mine").over(w), F.first("_mine").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    blocks = order.where("_nth is not null").groupBy(F.floor(F.col("_rank") / block)).agg(F.count("*").alias("_size"), F.min("_nth").alias("_of"))
    alone = blocks.where("_size = 1").select("_of", ((F.col("_of") + 1) % max(count, 1)).alias("_nth"))
    if count > 1 and not alone.isEmpty():
        lent = rows.select("_nth", F.col("_mine").alias("_lent")).join(alone, "_nth").select(F.col("_of").alias("_nth"), "_lent")
        rows = rows.join(lent, "_nth", "left").withColumn("_other", F.coalesce("_lent", "_other"))
    nth = (F.col("_rank") % F.size("_at") + 1).cast("int")
    theirs = F.element_at("_other._at", F.least(nth, F.size("_other._at")))
    mixed = F.concat(F.slice("chosen", F.lit(1), F.element_at("_at", nth) - 1), F.slice("_other.chosen", theirs, F.size("_other.chosen")))
    return rows.select(F.col("conv_id").alias("pair_id"), "chosen", mixed.alias("rejected"))


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN), _plain(t["role"]), F.lit("\n"), _plain(t["text"]), F.lit(CLOSE + "\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def _spans(turns: Column) -> Column:
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        whole = F.length(_turn(t))
        start = acc["at"] + F.length(F.concat(F.lit(OPEN), _plain(t["role"]), F.lit("\n")))
        mine = F.array(F.struct(start.cast("int").alias("start"), (acc["at"] + whole - 1).cast("int").alias("end"))).cast(_SPANS)
        return F.struct((acc["at"] + whole).cast("int").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], mine)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def _filled(turns: Column) -> Column:
    kept = F.filter(F.coalesce(turns, F.array().cast("array<struct<role:string,text:string>>")), lambda t: t.isNotNull())
    return F.transform(kept, lambda t: F.struct(F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs with prompt_turns, prompt, chosen, rejected (rendered), chosen_spans and rejected_spans in place of the turns."""
    made = ("prompt_turns", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans")
    names = [c for c in pairs.columns if c.lower() not in made]
    keep = [F.col(f"`{c}`") for c in names]
    row = F.struct(*keep) if keep else F.struct(F.lit(0).alias("prompt"))
    rows = pairs.select(row.alias("_row"), _filled(F.col("chosen")).alias("_c"), _filled(F.col("rejected")).alias("_r")).where("_c <> _r")
    common = "aggregate(sequence(0, greatest(size(_c), 1) - 1), 0, (n, i) -> if(n = i and i < least(size(_c), size(_r)) and get(_c, i) = get(_r, i), n + 1, n))"
    rows = rows.withColumn("_n", F.expr(common))
    rest = {c: F.slice(f"_{c[0]}", F.col("_n") + 1, F.greatest(F.size(f"_{c[0]}") - F.col("_n"), F.lit(0))) for c in ("chosen", "rejected")}
    rows = rows.select("_row", F.col("_n").alias("prompt_turns"), _render(F.slice("_c", F.lit(1), F.col("_n"))).alias("prompt"), *(r.alias(f"_{c}") for c, r in rest.items()))
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in names), "prompt_turns", "prompt", *(_render(F.col(f"_{c}")).alias(c) for c in rest), *(_spans(F.col(f"_{c}")).alias(f"{c}_spans") for c in rest))
