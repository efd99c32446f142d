"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns (role and text equal) is rendered once as
the prompt; what follows in each conversation is rendered as its completion.
A completion's mask lists the character spans to learn from: the text and end
mark of its assistant turns.

One shuffle brings a pair's turns together; everything else is expressions on
arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm._frames import table

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
LEARNED = "assistant"
_SPANS = "array<struct<start:bigint,end:bigint>>"


def _rendered(turns: str) -> Column:
    return F.expr(f"array_join(transform({turns}, t -> concat('{OPEN}', t.role, '\\n', t.text, '<|im_end|>\\n')), '')")


def _mask(turns: str) -> Column:
    head, tail = len(OPEN) + len(MIDDLE), len(CLOSE)
    return F.expr(
        f"aggregate({turns}, named_struct('at', cast(0 as bigint), 'out', cast(array() as {_SPANS})), (acc, t) -> named_struct("
        f"'at', acc.at + {head + tail} + length(t.role) + length(t.text), "
        f"'out', if(t.role = '{LEARNED}', concat(acc.out, array(named_struct('start', acc.at + {head} + length(t.role), 'end', acc.at + {head + tail} + length(t.role) + length(t.text)))), acc.out)), acc -> acc.out)"
    )


def formatted(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """pair_id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask, usable.

    `turns` has turn, role and text; `pair` is the pair of a turn's
    conversation and `chosen` tells which of the two it is.  Turns are taken in
    order of turn, then role, then text, a null turn first; null roles and
    texts count as empty.  Rows of a null pair belong to no conversation.  A
    pair that lacks a side has a null completion there and the other side's
    whole conversation as completion, with an empty prompt.  usable: both
    completions have something to learn from.
    """
    rows = turns.select(pair.alias("pair_id"), chosen.alias("good"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")).where("pair_id is not null")
    none = "cast(array() as array<struct<turn:bigint,role:string,text:string>>)"
    both = rows.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.when(F.col("good"), F.col("t")))).alias("c"), F.array_sort(F.collect_list(F.when(~F.col("good"), F.col("t")))).alias("r"))
    n = F.expr(
        f"if(size(c) = 0 or size(r) = 0, 0, aggregate(sequence(1, least(size(c), size(r))), 0, (acc, i) -> "
        "if(acc = i - 1 and element_at(c, i).role = element_at(r, i).role and element_at(c, i).text = element_at(r, i).text, i, acc)))"
    )
    cut = both.withColumn("n_prefix", n).withColumns({"p": F.expr("slice(c, 1, n_prefix)"), "a": F.expr(f"if(size(c) > n_prefix, slice(c, n_prefix + 1, size(c) - n_prefix), {none})"), "b": F.expr(f"if(size(r) > n_prefix, slice(r, n_prefix + 1, size(r) - n_prefix), {none})")})
    out = cut.select(
        "pair_id", F.col("n_prefix").cast("bigint").alias("n_prefix"), _rendered("p").alias("prompt"),
        F.when(F.size("c") > 0, _rendered("a")).alias("chosen"), F.when(F.size("r") > 0, _rendered("b")).alias("rejected"), _mask("a").alias("chosen_mask"), _mask("b").alias("rejected_mask"),
    )
    return out.withColumn("usable", (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0))


def _said(mask: str) -> Column:
    return F.expr(f"array_join(transform({mask}, s -> concat(s.start, ':', s.end)), ',')")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected)."""
    turns = table(spark, sf_dir, "conversations")
    out = formatted(turns, F.floor(F.col("conv_id") / 2), F.pmod(F.col("conv_id"), F.lit(2)) == 0)
    return out.select("pair_id", "n_prefix", "prompt", "chosen", "rejected", _said("chosen_mask").alias("chosen_mask"), _said("rejected_mask").alias("rejected_mask"), "usable")


SQL10 = r"""
WITH t AS (
  SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, ((conv_id % 2) + 2) % 2 = 0 AS good, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), m AS (
  SELECT c.pair_id, min(c.i) FILTER (r.i IS NULL OR r.role <> c.role OR r.text <> c.text) AS first_other, max(c.i) AS n
  FROM t c LEFT JOIN t r ON c.pair_id = r.pair_id AND c.i = r.i AND NOT r.good WHERE c.good GROUP BY c.pair_id
), p AS (
  SELECT DISTINCT t.pair_id, coalesce(CASE WHEN m.n IS NULL THEN 0 WHEN m.first_other IS NULL THEN m.n ELSE m.first_other - 1 END, 0) AS n_prefix FROM t LEFT JOIN m ON t.pair_id = m.pair_id
), s AS (
  SELECT t.pair_id, t.good, t.i, t.role, t.i <= p.n_prefix AS common, '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) AS said, length(t.role) + 13 AS head,
         sum(length(t.role) + length(t.text) + 24) FILTER (t.i > p.n_prefix) OVER (PARTITION BY t.pair_id, t.good ORDER BY t.i) AS ends, length(t.role) + length(t.text) + 24 AS size
  FROM t JOIN p ON t.pair_id = p.pair_id
), o AS (
  SELECT pair_id,
    coalesce(string_agg(said, '' ORDER BY i) FILTER (good AND common), '') AS prompt,
    CASE WHEN bool_or(good) THEN coalesce(string_agg(said, '' ORDER BY i) FILTER (good AND NOT common), '') END AS chosen,
    CASE WHEN bool_or(NOT good) THEN coalesce(string_agg(said, '' ORDER BY i) FILTER (NOT good AND NOT common), '') END AS rejected,
    coalesce(string_agg((ends - size + head) || ':' || ends, ',' ORDER BY i) FILTER (good AND NOT common AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg((ends - size + head) || ':' || ends, ',' ORDER BY i) FILTER (NOT good AND NOT common AND role = 'assistant'), '') AS rejected_mask
  FROM s GROUP BY pair_id
)
SELECT o.pair_id, CAST(p.n_prefix AS BIGINT) AS n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask, chosen_mask <> '' AND rejected_mask <> '' AS usable
FROM o JOIN p ON o.pair_id = p.pair_id
"""
