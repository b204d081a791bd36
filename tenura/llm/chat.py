"""Preference formatting of chat pairs.

A pair has a chosen and a rejected conversation.  Their longest common prefix
of turns is rendered once as the prompt; what follows on each side is a
completion with a loss mask, the character spans of the assistant's turns with
their end marks.  One aggregate by pair gathers the turns of its two
conversations (each one training example), the rest is one projection.

Turns stand in the order of (turn, role, text), so repeated turn numbers have a
defined order too.  A null role or text is empty.  A side without turns has no
common prefix and an empty completion.  Turns without a pair are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The marks around a turn.
BEGIN, FINISH = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), turn["role"], F.lit("\n"), turn["text"], F.lit(FINISH + "\n"))


def _spans(turns: Column) -> Column:
    """``start-end`` of every trained turn's text and end mark in the rendered turns."""
    def add(acc, t):
        begin = acc["at"] + F.length(t["role"]) + F.lit(len(BEGIN) + 1)
        end = begin + F.length(t["text"]) + F.lit(len(FINISH))
        span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        found = F.when(t["role"] == TRAINED, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((end + F.lit(1)).alias("at"), found.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, start, add, lambda acc: acc["spans"]), ",")


def format_preferences(turns: DataFrame, pair: str = "pair_id", side: str = "side") -> DataFrame:
    """``turns`` (pair, side 'chosen' or 'rejected', turn, role, text) to one row
    for each pair: n_prefix, prompt, and text and mask of both completions."""
    t = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
                 F.coalesce(F.col("text"), F.lit("")).alias("text"))
    both = (turns.where(F.col(pair).isNotNull()).groupBy(F.col(pair).alias("pair_id"))
            .agg(*[F.sort_array(F.collect_list(F.when(F.col(side) == s, t))).alias(s) for s in ("chosen", "rejected")]))
    differ = F.array_position(
        F.zip_with("chosen", "rejected", lambda a, b: F.coalesce(
            (a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False))), F.lit(False))
    # sides of unequal length differ where the shorter one ends; equal ones not at all
    n = F.when(differ == 0, F.size("chosen")).otherwise(differ - 1).cast("int")
    both = both.withColumn("n_prefix", n)

    def rest(s):
        return F.slice(s, F.col("n_prefix") + 1, F.size(s))

    return both.select(
        "pair_id", F.col("n_prefix").cast("long").alias("n_prefix"),
        F.array_join(F.transform(F.slice("chosen", F.lit(1), F.col("n_prefix")), _rendered), "").alias("prompt"),
        *[x for s in ("chosen", "rejected") for x in (
            F.array_join(F.transform(rest(s), _rendered), "").alias(s), _spans(rest(s)).alias(f"{s}_mask"))])


def op8_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each even id chosen over the odd one after it."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = c.select(F.floor(F.col("conv_id") / 2).alias("pair_id"),
                     F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text")
    return format_preferences(turns)


_TURN = f"'{BEGIN}' || role || chr(10) || txt || '{FINISH}' || chr(10)"
ORACLE = f"""
WITH t AS (
  SELECT floor(conv_id / 2)::BIGINT AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS txt,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
m AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.k, b.k) AS k,
         coalesce(a.role = b.role AND a.txt = b.txt, false) AS same
  FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.k = b.k),
n AS (SELECT pair_id, coalesce(min(k) FILTER (NOT same), max(k) + 1) - 1 AS n_prefix FROM m GROUP BY pair_id),
r AS (SELECT t.*, n_prefix, {_TURN} AS shown,
             coalesce(sum(length({_TURN})) OVER (PARTITION BY t.pair_id, side, k > n_prefix ORDER BY k
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + {len(BEGIN) + 1} AS b
      FROM t JOIN n USING (pair_id)),
s AS (SELECT *, (b::BIGINT)::VARCHAR || '-' || ((b + length(txt) + {len(FINISH)})::BIGINT)::VARCHAR AS span FROM r)
SELECT pair_id, any_value(n_prefix)::BIGINT AS n_prefix,
       coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 0 AND k <= n_prefix), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 0 AND k > n_prefix), '') AS chosen,
       coalesce(string_agg(span, ',' ORDER BY k) FILTER (side = 0 AND k > n_prefix AND role = '{TRAINED}'), '') AS chosen_mask,
       coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 1 AND k > n_prefix), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY k) FILTER (side = 1 AND k > n_prefix AND role = '{TRAINED}'), '') AS rejected_mask
FROM s GROUP BY pair_id"""

QUERIES = {"op8_chat_preferences": op8_chat_preferences}
SQL = {"op8_chat_preferences": ORACLE}
