"""Preference formatting: chosen and rejected conversations that share their first turns.

A pair's turns meet in one group, in order. The longest common prefix of turns is rendered once as the prompt; what follows
in either conversation is rendered as its completion, with a mask that marks the characters to train on (the text of
assistant turns) and leaves out turn marks and other roles.

Defined cases: a null role or text counts as empty; turns are ordered by number, then role, then text (a null number first), so repeated
turns stay, in a fixed order; a pair whose other side has no turns gets an empty completion there; equal conversations have
the whole of it as prompt and two empty completions; an empty table gives no rows; turns with a null conv_id belong to no
pair and are left out. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireworks.llm.common import or_empty, table

OPEN, CLOSE, END = "<|", "|>\n", "\n"
TRAINED = "assistant"


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """turns with pair_id and side (0 chosen, 1 rejected): conversations 2k and 2k + 1 are one pair, the even one chosen."""
    return turns.withColumns({"pair_id": F.floor(F.col("conv_id") / 2).cast("long"), "side": F.pmod(F.col("conv_id"), F.lit(2)).cast("int")}).filter("pair_id is not null")


def _marked(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """(start, end) of each trained stretch, in characters of the rendered turns."""
    size = lambda t: F.length(t["role"]) + F.length(t["text"]) + len(OPEN + CLOSE + END)
    spans = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("s")),
        lambda a, t: F.struct(
            (a["at"] + size(t)).alias("at"),
            F.when(
                t["role"] == TRAINED,
                F.concat(a["s"], F.array(F.struct((a["at"] + F.length(t["role"]) + len(OPEN + CLOSE)).alias("start"), (a["at"] + F.length(t["role"]) + len(OPEN + CLOSE) + F.length(t["text"])).alias("end")))),
            ).otherwise(a["s"]).alias("s"),
        ),
    )
    return spans["s"]


def format_pairs(turns: DataFrame) -> DataFrame:
    """One row for each pair of turns(pair_id, side, conv_id, turn, role, text): prompt, two completions, two masks."""
    one = F.struct(F.col("turn"), or_empty("role").alias("role"), or_empty("text").alias("text"))
    sides = turns.groupBy("pair_id").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("side") == k, one))).alias(name) for k, name in enumerate(("a", "b"))],
        *[F.min(F.when(F.col("side") == k, F.col("conv_id"))).alias(name) for k, name in enumerate(("chosen_id", "rejected_id"))],
    )
    least = F.least(F.size("a"), F.size("b"))
    differ = F.filter(
        F.when(least > 0, F.sequence(F.lit(0), least - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: (F.col("a")[i]["role"] != F.col("b")[i]["role"]) | (F.col("a")[i]["text"] != F.col("b")[i]["text"]),
    )
    cut = sides.withColumn("n_prompt_turns", F.coalesce(F.get(differ, 0), least))
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.greatest(F.size(c) - F.col("n_prompt_turns"), F.lit(0)))
    parted = cut.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", F.slice("a", F.lit(1), F.col("n_prompt_turns")).alias("p"), rest("a").alias("c"), rest("b").alias("r"))
    return parted.select(
        "pair_id", "chosen_id", "rejected_id", "n_prompt_turns", _marked(F.col("p")).alias("prompt"),
        _marked(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"), F.size("c").alias("n_chosen_turns"),
        _marked(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"), F.size("r").alias("n_rejected_turns"),
    )


def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = format_pairs(adjacent_pairs(table(spark, sf_dir, "conversations")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    trained = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return done.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        F.col("n_chosen_turns").cast("long").alias("n_chosen_turns"), F.col("n_rejected_turns").cast("long").alias("n_rejected_turns"),
        digest("prompt").alias("prompt_sha256"), digest("chosen").alias("chosen_sha256"), digest("rejected").alias("rejected_sha256"),
        trained("chosen_mask").alias("chosen_trained_chars"), trained("rejected_mask").alias("rejected_trained_chars"),
    )


_SHOW = "'<|' || role || '|>' || chr(10) || text || chr(10)"
ORACLE_SQL = f"""
WITH t AS (
  SELECT (conv_id // 2)::BIGINT AS pair_id, conv_id % 2 AS side, conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT pair_id, min(conv_id) FILTER (side = 0) AS chosen_id, min(conv_id) FILTER (side = 1) AS rejected_id,
             count(*) FILTER (side = 0) AS na, count(*) FILTER (side = 1) AS nb FROM t GROUP BY pair_id),
d AS (SELECT a.pair_id, min(a.k) AS k FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.k = b.k AND a.side = 0 AND b.side = 1
      WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id),
n AS (SELECT s.*, coalesce(d.k - 1, least(na, nb)) AS np FROM s LEFT JOIN d USING (pair_id))
SELECT n.pair_id, any_value(chosen_id) AS chosen_id, any_value(rejected_id) AS rejected_id, any_value(np)::BIGINT AS n_prompt_turns,
       any_value(na - np)::BIGINT AS n_chosen_turns, any_value(nb - np)::BIGINT AS n_rejected_turns,
       sha256(coalesce(string_agg({_SHOW}, '' ORDER BY k) FILTER (side = 0 AND k <= np), '')) AS prompt_sha256,
       sha256(coalesce(string_agg({_SHOW}, '' ORDER BY k) FILTER (side = 0 AND k > np), '')) AS chosen_sha256,
       sha256(coalesce(string_agg({_SHOW}, '' ORDER BY k) FILTER (side = 1 AND k > np), '')) AS rejected_sha256,
       coalesce(sum(length(text)) FILTER (side = 0 AND k > np AND role = 'assistant'), 0)::BIGINT AS chosen_trained_chars,
       coalesce(sum(length(text)) FILTER (side = 1 AND k > np AND role = 'assistant'), 0)::BIGINT AS rejected_trained_chars
FROM n JOIN t USING (pair_id) GROUP BY n.pair_id"""
