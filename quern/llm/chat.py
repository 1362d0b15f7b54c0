"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered anew: that speaker is the
assistant, every other one a user with a name, and the system's turns stay. The mask covers
what the assistant of the rendering says, with its end mark.

A rendering is returned turn by turn, with each turn's place in the whole, so that a
conversation of any length is never held in one piece: places come from sums over chunks of
turns, then running sums within a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import table

#: The marks of the format, the role that is no participant, and turns in a chunk.
END, SYSTEM, CHUNK = "<|end|>\n", "system", 256


def _escaped(c: Column, least: str) -> Column:
    """Marks can't be forged by a text."""
    return F.replace(F.coalesce(c, F.lit(least)), F.lit("<|"), F.lit("< |"))


def rotated(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, perspective, turn, seq, role, rendered, start, end, mask_start, mask_end) for each turn in each participant's rendering.

    seq counts a rendering's turns from 0, by turn, then role, then text (nulls first); whole
    repeats are turns of their own. start and end are places in the rendering (code points,
    end exclusive); mask_start and mask_end are -1 where nothing is to be learned. A null
    or empty role is the participant "unknown", null text is empty. Conversations of system
    turns alone have no participant and no rows, and so has an empty table. A null conv_id is
    a conversation of its own. Other columns are not read.
    """
    who = F.coalesce(F.nullif(F.col(f"`{role}`"), F.lit("")), F.lit("unknown"))
    said = df.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), who.alias("who"), _escaped(F.col(f"`{text}`"), "").alias("said"))
    said = said.withColumn("chunk", F.floor(F.coalesce("turn", F.lit(-1)) / CHUNK))
    people = said.where(F.col("who") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("who").alias("perspective")).distinct()
    # participants meet a conversation's chunks first, so that its turns are dealt by chunk however many they are
    chunks = said.select("conv_id", F.col("chunk").alias("k")).distinct().join(people, F.col("conv_id").eqNullSafe(F.col("c"))).select("c", "k", "perspective")
    each = said.join(chunks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))).drop("c", "k")
    name = F.regexp_replace("who", "[<>|\\s]", "_")
    mine = F.col("who") == F.col("perspective")
    head = F.when(F.col("who") == SYSTEM, F.lit("<|system|>\n")).when(mine, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    each = each.withColumns({"head": F.length(head).cast("long"), "mine": mine, "rendered": F.concat(head, F.col("said"), F.lit(END))}).withColumn("size", F.length("rendered").cast("long"))
    sums = each.groupBy("conv_id", "perspective", "chunk").agg(F.sum("size").alias("chars"), F.count("*").alias("turns"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("chunk").alias("k"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars"), F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns"))
    placed = each.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("chunk") == F.col("k")))
    within = Window.partitionBy("conv_id", "perspective", "chunk").orderBy("turn", "who", "said")
    placed = placed.withColumns({
        "seq": F.col("turns") + F.row_number().over(within) - 1,
        "end": F.col("chars") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)),
    })
    shown = F.when(F.col("who") == SYSTEM, F.lit("system")).when(F.col("mine"), F.lit("assistant")).otherwise(F.lit("user"))
    start = F.col("end") - F.col("size")
    return placed.select("conv_id", "perspective", "turn", "seq", shown.alias("role"), "rendered", start.alias("start"), "end", F.when(F.col("mine"), start + F.col("head")).otherwise(F.lit(-1)).alias("mask_start"), F.when(F.col("mine"), F.col("end")).otherwise(F.lit(-1)).alias("mask_end"))


def op10_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation in every participant's rendering."""
    return rotated(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH s AS (SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS who, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, who AS perspective FROM s WHERE who <> 'system'),
e AS (SELECT conv_id, perspective, turn, who, said, CASE WHEN who = 'system' THEN '<|system|>' || chr(10) WHEN who = perspective THEN '<|assistant|>' || chr(10)
  ELSE '<|user name=' || regexp_replace(who, '[<>|\\s]', '_', 'g') || '|>' || chr(10) END AS head FROM s JOIN p ON conv_id IS NOT DISTINCT FROM c),
r AS (SELECT *, head || said || '<|end|>' || chr(10) AS rendered FROM e),
o AS (SELECT *, row_number() OVER w - 1 AS seq, (sum(length(rendered)) OVER w)::BIGINT AS "end" FROM r
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, who, said ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, turn, seq, CASE WHEN who = 'system' THEN 'system' WHEN who = perspective THEN 'assistant' ELSE 'user' END AS role, rendered,
  "end" - length(rendered) AS start, "end", CASE WHEN who = perspective THEN "end" - length(rendered) + length(head) ELSE -1 END AS mask_start, CASE WHEN who = perspective THEN "end" ELSE -1 END AS mask_end FROM o"""
