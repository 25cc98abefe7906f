"""Chat formatting: every participant's view of a dialogue, in Spark SQL alone.

For each speaker of a conversation the dialogue is rendered with that speaker
as the assistant, the others as users under their names, and system turns as
they are. A view comes as its messages, in order, with their place in the
rendered text; joining ``segment`` in order of ``seq`` gives the text. A loss
mask covers what the assistant says, with the end mark: [mask_start, mask_end).

Places are prefix sums. They are taken within blocks of ``BLOCK`` turns, then
over the blocks' totals, so that no task holds one long conversation whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
NOBODY = "unknown"  # a message without a role
BLOCK = 64


def perspectives(conversations: DataFrame) -> DataFrame:
    """(conv_id, participant, seq, turn, speaker, role, segment, char_start,
    char_end, trained, mask_start, mask_end), a row for each message and view.

    Messages go by turn (null last), then speaker, then text; repeated rows all
    stay. A null text counts as empty, a null or empty role as "unknown", who
    is a participant. A conversation of system turns alone has no view. Rows
    without conv_id are one conversation. Offsets are code points.
    """
    speaker = F.when(F.coalesce("role", F.lit("")) == "", F.lit(NOBODY)).otherwise(F.col("role"))
    base = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), speaker.alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    views = base.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("participant")).distinct()
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(2**62)).cast("long")
    m = base.withColumn("block", block).alias("m").join(views.alias("v"), F.expr("m.conv_id <=> v.conv_id")).select("m.*", "participant")
    own = F.col("speaker") == F.col("participant")
    m = m.withColumn("role", F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user"))
    head = F.concat(F.lit(OPEN), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(F.lit("")), F.lit("\n"))
    m = m.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, "text", F.lit(CLOSE + "\n"))).withColumn("n", F.length("segment").cast("long"))
    inner = Window.partitionBy("conv_id", "participant", "block").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
    m = m.withColumn("k", F.row_number().over(inner).cast("long")).withColumn("end", F.sum("n").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    outer = Window.partitionBy("conv_id", "participant").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = m.groupBy("conv_id", "participant", "block").agg(F.count("*").alias("rows"), F.sum("n").alias("chars"))
    blocks = blocks.select("conv_id", "participant", "block", F.coalesce(F.sum("rows").over(outer), F.lit(0)).alias("rows"), F.coalesce(F.sum("chars").over(outer), F.lit(0)).alias("chars"))
    out = m.alias("m").join(blocks.alias("b"), F.expr("m.conv_id <=> b.conv_id AND m.participant = b.participant AND m.block = b.block"))
    start = F.col("chars") + F.col("end") - F.col("n")
    trained = F.col("role") == "assistant"
    return out.select(
        F.col("m.conv_id").alias("conv_id"), F.col("m.participant").alias("participant"), (F.col("rows") + F.col("k") - 1).cast("long").alias("seq"), "turn", "speaker", "role", "segment",
        start.cast("long").alias("char_start"), (start + F.col("n")).cast("long").alias("char_end"), trained.alias("trained"),
        F.when(trained, start + F.col("head")).cast("long").alias("mask_start"), F.when(trained, start + F.col("n") - 1).cast("long").alias("mask_end"),
    )


ORACLE = """
WITH base AS (
  SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS speaker, coalesce(text, '') AS text FROM conversations
), views AS (
  SELECT DISTINCT conv_id, speaker AS participant FROM base WHERE speaker <> 'system'
), m AS (
  SELECT base.*, participant,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = participant THEN 'assistant' ELSE 'user' END AS role
  FROM base JOIN views ON base.conv_id IS NOT DISTINCT FROM views.conv_id
), h AS (
  SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM m
), s AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h
), w AS (
  SELECT *, row_number() OVER v - 1 AS seq, CAST(sum(length(segment)) OVER (v ROWS UNBOUNDED PRECEDING) AS BIGINT) AS char_end
  FROM s WINDOW v AS (PARTITION BY conv_id, participant ORDER BY turn NULLS LAST, speaker, text)
)
SELECT conv_id, participant, seq, turn, speaker, role, segment, char_end - length(segment) AS char_start, char_end, role = 'assistant' AS trained,
       CASE WHEN role = 'assistant' THEN char_end - length(segment) + length(head) END AS mask_start,
       CASE WHEN role = 'assistant' THEN char_end - 1 END AS mask_end
FROM w
"""
