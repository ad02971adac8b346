"""Chat formatting by multi-party perspective rotation.

A conversation is rendered once per participant (distinct role). In a rendering
that speaker's turns are the assistant's; every other speaker is a user with a
name; system turns keep their role in every rendering and are no participant. One
row is one turn of one rendering: its text with header and end mark, its place
in the whole rendering (code points), and whether it counts for the loss (the
assistant's turns alone, without their headers).

Rows, not whole renderings, are the unit, so a conversation of any length stays
spread over tasks: turns are sorted by ranges into a table, blocks are BLOCK rows of it
in order (whatever the turns' numbers), and places are sums over a rendering's
blocks plus sums inside the block. `rendered` joins the rows of conversations of ordinary length to one
text and its mask.

Defined cases: a null text is empty; a null role is the speaker ''; null turns come
first; equal turns are ordered by role and text; repeated rows are rendered
as often as they occur; rows with a null conversation id are one conversation
(null); extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmap.llm.shared import Tables, sized, table, with_columns_renamed_apart

BLOCK = 1024
SYSTEM = "system"


def rotated(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, turn, role, name, rendered, start, end, loss_start, loss_end, in_loss."""
    rows = with_columns_renamed_apart(turns, {conv_col: "conv_id", turn_col: "turn", role_col: "speaker", text_col: "text"})
    rows = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("speaker").cast("string"), F.lit("")).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    tables = Tables(turns.sparkSession)
    # Rows in order, numbered by it: a conversation may begin in one range and end in another.
    order = ["conv_id", "turn", "speaker", "text", "tie"]
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    rows = tables.keep(rows.withColumn("nth", F.monotonically_increasing_id()), "turns")
    # One row per conversation and participant.
    parties = rows.filter(F.col("speaker") != SYSTEM).groupBy("conv_id", F.col("speaker").alias("perspective")).agg(F.count("*").alias("n")).select(F.col("conv_id").alias("c"), "perspective")
    own = rows.join(sized(tables, parties, "parties"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    own = own.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    header = F.concat(F.lit("<|"), "role", F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), "name")).otherwise(""), F.lit("|>\n"))
    own = own.withColumn("header", header).withColumn("rendered", F.concat("header", "text", F.lit("<|end|>\n"))).withColumn("length", F.length("rendered").cast("long"))
    own = own.withColumn("block", F.floor(F.col("nth") / BLOCK))
    key = ["conv_id", "perspective"]
    sums = own.groupBy(*key, "block").agg(F.sum("length").alias("block_length"))
    before = F.coalesce(F.sum("block_length").over(W.partitionBy(*key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), before.alias("before"))
    placed = own.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    inside = F.sum("length").over(W.partitionBy(*key, "block").orderBy("nth").rowsBetween(W.unboundedPreceding, 0))
    placed = placed.withColumn("end", F.col("before") + inside).withColumn("start", F.col("end") - F.col("length"))
    loss = F.col("role") == "assistant"
    return placed.select(
        *key, "turn", "role", "name", "rendered", "start", "end",
        F.when(loss, F.col("start") + F.length("header")).alias("loss_start"),
        F.when(loss, F.col("end") - 1).alias("loss_end"),
        loss.alias("in_loss"),
    )


def rendered(turns: DataFrame, **columns) -> DataFrame:
    """conv_id, perspective, text, mask (array of start and end): for conversations that fit a row."""
    rows = rotated(turns, **columns)
    parts = F.array_sort(F.collect_list(F.struct("start", "rendered", "loss_start", "loss_end")))
    out = rows.groupBy("conv_id", "perspective").agg(parts.alias("parts"))
    mask = F.transform(F.filter("parts", lambda p: p["loss_start"].isNotNull()), lambda p: F.struct(p["loss_start"].alias("start"), p["loss_end"].alias("end")))
    return out.select("conv_id", "perspective", F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("text"), mask.alias("mask"))


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'),
r AS (SELECT t.conv_id, perspective, turn, speaker, text, CASE WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, CASE WHEN role = 'user' THEN speaker END AS name, '<|' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || '|>' || chr(10) AS header FROM r),
s AS (SELECT *, header || text || '<|end|>' || chr(10) AS rendered FROM h),
o AS (SELECT *, (sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING))::BIGINT AS "end" FROM s)
SELECT conv_id, perspective, turn, role, name, rendered, "end" - length(rendered) AS start, "end", CASE WHEN role = 'assistant' THEN "end" - length(rendered) + length(header) END AS loss_start,
  CASE WHEN role = 'assistant' THEN "end" - 1 END AS loss_end, role = 'assistant' AS in_loss FROM o
"""


def op1_perspective_rotation(spark, sf_dir: str) -> DataFrame:
    return rotated(table(spark, sf_dir, "conversations"))
