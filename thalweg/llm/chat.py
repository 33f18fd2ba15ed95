"""Chat formatting with multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and
the others as named users; loss masks mark what the participant says. Participants are the roles of a
conversation other than `system`, whose turns open every rendering as they are.

Each turn is rendered for each perspective by itself (a narrow map over the turns joined with the
conversation's participants). A rendering is stored in pieces of at most `piece_turns` turns, so that no task
holds more of a long conversation than one piece: the texts of its pieces, in order, are the rendering, and
places in masks count code points from the start of the rendering, whatever the pieces.

Defined results: a null text is empty; a null role is the participant `unknown`; turns with a null conv_id
form one conversation, null; a null turn comes first; rows that repeat a turn follow one another by role and
text; "<|" in texts and roles becomes "< |", and a line end in a role a space, so that they can't form marks; columns other than conv_id, turn, role and text are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|start|>", "<|end|>\n"
PIECE_TURNS = 1024


def rotate_turns(turns: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """(conv_id, perspective, block, piece, turn, role, text, rendered, head, trained): one row for each turn and perspective; pieces are ordered by block and piece."""
    plain = lambda c, null: F.replace(F.coalesce(F.col(c).cast("string"), F.lit(null)), F.lit("<|"), F.lit("< |"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.translate(plain("role", "unknown"), "\n", " ").alias("role"), plain("text", "").alias("text"))
    speakers = rows.where("role <> 'system'").select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct()
    # Turn numbers name the block; what repeats in it is numbered, so that neither a conversation nor a turn is one array.
    rows = rows.withColumn("block", F.floor(F.coalesce("turn", F.lit(0)) / piece_turns).cast("long"))
    within = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.withColumn("piece", F.floor((F.row_number().over(within) - 1) / piece_turns).cast("long"))
    each = placed.join(speakers, placed.conv_id.eqNullSafe(speakers.of)).drop("of")
    own = F.col("role") == F.col("perspective")
    tag = F.when(F.col("role") == "system", F.lit("system")).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), "role"))
    head = F.concat(F.lit(START), tag, F.lit("\n"))
    return each.select("conv_id", "perspective", "block", "piece", "turn", "role", "text", F.concat(head, "text", F.lit(END)).alias("rendered"), F.length(head).alias("head"), own.alias("trained"))


def rotate_perspectives(turns: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """conv_id, perspective, piece (from 0), n_turns, n_trained, text and mask (start:end of what the perspective says, with its end mark, counted from the start of the whole rendering)."""
    each = rotate_turns(turns, piece_turns)
    parts = each.groupBy("conv_id", "perspective", "block", "piece").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "rendered", "head", "trained"))).alias("parts"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("spans"))

    def step(acc, p):
        end = acc["at"] + F.length(p["rendered"])
        span = F.struct((acc["at"] + p["head"]).alias("a"), (end - 1).alias("b"))
        return F.struct(end.alias("at"), F.when(p["trained"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    done = parts.select(
        "conv_id", "perspective", "block", "piece",
        F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p["trained"])).cast("long").alias("n_trained"),
        F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("text"),
        F.aggregate("parts", start, step).alias("folded"),
    )
    # A row for each piece: as many as a rendering's turns divided by piece_turns.
    order = Window.partitionBy("conv_id", "perspective").orderBy("block", "piece")
    base = F.coalesce(F.sum("folded.at").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = F.transform("folded.spans", lambda s: F.concat_ws(":", (s["a"] + F.col("base")).cast("string"), (s["b"] + F.col("base")).cast("string")))
    done = done.withColumns({"base": base, "number": F.row_number().over(order).cast("long") - 1})
    return done.select("conv_id", "perspective", F.col("number").alias("piece"), "n_turns", "n_trained", "text", F.array_join(spans, ",").alias("mask"))


#: DuckDB's form of op4, over the view conversations.
SQL = r"""
WITH r AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, replace(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(10), ' ') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), b AS (
  SELECT *, floor(coalesce(turn, 0) / 1024.0)::BIGINT AS block FROM r
), q AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, role, text) - 1) // 1024 AS part FROM b
), s AS (
  SELECT DISTINCT conv_id AS of_conv, role AS perspective FROM r WHERE role <> 'system'
), e AS (
  SELECT q.*, s.perspective, role = perspective AS trained,
    '<|start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head
  FROM q JOIN s ON q.conv_id IS NOT DISTINCT FROM s.of_conv
), p AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM e
), o AS (
  SELECT *, sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY block, part, turn NULLS FIRST, role, text, head ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop,
    dense_rank() OVER (PARTITION BY conv_id, perspective ORDER BY block, part) - 1 AS piece FROM p
)
SELECT conv_id, perspective, piece, count(*) AS n_turns, count(*) FILTER (trained) AS n_trained,
  string_agg(rendered, '' ORDER BY stop, turn) AS text,
  coalesce(string_agg((stop - length(rendered) + length(head))::BIGINT || ':' || (stop - 1)::BIGINT, ',' ORDER BY stop) FILTER (trained), '') AS mask
FROM o GROUP BY conv_id, perspective, piece
"""
