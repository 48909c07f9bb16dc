"""Chat formatting with collapse of cumulative snapshots. DataFrame operations only.

Loggers often store a conversation again after every turn, so a log holds many conversations that are prefixes of
longer ones. Turns are put in order, and every turn-prefix gets a rolling 128-bit hash: the running xor of hashes of
(place, role, text), which takes in one turn at a time and depends on the whole prefix in order. A conversation is
dropped if its full hash is that of a proper prefix of another one (an anti-join on length and hash); of equal
conversations the one with the smallest id stays. What is left is rendered, one text per conversation.

Scale: both sides of the anti-join are distinct keys, aggregated on the map side first, so a first turn or a whole
conversation that a third of the log shares is one key. Turns are placed by counts per block of turn numbers before
the exact order inside a block, so that a huge conversation is spread over many groups, and it is rendered in several
segments of at most `segment_turns` turns.

Defined results: rows equal in all four columns are one turn; turns of equal number are ordered by role, then text;
a NULL turn number comes first; a NULL role is written "unknown", a NULL text as empty (but both differ from those in
the comparison); rows with NULL conv_id belong to no conversation and are left out. Extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.session import materialize

BLOCK_TURNS = 4096
SEGMENT_TURNS = 4096

#: The marks of a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def placed_turns(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Distinct turns with place (from 1) and the rolling hash (h1, h2) of the prefix that ends there."""
    slim = rows.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.col(f"`{role_col}`").alias("role"),
        F.col(f"`{text_col}`").alias("text"),
    ).where("conv_id IS NOT NULL")
    turns = slim.dropDuplicates(["conv_id", "turn", "role", "text"])
    # NULL turn numbers come first, before all blocks
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62))).cast("long"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def up_to(sizes, columns):
        return sizes.select("conv_id", "block", *(c(before) for c in columns))

    sizes = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("rows"))
    starts = up_to(sizes, [lambda w: F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("start")])
    turns = turns.join(starts, ["conv_id", "block"]).withColumn("place", F.row_number().over(inside) + F.col("start")).drop("start")
    told = F.struct("place", "role", "text", F.col("role").isNull().alias("no_role"), F.col("text").isNull().alias("no_text"))
    turns = turns.withColumns({"x1": F.xxhash64(F.lit(1), told), "x2": F.xxhash64(F.lit(2), told)})
    # the same again for the hashes: running inside a block, on top of the blocks before
    blocks = turns.groupBy("conv_id", "block").agg(F.expr("bit_xor(x1)").alias("x1"), F.expr("bit_xor(x2)").alias("x2"))
    over = "OVER (PARTITION BY conv_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    earlier = blocks.select("conv_id", "block", *(F.expr(f"coalesce(bit_xor(x{k}) {over}, 0L)").alias(f"e{k}") for k in (1, 2)))
    run = "OVER (PARTITION BY conv_id, block ORDER BY place)"
    turns = turns.join(earlier, ["conv_id", "block"]).select(
        "conv_id", "place", "role", "text", *(F.expr(f"e{k} ^ bit_xor(x{k}) {run}").alias(f"h{k}") for k in (1, 2))
    )
    return turns


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no proper prefix of another, one of each group of equal ones."""
    size = turns.groupBy("conv_id").agg(F.max_by(F.struct("h1", "h2"), "place").alias("h"), F.max("place").alias("n_turns"))
    whole = size.groupBy("n_turns", "h").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    known = turns.join(size.select("conv_id", "n_turns"), "conv_id").where("place < n_turns")
    prefixes = known.select(F.col("place").alias("n_turns"), F.struct("h1", "h2").alias("h")).distinct()
    return whole.join(prefixes, ["n_turns", "h"], "left_anti").select("conv_id", "n_turns", "n_equal")


def render(turns: DataFrame, conversations: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """One text per conversation and segment, turns in order between the marks."""
    piece = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    rows = turns.join(conversations, "conv_id").withColumn("segment", F.floor((F.col("place") - 1) / segment_turns))
    texts = rows.groupBy("conv_id", "segment").agg(
        F.first("n_turns").alias("n_turns"),
        F.first("n_equal").alias("n_equal"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", piece.alias("piece")))), lambda x: x["piece"]), "").alias("rendered"),
    )
    return texts.withColumn("n_chars", F.char_length("rendered").cast("long"))


def format_chats(rows: DataFrame, segment_turns: int = SEGMENT_TURNS, **columns) -> DataFrame:
    """conv_id, segment, n_turns, n_equal, rendered, n_chars of the maximal conversations."""
    turns = materialize(placed_turns(rows, **columns))
    return render(turns, maximal(turns), segment_turns)


def op4_chat_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf}/conversations.parquet"))


OP4_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns FROM t GROUP BY conv_id
), d AS (
  SELECT turns, min(conv_id) AS conv_id, count(*) AS n_equal FROM c GROUP BY turns
), prefixes AS (
  SELECT DISTINCT turns[1 : k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM d)
), kept AS (
  SELECT d.* FROM d WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.turns = d.turns)
), written AS (
  SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, n_equal, array_to_string(list_transform(turns,
    lambda x: '<|im_start|>' || coalesce(x.r, 'unknown') || chr(10) || coalesce(x.t, '') || '<|im_end|>' || chr(10)), '') AS rendered
  FROM kept
)
SELECT conv_id, CAST(0 AS BIGINT) AS segment, n_turns, n_equal, rendered, CAST(length(rendered) AS BIGINT) AS n_chars FROM written
"""
