"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Chat logs often hold a conversation several times, each time with one more turn. A rolling hash over the turns names
every prefix; a conversation whose whole hash is a proper prefix of another, or equals that of one with a smaller id,
goes before anything is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

START, END = "<|im_start|>", "<|im_end|>"


def _clean(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that no other one continues or repeats.

    Turns are ordered by (turn, role, text), null turns first; null role or text counts as empty; a repeated row is
    one turn; null conv_id is a conversation. Prefixes are compared by two 64-bit hashes of their positions' turns
    and by their length.
    """
    turns = _clean(conversations).distinct().withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64("text", F.lit(7), "role")})
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.withColumn("pos", F.row_number().over(by_turn))
    rolling = by_turn.rowsBetween(Window.unboundedPreceding, 0)
    prefixes = turns.select(
        "conv_id", "pos", (F.lead("pos").over(by_turn).isNull()).alias("whole"),
        F.bit_xor(F.xxhash64("pos", "a", "b")).over(rolling).alias("h1"), F.bit_xor(F.xxhash64("b", F.lit(3), "pos", "a")).over(rolling).alias("h2"),
    )
    prefixes = materialize(prefixes, "chat-prefixes")
    whole = prefixes.where("whole").groupBy("h1", "h2", "pos").agg(F.min("conv_id").alias("conv_id"))
    longer = prefixes.where("NOT whole").select("h1", "h2", "pos").distinct()
    return whole.join(longer, ["h1", "h2", "pos"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"))


def format_chats(conversations: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """Rendered maximal conversations: conv_id, n_turns, text.

    Rows as in :func:`maximal_conversations`. An empty table gives no rows; extra columns are not read.
    """
    kept = maximal_conversations(conversations).withColumnRenamed("conv_id", "__kept")
    turns = _clean(conversations).join(kept, F.col("conv_id").eqNullSafe(F.col("__kept")))
    turn = F.struct("turn", "role", "text")  # a set in the order of above
    chats = turns.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_set(turn)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(start), t["role"], F.lit("\n"), t["text"], F.lit(end + "\n"))), "")
    return chats.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), text.alias("text"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP2_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT conv_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS (
  SELECT min(conv_id) AS conv_id, n_turns, prefix AS text FROM p WHERE pos = n_turns GROUP BY n_turns, prefix
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, text FROM f
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos = f.n_turns AND p.pos < p.n_turns AND p.prefix = f.text)
"""
