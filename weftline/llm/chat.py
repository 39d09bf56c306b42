"""Chat formatting with cumulative-snapshot collapse (DataFrame functions only).

Logs often hold a conversation many times, each snapshot longer than the last. Every
turn prefix gets a rolling hash: the running XOR of two 64-bit hashes of (position,
role, text), so a prefix of k turns has the pair of values after turn k. A conversation
whose full hash equals a proper prefix hash of another one is a snapshot of it and
goes; of equal conversations the one with the least id stays. Both are anti-joins on
the hash pair. What remains is rendered.

Distribution: prefix hashes come from a window per conversation that streams its turns.
Prefixes are first reduced to distinct (length, hash) pairs, so a first turn shared by
a third of all conversations is one row per map task. Rendering gathers the turns of a
conversation, which is one output string.

Nulls: null roles render as ``user``, null texts as empty, and hash apart from both;
turns are ordered by ``turn`` (null first), role, text; a null conv_id groups as one
conversation and comes last in ties. Repeated rows are repeated turns. Empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: role, rendered before its text; the end of a turn
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"


def turns_hashed(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, last, h1, h2, role, text): position from 1, and the prefix hashes after the turn."""
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("n", F.row_number().over(order))
    parts = [F.col("n"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    upto = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("t1", F.xxhash64(F.lit(1), *parts)).withColumn("t2", F.xxhash64(F.lit(2), *parts))
    return rows.select("conv_id", "n", "role", "text", F.bit_xor("t1").over(upto).alias("h1"), F.bit_xor("t2").over(upto).alias("h2"), F.lead("n").over(Window.partitionBy("conv_id").orderBy("n")).isNull().alias("last"))


def maximal(hashed: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that are neither a proper prefix of another nor a repeat."""
    whole = hashed.where("last").select("conv_id", "n", "h1", "h2")
    proper = hashed.where("not last").select("n", "h1", "h2").distinct()
    longest = whole.join(proper, ["n", "h1", "h2"], "left_anti")
    first = longest.groupBy("n", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNull().alias("x"), "conv_id")).alias("k"))
    return first.select("k.conv_id", F.col("n").alias("n_turns"))


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, text."""
    hashed = materialise(turns_hashed(conversations), "chat-turns")
    kept = maximal(hashed).withColumnRenamed("conv_id", "kept_id")
    turns = hashed.join(kept, hashed["conv_id"].eqNullSafe(kept["kept_id"]))
    piece = F.concat(F.lit(TURN_START), F.coalesce("role", F.lit("user")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(TURN_END + "\n"))
    gathered = turns.groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(F.struct("n", piece.alias("piece")))).alias("pieces"))
    return gathered.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.array_join(F.col("pieces.piece"), "").alias("text"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations"))
