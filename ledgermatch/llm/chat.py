"""Chat formatting after collapsing cumulative snapshots (DataFrame functions only).

A chat log often holds a conversation several times, each time with more turns.  Every
turn gets two 64-bit hashes of its place, role and text; their running sums in a
conversation are the rolling hashes of its turn prefixes (two exact sums of 64-bit values,
so that unequal prefixes of equal length practically never agree).  A conversation whose
full hash is the hash of a shorter prefix of another one is dropped by an anti-join;
of equal conversations the one of smallest id stays.  What is left is rendered.

No conversation is gathered in one task before it is cut: turns are numbered by a
distributed sort, running sums are built from blocks of ``BLOCK`` turns, and rendered rows
hold at most ``TURNS_PER_PART`` turns each (``part`` counts them; parts concatenate to the
whole).

Defined results: the turns of a conversation are ordered by turn, then role, then text,
null first; a null role is rendered as ``unknown``, a null text as empty, and each equals
only itself when turns are compared; rows with null conv_id are one conversation; repeated
turns stay; markers that occur in a text are broken up by a space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.llm.common import key_of
from ledgermatch.operators.ordering import with_row_index
from ledgermatch.session import materialize

BLOCK = 4096
TURNS_PER_PART = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, key, pos (from 0), n_turns, role, text."""
    d = turns.select("conv_id", key_of("conv_id").alias("key"), F.col("turn").alias("turn"),
                     F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    t = with_row_index(d, ["key", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(),
                           F.col("text").asc_nulls_first()], "idx")
    spans = t.groupBy("key").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n_turns"))
    return t.join(spans, "key").select("conv_id", "key", (F.col("idx") - F.col("first")).alias("pos"), "n_turns", "role", "text")


def prefix_hashes(t: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, key, pos, n_turns, h1, h2): rolling hashes of the prefix that ends at pos."""
    def own(seed: int) -> Column:
        return F.xxhash64(F.lit(seed), "pos", key_of("role"), key_of("text")).cast("decimal(38,0)")

    d = t.select("conv_id", "key", "pos", "n_turns", F.expr(f"pos div {int(block)}").alias("blk"),
                 own(1).alias("t1"), own(2).alias("t2"))
    sums = (d.where(F.col("n_turns") > block).groupBy("key", "blk")
            .agg(F.sum("t1").cast("decimal(38,0)").alias("s1"), F.sum("t2").cast("decimal(38,0)").alias("s2")))
    earlier = Window.partitionBy("key").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("key", "blk", F.sum("s1").over(earlier).cast("decimal(38,0)").alias("o1"),
                          F.sum("s2").over(earlier).cast("decimal(38,0)").alias("o2"))
    within = Window.partitionBy("key", "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = d.select("conv_id", "key", "pos", "n_turns", "blk", F.sum("t1").over(within).alias("r1"), F.sum("t2").over(within).alias("r2"))
    zero = F.lit(0).cast("decimal(38,0)")
    return run.join(offsets, ["key", "blk"], "left").select(
        "conv_id", "key", "pos", "n_turns",
        (F.col("r1") + F.coalesce("o1", zero)).cast("decimal(38,0)").alias("h1"),
        (F.col("r2") + F.coalesce("o2", zero)).cast("decimal(38,0)").alias("h2"))


def maximal(hashes: DataFrame) -> DataFrame:
    """Keys of the conversations that are no prefix of another one, one of equal ones."""
    full = (hashes.where(F.col("pos") == F.col("n_turns") - 1)
            .groupBy(F.col("n_turns").alias("n"), "h1", "h2")
            .agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "key"))["key"].alias("key")))
    shorter = hashes.where(F.col("pos") < F.col("n_turns") - 1).select((F.col("pos") + 1).alias("n"), "h1", "h2").distinct()
    return full.join(shorter, ["n", "h1", "h2"], "left_anti").select("key")


def _plain(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))


def rendered_turn(role, text) -> Column:
    return F.concat(F.lit(OPEN), _plain(F.coalesce(role, F.lit("unknown"))), F.lit("\n"),
                    _plain(F.coalesce(text, F.lit(""))), F.lit(CLOSE + "\n"))


def format_chats(turns: DataFrame, block: int = BLOCK, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """``turns`` (conv_id, turn, role, text): one row per retained conversation and part:
    conv_id, part, n_turns (of the conversation) and text."""
    t = materialize(numbered(turns), "chat-turns")
    hashes = materialize(prefix_hashes(t, block), "chat-hashes")
    kept = t.join(maximal(hashes), "key", "left_semi")
    line = rendered_turn(F.col("role"), F.col("text"))
    parts = kept.select("conv_id", "key", "n_turns", F.expr(f"pos div {int(turns_per_part)}").alias("part"),
                        F.struct("pos", line.alias("line")).alias("one"))
    # a group holds at most turns_per_part turns
    return (parts.groupBy("conv_id", "key", "n_turns", "part").agg(F.array_sort(F.collect_list("one")).alias("all"))
            .select("conv_id", "part", "n_turns", F.array_join(F.col("all.line"), "").alias("text")))
