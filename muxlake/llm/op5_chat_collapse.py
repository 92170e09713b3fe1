"""Operator 5, chat formatting: logged snapshots of a conversation collapse to the longest before they are rendered.

A turn's hash covers its place, role and text; the running sum of a conversation's turn hashes is the hash of its prefix. A
conversation whose whole hash is a shorter prefix of another is a snapshot of it: an anti-join against the distinct prefix hashes
keeps the maximal ones, and of equal conversations the smallest conv_id. Those are rendered with a mark for each role.

Defined cases: turns are ordered by turn, then role and text, nulls first, and repeated rows are turns of their own; a null role or text
differs from an empty one and is rendered as empty; rows with a null conv_id are left out, as they belong to no conversation; an
empty table gives an empty result; other columns are ignored. A conversation is one window group and one row of the result, so its turns have to
fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muxlake.llm.common import saved

TURN_START, TURN_END = "<|turn|>", "<|end|>\n"
_HASH = ["a", "b", "c", "d"]


def _halves(seed: int) -> list[Column]:
    """Two 32-bit halves of a turn's hash; their sums do not overflow."""
    h = F.xxhash64(F.lit(seed), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    return [F.shiftrightunsigned(h, 32), h.bitwiseAND(0xFFFFFFFF)]


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, a, b, c, d): a to d hash the turns up to this one; place counts from 1."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order))
    halves = [*_halves(1), *_halves(2)]
    hashed = placed.select("conv_id", "turn", "role", "text", "place", *(h.alias(f"h_{c}") for h, c in zip(halves, _HASH)))
    running = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    return hashed.select("conv_id", "place", "role", "text", *(F.sum(f"h_{c}").over(running).alias(c) for c in _HASH))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no snapshot of a longer one, one of equal ones."""
    hashed = saved(prefixes(turns).select("conv_id", "place", *_HASH), "prefixes")
    whole = hashed.groupBy("conv_id").agg(F.max_by(F.struct("place", *_HASH), "place").alias("w")).select("conv_id", "w.*")
    shorter = (
        hashed.select("conv_id", "place", *_HASH).join(whole.select("conv_id", F.col("place").alias("n_turns")), "conv_id")
        .where("place < n_turns").select("place", *_HASH).distinct()
    )
    one = whole.groupBy("place", *_HASH).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    kept = one.join(shorter, ["place", *_HASH], "left_anti")
    return kept.select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations."""
    kept = maximal(turns)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.select("conv_id", "turn", "role", "text").join(kept, "conv_id").withColumn("place", F.row_number().over(order))
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turn = F.concat(F.lit(TURN_START), role, F.lit("\n"), text, F.lit(TURN_END))
    parts = placed.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("place", turn.alias("t")))).alias("t"))
    return parts.select("conv_id", "n_turns", "n_copies", F.array_join("t.t", "").alias("rendered"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All logged conversations, collapsed and rendered."""
    out = render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "n_turns", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))
