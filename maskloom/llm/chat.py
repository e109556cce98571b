"""Collapsing cumulative snapshots of conversations, then rendering what is left.

A logging client often stores a conversation again after each exchange. The rolling hash of the
first t turns is the running sum of hashes of (place, role, text); as each place is hashed with
its turn, equal sums mean equal prefixes. A conversation whose full hash is the hash of a proper
prefix of another one is dropped by an anti-join; of equal conversations the smallest id stays.

A conversation may hold a large share of all turns: places and running sums are made in two
levels, from counts and sums of blocks of turns and windows inside a block, and the rendering has
one row per turn with its place in the text, so nothing gathers a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import stored

BLOCK = 1024
# Three numbers of 9 hex digits (36 bits): sums stay below 2**63 for 2**27 turns.
_DIGITS, _PARTS = 9, 3
_HASH = [f"h{k}" for k in range(_PARTS)]

# The template of a turn.
HEAD, MIDDLE, TAIL = "<|", "|>\n", "<|end|>\n"


def _turn_hashes(place: Column) -> list[Column]:
    def part(c: str) -> Column:
        text = F.coalesce(F.col(c), F.lit(""))
        return F.concat(F.when(F.col(c).isNull(), "n").otherwise(F.length(c).cast("string")), F.lit(":"), text)

    digest = F.md5(F.concat(place.cast("string"), F.lit("|"), part("role"), F.lit("|"), part("text")))
    return [
        F.conv(F.substring(digest, 1 + k * _DIGITS, _DIGITS), 16, 10).cast("long").alias(_HASH[k])
        for k in range(_PARTS)
    ]


def _running(df: DataFrame, order: list[str], columns: list[str], upto: list[str]) -> DataFrame:
    """Running sums of ``columns`` per conversation as ``upto``, blocks first."""
    sums = df.groupBy("conv_id", "block").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        F.col("conv_id").alias("_conv"), F.col("block").alias("_block"),
        *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in columns],
    )
    inside = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(
        before, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("block").eqNullSafe(F.col("_block"))
    )
    return joined.select(
        *df.columns, *[(F.col(f"_{c}") + F.sum(c).over(inside)).alias(u) for c, u in zip(columns, upto)]
    )


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    """(conv_id, place, n_turns, role, rendered, start) of the maximal conversations of ``turns``.

    ``turns`` has conv_id, turn, role and text; other columns are ignored. Turns are ordered by
    turn (null first), role and text; repeated rows count once. Rows with a null conv_id form one
    conversation. Null roles and texts render as empty but differ from empty ones. ``start`` is
    the place of the rendered turn in the conversation's text, in characters; joining the rows of
    a conversation by place gives that text.
    """
    rows = turns.select("conv_id", "turn", "role", "text").distinct()
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK)).withColumn("one", F.lit(1))
    order = ["turn", "role", "text"]
    placed = _running(rows, order, ["one"], ["place"])
    rendered = F.concat(
        F.lit(HEAD), F.coalesce("role", F.lit("")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(TAIL)
    )
    hashed = placed.select(
        "conv_id", "place", "role", *_turn_hashes(F.col("place")), rendered.alias("rendered"),
        F.length(rendered).alias("chars"), F.floor((F.col("place") - 1) / BLOCK).alias("block"),
    )
    upto = [f"p{k}" for k in range(_PARTS)]
    whole = stored(_running(hashed, ["place"], [*_HASH, "chars"], [*upto, "end"]))

    sizes = whole.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    prefixes = whole.select("conv_id", "place", *upto)
    known = prefixes.join(sizes.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")))
    ends = known.where("place = n_turns").groupBy("place", *upto).agg(F.min("conv_id").alias("conv_id"))
    proper = known.where("place < n_turns").select("place", *upto).distinct()
    kept = ends.join(proper, ["place", *upto], "left_anti").select(
        F.col("conv_id").alias("_conv"), F.col("place").alias("n_turns")
    )
    return whole.join(kept, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", "place", "n_turns", "role", "rendered", (F.col("end") - F.col("chars")).alias("start")
    )
