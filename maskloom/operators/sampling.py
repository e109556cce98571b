"""Seeded samples and draws from a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions.hashing import DEFAULT_SEED, random_below, random_key
from maskloom.operators.index import random_index


def percent_divisor(percent: int) -> int:
    """Divisor of the share: 30 -> 3, 34..50 -> 2, 51..100 -> 1. Above 100 there is none."""
    divisor = int(100 / percent)
    if divisor == 0:
        raise ZeroDivisionError(f"percent must be at most 100, not {percent}")
    return divisor


def sample_percent(
    members: DataFrame, percent: int = 30, salt: str = "relabel", seed: int = DEFAULT_SEED
) -> DataFrame:
    """Sample ``n // int(100 / percent)`` points without replacement, ranked in ``idx``."""
    divisor = percent_divisor(percent)

    def share(total: Column) -> Column:
        return F.floor(total / F.lit(divisor)).cast("bigint")

    return random_index(members, salt, seed=seed, first=share)


def sample_with_replacement(
    indexed: DataFrame, percent: int = 30, salt: str = "draw", seed: int = DEFAULT_SEED
) -> DataFrame:
    """Same size, with replacement: rows (draw, point_id). ``indexed`` has a dense ``idx``."""
    divisor = percent_divisor(percent)
    total = indexed.agg(F.count("*").alias("total")).scalar()
    # The first k places double as draw numbers, so draws are spread like the rows themselves.
    draws = (
        indexed.select(F.col("idx").alias("draw"))
        .withColumn("_total", total)
        .filter(F.col("draw") < F.floor(F.col("_total") / F.lit(divisor)))
        .select("draw", random_below(salt, F.col("draw"), F.col("_total"), seed).alias("idx"))
    )
    return draws.join(indexed, "idx").drop("idx")


def draw_one(members: DataFrame, salt: str = "draw_one", seed: int = DEFAULT_SEED) -> DataFrame:
    """One random point: the first of the seeded permutation, as an aggregate."""
    key = random_key(salt, F.col("point_id"), seed)
    return members.agg(F.min_by("point_id", F.struct(key, F.col("point_id"))).alias("point_id"))


def head(indexed: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    """First n points by dense position; a range filter, pushed to the scan."""
    return indexed.filter(F.col(idx) < n)
