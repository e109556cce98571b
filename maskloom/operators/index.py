"""Exact global ranks without a one-task window.

``ordered_index``  any keys; one range shuffle, materialised once.
``random_index``   seeded permutation; lazy, one hash shuffle of the kept rows.
``position_index`` unique compact integers (``ord``); lazy, one hash shuffle.

All of them expect narrow rows (ids and keys): pixels are attached afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions.hashing import DEFAULT_SEED, random_key
from maskloom.session import cut_lineage

# monotonically_increasing_id() keeps the partition above bit 33 and the row number below it.
_ROW_BITS = 33
# Four hex digits: at most 65,536 buckets, so the table of bucket sizes has a fixed bound.
_HEX_DIGITS = 4
# Ord values per bucket; ords are unique, so this also bounds the rows of a bucket.
ORD_BUCKET = 1 << 17


def _cols(keys) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def ordered_index(df: DataFrame, *keys: str | Column, name: str = "idx") -> DataFrame:
    """0-based rank of every row by ``keys``, which must order rows uniquely.

    Rows are range-partitioned and sorted, then written to the checkpoint folder so that
    counting and ranking see the same partitions. A key shared by many rows is harmless as long
    as a later key tells them apart: the range bounds compare whole key tuples.
    """
    keys = _cols(keys)
    placed = cut_lineage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    part = F.shiftright("_slot", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition: the window below stays small however many rows there are.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    row = F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + row)
        .drop("_part", "_slot", "_offset")
    )


def _bucket_offsets(df: DataFrame, bucket: Column) -> DataFrame:
    """(_bucket, _offset, _total): rows in lower buckets and in all of them."""
    sizes = df.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return sizes.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias("_total"),
    )


def random_index(
    df: DataFrame,
    salt: str,
    id_col: str = "point_id",
    seed: int = DEFAULT_SEED,
    name: str = "idx",
    first=None,
) -> DataFrame:
    """0-based rank in the seeded permutation of ``id_col`` (unique ids).

    ``first`` keeps only the leading rows: an int, or a function from the total row count column
    to a count column. Buckets past that count are dropped before the shuffle, so taking a few
    rows moves a few rows.
    """
    key = random_key(salt, F.col(id_col), seed)
    keyed = df.withColumn("_key", key)
    bucket = F.substring("_key", 1, _HEX_DIGITS)
    offsets = _bucket_offsets(keyed, bucket)
    ranked = keyed.withColumn("_bucket", bucket).join(F.broadcast(offsets), "_bucket")
    if first is not None:
        limit = first(F.col("_total")) if callable(first) else F.lit(first)
        ranked = ranked.withColumn("_limit", limit).filter(F.col("_offset") < F.col("_limit"))
    inside = Window.partitionBy("_bucket").orderBy("_key", id_col)
    ranked = ranked.withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
    if first is not None:
        ranked = ranked.filter(F.col(name) < F.col("_limit")).drop("_limit")
    return ranked.drop("_bucket", "_key", "_offset", "_total")


def position_index(
    df: DataFrame, ord_col: str = "ord", name: str = "idx", within: str | None = None
) -> DataFrame:
    """0-based dense rank of unique compact integers such as ``ord``.

    With ``within`` the rank restarts for each of its values (a few collection names).
    """
    groups = [within] if within else []
    keyed = df.withColumn("_bucket", F.floor(F.col(ord_col) / F.lit(ORD_BUCKET)))
    sizes = keyed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    if within:
        before = Window.partitionBy(within).orderBy("_bucket").rowsBetween(
            Window.unboundedPreceding, -1
        )
    offsets = sizes.select(
        *groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(ord_col)
    return (
        keyed.join(offsets, [*groups, "_bucket"])
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_offset")
    )
