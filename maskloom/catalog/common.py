"""Query registration and the frames that queries and their SQL counterparts share.

The driver tables stand in for image data: an embedding of 64 numbers is an 8 x 8 picture, an
order is a point. Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions.hashing import point_id

SIDE = 8
PIXELS = SIDE * SIDE
# Slope and centre of the stand-in soft prediction.
SLOPE, CENTER = 20.0, 0.05


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under its own name."""

    def wrap(build):
        QUERIES[build.__name__] = Query(build.__name__, build, sql)
        return build

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), 6)


def long_rows(df: DataFrame, *keys: str, image: str = "image") -> DataFrame:
    """(keys..., i, v): one row per pixel, rounded."""
    long = df.select(*keys, F.posexplode_outer(image).alias("i", "_v")).filter(F.col("i").isNotNull())
    return long.select(*keys, F.col("i").cast("bigint").alias("i"), r6("_v").alias("v"))


# --- points from orders ---------------------------------------------------------------------


def order_points(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.select(
        point_id("orders", F.col("o_orderkey")).alias("point_id"),
        F.col("o_orderkey").alias("pos"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderdate").alias("day"),
    )


SQL_POINTS = """
pts AS (
  SELECT md5('orders:' || o_orderkey) AS point_id, o_orderkey AS pos, o_totalprice AS value,
         o_orderstatus AS status, o_custkey AS customer, o_orderdate AS day
  FROM orders
), cnt AS (SELECT count(*) AS n FROM orders)
"""


# --- images from embeddings -----------------------------------------------------------------


def images(spark: SparkSession, folder: str) -> DataFrame:
    """8 x 8 pictures with a true mask (x > 0) and a soft prediction."""
    x = F.col("embedding")

    def soft(v: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-SLOPE) * (v.cast("double") - F.lit(CENTER))))

    return table(spark, folder, "embeddings").select(
        point_id("embeddings", F.col("vec_id")).alias("point_id"),
        F.col("vec_id").alias("pos"),
        F.lit(SIDE).alias("h"),
        F.lit(SIDE).alias("w"),
        x.alias("image"),
        F.transform(x, lambda v: F.when(v > 0, 1.0).otherwise(0.0)).alias("truth"),
        F.transform(x, soft).alias("prob"),
        "label",
    )


def bytes_images(spark: SparkSession, folder: str) -> DataFrame:
    """The pictures mapped to whole intensities 0..255."""
    def level(v: Column) -> Column:
        scaled = F.floor((v.cast("double") + 1) * 127.5)
        return F.least(F.greatest(scaled, F.lit(0)), F.lit(255)).cast("int")

    return images(spark, folder).withColumn("image", F.transform("image", level))


SQL_PX = f"""
px AS (
  SELECT pos, point_id, label, i, i // {SIDE} AS r, i % {SIDE} AS c, x,
         CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t,
         1.0::DOUBLE / (1.0::DOUBLE + exp(-20.0::DOUBLE * (x - 0.05::DOUBLE))) AS p,
         CAST(least(greatest(floor((x + 1) * 127.5::DOUBLE), 0), 255) AS BIGINT) AS u
  FROM (
    SELECT vec_id AS pos, md5('embeddings:' || vec_id) AS point_id, label,
           CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i,
           unnest(embedding)::DOUBLE AS x
    FROM embeddings)
), ecnt AS (SELECT count(*) AS n FROM embeddings)
"""


def sql_double(value: float) -> str:
    """The exact double as SQL text; a plain decimal literal could be rounded twice."""
    return f"CAST('{value!r}' AS DOUBLE)"


def sql_share(n: str, *factors: float) -> str:
    """``int(f1 * f2 * n)`` with the multiplication order of the library."""
    product = factors[0]
    for factor in factors[1:]:
        product = product * factor
    return f"CAST(trunc({sql_double(product)} * {n}) AS BIGINT)"


def sql_key(salt: str, id_col: str = "point_id", seed: int = 42) -> str:
    return f"md5('{seed}:{salt}:' || {id_col})"
