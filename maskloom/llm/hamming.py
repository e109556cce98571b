"""Exact nearest binary codes by incremental multi-index hashing.

A vector's code has the sign of each of its numbers as one bit. Codes are cut into m segments,
each with an index of its own. A query looks up its segments' values, then all values one bit
away, then two, and so on. After radius r every code closer than m (r + 1) has been seen, as one of
its segments would differ in r bits at most; a query is done once its k-th distance is below that.

All queries advance together; each radius is one join of the values to look up with the index.
Equal codes are one entry with their k smallest ids, which is all that k results can need, and a
value's entries are kept in rows of bounded length, so that a value shared by very many codes
spreads over tasks and gives each query at most k rows per such row.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import stored

BITS = 64
ROW_CODES = 1024


def code(vector: Column, bits: int = BITS) -> Column:
    """Signs of a vector as a long, first number lowest; null unless it has ``bits`` real numbers."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    valid = (F.size(numbers) == bits) & F.forall(
        numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    # Shifting the code up and adding a bit, from the last number to the first.
    packed = F.aggregate(
        F.reverse(numbers), F.lit(0).cast("long"),
        lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("long")),
    )
    return F.when(valid, packed)


def segments_for(rows: int, bits: int = BITS) -> int:
    """Segments of about log2(rows) bits, for which a value has about one code."""
    return max(2, min(8, math.ceil(bits / max(8, math.log2(max(rows, 2))))))


def bounds(segments: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; the first ones are wider by one where needed."""
    small, rest = divmod(bits, segments)
    out, at = [], 0
    for k in range(segments):
        width = small + (k < rest)
        out.append((at, width))
        at += width
    return out


def _value(c: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(c, first).bitwiseAND(F.lit((1 << width) - 1)).cast("long")


def _segment_values(df: DataFrame, cuts: list[tuple[int, int]], keep: list[str]) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(k).alias("segment"), _value(F.col("code"), a, w).alias("value"))
        for k, (a, w) in enumerate(cuts)
    ])
    return df.select(*keep, F.inline(entries))


def nearest_codes(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest of ``vectors`` for each of ``queries``.

    Both have vec_id and embedding; other columns are ignored. Ties go to the smaller vec_id, and
    a query that is also a row finds itself. Vectors that are null, of another length, or hold
    null or non-finite numbers are neither found nor queries; so are null ids. Repeated rows of
    an id are found once each at most; with fewer than k vectors a query has as many results.
    """
    spark = vectors.sparkSession

    def coded(df: DataFrame) -> DataFrame:
        return df.select("vec_id", code(F.col("embedding"), bits).alias("code")).where(
            "vec_id IS NOT NULL AND code IS NOT NULL"
        ).distinct()

    # The k smallest ids of a code: a window over ids inside slices first, then over the slices'
    # smallest, so that very many copies of one code meet in no task.
    slice_ = F.pmod(F.xxhash64("vec_id"), F.lit(256))
    first = Window.partitionBy("code", "slice").orderBy("vec_id")
    second = Window.partitionBy("code").orderBy("vec_id")
    ids = (
        coded(vectors).withColumn("slice", slice_)
        .withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
        .withColumn("n", F.row_number().over(second)).where(F.col("n") <= k)
    )
    entries = stored(ids.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    rows = entries.count()
    cuts = bounds(segments_for(rows, bits), bits)

    flat = _segment_values(entries.select("code", F.get("ids", F.lit(0)).alias("low")), cuts, ["code", "low"])
    sizes = flat.groupBy("segment", "value").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("code"), F.ceil(F.col("n") / ROW_CODES))
    index = stored(
        flat.join(sizes, ["segment", "value"]).groupBy("segment", "value", part.alias("part"))
        .agg(F.collect_list(F.struct("code", "low")).alias("codes")).drop("part")
    )

    asked = stored(coded(queries).select(F.col("vec_id").alias("query_id"), "code"))
    open_ = asked
    best = None
    radius = 0
    done: list[DataFrame] = []
    while True:
        masks = [
            (s, sum(1 << b for b in chosen))
            for s, (_, width) in enumerate(cuts)
            for chosen in itertools.combinations(range(width), radius)
        ]
        if masks:
            changed = spark.createDataFrame(masks, "segment int, mask long")
            probes = _segment_values(open_.withColumnRenamed("code", "own").withColumn("code", F.col("own")), cuts, ["query_id", "own"])
            probes = probes.join(changed, "segment").select(
                "query_id", "own", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value")
            )
            found = probes.join(index, ["segment", "value"])
            ranked = F.transform(
                "codes",
                lambda c: F.struct(
                    F.bit_count(c["code"].bitwiseXOR(F.col("own"))).alias("distance"),
                    c["low"].alias("low"), c["code"].alias("code"),
                ),
            )
            near = found.select("query_id", F.inline(F.slice(F.array_sort(ranked), 1, k)))
            near = near.distinct() if best is None else near.union(best).distinct()
            order = Window.partitionBy("query_id").orderBy("distance", "low", "code")
            near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")
            best = stored(near)
        # A code stands for as many results as it has ids, k at most.
        held = best.join(entries.select("code", F.size("ids").alias("m")), "code")
        order = Window.partitionBy("query_id").orderBy("distance", "low", "code").rowsBetween(Window.unboundedPreceding, 0)
        held = held.withColumn("sum", F.sum("m").over(order)).groupBy("query_id").agg(
            F.min(F.when(F.col("sum") >= k, F.col("distance"))).alias("kth")
        )
        covered = len(cuts) * (radius + 1) - 1
        radius += 1
        finished = held.where(F.col("kth") <= covered).select("query_id")
        last = covered >= bits or radius > max(w for _, w in cuts)
        still = None if last else stored(open_.join(finished, "query_id", "left_anti"))
        if last or still.isEmpty():
            done.append(best)
            break
        done.append(best.join(finished, "query_id", "left_semi"))
        best = stored(best.join(still.select("query_id"), "query_id", "left_semi"))
        open_ = still
    whole = done[0]
    for frame in done[1:]:
        whole = whole.union(frame)
    results = whole.join(entries, "code").select("query_id", "distance", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return results.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", F.col("distance").cast("long").alias("distance")
    )
