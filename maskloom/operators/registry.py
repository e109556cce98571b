"""Named collections of points as rows of a membership table.

A collection is a frame (point_id, ord[, value]); a registry is a frame
(collection, point_id, ord[, value]). ``ord`` is an ordering key: unique inside a collection and
growing with insertion, but not dense. Use ``position_index`` for places.

Every function returns a new frame; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskloom.functions.hashing import DEFAULT_SEED, point_id
from maskloom.operators.index import ORD_BUCKET, ordered_index, position_index, random_index

# Ranges of ``ord`` that one pass of get_at counts.
PARTS = 4096


# --- building collections -------------------------------------------------------------------


def make_points(df: DataFrame, source: str | Column, pos: str = "pos") -> DataFrame:
    """Give every row a stable point id derived from its source and position."""
    return df.withColumn("point_id", point_id(source, F.col(pos)))


def from_points(points: DataFrame, pos: str = "pos", value: str = "value") -> DataFrame:
    """Collection of (point_id, pos, value) rows; a repeated id keeps its first place and takes
    its last value."""
    return points.groupBy("point_id").agg(
        F.min(pos).alias("ord"), F.max_by(value, pos).alias(value)
    )


def from_values(
    values: DataFrame,
    keys: DataFrame | None = None,
    source: str = "values",
    pos: str = "pos",
    value: str = "value",
) -> DataFrame:
    """Collection of values in order, with the i-th key as id of the i-th value if given.

    ``values`` has (pos, value) and ``keys`` (pos, point_id), both with dense positions.
    """
    if keys is None:
        return make_points(values, source, pos).select("point_id", F.col(pos).alias("ord"), value)
    return from_points(values.join(keys, pos).select("point_id", pos, value), pos, value)


def upsert(collection: DataFrame, new: DataFrame, pos: str = "pos", value: str = "value") -> DataFrame:
    """Add points: an unknown id goes last, a known one keeps its place and takes the new value."""
    last = collection.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last")).scalar()
    fresh = from_points(new, pos, value).select(
        "point_id", F.col("ord").alias("_pos"), F.col(value).alias("_new"), F.lit(True).alias("_hit")
    )
    return (
        collection.join(fresh, "point_id", "full_outer")
        .withColumn("_last", last)
        .select(
            "point_id",
            F.coalesce("ord", F.col("_last") + 1 + F.col("_pos")).alias("ord"),
            F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(value)).alias(value),
        )
    )


def missing_ids(collection: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids that the collection does not hold."""
    return ids.select("point_id").join(collection, "point_id", "left_anti")


def remove(collection: DataFrame, ids: DataFrame, strict: bool = True) -> DataFrame:
    """Delete points by id; with ``strict`` an unknown id raises ``KeyError``."""
    if strict:
        unknown = missing_ids(collection, ids).take(1)
        if unknown:
            raise KeyError(unknown[0]["point_id"])
    return collection.join(ids.select("point_id"), "point_id", "left_anti")


def get_at(collection: DataFrame, index: int) -> DataFrame:
    """Row at a place; a negative index counts from the end.

    Counts by range of ``ord`` lead to the range that holds the place, ``PARTS`` ranges at a time, so
    that only rows of one range of ``ORD_BUCKET`` are sorted, and the range reaches the scan.
    """
    size, low, high = collection.agg(F.count("*"), F.min("ord"), F.max("ord")).first()
    at = index + size if index < 0 else index
    if not 0 <= at < size:
        raise IndexError(index)
    rows, left = collection, at
    while high - low >= ORD_BUCKET:
        width = -(-(high - low + 1) // PARTS)
        counts = rows.groupBy(F.expr(f"(ord - {low}) div {width}").alias("part")).count().collect()
        for part, n in sorted(counts):
            if left < n:
                break
            left -= n
        low += part * width
        high = low + width - 1
        rows = collection.filter(F.col("ord").between(low, high))
    place = F.row_number().over(Window.orderBy("ord"))
    found = rows.withColumn("idx", place).filter(F.col("idx") == left + 1)
    return found.withColumn("idx", F.lit(at).cast("bigint"))


def get_point(collection: DataFrame, wanted: str, strict: bool = True) -> DataFrame:
    """Row of one id."""
    hit = collection.filter(F.col("point_id") == wanted)
    if strict and hit.isEmpty():
        raise KeyError(wanted)
    return hit


def shuffled(collection: DataFrame, salt: str = "shuffle", seed: int = DEFAULT_SEED) -> DataFrame:
    """Same points in seeded random order."""
    return random_index(collection.drop("ord"), salt, seed=seed, name="ord")


def in_order(collection: DataFrame) -> DataFrame:
    """Rows sorted by place: what a caller iterates or writes out."""
    return collection.orderBy("ord")


def contains(collection: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of the ids that the collection holds."""
    return ids.join(collection.select("point_id"), "point_id", "left_semi")


def order_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Places at which two collections hold different ids; empty when they are aligned."""
    a = position_index(left).select("idx", F.col("point_id").alias("left_id"))
    b = position_index(right).select("idx", F.col("point_id").alias("right_id"))
    return a.join(b, "idx", "full_outer").filter(~F.col("left_id").eqNullSafe(F.col("right_id")))


# --- the registry ---------------------------------------------------------------------------


def collection_of(registry: DataFrame, name: str) -> DataFrame:
    """Points of a named collection; an unknown name gives an empty frame."""
    return registry.filter(F.col("collection") == name).drop("collection")


def exists(registry: DataFrame, name: str) -> bool:
    return not registry.filter(F.col("collection") == name).isEmpty()


def register(registry: DataFrame, collection: DataFrame, name: str) -> DataFrame:
    """Put a collection under a name, dropping an older one of that name."""
    return register_all(registry, collection.withColumn("collection", F.lit(name)), [name])


def register_all(registry: DataFrame, collections: DataFrame, names: Iterable[str]) -> DataFrame:
    """Put several collections (with their ``collection`` column) in one pass."""
    rest = registry.filter(~F.col("collection").isin(list(names)))
    return rest.unionByName(collections.select(*registry.columns))


def names(registry: DataFrame) -> DataFrame:
    return registry.select("collection").distinct()


def sizes(registry: DataFrame) -> DataFrame:
    return registry.groupBy("collection").agg(F.count("*").alias("n_points"))


def find(registry: DataFrame, wanted: str) -> DataFrame:
    """Collections holding one id."""
    return registry.filter(F.col("point_id") == wanted).select("collection")


def find_all(registry: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(point_id, collections): sorted names of the collections holding each id."""
    hits = registry if ids is None else contains(registry, ids)
    return hits.groupBy("point_id").agg(
        F.array_sort(F.collect_set("collection")).alias("collections")
    )


def find_named(members: DataFrame, catalog: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Collections holding each id, by name.

    ``members`` has (collection_id, point_id); ``catalog`` has (collection_id, name, reg_no) with
    a null name for unnamed collections. An unnamed hit is called ``unknown<i>``, i being its
    place among the hits in registration order.
    """
    hits = members if ids is None else contains(members, ids)
    # One row per collection of the point, so the window groups are small.
    order = Window.partitionBy("point_id").orderBy("reg_no")
    return (
        # Spark broadcasts the catalog while it is small and splits heavy collections otherwise.
        hits.join(catalog, "collection_id")
        .withColumn("hit", F.row_number().over(order) - 1)
        .select(
            "point_id",
            "collection_id",
            F.coalesce("name", F.concat(F.lit("unknown"), F.col("hit"))).alias("name"),
        )
    )


def tops(registry: DataFrame) -> DataFrame:
    """(collection, top): highest ord of each collection. A row per collection."""
    return registry.groupBy("collection").agg(F.max("ord").alias("top"))


def move(
    registry: DataFrame, moves: DataFrame, strict: bool = True, may_collide: bool = True
) -> DataFrame:
    """Move points between collections in one pass.

    ``moves`` has (point_id, source, target, rank); a moved point lands behind everything its
    target held, in ``rank`` order, also when the target is its own collection. If another target
    already holds the id, the moved row takes its place there, with the moved values, as with a
    dict; ``may_collide=False`` saves that look-up when it cannot happen. All moves are made at
    once: a point leaves a source once only. With ``strict`` a second move of it, or a point
    missing from its source, raises ``KeyError``; else the move of the lowest rank counts.
    """
    if strict:
        again = moves.groupBy("point_id", "source").count().where("count > 1").take(1)
        if again:
            raise KeyError(again[0]["point_id"])
        unknown = moves.join(
            registry.select("point_id", F.col("collection").alias("source")),
            ["point_id", "source"],
            "left_anti",
        ).take(1)
        if unknown:
            raise KeyError(unknown[0]["point_id"])
    else:
        moves = moves.groupBy("point_id", "source").agg(F.min(F.struct("rank", "target")).alias("m")).select(
            "point_id", "source", "m.target", "m.rank"
        )
    targets = tops(registry).withColumnsRenamed({"collection": "target", "top": "_top"})
    placed = moves.join(targets, "target", "left").select(
        "point_id",
        F.col("source").alias("collection"),
        "target",
        (F.coalesce("_top", F.lit(-1)) + 1 + F.col("rank")).alias("_ord"),
    )
    columns = registry.columns
    if may_collide:
        placed = _with_held(placed, registry)
        replaced = placed.where("_held").select("point_id", F.col("target").alias("collection"))
        registry = registry.join(replaced, ["point_id", "collection"], "left_anti")
    joined = registry.join(placed, ["point_id", "collection"], "left")
    return joined.select(
        *[
            F.coalesce("target", "collection").alias(c)
            if c == "collection"
            else (F.coalesce("_ord", "ord").alias(c) if c == "ord" else F.col(c))
            for c in columns
        ]
    )


def _with_held(placed: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``_held``, whether the target goes on holding the id, and take over its place."""
    staying = registry.join(placed.select("point_id", "collection"), ["point_id", "collection"], "left_anti")
    held = staying.select(
        "point_id", F.col("collection").alias("target"), F.col("ord").alias("_place"), F.lit(True).alias("_held")
    )
    joined = placed.join(held, ["point_id", "target"], "left")
    return joined.select(
        "point_id", "collection", "target", F.coalesce("_place", "_ord").alias("_ord"),
        F.coalesce("_held", F.lit(False)).alias("_held"),
    )


class Registry:
    """The functions above bound to one membership frame, for interactive use."""

    def __init__(self, members: DataFrame):
        self.members = members

    @classmethod
    def empty(cls, spark: SparkSession) -> "Registry":
        schema = "collection string, point_id string, ord bigint"
        return cls(spark.createDataFrame([], schema))

    def register(self, collection: DataFrame, name: str) -> "Registry":
        return Registry(register(self.members, collection, name))

    def get(self, name: str) -> DataFrame | None:
        """The collection, or None for an unknown name."""
        return collection_of(self.members, name) if exists(self.members, name) else None

    def add(self, name: str, points: DataFrame) -> "Registry":
        """Append points (point_id, pos) to a collection, with the values the registry holds."""
        old = collection_of(self.members, name)
        if "value" in old.columns:
            return self.register(upsert(old.select("point_id", "ord", "value"), points.select("point_id", "pos", "value")), name)
        merged = upsert(old.withColumn("value", F.lit(0)), points.select("point_id", "pos", F.lit(0).alias("value")))
        return self.register(merged.drop("value"), name)

    def remove(self, name: str, ids: DataFrame, strict: bool = True) -> "Registry":
        return self.register(remove(collection_of(self.members, name), ids, strict), name)

    def move(self, moves: DataFrame, strict: bool = True) -> "Registry":
        return Registry(move(self.members, moves, strict))

    def find(self, wanted: str) -> list[str]:
        """Names of the collections holding an id: at most one row per collection."""
        return sorted(r["collection"] for r in find(self.members, wanted).collect())

    def names(self) -> list[str]:
        return sorted(r["collection"] for r in names(self.members).collect())

    def sizes(self) -> dict[str, int]:
        return {r["collection"]: r["n_points"] for r in sizes(self.members).collect()}


def ordered_collection(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Collection from rows with a ``point_id`` and arbitrary ordering keys."""
    return ordered_index(df, *keys, name="ord")
