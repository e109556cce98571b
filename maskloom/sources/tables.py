"""Parquet tables: points, registry snapshots, histories, numbered artifacts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A membership state; the collection is a folder, so reading one collection reads its files only.
MEMBERSHIP_SCHEMA = "point_id string, ord bigint, value int, collection string"


# --- points ---------------------------------------------------------------------------------


def write_points(
    points: DataFrame, path: str, table: str | None = None, buckets: int = 0, mode: str = "errorifexists"
) -> None:
    """Write the immutable pixel table.

    With ``table`` and ``buckets`` it is bucketed by point id, so joining a membership frame too
    large to broadcast moves only the membership, never the pixels.
    """
    if table and buckets:
        (
            points.repartition(buckets, "point_id")
            .write.mode(mode)
            .format("parquet")
            .option("path", path)
            .bucketBy(buckets, "point_id")
            .sortBy("point_id")
            .saveAsTable(table)
        )
    else:
        points.write.mode(mode).parquet(path)


def open_bucketed(spark: SparkSession, path: str, table: str, schema: str, buckets: int) -> DataFrame:
    """Declare an existing bucketed folder in this session and read it."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet "
        f"CLUSTERED BY (point_id) SORTED BY (point_id) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


# Positions of a chunk: the most members that one row of a chunk's members can hold.
CHUNK = 1024


def chunk_of(pos: Column) -> Column:
    return F.floor(pos / F.lit(CHUNK)).cast("bigint")


def write_chunked(points: DataFrame, path: str, table: str, buckets: int, mode: str = "errorifexists") -> DataFrame:
    """Write the pixel table in chunks of neighbouring positions and return it.

    Chunks are dealt to buckets and sorted by position, so a large membership joins by chunk without
    moving pixels (see ``operators.curation.attach``), and a range of positions skips row groups. Take at
    least as many buckets as shuffle partitions: Spark deals fewer ones out anew.
    """
    (
        points.withColumn("chunk", chunk_of(F.col("pos")))
        .repartition(buckets, "chunk")
        .write.mode(mode)
        .format("parquet")
        .option("path", path)
        .bucketBy(buckets, "chunk")
        .sortBy("chunk", "pos")
        .saveAsTable(table)
    )
    return points.sparkSession.table(table)


def read_points(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Read points, optionally only the first by position (pushed to the scan)."""
    points = spark.read.parquet(path)
    return points if first is None else points.filter(F.col("pos") < first)


# --- snapshots ------------------------------------------------------------------------------


class SnapshotStore:
    """Registry states as parquet partitions ``run=/cycle=/step=``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _folder(self, run: str, cycle: int, step: int) -> str:
        return f"{self.path}/run={run}/cycle={cycle}/step={step}"

    def save(self, members: DataFrame, run: str, cycle: int, step: int) -> DataFrame:
        """Write one state and return it read back, which also cuts its lineage.

        A state is never overwritten.
        """
        folder = self._folder(run, cycle, step)
        members.write.mode("errorifexists").partitionBy("collection").parquet(folder)
        return self.load(run, cycle, step)

    def load(self, run: str, cycle: int, step: int) -> DataFrame:
        """One state; only its folder is listed and read."""
        return self.spark.read.schema(MEMBERSHIP_SCHEMA).parquet(self._folder(run, cycle, step))

    def all(self) -> DataFrame:
        """Every state, with ``run``, ``cycle`` and ``step`` as pruned partition columns."""
        schema = f"{MEMBERSHIP_SCHEMA}, run string, cycle int, step int"
        return self.spark.read.schema(schema).parquet(self.path)


def trace(states: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Where each point was in every state and where it had been in the state before.

    Rows (run, point_id, cycle, step, collections, previous). A point has one row per state, so
    its window group is as small as the number of states.
    """
    if ids is not None:
        states = states.join(ids.select("point_id"), "point_id", "left_semi")
    placed = states.groupBy("run", "point_id", "cycle", "step").agg(
        F.concat_ws(",", F.array_sort(F.collect_set("collection"))).alias("collections")
    )
    earlier = Window.partitionBy("run", "point_id").orderBy("cycle", "step")
    return placed.withColumn("previous", F.lag("collections").over(earlier))


def transitions(states: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Only the rows of ``trace`` at which a point changed its collections."""
    traced = trace(states, ids)
    return traced.filter(F.col("previous").isNotNull() & (F.col("previous") != F.col("collections")))


# --- histories and artifacts ----------------------------------------------------------------


def append_history(history: DataFrame, path: str) -> None:
    """Append per-epoch rows (run, cycle, model, epoch, loss, metric, val_loss, val_metric)."""
    history.write.mode("append").parquet(path)


def first_free_version(artifacts: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """(name, version): lowest number from 0 not yet taken, per artifact name.

    Candidates are 0 and every taken number plus one; the taken ones are removed by an anti join,
    so a name with very many versions is no hot spot.
    """
    taken = artifacts.select(name, F.col(version).cast("bigint").alias(version)).distinct()
    candidates = taken.select(name, F.explode(F.array(F.lit(0), F.col(version) + 1)).alias(version))
    free = candidates.join(taken, [name, version], "left_anti")
    return free.groupBy(name).agg(F.min(version).alias(version))


def write_version(df: DataFrame, path: str) -> int:
    """Write under the first free ``version=`` folder of ``path`` and return its number.

    The number is claimed before anything is written, so two writers never take the same one.
    """
    from maskloom.sources.journal import NumberedFiles

    spark = df.sparkSession
    path = path.rstrip("/")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    # Spark's readers skip folders that begin with an underscore.
    claims = NumberedFiles(spark, f"{path}/_versions")
    if fs.exists(hadoop(path)):
        names = (entry.getPath().getName() for entry in fs.listStatus(hadoop(path)))
        known = {int(name.removeprefix("version=")) for name in names if re.fullmatch(r"version=\d+", name)}
        for number in known - set(claims.taken()):
            claims.create(number, "{}")
    number = claims.claim(lowest=True)
    df.write.mode("errorifexists").parquet(f"{path}/version={number}")
    return number
