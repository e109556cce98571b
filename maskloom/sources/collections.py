"""A stored catalog of collections, named or not, in the order of their registration.

A registration writes the collection's rows, then claims the next number with a file that names
them; numbers are never shared or used again. A name stands for its latest registration.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.sources.journal import NumberedFiles

_ROW = "point_id string, ord bigint, value int"
CATALOG_SCHEMA = "reg_no bigint, name string, folder string"


class CollectionCatalog:
    """Collections (point_id, ord, value) under a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = NumberedFiles(spark, f"{self.path}/catalog")

    def register(self, collection: DataFrame, name: str | None = None) -> int:
        """Store a collection and return its number; under a ``name`` it takes the place of an older one."""
        folder = f"{self.path}/rows/{uuid.uuid4().hex}"
        columns = [f"CAST({c} AS {kind}) AS {c}" for c, kind in (x.split() for x in _ROW.split(", "))]
        collection.selectExpr(*columns).write.parquet(folder)
        return self.files.claim(json.dumps({"name": name, "folder": folder}) + "\n")

    def registrations(self) -> DataFrame:
        """(reg_no, name, folder) of every registration, also of those that a later one replaced."""
        if not self.files.taken():
            return self.spark.createDataFrame([], CATALOG_SCHEMA)
        rows = self.spark.read.schema("name string, folder string").json(f"{self.files.folder}/*.json")
        number = F.substring(F.col("_metadata.file_name"), 1, 12).cast("bigint")
        return rows.select(number.alias("reg_no"), "name", "folder")

    def table(self) -> DataFrame:
        """(reg_no, name, folder) of the collections that stand."""
        every = self.registrations()
        last = every.where("name IS NOT NULL").groupBy("name").agg(F.max("reg_no").alias("reg_no"))
        unnamed = every.where("name IS NULL")
        return unnamed.unionByName(every.join(last, ["name", "reg_no"]).select(*every.columns))

    def _rows(self, held: list) -> DataFrame:
        """Rows of some registrations, with their number and name."""
        schema = f"reg_no bigint, name string, {_ROW}"
        rows = self.spark.createDataFrame([], schema)
        for r in held:
            part = self.spark.read.schema(_ROW).parquet(r["folder"])
            rows = rows.unionByName(part.select(
                F.lit(r["reg_no"]).cast("bigint").alias("reg_no"), F.lit(r["name"]).cast("string").alias("name"),
                "point_id", "ord", "value",
            ))
        return rows

    def members(self) -> DataFrame:
        """(reg_no, name, point_id, ord, value) of all standing collections."""
        # A row per collection.
        return self._rows(self.table().orderBy("reg_no").collect())

    def get(self, name: str) -> DataFrame | None:
        """(point_id, ord, value) of a named collection; None for an unknown name."""
        held = self.table().where(F.col("name") == name).collect()
        return self._rows(held).select("point_id", "ord", "value") if held else None

    def find(self, ids: DataFrame) -> DataFrame:
        """(point_id, reg_no, name) of the earliest standing collection that holds each of the ids."""
        hits = self.members().join(ids.select("point_id").distinct(), "point_id", "left_semi")
        return hits.groupBy("point_id").agg(F.min(F.struct("reg_no", "name")).alias("first")).select(
            "point_id", "first.reg_no", "first.name"
        )
