"""Registry states as a log of changes, merged when they are read.

A step writes one part: the collections it made, whole, and for the others the rows that came, moved
or went. The journal says which parts a state is made of, so a state costs as much as what changed,
and an older one stays readable. A collection with many changes is written whole again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.sources.journal import Entry, Journal
from maskloom.sources.tables import MEMBERSHIP_SCHEMA

STATE = "state"
# Parts a collection may have before it is compacted.
MOST_PARTS = 8
_ROW = "point_id string, ord bigint, value int, live boolean"
_COLUMNS = ("point_id", "ord", "value", "collection")
_TYPED = [f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in f"{_ROW}, collection string".split(", ")]


def changed_rows(before: DataFrame, after: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (point_id, ord, value, collection, live) that turn ``before`` into ``after``.

    ``ids`` (point_id) are the points that may differ; only their rows are looked at.
    """
    ids = ids.select("point_id").distinct()
    old = before.join(ids, "point_id", "left_semi").select(*_COLUMNS)
    new = after.join(ids, "point_id", "left_semi").select(*_COLUMNS)
    here = "n.point_id = o.point_id AND n.collection = o.collection"
    same = F.expr(f"{here} AND n.ord <=> o.ord AND n.value <=> o.value")
    came = new.alias("n").join(old.alias("o"), same, "left_anti").withColumn("live", F.lit(True))
    gone = old.alias("o").join(new.alias("n"), F.expr(here), "left_anti").withColumn("live", F.lit(False))
    return came.unionByName(gone)


class ChangeStore:
    """States by run, cycle and step. Reading gives what ``SnapshotStore`` gives."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.journal = Journal(spark, f"{self.path}/journal")

    # --- writing ----------------------------------------------------------------------------

    def save(
        self, run: str, cycle: int, step: int, whole: DataFrame | None = None, names: list[str] = (),
        changes: DataFrame | None = None, before: dict[str, list[str]] | None = None,
        more: list[Entry] = (),
    ) -> dict[str, list[str]]:
        """Write a state as its difference to the one made of the parts ``before``.

        ``whole`` holds all rows of the collections ``names``; ``changes`` holds rows with
        ``live`` of other collections. ``more`` are journal entries that stand or fall with this state.
        Returns the parts of the new state by collection, oldest first.
        """
        before = before or {}
        frames = []
        if whole is not None:
            frames.append(whole.withColumn("live", F.lit(True)).selectExpr(*_TYPED))
        if changes is not None:
            frames.append(changes.selectExpr(*_TYPED))
        parts = dict(before)
        if frames:
            folder = f"{self.path}/parts/{uuid.uuid4().hex}"
            rows = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
            rows.write.partitionBy("collection").parquet(folder)
            # One listing: what the part holds rows of.
            held = set(self._folders(folder))
            parts |= {name: [folder] if name in held else [] for name in names}
            parts |= {name: [*before.get(name, []), folder] for name in held - set(names)}
        self.journal.append([*more, Entry(run, cycle, step, STATE, parts)])
        return parts

    def compact(self, parts: dict[str, list[str]]) -> tuple[DataFrame | None, list[str]]:
        """(rows, names) of the collections that have too many parts, to be saved as ``whole``."""
        names = [name for name, own in parts.items() if len(own) > MOST_PARTS]
        return (self.read({name: parts[name] for name in names}), names) if names else (None, [])

    def _folders(self, folder: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [entry.getPath().getName() for entry in fs.listStatus(path)]
        return [name.removeprefix("collection=") for name in names if name.startswith("collection=")]

    # --- reading ----------------------------------------------------------------------------

    def _part(self, folder: str, names: list[str]) -> DataFrame:
        """Rows of some collections of a part; only their folders are listed and read."""
        paths = [f"{folder}/collection={name}" for name in names]
        read = self.spark.read.schema(f"{_ROW}, collection string").option("basePath", folder)
        return read.parquet(*paths).select(*_COLUMNS, "live")

    def read(self, parts: dict[str, list[str]]) -> DataFrame:
        """The state made of these parts: (point_id, ord, value, collection).

        The oldest part of a collection is read as it is, less the points that later parts name. Only the
        later parts, which are small, are put in order.
        """
        by_folder: dict[str, list[str]] = {}
        for name, own in parts.items():
            if own:
                by_folder.setdefault(own[0], []).append(name)
        state = None
        for folder, names in by_folder.items():
            rows = self._part(folder, names).where("live")
            state = rows if state is None else state.unionByName(rows)
        later = None
        for name, own in parts.items():
            for version, folder in enumerate(own[1:]):
                rows = self._part(folder, [name]).withColumn("version", F.lit(version))
                later = rows if later is None else later.unionByName(rows)
        if state is None:
            return self.spark.createDataFrame([], MEMBERSHIP_SCHEMA)
        if later is not None:
            last = later.groupBy("collection", "point_id").agg(
                F.max_by(F.struct("ord", "value", "live"), "version").alias("last")
            )
            kept = state.join(last, ["collection", "point_id"], "left_anti").select(*_COLUMNS)
            came = last.where("last.live").select("point_id", "last.ord", "last.value", "collection")
            return kept.unionByName(came)
        return state.select(*_COLUMNS)

    def parts(self, run: str, cycle: int, step: int) -> dict[str, list[str]]:
        """Parts of a stored state; an unknown one is an error."""
        found = [e for e in self.journal.entries(run) if e.kind == STATE and (e.cycle, e.step) == (cycle, step)]
        if not found:
            raise ValueError(f"run {run} has no state stored for cycle {cycle}, step {step}")
        return found[-1].payload

    def load(self, run: str, cycle: int, step: int) -> DataFrame:
        """One state (point_id, ord, value, collection)."""
        return self.read(self.parts(run, cycle, step))

    def states(self) -> list[tuple[str, int, int, dict[str, list[str]]]]:
        """(run, cycle, step, parts) of every standing state."""
        runs = [r["run"] for r in self.journal.table().select("run").distinct().collect()]
        last = {(e.run, e.cycle, e.step): e.payload for run in sorted(runs) for e in self.journal.entries(run) if e.kind == STATE}
        return [(*key, parts) for key, parts in last.items()]

    def all(self) -> DataFrame:
        """Every state, with ``run``, ``cycle`` and ``step``.

        Each part is read once; a small table says which states a collection of it belongs to.
        """
        uses = [
            (run, cycle, step, name, folder, version, len(own) == 1)
            for run, cycle, step, parts in self.states()
            for name, own in parts.items() for version, folder in enumerate(own)
        ]
        if not uses:
            return self.spark.createDataFrame([], f"{MEMBERSHIP_SCHEMA}, run string, cycle int, step int")
        held: dict[str, set[str]] = {}
        for _, _, _, name, folder, _, _ in uses:
            held.setdefault(folder, set()).add(name)
        rows = None
        for folder, names in held.items():
            part = self._part(folder, sorted(names)).withColumn("part", F.lit(folder))
            rows = part if rows is None else rows.unionByName(part)
        schema = "run string, cycle int, step int, collection string, part string, version int, single boolean"
        placed = rows.join(F.broadcast(self.spark.createDataFrame(uses, schema)), ["part", "collection"])
        columns = (*_COLUMNS, "run", "cycle", "step")
        merged = placed.where("NOT single").groupBy("run", "cycle", "step", "collection", "point_id").agg(
            F.max_by(F.struct("ord", "value", "live"), "version").alias("last")
        )
        return placed.where("single AND live").select(*columns).unionByName(
            merged.where("last.live").select("point_id", "last.ord", "last.value", "collection", "run", "cycle", "step")
        )
