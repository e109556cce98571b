"""Numbered files in a shared folder: an append-only journal of runs, and free version numbers.

A number belongs to whoever creates its file first; creation fails if the file exists, so two writers
never share one.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY_SCHEMA = "run string, cycle int, step int, kind string, payload string"


class NumberedFiles:
    """Files ``000000000000.json``, … of one folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def taken(self) -> list[int]:
        """Numbers in use, rising; one listing."""
        folder = self._path(self.folder)
        if not self._fs.exists(folder):
            return []
        names = (entry.getPath().getName() for entry in self._fs.listStatus(folder))
        return sorted(int(name[:12]) for name in names if re.fullmatch(r"\d{12}\.json", name))

    def create(self, number: int, text: str) -> bool:
        """Write the file of a number; False if somebody has it already."""
        path = self._path(f"{self.folder}/{number:012d}.json")
        if self._fs.getScheme() == "file":
            return self._link(path.toUri().getPath(), text)
        try:
            out = self._fs.create(path, False)
        except Py4JJavaError as error:
            if self._fs.exists(path):
                return False
            raise error
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _link(self, path: str, text: str) -> bool:
        """As ``create`` on a mounted folder, where Hadoop's own creation looks first and writes then."""
        folder, name = os.path.split(path)
        os.makedirs(folder, exist_ok=True)
        draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(draft, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)

    def claim(self, text: str = "{}", lowest: bool = False) -> int:
        """Take the number after the last one, or the ``lowest`` free one, and write its file."""
        while True:
            taken = self.taken()
            number = taken[-1] + 1 if taken else 0
            if lowest:
                number = next(n for n, held in enumerate([*taken, None]) if n != held)
            if self.create(number, text):
                return number


@dataclass(frozen=True)
class Entry:
    """One line of the journal; ``payload`` is whatever JSON can hold."""

    run: str
    cycle: int
    step: int
    kind: str
    payload: object


RESUMED = "resumed"


class Journal:
    """What happened in runs, in order. A few lines per step, read on the driver."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = NumberedFiles(spark, self.folder)

    def append(self, entries: Iterable[Entry]) -> None:
        """Add entries as one file, so that all of them or none are seen."""
        lines = [json.dumps({**e.__dict__, "payload": json.dumps(e.payload)}) for e in entries]
        if lines:
            self.files.claim("\n".join(lines) + "\n")

    def table(self) -> DataFrame:
        """All entries (number, line, run, cycle, step, kind, payload) with the payload as JSON text."""
        if not self.files.taken():
            return self.spark.createDataFrame([], f"number bigint, line bigint, {ENTRY_SCHEMA}")
        # A file is one partition or less, so row numbers in it follow its lines.
        rows = self.spark.read.schema(ENTRY_SCHEMA).json(f"{self.folder}/*.json")
        number = F.substring(F.col("_metadata.file_name"), 1, 12).cast("bigint")
        return rows.select(number.alias("number"), F.monotonically_increasing_id().alias("line"), *rows.columns)

    def entries(self, run: str) -> list[Entry]:
        """Entries of a run that stand: what a later resumption left behind is out."""
        rows = self.table().where(F.col("run") == run).orderBy("number", "line").collect()
        standing: list[Entry] = []
        for r in rows:
            entry = Entry(r["run"], r["cycle"], r["step"], r["kind"], json.loads(r["payload"]))
            if entry.kind == RESUMED:
                standing = [e for e in standing if (e.cycle, e.step) <= (entry.cycle, entry.step)]
            else:
                standing.append(entry)
        return standing

    def until(self, run: str, cycle: int, step: int) -> list[Entry]:
        """Standing entries of a run up to a step."""
        return [e for e in self.entries(run) if (e.cycle, e.step) <= (cycle, step)]
