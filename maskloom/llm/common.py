"""Shared pieces: tables cut from their lineage, word hashes of text batches, components of links."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.session import shared_dir

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def stored(df: DataFrame) -> DataFrame:
    """Write a frame to the cluster's shared folder and continue from the files.

    Cuts lineage: a lost executor repeats at most the reading of these files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


# --- text batches as bytes ------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, offsets of the texts); a null text is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0]: at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift-multiply), vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                     + np.uint64(seed))


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, factor = 1, np.uint64(base)
    while done < n:
        take = min(done, n - done)
        out[done: done + take] = out[:take] * factor
        done += take
        factor = factor * factor
    return out


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class Roller:
    """64-bit polynomial hashes of any byte ranges of an array, each in constant time."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        values = seeded64(256, seed)
        with np.errstate(over="ignore"):
            terms = values[data] * _powers(len(data), _BASE)
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(terms, out=self.sums[1:])
            self.back = _powers(len(data) + 1, _INVERSE)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
            return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that do not cross texts: starts, ends, number of their text."""
    n = len(inside)
    if not n:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first = first[:n]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:] & ~first[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


# The white space that separates words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

# Bytes of a term: ASCII letters, digits and every byte of a longer UTF-8 sequence.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:256] = True


# --- links to components ---------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b), whose ids are longs.

    Contraction in rounds: every node points to the smallest id, in a hashed order, among itself
    and its neighbours; links are rewritten to these and shrink by a constant share per round. A
    node with very many links is met by partial minima and by joins on its id only, which Spark
    splits. Each round is written to the shared folder. The root is some node of the component.
    """
    spark = edges.sparkSession
    links = stored(edges.where(F.col("a") != F.col("b")).select("a", "b"))
    steps: list[DataFrame] = []
    while not links.isEmpty():
        seed = F.lit(len(steps))
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(
            F.min(F.struct(F.xxhash64(seed, "b").alias("key"), F.col("b").alias("id"))).alias("near")
        )
        own = F.struct(F.xxhash64(seed, "node").alias("key"), F.col("node").alias("id"))
        step = stored(near.select("node", F.least(own, F.col("near"))["id"].alias("root")))
        steps.append(step)
        for side in ("a", "b"):
            to = step.select(F.col("node").alias(side), F.col("root").alias("_root"))
            links = links.join(to, side).drop(side).withColumnRenamed("_root", side)
        links = stored(links.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    if not steps:
        return spark.createDataFrame([], "node bigint, root bigint")
    whole = steps[-1]
    for step in reversed(steps[:-1]):
        later = whole.select(F.col("node").alias("root"), F.col("root").alias("_last"))
        whole = step.join(later, "root", "left").select(
            "node", F.coalesce("_last", "root").alias("root")
        )
        whole = stored(whole)
    return whole
