"""Nearest vectors by inner product in a hierarchical k-means tree, searched best bin first.

Index. Equal vectors are one entry with its smallest ids, which is all that k results can need. The
upper levels of the tree are fitted to a bounded sample and cut the entries into cells; a cell's
entries are dealt to slices of bounded size, and every slice grows the lower levels from all its
entries, in the task that holds it. Every node knows its center and how far its vectors lie from it.

Search. A query walks the upper tree through a priority queue: the node with the best outlook,
center times query plus length of query times spread, is opened next, until it has met a given
number of cells. In each cell it goes on the same way through the lower levels, to a given number
of leaves, and compares all vectors there. Both numbers are widened together: they double until the
recall of a sample of the queries, whose true neighbours are found by comparing all rows, is reached
with confidence; all queries then use that width. At its widest the search visits every leaf.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import stored

TOP = 20
# The upper levels are fitted to so many entries, on the driver, whatever the size of the table.
SAMPLE = 32_768
BRANCH, CELL_ROWS, MOST_CELLS = 16, 2048, 2048
SLICE_ROWS, LEAF_ROWS = 8192, 64
# Queries that the width is calibrated on, and what their mean recall must surely exceed.
CALIBRATION, RECALL = 256, 0.92
QUERY_BLOCK = 2048
# Weight of the spread in a node's outlook, in units of spread / sqrt(dim).
OUTLOOK = 2.0


# --- trees ---------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in arrays, root first: children are ``first`` to ``first + count``; leaves have none."""

    centers: np.ndarray
    spreads: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.leaf >= 0).sum())

    def walk(self, query: np.ndarray, most: int) -> Iterator[int]:
        """Numbers of the leaves, best outlook first, ``most`` of them."""
        outlook = self.centers @ query + (OUTLOOK * np.linalg.norm(query) / math.sqrt(len(query))) * self.spreads
        queue = [(-outlook[0], 0)]
        met = 0
        while queue and met < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                met += 1
                yield int(self.leaf[node])
            for child in range(self.first[node], self.first[node] + self.count[node]):
                heapq.heappush(queue, (-outlook[child], child))

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down to the nearest child at every level."""
        node = np.zeros(len(vectors), np.int64)
        while True:
            inner = self.leaf[node] < 0
            if not inner.any():
                return self.leaf[node]
            for parent in np.unique(node[inner]).tolist():
                here = np.flatnonzero(node == parent)
                low = self.first[parent]
                node[here] = low + nearest(vectors[here], self.centers[low: low + self.count[parent]])


def nearest(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers * centers).sum(1) - 2 * (vectors @ centers.T), axis=1)


def k_means(vectors: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Part of each vector after a few rounds; parts that lose all their vectors disappear."""
    centers = vectors[draw.choice(len(vectors), min(k, len(vectors)), replace=False)]
    for _ in range(rounds):
        part = nearest(vectors, centers)
        held, part = np.unique(part, return_inverse=True)
        sums = np.zeros((len(held), vectors.shape[1]))
        np.add.at(sums, part, vectors)
        centers = sums / np.bincount(part)[:, None]
    return part


def grow(vectors: np.ndarray, most: int, draw: np.random.Generator) -> tuple[Tree, np.ndarray]:
    """(tree, leaf of each vector) with at most ``most`` vectors a leaf, but for ones that cannot be told apart."""
    centers, spreads, first, count, leaf = [], [], [], [], []
    leaf_of = np.zeros(len(vectors), np.int64)

    def node(members: np.ndarray) -> None:
        inside = vectors[members]
        center = inside.mean(0) if len(members) else np.zeros(vectors.shape[1])
        centers.append(center)
        spreads.append(math.sqrt(((inside - center) ** 2).sum(1).mean()) if len(members) else 0.0)
        first.append(0)
        count.append(0)
        leaf.append(-1)

    node(np.arange(len(vectors)))
    waiting = [(0, np.arange(len(vectors)))]
    n_leaves = 0
    while waiting:
        at, members = waiting.pop()
        part = None
        if len(members) > most:
            part = k_means(vectors[members], min(BRANCH, -(-len(members) // most) + 1), draw)
        if part is None or part.max() == 0:
            leaf[at] = n_leaves
            leaf_of[members] = n_leaves
            n_leaves += 1
            continue
        first[at], count[at] = len(centers), int(part.max()) + 1
        for p in range(count[at]):
            inside = members[part == p]
            waiting.append((len(centers), inside))
            node(inside)
    return Tree(np.array(centers), np.array(spreads), np.array(first), np.array(count), np.array(leaf)), leaf_of


# --- index ---------------------------------------------------------------------------------------


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """Distinct (vec_id, embedding) that take part."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & (F.size("embedding") == dim)
        & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
        & F.exists("embedding", lambda c: c != 0)
    ).distinct()


def usual_length(vectors: DataFrame) -> int:
    """The length most vectors have; ties: the longer."""
    row = (
        vectors.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("dim")).count()
        .orderBy(F.desc("count"), F.desc("dim")).first()
    )
    return row["dim"] if row else 0


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _column(rows: np.ndarray) -> pa.Array:
    edges = np.arange(len(rows) + 1) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(rows.ravel()))


@dataclass
class Index:
    """Entries (low, code, embedding, ids), the upper tree, and a row per slice of a cell.

    An entry is a vector with the ids of its rows; its smallest id and its hash name it.
    """

    entries: DataFrame
    slices: DataFrame
    upper: Tree
    dim: int
    rows: int


_SLICE = (
    "cell int, lows array<bigint>, codes array<bigint>, leaf array<int>, vectors array<double>, "
    "centers array<double>, spreads array<double>, first array<int>, count array<int>, leaves array<int>"
)
_SLICE_COLUMNS = [c.split()[0] for c in _SLICE.split(", ")]


def entries_of(vectors: DataFrame, dim: int, most: int) -> DataFrame:
    """(low, code, embedding, ids): each vector once, with the ``most`` smallest ids of its rows.

    Ids are cut inside slices first, so that very many copies of a vector meet in no task.
    """
    kept = usable(vectors, dim).withColumn("code", F.xxhash64("embedding"))
    slice_ = F.pmod(F.xxhash64("vec_id"), F.lit(256))
    for keys in (("code", "embedding", slice_), ("code", "embedding")):
        order = Window.partitionBy(*keys).orderBy("vec_id")
        kept = kept.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    grouped = kept.groupBy("code", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return grouped.select(F.get("ids", F.lit(0)).alias("low"), "code", "embedding", "ids")


def build(vectors: DataFrame, k: int = TOP, dim: int | None = None) -> Index | None:
    """Index all usable rows of (vec_id, embedding) for up to ``k`` results; None if there is none.

    Left out are null ids and vectors that are null, zero, hold null or non-finite numbers, or have
    not the usual length. Repeated rows are one; different vectors under one id are rows of their
    own. Other columns are ignored.
    """
    dim = usual_length(vectors) if dim is None else dim
    # One id more than results: a query that is a copy itself is not its own result.
    entries = stored(entries_of(vectors, dim, k + 1))
    n = entries.count()
    if n == 0:
        return None
    upper = _upper(entries, n, dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = pa.array(upper.place(_matrix(batch.column(2), dim)), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, cell], names=[*batch.schema.names, "cell"])

    vector = entries.select("low", "code", "embedding")
    placed = stored(vector.mapInArrow(place, "low bigint, code bigint, embedding array<double>, cell int"))
    # At most MOST_CELLS rows.
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / SLICE_ROWS).alias("parts"))
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64("low", "code"), "parts"))

    def lower(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([("low", "ascending"), ("code", "ascending")]).combine_chunks()
        x = _matrix(part["embedding"].chunk(0), dim)
        tree, leaf_of = grow(x, LEAF_ROWS, np.random.default_rng(13))
        order = np.argsort(leaf_of, kind="stable")
        longs, reals, ints = pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int32())
        return pa.table({
            "cell": pa.array([key[0].as_py()], pa.int32()),
            "lows": pa.array([part["low"].to_numpy()[order]], longs),
            "codes": pa.array([part["code"].to_numpy()[order]], longs),
            "leaf": pa.array([leaf_of[order]], ints),
            "vectors": pa.array([x[order].ravel()], reals),
            "centers": pa.array([tree.centers.ravel()], reals),
            "spreads": pa.array([tree.spreads], reals),
            "first": pa.array([tree.first], ints),
            "count": pa.array([tree.count], ints),
            "leaves": pa.array([tree.leaf], ints),
        })

    return Index(entries, stored(dealt.groupBy("cell", "slice").applyInArrow(lower, _SLICE)), upper, dim, n)


def _upper(entries: DataFrame, n: int, dim: int) -> Tree:
    """The upper levels: at most ``MOST_CELLS`` cells of about ``CELL_ROWS`` entries, from ``SAMPLE`` of them."""
    order = F.xxhash64(F.lit(13), "low", "code")
    # A hash picks somewhat more than the sample, the order cuts it to size.
    share = min(1.0, 1.5 * SAMPLE / n)
    picked = entries.where(F.pmod(order, F.lit(1 << 30)) <= int(share * (1 << 30)))
    sample = picked.orderBy(order, "low", "code").limit(SAMPLE).select("embedding").toArrow()
    x = _matrix(sample["embedding"].combine_chunks(), dim)
    cells = max(1, min(MOST_CELLS, -(-n // CELL_ROWS)))
    return grow(x, max(1, -(-len(x) // cells)), np.random.default_rng(13))[0]


# --- search --------------------------------------------------------------------------------------


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed in one order whatever the number of vectors."""
    return (vectors * query).sum(1)


def best(scores: np.ndarray, lows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((lows[some], -scores[some]))][:k]


_FOUND = "asker bigint, asker_code bigint, low bigint, code bigint, score double"
_FOUND_COLUMNS = [c.split()[0] for c in _FOUND.split(", ")]


def _found(rows: list[tuple]) -> pa.RecordBatch:
    """Result rows of (asker, asker_code, lows, codes, scores) per query."""
    sizes = [len(r[2]) for r in rows]
    columns = [np.repeat(np.array([r[c] for r in rows], np.int64), sizes) for c in (0, 1)]
    columns += [np.concatenate([r[c] for r in rows]) for c in (2, 3, 4)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_FOUND_COLUMNS)


def _ranked(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("asker", "asker_code").orderBy(F.desc("score"), "low", "code")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def _searched(index: Index, queries: DataFrame, cells: int, leaves: int, most: int) -> DataFrame:
    """The ``most`` best entries met by each of the queries (low, code, embedding)."""
    upper, dim = index.upper, index.dim

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = [list(upper.walk(q, cells)) for q in _matrix(batch.column(2), dim)]
            at = pa.array(np.repeat(np.arange(len(met)), [len(m) for m in met]))
            cell = pa.array([c for m in met for c in m], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(at) for c in batch.columns), cell], names=["asker", "asker_code", "asked", "cell"]
            )

    visits = queries.select("low", "code", "embedding").mapInArrow(
        visit, "asker bigint, asker_code bigint, asked array<double>, cell int"
    )
    # Queries meet the slices of a cell in blocks of bounded size. At most MOST_CELLS rows are broadcast.
    parts = visits.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("parts"))
    block = F.pmod(F.xxhash64("asker", "asker_code"), "parts")
    blocks = visits.join(F.broadcast(parts), "cell").groupBy("cell", block.alias("block")).agg(
        F.collect_list(F.struct("asker", "asker_code", "asked")).alias("queries")
    ).select(
        "cell", F.col("queries.asker").alias("askers"), F.col("queries.asker_code").alias("asker_codes"),
        F.flatten("queries.asked").alias("asked"),
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {
                    name: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
                    for c, name in enumerate(batch.schema.names)
                }
                tree = Tree(row["centers"].reshape(-1, dim), row["spreads"], row["first"], row["count"], row["leaves"])
                vectors, lows, codes = row["vectors"].reshape(-1, dim), row["lows"], row["codes"]
                edges = np.searchsorted(row["leaf"], np.arange(tree.leaves + 1))
                out = []
                for asker, code, q in zip(row["askers"], row["asker_codes"], row["asked"].reshape(-1, dim)):
                    near = np.concatenate([np.arange(edges[x], edges[x + 1]) for x in tree.walk(q, leaves)])
                    scores = products(vectors[near], q)
                    top = best(scores, lows[near], most)
                    out.append((asker, code, lows[near][top], codes[near][top], scores[top]))
                yield _found(out)

    pairs = blocks.join(index.slices, "cell").select("askers", "asker_codes", "asked", *_SLICE_COLUMNS[1:])
    return _ranked(pairs.mapInArrow(compare, _FOUND), most)


def _compared(index: Index, asked: list[tuple[int, int, list[float]]], most: int) -> DataFrame:
    """The ``most`` best of all entries for a few queries."""
    dim = index.dim
    keys, x = [(low, code) for low, code, _ in asked], np.array([v for _, _, v in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vectors = _matrix(batch.column(2), dim)
            out = []
            for (low, code), q in zip(keys, x):
                scores = products(vectors, q)
                top = best(scores, lows, most)
                out.append((low, code, lows[top], codes[top], scores[top]))
            yield _found(out)

    return _ranked(index.entries.select("low", "code", "embedding").mapInArrow(run, _FOUND), most)


@dataclass
class Width:
    """Cells a query visits, leaves in each, and the mean recall of the calibration queries."""

    cells: int
    leaves: int
    recall: float


def calibrate(index: Index, queries: DataFrame, k: int = TOP, recall: float = RECALL) -> Width:
    """The first width at which the mean recall of ``CALIBRATION`` queries lies above ``recall`` by two standard errors."""
    order = F.xxhash64(F.lit(17), "low", "code")
    sample = queries.orderBy(order, "low", "code").limit(CALIBRATION).select("low", "code", "embedding")
    asked = [(r["low"], r["code"], r["embedding"]) for r in sample.collect()]
    if not asked:
        return Width(1, 1, 1.0)
    keys = ["asker", "asker_code", "low", "code"]
    sample = sample.sparkSession.createDataFrame(asked, "low bigint, code bigint, embedding array<double>")
    truth = stored(_compared(index, asked, k + 1).select(*keys))
    cells, leaves, all_cells = 1, 2, index.upper.leaves
    while True:
        met = _searched(index, sample, cells, leaves, k + 1).select(*keys, F.lit(1.0).alias("hit"))
        # At most CALIBRATION rows.
        hits = truth.join(met, keys, "left").groupBy("asker", "asker_code").agg(
            F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall")
        ).toPandas()["recall"].to_numpy()
        if hits.mean() - 2 * hits.std() / math.sqrt(len(hits)) >= recall or (cells >= all_cells and leaves >= SLICE_ROWS):
            return Width(cells, leaves, float(hits.mean()))
        cells, leaves = min(2 * cells, all_cells), 2 * leaves


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = TOP, width: Width | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k found with the largest inner product for each of ``queries``.

    Both have vec_id and embedding; what ``build`` leaves out is neither found nor a query. Ties go
    to the smaller vec_id. A query does not find rows of its own id; with fewer candidates it has as
    many results, and so has a query whose id several different vectors among its nearest share. Scores are the inner products of the vectors as double. Without any usable
    vector or query there is no row.
    """
    index = build(vectors, k)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    # Queries with one vector are searched once; all their ids are kept, as rows.
    asked = stored(usable(queries, index.dim).withColumn("code", F.xxhash64("embedding")))
    lows = asked.groupBy("code", "embedding").agg(F.min("vec_id").alias("low"))
    distinct = stored(lows)
    width = calibrate(index, distinct, k) if width is None else width
    found = stored(_searched(index, distinct, width.cells, width.leaves, k + 1))
    ids = index.entries.select("low", "code", "ids")
    # At most k + 1 entries a query vector, with at most k + 1 ids each: cut before the queries' ids come in.
    order = Window.partitionBy("asker", "asker_code").orderBy(F.desc("score"), "vec_id")
    results = (
        found.join(ids, ["low", "code"]).select("asker", "asker_code", "score", F.explode("ids").alias("vec_id"))
        .withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
        .groupBy("asker", "asker_code").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    )
    named = distinct.join(asked.select("code", "embedding", F.col("vec_id").alias("query_id")), ["code", "embedding"]).select(
        F.col("low").alias("asker"), F.col("code").alias("asker_code"), "query_id"
    )
    others = F.slice(F.filter("found", lambda r: r["vec_id"] != F.col("query_id")), 1, k)
    return results.join(named, ["asker", "asker_code"]).select("query_id", F.posexplode(others).alias("place", "r")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("r.vec_id").alias("vec_id"), F.col("r.score").alias("score")
    )
