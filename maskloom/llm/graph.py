"""Near-equal vectors by a pruned flat graph over overlapping shards.

Centroids of a bounded sample cut the vectors into cells; each vector is in its ``OVERLAP``
nearest ones, and cells that came out large are cut into blocks by a hash. Each shard (block of a
cell) builds a graph: candidates nearest in the shard plus some at random, pruned robustly (a
candidate goes if a kept neighbour is nearer to it by a factor). A vector's lists from all its
shards are united. Every vector then searches its shards: greedily from the medoid, then by range
expansion, which follows the edges of everything within the threshold, from there and from its
own place in the graph. Pairs of blocks of one cell search each other.

Found pairs are verified in double precision where they are found. A pair that several cells find
counts in the smallest cell that both belong to, so pairs never leave their task: a task gives one
count per vector and the roots of its links. Recall is audited against brute force over a sample
of queries, and missing it widens the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import components, seeded64, stored

THRESHOLD = 0.9
# Vectors that centroids are fitted to, centroids at most, and vectors a cell should have.
SAMPLE, CELLS, CELL = 20_000, 4096, 1200
BLOCK = 2048
OVERLAP = 3
NEAREST, RANDOM, DEGREE, FACTOR = 24, 4, 14, 1.2
BEAM, STEPS = 12, 40
# Range expansion also follows what is a little below the threshold.
SLACK = 0.03
AUDIT, RECALL = 256, 0.95


def _unit(values: np.ndarray) -> np.ndarray:
    return values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-300)


def centroids(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Spherical k-means in double precision."""
    rng = np.random.default_rng(seed)
    centers = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[a: a + 4096] @ centers.T).argmax(1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        filled = np.linalg.norm(sums, axis=1) > 0
        centers = np.where(filled[:, None], _unit(sums), centers)
    return centers


def prune(vectors: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, factor: float = FACTOR) -> np.ndarray:
    """Which candidates (rows sorted by similarity) of each vector robust pruning keeps."""
    own = 2 - 2 * np.einsum("nd,ncd->nc", vectors, vectors[candidates])
    alive = np.ones(candidates.shape, bool)
    kept = np.zeros(candidates.shape, bool)
    for c in range(candidates.shape[1]):
        kept[:, c] = alive[:, c] & (kept.sum(1) < degree)
        rest = candidates[:, c + 1:]
        if rest.shape[1]:
            between = 2 - 2 * np.einsum("nd,ncd->nc", vectors[candidates[:, c]], vectors[rest])
            alive[:, c + 1:] &= ~(kept[:, c: c + 1] & (factor**2 * between <= own[:, c + 1:]))
    return kept


def build(ids: np.ndarray, vectors: np.ndarray) -> list[list[int]]:
    """Neighbour ids of each vector of a shard, edges taken in both directions."""
    n = len(ids)
    if n < 2:
        return [[] for _ in ids]
    near = vectors @ vectors.T
    np.fill_diagonal(near, -2)
    take = min(NEAREST, n - 1)
    best = np.argpartition(-near, take - 1, 1)[:, :take]
    order = np.argsort(-np.take_along_axis(near, best, 1), 1, kind="stable")
    candidates = np.take_along_axis(best, order, 1)
    kept = prune(vectors, candidates)
    a, b = np.nonzero(kept)
    a, b = a, candidates[a, b]
    # Edges at random keep groups of near copies within reach of each other.
    far = (seeded64(n * RANDOM, 21) % np.uint64(n)).astype(np.int64)
    a = np.concatenate([a, np.repeat(np.arange(n), RANDOM)])
    b = np.concatenate([b, far])
    edges = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = edges // n, edges % n
    lists = np.split(ids[b[a != b]], np.cumsum(np.bincount(a[a != b], minlength=n))[:-1])
    return [x.tolist() for x in lists]


def search(queries: np.ndarray, nodes: np.ndarray, lists: list[np.ndarray], own: np.ndarray, threshold: float):
    """(query, node) pairs with similarity near or above the threshold that the graph leads to.

    ``own`` is the node of a query itself or -1.
    """
    nq, nb = len(queries), len(nodes)
    width = max(1, max(map(len, lists), default=1))
    table = np.full((nb, width), -1, np.int64)
    for k, x in enumerate(lists):
        table[k, : len(x)] = x
    medoid = int((nodes @ nodes.mean(0)).argmax())
    seen = np.zeros((nq, nb), bool)
    rows = np.arange(nq)
    seen[rows, medoid] = True
    # Greedy search with a beam.
    beam = np.full((nq, BEAM), -1, np.int64)
    value = np.full((nq, BEAM), -3.0)
    open_ = np.zeros((nq, BEAM), bool)
    beam[:, 0], value[:, 0], open_[:, 0] = medoid, queries @ nodes[medoid], True
    near: list[tuple] = [(rows, beam[:, 0].copy(), value[:, 0].copy())]
    active = rows
    for _ in range(STEPS):
        scores = np.where(open_[active], value[active], -3.0)
        pick = scores.argmax(1)
        going = scores[np.arange(len(active)), pick] > -3
        active, pick = active[going], pick[going]
        if not len(active):
            break
        open_[active, pick] = False
        nbr = table[beam[active, pick]]
        fresh = (nbr >= 0) & ~seen[active[:, None], nbr]
        sims = np.full(nbr.shape, -3.0)
        at = np.nonzero(fresh)
        q, v = active[at[0]], nbr[at]
        seen[q, v] = True
        sims[at] = np.einsum("pd,pd->p", queries[q], nodes[v])
        near.append((q, v, sims[at]))
        all_v = np.concatenate([beam[active], np.where(fresh, nbr, -1)], 1)
        all_s = np.concatenate([value[active], sims], 1)
        all_o = np.concatenate([open_[active], fresh], 1)
        top = np.argpartition(-all_s, BEAM - 1, 1)[:, :BEAM]
        beam[active] = np.take_along_axis(all_v, top, 1)
        value[active] = np.take_along_axis(all_s, top, 1)
        open_[active] = np.take_along_axis(all_o, top, 1)
    # Range expansion, all queries together.
    q, v, s = (np.concatenate(x) for x in zip(*near))
    inside = s >= threshold - SLACK
    found = [(q[inside], v[inside])]
    start = own >= 0
    fq = np.concatenate([q[inside], rows[start]])
    fv = np.concatenate([v[inside], own[start]])
    while len(fq):
        next_q, next_v = [], []
        for low in range(0, len(fq), 1 << 16):
            pairs_q = np.repeat(fq[low: low + (1 << 16)], width)
            pairs_v = table[fv[low: low + (1 << 16)]].ravel()
            fresh = (pairs_v >= 0) & ~seen[pairs_q, pairs_v]
            code = np.unique(pairs_q[fresh] * nb + pairs_v[fresh])
            pq, pv = code // nb, code % nb
            seen[pq, pv] = True
            sims = np.einsum("pd,pd->p", queries[pq], nodes[pv])
            near_ = sims >= threshold - SLACK
            next_q.append(pq[near_])
            next_v.append(pv[near_])
        fq, fv = np.concatenate(next_q), np.concatenate(next_v)
        found.append((fq, fv))
    return tuple(np.concatenate(x) for x in zip(*found))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number reachable from each of 0..n-1 by links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return root
        root = new


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    ids = pdf["id"].to_numpy()
    order = np.argsort(ids)
    vectors = _unit(np.stack(pdf["vector"].to_numpy())[order])
    return pd.DataFrame({"id": ids[order], "near": build(ids[order], vectors)})


def _search_unit(threshold: float):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        cell, one, two = (int(k) for k in key)
        pdf = pdf.sort_values("id")
        raw = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        norm = np.linalg.norm(raw, axis=1)
        unit = raw / norm[:, None]
        ids, copies = pdf["id"].to_numpy(), pdf["copies"].to_numpy()
        size, cells = pdf["size"].to_numpy(), np.stack(pdf["cells"].to_numpy())
        block = pdf["block"].to_numpy()
        q_at, n_at = np.flatnonzero(block == one), np.flatnonzero(block == two)
        place = np.full(len(ids), -1)
        place[n_at] = np.arange(len(n_at))
        position = {v: k for k, v in enumerate(ids[n_at].tolist())}
        lists = [
            np.array([position[x] for x in near if x in position], np.int64) for near in pdf["near"].iloc[n_at]
        ]
        if not len(q_at) or not len(n_at):
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        q, v = search(unit[q_at], unit[n_at], lists, place[q_at], threshold)
        a, b = q_at[q], n_at[v]
        # Each pair once, verified in double precision.
        a, b = np.minimum(a, b), np.maximum(a, b)
        code = np.unique(a[a != b] * len(ids) + b[a != b])
        a, b = code // len(ids), code % len(ids)
        links = np.zeros(len(ids), np.int64)
        good = np.empty(len(a), bool)
        for low in range(0, len(a), 1 << 18):
            x, y = a[low: low + (1 << 18)], b[low: low + (1 << 18)]
            cosine = np.einsum("pd,pd->p", raw[x], raw[y]) / (norm[x] * norm[y])
            ok = (cosine >= threshold) & (size[x] == size[y])
            good[low: low + (1 << 18)] = ok
            x, y = x[ok], y[ok]
            common = np.full(len(x), np.iinfo(np.int64).max)
            for c in range(cells.shape[1]):
                shared = (cells[x, c][:, None] == cells[y]).any(1)
                common = np.where(shared, np.minimum(common, cells[x, c]), common)
            here = common == cell
            np.add.at(links, x[here], copies[y[here]])
            np.add.at(links, y[here], copies[x[here]])
        roots = _roots(len(ids), a[good], b[good])
        return pd.DataFrame({"id": ids, "links": links, "root": ids[roots]})

    return run


def _assign(centers: np.ndarray, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat = batch.column(3).flatten().to_numpy().reshape(n, -1)
            near = _unit(flat) @ centers.T
            take = min(overlap, near.shape[1])
            cells = np.argpartition(-near, take - 1, 1)[:, :take].astype(np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, n * take + 1, take), pa.int32()), pa.array(cells.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists], names=["id", "copies", "size", "vector", "cells"]
            )

    return run


def _links_once(classes: DataFrame, centers: np.ndarray, overlap: int, threshold: float) -> DataFrame:
    """(id, links, root) of each shard search: several rows per class."""
    placed = stored(classes.mapInArrow(
        _assign(centers, overlap), "id bigint, copies bigint, size int, vector array<double>, cells array<bigint>"
    ))
    members = placed.withColumn("cell", F.explode("cells"))
    blocks = members.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = stored(members.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    near = members.groupBy("cell", "block").applyInPandas(_build_shard, "id bigint, near array<bigint>")
    near = near.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    # A block meets itself and every other block of its cell once.
    units = members.join(near, "id").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    return units.groupBy("cell", "one", "two").applyInPandas(
        _search_unit(threshold), "id bigint, links bigint, root bigint"
    )


def audit(classes: DataFrame, links: DataFrame, threshold: float, queries: int = AUDIT) -> float:
    """Share of the links of a sample of vectors, by brute force over all, that was found."""
    picked = classes.orderBy(F.xxhash64("id"), "id").limit(queries).toPandas()
    if not len(picked):
        return 1.0
    raw = np.stack(picked["vector"].to_numpy())
    norm, size, ids = np.linalg.norm(raw, axis=1), picked["size"].to_numpy(), picked["id"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(raw), np.int64)
        for batch in batches:
            n = batch.num_rows
            if n:
                flat = batch.column(3).flatten().to_numpy().reshape(n, -1)
                cosine = (raw @ flat.T) / (norm[:, None] * np.linalg.norm(flat, axis=1))
                linked = (cosine >= threshold) & (size[:, None] == batch.column(2).to_numpy())
                linked &= ids[:, None] != batch.column(0).to_numpy()
                total += linked @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "links"])

    true = classes.select("id", "copies", "size", "vector").mapInArrow(run, "id bigint, links bigint")
    wanted = true.agg(F.sum("links")).first()[0] or 0
    got = links.where(F.col("id").isin([int(i) for i in ids])).agg(F.sum("links")).first()[0] or 0
    return got / wanted if wanted else 1.0


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of (vec_id, embedding).

    Vectors that are null, empty or zero, or hold null or non-finite numbers link with nothing, and
    vectors of different lengths do not link with each other. Equal vectors are one class that is
    searched once. Null ids are never the smallest of a component; with null ids only,
    component_id is null and the rows are kept. Other columns are ignored.
    """
    spark = vectors.sparkSession
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", numbers.alias("vector"))
    valid = F.coalesce(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("vector", lambda x: x != 0), F.lit(False),
    )
    rows = rows.withColumn("valid", valid)
    known = rows.where("valid")
    classes = known.groupBy("vector").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    classes = classes.withColumns({"id": F.xxhash64("vector"), "size": F.size("vector")})
    width = classes.agg(F.max("size")).first()[0]
    if width is None:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    padded = F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(width) - F.col("size")))
    named = stored(classes)
    flat = stored(named.select("id", "copies", "size", padded.alias("vector")))
    n = flat.count()
    sample = flat.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(SAMPLE).select("vector").toPandas()
    centers = centroids(_unit(np.stack(sample["vector"].to_numpy())), min(CELLS, max(1, -(-n // CELL))))
    overlap = min(OVERLAP, len(centers))
    while True:
        found = stored(_links_once(flat, centers, overlap, threshold))
        links = stored(found.groupBy("id").agg(F.sum("links").alias("links")))
        if overlap >= len(centers) or audit(flat, links, threshold) >= recall:
            break
        overlap = min(overlap * 2, len(centers))
    roots = components(found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    joined = named.join(links, "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
    joined = joined.withColumn("root", F.coalesce("root", "id"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("lowest"))
    joined = joined.join(lowest, "root").select(
        F.col("vector").alias("_vector"), (F.col("links") + F.col("copies") - 1).alias("links"), "lowest"
    )
    out = rows.join(joined, rows.vector == joined["_vector"], "left")
    component = F.when(F.col("valid"), F.col("lowest")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"),
    )
