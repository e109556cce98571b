"""Near-duplicate documents by b-bit MinHash, with links confirmed on full shingle sets.

1. One pass over the texts gives each document its set's size and digest, 128 minima, the keys of
   32 bands of 4 minima, and a signature of the 2 low bits of every minimum in four longs.
2. Documents with equal sets are one class; everything below works on classes.
3. Star rounds, two at most: in each band bucket every class is paired with one of
   them, the center, another one in each round. Pairs whose estimated similarity (matching low bits,
   corrected for chance matches) is not far below the threshold are confirmed on the full sets. Links
   give components, and later rounds pair the center with other components only.
4. Cross round: buckets that still hold several components are searched for further pairs between
   different components; an estimate from sixteen times as many minima is a condition of the join,
   by bit counts, and a pair leaves it from the first of its shared bands only. So a bucket of
   thousands of near copies costs a few pairs per member, and yet no link between components that a
   band catches is left out.

A pair at similarity 0.75 shares no band with probability (1 - 0.75 ** 4) ** 32 = 5e-6, and the
estimate's margin is four standard deviations. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import (
    WHITE, Roller, components, lowered, mix64, runs, seeded64, stored, text_bytes,
)

WORDS = 5
HASHES, ROWS, BITS = 128, 4, 2
BANDS = HASHES // ROWS
SHARE = 75
# Most rounds before the search for pairs between components; they change the work, not the result.
STAR_ROUNDS = 2
# Standard error of the estimate at the threshold is 0.046.
MARGIN = 0.19
# The search between components compares 2048 minima, with a standard error of 0.012.
LONG_HASHES, LONG_MARGIN = 2048, 0.05
_PAIRS = 0x5555555555555555
_PLACE = seeded64(WORDS, 11) | np.uint64(1)
_COUNT = seeded64(WORDS + 1, 12)
_XOR, _TIMES = seeded64(HASHES, 13), seeded64(HASHES, 14) | np.uint64(1)
_LONG_XOR, _LONG_TIMES = seeded64(LONG_HASHES, 17), seeded64(LONG_HASHES, 18) | np.uint64(1)
_ROW, _BAND = seeded64(ROWS, 15) | np.uint64(1), seeded64(BANDS, 16)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of all texts in a row, bounds of the texts' parts)."""
    data, offsets = text_bytes(column)
    low = lowered(data)
    starts, ends, _ = runs(~WHITE[low], offsets)
    words = Roller(low).hashes(starts, ends)
    bounds = np.searchsorted(starts, offsets)
    with np.errstate(over="ignore"):
        n = len(words) - WORDS + 1
        whole = np.zeros(max(n, 0), np.uint64)
        for k in range(WORDS):
            whole += words[k: k + max(n, 0)] * _PLACE[k]
        whole = mix64(whole + _COUNT[WORDS])
        parts = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= WORDS:
                part = np.sort(whole[a: b - WORDS + 1])
                parts.append(part[np.append(True, part[1:] != part[:-1])])
            elif b > a:
                few = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64)
                parts.append(mix64(np.array([few + _COUNT[b - a]], np.uint64)))
            else:
                parts.append(words[:0])
    edges = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=edges[1:])
    return (np.concatenate(parts) if parts else words[:0]), edges


def sketches(column: pa.Array):
    """(sizes, digests, signatures of four longs, band keys) of a text column."""
    members, edges = shingle_sets(column)
    sizes = np.diff(edges)
    some = np.flatnonzero(sizes)
    digests = np.zeros(len(sizes), np.uint64)
    signatures = np.zeros((len(sizes), 4), np.uint64)
    keys = np.zeros((len(sizes), BANDS), np.uint64)
    if len(some):
        at = edges[:-1][some]
        with np.errstate(over="ignore"):
            digests[some] = mix64(np.add.reduceat(mix64(members ^ _COUNT[0]), at) + sizes[some].astype(np.uint64))
            minima = np.empty((HASHES, len(some)), np.uint64)
            for k in range(HASHES):
                minima[k] = np.minimum.reduceat((members ^ _XOR[k]) * _TIMES[k], at)
            minima = mix64(minima)
            low = minima & np.uint64(3)
            for k in range(HASHES):
                signatures[some, k // 32] |= low[k] << np.uint64(2 * (k % 32))
            for b in range(BANDS):
                keys[some, b] = mix64((minima[b * ROWS: (b + 1) * ROWS] * _ROW[:, None]).sum(0) + _BAND[b])
    return sizes, digests.view(np.int64), signatures.view(np.int64), keys.view(np.int64)


def slices(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of a text column with about ``most`` bytes each."""
    _, offsets = text_bytes(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most)))
        yield low, min(high, len(column))
        low = high


_SKETCH = "doc_id bigint, text_hash bigint, digest bigint, n_shingles bigint, signature array<bigint>, bands array<bigint>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in slices(batch.column(1)):
            part = batch.slice(low, high - low)
            sizes, digests, signatures, keys = sketches(part.column(1))
            n = len(sizes)
            ends = np.where(sizes > 0, BANDS, 0).cumsum()
            bands = pa.ListArray.from_arrays(
                pa.array(np.append(0, ends), pa.int32()), pa.array(keys[sizes > 0].ravel())
            )
            four = pa.ListArray.from_arrays(
                pa.array(np.arange(0, 4 * n + 1, 4), pa.int32()), pa.array(signatures.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(digests), pa.array(sizes.astype(np.int64)), four, bands],
                names=["doc_id", "text_hash", "digest", "n_shingles", "signature", "bands"],
            )


def _long_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in slices(batch.column(1)):
            part = batch.slice(low, high - low)
            members, edges = shingle_sets(part.column(1))
            out = np.zeros((len(edges) - 1, LONG_HASHES // 32), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(LONG_HASHES):
                    minima = np.minimum.reduceat((members ^ _LONG_XOR[k]) * _LONG_TIMES[k], edges[:-1])
                    out[:, k // 32] |= (mix64(minima) & np.uint64(3)) << np.uint64(2 * (k % 32))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32()), pa.array(out.view(np.int64).ravel())
            )
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["digest", "long"])


def estimate(a: Column, b: Column, hashes: int = HASHES) -> Column:
    """Similarity from two signatures: share of equal low-bit pairs, less what chance gives."""
    differing = F.lit(0)
    for k in range(hashes // 32):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        differing = differing + F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(_PAIRS)))
    chance = 1.0 / (1 << BITS)
    return (1.0 - differing / float(hashes) - chance) / (1.0 - chance)


def _confirm(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for low, high in slices(batch.column(2)):
                (x, ex), (y, ey) = (shingle_sets(batch.column(c).slice(low, high - low)) for c in (2, 3))
                for k in range(high - low):
                    one, two = x[ex[k]: ex[k + 1]], y[ey[k]: ey[k + 1]]
                    both = np.sort(np.concatenate([one, two]))
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    linked[low + k] = common > 0 and 100 * common >= share * (len(both) - common)
            yield batch.select([0, 1]).filter(pa.array(linked))

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, share: int = SHARE) -> DataFrame:
    """The pairs (a, b) of digests whose full sets are similar enough; ``texts`` (digest, text)."""
    def side(name: str) -> DataFrame:
        return texts.select(F.col("digest").alias(name), F.col("text").alias(f"text_{name}"))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(_confirm(share), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash), one row per row of (doc_id, text).

    Null, empty and blank texts have no set and link with nothing. A null doc_id is never the
    smallest of a component; in a component of null ids alone component_id is null and all rows
    are kept. Rows that repeat an id are the same document. Other columns are ignored.
    """
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = stored(source.mapInArrow(_sketch, _SKETCH))
    some = rows.where("n_shingles > 0")
    classes = stored(some.dropDuplicates(["digest"]))
    members = classes.select(F.explode("bands").alias("band"), "digest")
    buckets = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    shared = stored(members.join(buckets, "band"))

    # Texts of the classes that share a bucket, read once for both rounds.
    wanted = shared.select("digest").distinct().join(classes.select("digest", "doc_id", "text_hash"), "digest")
    texts = stored(
        source.alias("d").join(
            wanted.alias("w"),
            F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash")),
        ).select("digest", "text").dropDuplicates(["digest"])
    )

    def near(a: str, b: str) -> Column:
        return estimate(F.col(a), F.col(b)) >= share / 100 - MARGIN

    signed = classes.select("digest", "signature")

    def with_signature(df: DataFrame, key: str) -> DataFrame:
        return df.join(signed.select(F.col("digest").alias(key), F.col("signature").alias(f"s_{key}")), key)

    def placed_in(roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return shared.withColumn("root", F.col("digest"))
        return shared.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))

    tested = links = roots = None
    for turn in range(STAR_ROUNDS):
        placed = placed_in(roots)
        pick = F.struct(F.xxhash64(F.lit(turn), "digest"), "digest", "root")
        centers = (
            placed.groupBy("band").agg(F.min(pick).alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
            .where("low != high").select("band", F.col("c.digest").alias("center"), F.col("c.root").alias("center_root"))
        )
        stars = placed.join(centers, "band").where("root != center_root").select(
            F.least("digest", "center").alias("a"), F.greatest("digest", "center").alias("b")
        ).distinct()
        if tested is not None:
            stars = stars.join(tested, ["a", "b"], "left_anti")
        stars = stored(with_signature(with_signature(stars, "a"), "b").where(near("s_a", "s_b")).select("a", "b"))
        if tested is not None and stars.isEmpty():
            break
        found = stored(confirmed(stars, texts, share))
        tested = stars if tested is None else tested.union(stars)
        if links is not None and found.isEmpty():
            break
        links = found if links is None else links.union(found)
        roots = components(links).select(F.col("node").alias("digest"), "root")

    placed = placed_in(roots)
    open_ = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    rest = stored(placed.join(open_.select("band"), "band"))
    asked = texts.join(rest.select("digest").distinct(), "digest").select("digest", "text")
    signed_long = stored(asked.mapInArrow(_long_signatures, "digest bigint, long array<bigint>"))
    # The open buckets of a class go along, so that a pair knows the first bucket it shares.
    own = rest.groupBy("digest").agg(F.sort_array(F.collect_list("band")).alias("bands"))
    rest = rest.join(signed_long.join(own, "digest"), "digest")
    one, two = rest.alias("x"), rest.alias("y")
    first_shared = F.get(F.array_intersect("x.bands", "y.bands"), F.lit(0)) == F.col("x.band")
    # A quarter of the minima settles most pairs.
    likely = (estimate(F.col("x.long"), F.col("y.long"), LONG_HASHES // 4) >= share / 100 - 2 * LONG_MARGIN) & (
        estimate(F.col("x.long"), F.col("y.long"), LONG_HASHES) >= share / 100 - LONG_MARGIN
    )
    cross = one.join(
        two,
        (F.col("x.band") == F.col("y.band")) & (F.col("x.digest") < F.col("y.digest"))
        & (F.col("x.root") != F.col("y.root")) & likely & first_shared,
    ).select(F.col("x.digest").alias("a"), F.col("y.digest").alias("b"))
    cross = stored(cross.join(tested, ["a", "b"], "left_anti"))
    more = stored(confirmed(cross, texts, share))

    # The later links join whole components of the earlier ones.
    whole = components(links.union(more)).select(F.col("node").alias("digest"), "root")
    named = classes.select("digest").join(whole, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    smallest = some.groupBy("digest").agg(F.min("doc_id").alias("low"))
    named = named.join(smallest, "digest")
    lowest = named.groupBy("root").agg(F.min("low").alias("lowest"))
    named = named.join(lowest, "root").select("digest", "lowest")
    out = rows.select("doc_id", "digest", "n_shingles", "text_hash").join(named, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("lowest")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), "text_hash",
    )


def one_of_each(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """The rows of ``docs``, with all their columns, of one document per component.

    Rows that are equal in every column count once; a row of another text under the same id is
    kept if its own component's smallest id is its id.
    """
    keys = near_duplicates(docs, share).where("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    keys = stored(keys).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n")
    met = docs["doc_id"].eqNullSafe(keys["_id"]) & (F.xxhash64(docs["text"]) == keys["_hash"])
    rows = docs.join(keys, met, "left_semi")
    return rows if keys.where("n > 1").isEmpty() else rows.dropDuplicates()
