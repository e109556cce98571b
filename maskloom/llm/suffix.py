"""Repeated byte strings across documents, by sorted suffixes.

Every byte that a 400-byte string covers which also starts anywhere else is removed. Shipping all
suffixes would take many times the input, so those that cannot or must be repeated are set
apart first, without losing any:

1. Each string (window) has an anchor, its 32-byte gram with the smallest hash, so equal strings
   have equal anchors at equal places. The windows of a text that share an anchor are one run.
2. Grams that occur once drop out. Runs whose bytes occur at several places as a whole are
   repeated altogether; one of them stays to be compared.
3. The suffixes of the remaining runs are sorted: sampled splitters partition them by the
   leading bytes of their anchor, and each partition sorts locally by multikey quicksort with
   64-byte characters, taking only groups of equal suffixes on to the next character.
4. An anchor with very many different runs is cut into slices that sort on their own; what is
   unique in its slice is then compared across slices by digests of whole windows.

Characters are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import Roller, mix64, stored, text_bytes

SPAN = 400
GRAM = 32
CHARACTER = 64
# Runs of an anchor that one slice sorts together: about a million windows, 100 MB.
SLICE = 8192
# Windows that a task sorts at a time.
CHUNK = 1 << 20
_POSITION_BITS = 24
_HASH_BITS = np.uint64(40)


def anchors(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """(roller, doc, anchor, first, last): windows first..last of a text share the anchor.

    The anchor of a window is the start of its gram with the smallest hash, the first of equals,
    so it depends on the window's bytes alone.
    """
    roller = Roller(data)
    n, width = len(data), span - gram + 1
    count = n - span + 1
    empty = np.empty(0, np.int64)
    if count <= 0:
        return roller, empty, empty, empty, empty
    at = np.arange(n - gram + 1)
    keys = roller.hashes(at, at + gram)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    keys = (keys & ~low) | at.astype(np.uint64)
    # Minima of all runs of ``width`` keys: suffix minima of a block with prefix minima of the next.
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, ~np.uint64(0), np.uint64)
    padded[: len(keys)] = keys
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:count], ahead[width - 1: width - 1 + count])
    anchor = (least & low).astype(np.int64)
    # Windows within one text.
    sizes = np.diff(offsets)
    valid = np.zeros(count + 1, np.int32)
    long_ = sizes >= span
    np.add.at(valid, offsets[:-1][long_], 1)
    np.add.at(valid, offsets[1:][long_] - span + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    change = np.empty(count, bool)
    change[0] = True
    change[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    starts = np.flatnonzero(change)
    # A text that ends where the next begins leaves at least span - 1 invalid windows between.
    ends = np.append(starts[1:], count) - 1
    keep = valid[starts]
    first, last = starts[keep], ends[keep]
    doc = np.searchsorted(offsets, first, "right") - 1
    return roller, doc, anchor[first], first, last


def text_slices(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    _, offsets = text_bytes(column)
    low = 0
    while low < len(column):
        high = min(len(column), max(low + 1, int(np.searchsorted(offsets, offsets[low] + most))))
        yield low, high
        low = high


def gram_keys(roller: Roller, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the grams at some places below their three leading bytes, as signed longs."""
    lead = np.zeros(len(at), np.uint64)
    for k in range(3):
        lead = (lead << np.uint64(8)) | data[at + k]
    return ((lead << _HASH_BITS) | (roller.hashes(at, at + GRAM) >> (np.uint64(64) - _HASH_BITS))).view(np.int64)


_RUNS = "doc bigint, gram bigint, run bigint, first int, last int, anchor int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in text_slices(batch.column(1)):
            data, offsets = text_bytes(batch.column(1).slice(low, high - low))
            if len(data) >= 1 << _POSITION_BITS:
                parts = _long_runs(data, offsets)
            else:
                parts = [(data, 0, *anchors(data, offsets))]
            keys = batch.column(0).slice(low, high - low).to_numpy()
            for piece, shift, roller, doc, anchor, first, last in parts:
                with np.errstate(over="ignore"):
                    whole = roller.hashes(first, last + SPAN) + mix64((anchor - first).astype(np.uint64))
                start = offsets[:-1][doc] - shift
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[doc]), pa.array(gram_keys(roller, piece, anchor)), pa.array(whole.view(np.int64)),
                     *[pa.array((x - start).astype(np.int32)) for x in (first, last, anchor)]],
                    names=["doc", "gram", "run", "first", "last", "anchor"],
                )


def _long_runs(data: np.ndarray, offsets: np.ndarray):
    """Runs of one very long text, from pieces that overlap by a window less one byte."""
    step = 1 << 22
    for k in range(len(offsets) - 1):
        low, high = int(offsets[k]), int(offsets[k + 1])
        for start in range(low, max(high - SPAN + 1, low), step):
            piece = data[start: min(start + step + SPAN - 1, high)]
            roller, doc, anchor, first, last = anchors(piece, np.array([0, len(piece)]))
            yield piece, start, roller, doc + k, anchor, first, last


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes: texts cross the network twice."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        for low, high in text_slices(column, 1 << 23):
            data, offsets = text_bytes(column.slice(low, high - low))
            whole = data.tobytes()
            at = offsets.tolist()
            bodies = [pack(whole[a:b]) for a, b in zip(at[:-1], at[1:])]
            part = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(bodies, pa.binary())], names=[*batch.schema.names[:-1], "body"]
            )


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes under the windows of each listed run of a text."""
    unpack = zstandard.ZstdDecompressor().decompress
    names = ["gram", "part", "parts", "doc", "first", "before", "bytes"]
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for doc, body, runs in zip(*[batch.column(c) for c in range(3)]):
            text = unpack(body.as_py())
            for r in runs.as_py():
                cut = text[r["first"]: r["last"] + SPAN]
                rows.append((r["gram"], r["part"], r["parts"], doc.as_py(), r["first"], r["anchor"] - r["first"], cut))
                size += len(cut)
            if size > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CONTEXT)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CONTEXT)], names=names)


_CONTEXT = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
_CONTEXT_SQL = "gram bigint, part int, parts int, doc bigint, first int, before int, bytes binary"


def multikey_groups(roller: Roller, at: np.ndarray, groups: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Which of the suffixes at ``at`` share their first ``span`` bytes with one of their group."""
    repeated = np.zeros(len(at), bool)
    rest, group = np.arange(len(at)), groups
    for depth in range(0, span, CHARACTER):
        low = at[rest] + depth
        with np.errstate(over="ignore"):
            keys = mix64(roller.hashes(low, low + min(CHARACTER, span - depth)) + mix64(group.astype(np.uint64)))
        order = np.argsort(keys)
        keys = keys[order]
        new = np.append(True, keys[1:] != keys[:-1])
        number = np.cumsum(new) - 1
        many = np.bincount(number)[number] > 1
        rest, group = rest[order[many]], number[many]
        if not len(rest):
            break
    repeated[rest] = True
    return repeated


def _sorted_chunk(rows: list[tuple]):
    """(repeated runs of windows, digests of windows of sliced anchors) of some contexts."""
    bodies = [r[6] for r in rows]
    data = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies], np.int64)
    starts = np.cumsum(sizes) - sizes
    count = sizes - SPAN + 1
    owner = np.repeat(np.arange(len(rows)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = starts[owner] + number
    gram = np.array([r[0] for r in rows], np.int64)
    before = np.array([r[5] for r in rows], np.int64)
    first = np.array([r[4] for r in rows], np.int64)
    doc = np.array([r[3] for r in rows], np.int64)
    with np.errstate(over="ignore"):
        place = mix64(gram.view(np.uint64))[owner] + (before[owner] - number).astype(np.uint64)
    roller = Roller(data)
    repeated = multikey_groups(roller, at, place)
    # Consecutive repeated windows of a context are one run.
    edge = np.flatnonzero(repeated & np.append(True, ~repeated[:-1] | (owner[1:] != owner[:-1])))
    stop = np.flatnonzero(repeated & np.append(~repeated[1:] | (owner[1:] != owner[:-1]), True))
    found = (doc[owner[edge]], first[owner[edge]] + number[edge], first[owner[stop]] + number[stop])
    sliced = np.array([r[2] > 1 for r in rows])[owner]
    with np.errstate(over="ignore"):
        digest = mix64(roller.hashes(at[sliced], at[sliced] + SPAN) + mix64(place[sliced]))
    digest, which = np.unique(digest, return_index=True)
    which = np.flatnonzero(sliced)[which]
    cross = (digest.view(np.int64), doc[owner[which]], first[owner[which]] + number[which], ~repeated[which])
    return found, cross


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["digest", "doc", "first", "last", "alone"]
    rows: list[tuple] = []
    windows, key = 0, None

    def flush():
        (d, a, b), (digest, doc, place, alone) = _sorted_chunk(rows)
        n, m = len(d), len(doc)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(np.zeros(n, np.int64), digest), mask=np.append(np.ones(n, bool), np.zeros(m, bool))),
             pa.array(np.append(d, doc)), pa.array(np.append(a, place).astype(np.int32)),
             pa.array(np.append(b, place).astype(np.int32)), pa.array(np.append(np.zeros(n, bool), alone))],
            names=names,
        )

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns[:7]]):
            if rows and windows >= CHUNK and row[:2] != key:
                yield from flush()
                rows, windows = [], 0
            key = row[:2]
            rows.append(row)
            windows += len(row[6]) - SPAN + 1
    if rows:
        yield from flush()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out = []
        for body, spans in zip(batch.column(1), batch.column(2)):
            text = unpack(body.as_py())
            kept, removed, number, at = hashlib.sha256(), 0, 0, -1
            for span in sorted((s["first"], s["last"]) for s in spans.as_py() or []):
                low, high = span[0], span[1] + SPAN
                if low > at:
                    kept.update(text[max(at, 0): low])
                    number += 1
                    removed += high - low
                    at = high
                elif high > at:
                    removed += high - at
                    at = high
            kept.update(text[max(at, 0):])
            out.append((len(text), removed, number, kept.hexdigest()))
        columns = [list(c) for c in zip(*out)] or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of (doc_id, text).

    Null and empty texts have no bytes. Null ids and repeated rows are documents of their own, so
    a repeated row repeats all its strings. Other columns are ignored.
    """
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), "text")
    runs = stored(keyed.select("doc", "text").mapInArrow(_runs, _RUNS))
    often = runs.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    shared = stored(runs.join(often, "gram"))
    kinds = stored(
        shared.groupBy("gram", "run").agg(
            F.count("*").alias("n"), F.min(F.struct("doc", "first", "last", "anchor")).alias("one")
        )
    )
    whole = shared.join(kinds.where("n > 1").select("gram", "run"), ["gram", "run"]).select("doc", "first", "last")
    # Anchors with several different runs: one of each is compared.
    several = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    compared = kinds.join(several, "gram").select(
        "gram", "one.*", F.ceil(F.col("kinds") / SLICE).cast("int").alias("parts"), "run"
    )
    compared = stored(compared.withColumn("part", F.pmod(F.xxhash64("run"), F.col("parts")).cast("int")).drop("run"))
    lists = compared.groupBy("doc").agg(
        F.collect_list(F.struct("gram", "part", "parts", "first", "last", "anchor")).alias("runs")
    )
    bodies = keyed.select("doc_id", "doc", "text").mapInArrow(_compress, "doc_id bigint, doc bigint, body binary")
    contexts = bodies.select("doc", "body").join(lists, "doc").select("doc", "body", "runs")
    contexts = contexts.mapInArrow(_cut_contexts, _CONTEXT_SQL)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Splitters from quantiles of the leading bytes and hash of the compared anchors.
    splitters = compared.select(
        F.percentile_approx("gram", [k / (4 * parts) for k in range(1, 4 * parts)], 10 * parts).alias("s")
    ).first()["s"]
    bounds = F.array(*[F.lit(b).cast("long") for b in sorted(set(splitters or [0]))])
    bucket = F.size(F.filter(bounds, lambda b: b < F.col("gram")))
    ordered = (
        contexts.withColumn("bucket", bucket).repartition(parts, "bucket", "part")
        .sortWithinPartitions("gram", "part")
    )
    found = stored(ordered.mapInArrow(_sort, "digest bigint, doc bigint, first int, last int, alone boolean"))
    inside = found.where("digest IS NULL").select("doc", "first", "last")
    sliced = found.where("digest IS NOT NULL")
    again = sliced.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    across = sliced.where("alone").join(again, "digest").select("doc", "first", "last")
    spans = whole.union(inside).union(across).groupBy("doc").agg(
        F.collect_set(F.struct("first", "last")).alias("spans")
    )
    joined = bodies.join(spans, "doc", "left").select("doc_id", "body", "spans")
    return joined.mapInArrow(
        _remove, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
