"""Ranked lexical search over a length-stratified index.

Build. One pass counts the terms of every text, for N documents with L terms. A second pass cuts each
task's documents into segments of bounded size. A segment's documents are ordered by their length
normaliser m; those with equal m form a stratum. A term's postings in a segment are groups of
equal (m, tf), each with its documents, so that an impact is worked out once per group. The index is
a table of (segment, term) rows and a table of documents per segment; no text is shuffled.

Search. A term's document frequency is the sum over segments, its weight follows. Every segment answers
all items: a stratum's bound is the sum over the item's terms of weight times the impact of the
highest tf there; strata are visited from the highest bound on, in growing steps, until the next
bound lies below the k-th score. A sixteenth of the segments goes first and gives each item a floor that
the others start from, so most of their strata are never opened. Segments return at most k documents an item.

Items are searched in blocks of bounded size, sent along with the tasks. Within a segment, terms are told apart by
64-bit hashes; the index holds the terms themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import TERM, Roller, lowered, stored, text_bytes
from maskloom.llm.minhash import slices

TOP = 20
# Bytes of text in a segment, but for a longer document.
SEGMENT_BYTES = 8 << 20
# Rows (item, term) that a task gets at a time, about 6 MB.
BLOCK_TERMS = 100_000
# One segment in so many is searched first, for the floors.
FIRST = 16


# --- terms -------------------------------------------------------------------------------------


@dataclass
class Terms:
    """Distinct (document, term) of a text batch: ordinals, term numbers, occurrences; the terms' texts."""

    lengths: np.ndarray
    doc: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    names: list[bytes]


def _edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the terms, and the number of each one's text."""
    inside = np.append(TERM[data], False)
    first = np.zeros(len(inside), bool)
    first[offsets[:-1]] = True
    before = np.append(False, inside[:-1])
    starts = np.flatnonzero(inside & (~before | first))
    after = np.append(inside[1:] & ~first[1:], False)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lengths_of(column: pa.Array) -> np.ndarray:
    """Terms, with repeats, of each text."""
    data, offsets = text_bytes(column)
    return np.bincount(_edges(data, offsets)[2], minlength=len(column))


def terms_of(column: pa.Array) -> Terms:
    data, offsets = text_bytes(column)
    data = lowered(data)
    starts, ends, text = _edges(data, offsets)
    hashes, first, number = np.unique(Roller(data).hashes(starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    names = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    pairs, tf = np.unique(number * len(column) + text, return_counts=True)
    return Terms(
        np.bincount(text, minlength=len(column)), pairs % max(len(column), 1), pairs // max(len(column), 1), tf, names
    )


# --- index -------------------------------------------------------------------------------------


@dataclass
class Index:
    """Tables of the index: ``postings`` (segment, term, m, tf, n, docs), ``places`` (segment, ids, m)."""

    postings: DataFrame
    places: DataFrame
    documents: int
    terms: int


_POSTINGS = "segment bigint, term string, m array<bigint>, tf array<bigint>, n array<int>, docs array<int>"
_PLACES = "segment bigint, ids array<bigint>, m array<bigint>"


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values))


def _segment(ids: pa.Array, texts: pa.Array, documents: int, terms: int):
    """(postings, places) of one segment: postings as arrays with edges, ready for columns."""
    found = terms_of(texts)
    m = 100 - 25 + (25 * found.lengths * documents) // terms
    order = np.argsort(m, kind="stable")
    ordinal = np.empty(len(order), np.int64)
    ordinal[order] = np.arange(len(order))
    doc, term, tf = ordinal[found.doc], found.term, found.tf
    at = np.lexsort((doc, tf, m[order][doc], term))
    doc, term, tf = doc[at], term[at], tf[at]
    stratum = m[order][doc]
    new = np.append(True, (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1]) | (tf[1:] != tf[:-1]))
    group = np.flatnonzero(new[: len(term)])
    per_term = np.searchsorted(term[group], np.arange(len(found.names) + 1))
    docs_edges = np.append(group, len(term))[per_term]
    postings = (
        found.names, _lists(stratum[group], per_term), _lists(tf[group], per_term),
        _lists(np.diff(np.append(group, len(term))).astype(np.int32), per_term),
        _lists(doc.astype(np.int32), docs_edges),
    )
    return postings, ids.take(pa.array(order)), m[order]


def build(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> Index:
    """Index the rows of (doc_id, text); each row is a document, also if its id or text is repeated.

    Null texts and texts without terms hold no term: they count in no figure and are found by no item.
    A null doc_id is a document like others. Other columns are ignored.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for low, high in slices(batch.column(0)):
                lengths = lengths_of(batch.column(0).slice(low, high - low))
                n, total = n + int((lengths > 0).sum()), total + int(lengths.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0)
    row = source.select("text").mapInArrow(count, "n bigint, total bigint").agg(F.sum("n"), F.sum("total")).first()
    documents, terms = row[0] or 0, row[1] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for ids, texts in _chunks(batches, segment_bytes):
            segment = (task << 32) + made
            made += 1
            (names, *lists), ordered, m = _segment(ids, texts, documents, terms)
            whole = _lists(ordered, np.array([0, len(ordered)])), _lists(m, np.array([0, len(m)]))
            # The first row of a segment lists its documents, the others are its terms.
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment]), pa.array([None], pa.string()), whole[1], pa.array([None], pa.list_(pa.int64())),
                 pa.array([None], pa.list_(pa.int32())), pa.array([None], pa.list_(pa.int32())), whole[0]],
                names=["segment", "term", "m", "tf", "n", "docs", "ids"],
            )
            if names:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment] * len(names)), pa.array(names, pa.binary()).cast(pa.string()), *lists,
                     pa.array([None] * len(names), pa.list_(pa.int64()))],
                    names=["segment", "term", "m", "tf", "n", "docs", "ids"],
                )

    if not terms:
        whole = source.sparkSession.createDataFrame([], f"{_POSTINGS}, ids array<bigint>")
    else:
        whole = stored(source.mapInArrow(run, f"{_POSTINGS}, ids array<bigint>"))
    postings = whole.where("term IS NOT NULL").drop("ids")
    places = whole.where("term IS NULL").select("segment", "ids", "m")
    return Index(postings, places, documents, terms)


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Documents of a task in runs of about ``most`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        for low, high in slices(batch.column(1), most):
            part = batch.slice(low, high - low)
            _, offsets = text_bytes(part.column(1))
            if held and size + int(offsets[-1]) > most:
                yield _joined(held)
                held, size = [], 0
            held.append(part)
            size += int(offsets[-1])
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    return (
        pa.concat_arrays([p.column(0) for p in parts]),
        pa.concat_arrays([p.column(1).cast(pa.large_string()) for p in parts]),
    )


# --- search ------------------------------------------------------------------------------------


def weight(documents: int, df: Column) -> Column:
    return F.floor(1000 * F.log((F.lit(2 * documents + 2).cast("double")) / (2 * df + 1).cast("double")))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Segment:
    """The postings of some terms in one segment, laid out to score items."""

    def __init__(self, postings: pd.DataFrame, ids: np.ndarray, m: np.ndarray):
        self.ids = ids
        self.strata, self.stratum_of = np.unique(m, return_inverse=True)
        self.number = {t: i for i, t in enumerate(postings["term"])}
        groups = [len(x) for x in postings["m"]]
        self.first = np.append(0, np.cumsum(groups))
        self.sizes = np.concatenate(list(postings["n"])).astype(np.int64)
        self.docs = np.concatenate(list(postings["docs"])).astype(np.int64)
        self.at = np.append(0, np.cumsum(self.sizes))
        self.stratum = np.searchsorted(self.strata, np.concatenate(list(postings["m"])))
        # One impact for all documents of a (stratum, tf).
        self.impact = impacts(
            np.concatenate(list(postings["tf"])).astype(np.int64), self.strata[self.stratum].astype(np.int64)
        )
        # A term's highest impact in each stratum: its groups are sorted by (m, tf).
        self.highest = np.zeros((len(groups), len(self.strata)), np.int64)
        self.highest[np.repeat(np.arange(len(groups)), groups), self.stratum] = self.impact

    def best(self, terms: list[str], weights: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """The k best (score, ordinal) with a score of at least ``floor``, which is above 0."""
        held = [(self.number[t], w) for t, w in zip(terms, weights) if t in self.number and w > 0]
        if not held:
            return []
        rows, w = np.array([r for r, _ in held]), np.array([x for _, x in held])
        bounds = w @ self.highest[rows]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] >= max(floor, 1)]
        if not len(order):
            return []
        counts = self.first[rows + 1] - self.first[rows]
        groups = np.repeat(self.first[rows], counts) + _within(counts)
        gain = np.repeat(w, counts) * self.impact[groups]
        turn = np.full(len(self.strata), len(order))
        turn[order] = np.arange(len(order))
        turns = turn[self.stratum[groups]]
        top: list[tuple[int, int]] = []
        low, step = 0, 4
        while low < len(order):
            least = max(floor, top[k - 1][0] if len(top) >= k else 1)
            if bounds[order[low]] < least:
                break
            high = min(len(order), low + step)
            # Strata of this step that cannot reach the k-th score stay closed.
            high = low + int(np.searchsorted(-bounds[order[low:high]], -least, "right"))
            mine = np.flatnonzero((turns >= low) & (turns < high))
            g = groups[mine]
            size = self.sizes[g]
            docs = self.docs[np.repeat(self.at[g], size) + _within(size)]
            found, place = np.unique(docs, return_inverse=True)
            scores = np.zeros(len(found), np.int64)
            np.add.at(scores, place, np.repeat(gain[mine], size))
            keep = np.flatnonzero(scores >= least)
            top += zip(scores[keep].tolist(), found[keep].tolist())
            top.sort(key=lambda x: (-x[0], self._id(x[1])))
            del top[k:]
            low, step = high, 2 * step
        return top

    def _id(self, ordinal: int) -> tuple[bool, int]:
        i = self.ids[ordinal]
        return (i is None, i or 0)


def _within(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


_FOUND = "item bigint, doc_id bigint, score bigint"


def _answers(index: Index, postings: DataFrame, items: list[tuple[int, list[str], list[int]]],
             floors: dict[int, int], k: int) -> DataFrame:
    """Up to k documents per item and segment, of the segments that ``postings`` has rows of."""
    wanted = [(item, terms, np.array(w, np.int64)) for item, terms, w in items]

    def run(key, postings: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(postings) and len(places):
            ids = [None if pd.isna(i) else int(i) for i in places["ids"].iloc[0]]
            segment = Segment(postings, ids, np.asarray(places["m"].iloc[0], np.int64))
            for item, terms, w in wanted:
                for score, ordinal in segment.best(terms, w, k, floors.get(item, 1)):
                    out.append((item, ids[ordinal], score))
        frame = pd.DataFrame(out, columns=["item", "doc_id", "score"])
        return frame.astype({"item": "int64", "doc_id": "Int64", "score": "int64"})

    return postings.groupBy("segment").cogroup(index.places.groupBy("segment")).applyInPandas(run, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, times) of rows (item, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1)):
                part = batch.slice(low, high - low)
                found = terms_of(part.column(1))
                names = pa.array(found.names, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(found.doc)), names.take(pa.array(found.term)), pa.array(found.tf)],
                    names=["item", "term", "times"],
                )

    return items.select("item", "text").mapInArrow(run, "item bigint, term string, times bigint")


def search(index: Index, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each of (item_id, text).

    Only scores above 0 count; equal ones by ascending doc_id, a null one last. Repeated documents
    are ranked each. Equal rows of ``items`` are one item; rows with one id and different texts
    are ranked apart under that id. Items without terms, and any over an empty index, have no row.
    """
    spark = items.sparkSession
    named = stored(
        items.select("item_id", "text").distinct()
        .withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", F.col("text").isNull(), "text"))
    )
    asked = stored(item_terms(named))
    if index.documents == 0 or asked.isEmpty():
        kind = dict(items.dtypes)["item_id"]
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    matched = stored(index.postings.join(asked.select("term").distinct(), "term", "left_semi"))
    df = matched.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weighted = asked.join(df, "term").select(
        "item", "term", (weight(index.documents, F.col("df")) * F.col("times")).alias("w")
    )
    rows = weighted.count()
    blocks = max(1, -(-rows // BLOCK_TERMS))
    by_block = stored(
        weighted.groupBy("item").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("w"))
        .withColumn("block", F.pmod("item", F.lit(blocks)))
    )
    first = F.pmod(F.xxhash64("segment"), F.lit(FIRST)) == 0
    parts = []
    for block in range(blocks):
        # About BLOCK_TERMS rows at a time, whatever the number of items.
        wanted = [(r["item"], r["terms"], r["w"]) for r in by_block.where(F.col("block") == block).collect()]
        early = stored(_ranked(_answers(index, matched.where(first), wanted, {}, k), k))
        floors = {r["item"]: r["score"] for r in early.where(F.col("rank") == k).collect()}
        late = _answers(index, matched.where(~first), wanted, floors, k)
        parts.append(stored(early.drop("rank").union(late)))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return _ranked(found, k).join(named.select("item", "item_id"), "item").select(
        "item_id", "rank", "doc_id", "score"
    )
