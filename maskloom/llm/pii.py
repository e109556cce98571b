"""Personal data: patterns, and terms that reveal them by co-occurrence.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Each distinct value is a
protected entity e. A term t anywhere in its documents, outside of values, reveals
PMI(e, t) = log2(P(e | t) / P(e)) of the entity's information IC(e) = -log2 P(e), with all
probabilities counted over whole documents. A term that reveals more than a share of IC(e) of any
entity is generalised, above a higher share removed, at every place of the entity's documents or,
as the registered query and the pipeline ask for, of all documents.

Every pair of an entity and a term in one document or more is scored, and chance lowers its PMI. If
the n documents of t were dealt at random, at least as many of them as found would hold e with a
probability below 2 ** -(n * D(P(e | t) || P(e))), by Chernoff's bound. Times the number of terms
whose documents are as many as those of t, within a power of two, that is how many terms chance
would put beside e. PMI loses the bits by which this exceeds CHANCE. So a word that stands in one
document, beside a value that does, too, reveals it where such words are rare, and not where every
document has some.

Copies of a document and fixed blocks, such as signatures, count like any other documents.
Entities and terms are compared by 64-bit hashes. Counts are combined before every shuffle, so a
value or term in very many documents meets in no task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from maskloom.llm.common import TERM, Roller, lowered, runs, stored, text_bytes

# Fixed values of the contract: kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
ADDED = ("generalise", "remove")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A number that fails at the start of its digits fails at each later digit, too.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Terms beside a value by chance, up to which a pair's PMI stands unlowered.
CHANCE = 0.001
# At most so many terms are common, see disclosing_terms.
COMMON = 100_000
GENERALISE, REMOVE = 0.90, 0.95
# Bits of the filter that a pass over all terms uses: 1 MB, whatever the input.
_FILTER_BITS = 23


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all pattern matches, sorted."""
    found = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            start = at = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                last = m.end()
                found.append((start, 0, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start():
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def _hashes(words: list[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array(words, pa.large_string()))
    return Roller(lowered(data)).hashes(offsets[:-1], offsets[1:]).view(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices with about 2 MB in their column ``text``, whole rows."""
    for batch in batches:
        _, bounds = text_bytes(batch.column("text"))
        low = 0
        while low < len(batch):
            high = min(len(batch), max(low + 1, int(np.searchsorted(bounds, bounds[low] + (1 << 21)))))
            yield batch.slice(low, high - low)
            low = high


def _scan(column: pa.Array):
    """(spans of the values per text; text, hash, start and end of every whole term outside of them).

    Places are code points of the term's text.
    """
    data, offsets = text_bytes(column)
    starts, ends, doc = runs(TERM[data], offsets)
    terms = Roller(lowered(data)).hashes(starts, ends).view(np.int64)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    starts, ends, first = points[starts], points[ends], points[offsets[:-1]]
    spans = [find_base(text or "") for text in column.to_pylist()]
    covered = np.zeros(int(points[-1]) + 1, np.int64)
    for k in np.flatnonzero([len(x) for x in spans]).tolist():
        for start, _, end in spans[k]:
            covered[first[k] + start: first[k] + end] = 1
    before = np.zeros(len(covered) + 1, np.int64)
    np.cumsum(covered, out=before[1:])
    free = before[ends] == before[starts]
    doc = doc[free]
    return spans, doc, terms[free], starts[free] - first[doc], ends[free] - first[doc]


def _counted(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how often each stands."""
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    at = np.flatnonzero(new)
    return first[at], second[at], np.diff(at, append=len(first))


_FOUND = (
    "row bigint, doc_id bigint, text_hash bigint, starts array<int>, kinds array<int>, ends array<int>, "
    "entities array<bigint>, terms array<bigint>"
)
_INT, _LONG = pa.list_(pa.int32()), pa.list_(pa.int64())
_ARROW = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("starts", _INT), ("kinds", _INT), ("ends", _INT),
     ("entities", _LONG), ("terms", _LONG)]
)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and distinct values of every text, and the distinct terms of texts that hold a value."""
    row = TaskContext.get().partitionId() << 33
    for batch in _pieces(batches):
        spans, doc, terms, _, _ = _scan(batch.column("text"))
        values = []
        for text, found in zip(batch.column("text"), spans):
            text = text.as_py() if found else ""
            values.append([
                f"{KINDS[c]} {text[s:e] if c in (0, 1) else ''.join(_DIGIT.findall(text[s:e]))}" for s, c, e in found
            ])
        sizes = np.array([len(v) for v in values])
        entities = np.split(_hashes([v for own in values for v in own]), np.cumsum(sizes)[:-1])
        held = sizes[doc] > 0
        doc, terms, _ = _counted(doc[held], terms[held])
        n = len(spans)
        bounds = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
        yield pa.record_batch(
            [
                pa.array(range(row, row + n), pa.int64()), batch.column("doc_id"), batch.column("text_hash"),
                *[pa.array([[s[i] for s in x] for x in spans], _INT) for i in range(3)],
                pa.array([np.unique(x) for x in entities], _LONG),
                pa.ListArray.from_arrays(pa.array(bounds), pa.array(terms, pa.int64())),
            ],
            schema=_ARROW,
        )
        row += n


def _filter(df: DataFrame, column: str) -> bytes:
    """One bit per slot of the hashes of a column: at most 2 ** 17 words come back, for any input."""
    slot = F.shiftrightunsigned(column, 64 - _FILTER_BITS)
    words = df.select(F.shiftright(slot, 6).alias("word"), (slot % 64).cast("int").alias("bit")).groupBy("word").agg(
        F.expr("bit_or(shiftleft(1L, bit))").alias("bits")
    ).toPandas()
    out = np.zeros(1 << (_FILTER_BITS - 6), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.tobytes()


def _passes(wanted: bytes):
    bits = np.unpackbits(np.frombuffer(wanted, np.uint8), bitorder="little").view(bool)
    return lambda hashes: bits[hashes.view(np.uint64) >> np.uint64(64 - _FILTER_BITS)]


def _pair_counts(wanted: bytes):
    """Documents of each pair of a value whose slot is in the filter and a term, combined within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = _passes(wanted)
        firsts, seconds, size = [], [], 0

        def flush():
            nonlocal size
            if size:
                columns = _counted(np.concatenate(firsts), np.concatenate(seconds))
                for low in range(0, len(columns[0]), 1 << 16):
                    yield pa.record_batch(
                        [pa.array(c[low: low + (1 << 16)], pa.int64()) for c in columns], names=["entity", "term", "n"]
                    )
            firsts.clear()
            seconds.clear()
            size = 0

        for batch in batches:
            for own, terms in zip(batch.column(0), batch.column(1)):
                own = own.values.to_numpy()
                own = own[passes(own)]
                terms = terms.values.to_numpy() if len(own) else ()
                if not len(terms):
                    continue
                step = max(1, (1 << 20) // len(terms))
                for low in range(0, len(own), step):
                    part = own[low: low + step]
                    firsts.append(np.repeat(part, len(terms)))
                    seconds.append(np.tile(terms, len(part)))
                    size += len(part) * len(terms)
                    if size >= 1 << 21:
                        yield from flush()
        yield from flush()

    return run


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each term, combined within the task."""
    names, counts, size = [], [], 0

    def flush():
        terms, at = np.unique(np.concatenate(names), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        for low in range(0, len(terms), 1 << 16):
            yield pa.record_batch([pa.array(c[low: low + (1 << 16)]) for c in (terms, n)], names=["term", "n"])
        names.clear()
        counts.clear()

    for batch in _pieces(batches):
        _, doc, terms, _, _ = _scan(batch.column("text"))
        _, terms, _ = _counted(doc, terms)
        terms, n = np.unique(terms, return_counts=True)
        names.append(terms)
        counts.append(n)
        size += len(terms)
        if size >= 1 << 21:
            yield from flush()
            size = 0
    if names:
        yield from flush()


def _places(wanted: bytes):
    """Every place of each term whose slot is in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = _passes(wanted)
        for batch in _pieces(batches):
            _, doc, terms, starts, ends = _scan(batch.column("text"))
            hit = passes(terms)
            rows = pa.array(doc[hit])
            yield pa.record_batch(
                [batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(terms[hit]),
                 pa.array(starts[hit].astype(np.int32)), pa.array(ends[hit].astype(np.int32))],
                names=["doc_id", "text_hash", "term", "start", "end"],
            )

    return run


def _of_terms(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Pairs with the count of their term.

    A common term stands beside very many values. All counts together are COMMON times the limit, so
    at most COMMON terms lie above it; these are broadcast, and the others meet by a shuffle.
    """
    limit = (counts.agg(F.sum("with_term")).first()[0] or 0) / COMMON
    common = F.broadcast(counts.where(F.col("with_term") > limit))
    rest = pairs.join(common.select("term"), "term", "left_anti").join(counts.where(F.col("with_term") <= limit), "term")
    return pairs.join(common, "term").unionByName(rest)


def disclosing_terms(found: DataFrame, docs: DataFrame, generalise: float = GENERALISE,
                     remove: float = REMOVE, chance: float = CHANCE) -> DataFrame:
    """(entity, term, action) of terms that reveal an entity; ``found`` as made from ``docs``.

    Of entities that stand in the same documents, one is listed.
    """
    with_entity = found.select("row", F.explode("entities").alias("entity")).groupBy("entity").agg(
        F.count("*").alias("with_entity"), F.expr("bit_xor(xxhash64(row))").alias("a"),
        F.expr("bit_xor(xxhash64(row, 1))").alias("b"),
    )
    # Values of the same documents reveal the same: one of them stands for all.
    with_entity = stored(with_entity.groupBy("a", "b", "with_entity").agg(F.min("entity").alias("entity")).drop("a", "b"))
    together = (
        found.select("entities", "terms").where(F.size("entities") > 0)
        .mapInArrow(_pair_counts(_filter(with_entity, "entity")), "entity bigint, term bigint, n bigint")
        .groupBy("entity", "term").agg(F.sum("n").alias("both"))
    )
    together = stored(together.join(with_entity, "entity"))
    counts = docs.select("text").mapInArrow(_document_counts, "term bigint, n bigint")
    counts = stored(counts.groupBy("term").agg(F.sum("n").alias("with_term")))
    rarity = F.floor(F.log2("with_term"))
    # A row for each power of two.
    alike = counts.groupBy(rarity.alias("rarity")).agg(F.count("*").alias("alike"))
    share_e = F.col("with_entity") / F.lit(max(found.count(), 1))
    share_t = F.col("both") / F.col("with_term")
    pmi = F.log2(share_t / share_e)
    without = F.when(share_t < 1, (1 - share_t) * F.log2((1 - share_t) / (1 - share_e))).otherwise(0.0)
    evidence = F.col("with_term") * (share_t * pmi + without)
    by_chance = F.greatest(F.lit(0.0), F.log2(F.col("alike").cast("double")) - F.log2(F.lit(chance)) - evidence)
    share = F.when(share_e < 1, (pmi - by_chance) / -F.log2(share_e)).otherwise(0.0)
    scored = _of_terms(together, counts).withColumn("rarity", rarity).join(F.broadcast(alike), "rarity")
    scored = scored.select("entity", "term", share.alias("share"))
    action = F.when(F.col("share") >= remove, F.lit(1)).otherwise(F.lit(0))
    return scored.where(F.col("share") >= generalise).select("entity", "term", action.alias("action"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, *ADDED)])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def _spans(docs: DataFrame, everywhere: bool, **thresholds) -> DataFrame:
    """(doc_id, text_hash, kinds, base, everything) with sorted spans, one row per row."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = stored(docs.mapInArrow(_find, _FOUND))
    flagged = stored(disclosing_terms(found, docs, **thresholds))
    places = docs.mapInArrow(
        _places(_filter(flagged, "term")), "doc_id bigint, text_hash bigint, term bigint, start int, end int"
    )
    if everywhere:
        marked = places.join(flagged.groupBy("term").agg(F.max("action").alias("action")), "term")
    else:
        own = found.select(F.col("doc_id").alias("to_id"), F.col("text_hash").alias("to_hash"), F.explode("entities").alias("entity"))
        own = own.join(flagged, "entity").groupBy("to_id", "to_hash", F.col("term").alias("to_term")).agg(F.max("action").alias("action"))
        marked = places.join(own, F.col("doc_id").eqNullSafe(F.col("to_id")) & (F.col("text_hash") == F.col("to_hash"))
                             & (F.col("term") == F.col("to_term")))
    # Repeated rows have the same places: a set of them for each id and text.
    added = marked.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", (F.col("action") + len(KINDS)).alias("kind"), "end")).alias("added")
    ).select(F.col("doc_id").alias("to_id"), F.col("text_hash").alias("to_hash"), "added")
    base = F.transform(
        F.arrays_zip("starts", "kinds", "ends"),
        lambda s: F.struct(s["starts"].alias("start"), s["kinds"].alias("kind"), s["ends"].alias("end")),
    )
    met = F.col("doc_id").eqNullSafe(F.col("to_id")) & (F.col("text_hash") == F.col("to_hash"))
    rows = found.select("doc_id", "text_hash", "kinds", base.alias("base")).join(added, met, "left")
    everything = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return rows.select("doc_id", "text_hash", "kinds", "base", everything.alias("everything"))


def find_personal_data(docs: DataFrame, everywhere: bool = False, **thresholds) -> DataFrame:
    """One row per row of (doc_id, text): counts, digest and list of its spans.

    Columns: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans. Spans are
    kind:start:end in code points, end exclusive, sorted by start and kind. Null and empty texts
    have none; null ids and repeated rows are documents of their own. Other columns are ignored.
    Terms that reveal a value are marked in all documents that hold it, or ``everywhere``; a value may
    stand in one document only. An empty table gives no rows.
    """

    def count(kind: int) -> Column:
        return F.size(F.filter("kinds", lambda k: k == kind)).cast("long")

    return _spans(docs, everywhere, **thresholds).select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("everything")).alias("spans"),
    )


@F.pandas_udf(StringType())
def _sanitised(texts: pd.Series, spans: pd.Series) -> pd.Series:
    tags = {name: f"[{name.upper()}]" for name in KINDS} | {"generalise": "[TERM]", "remove": ""}
    out = []
    for text, listed in zip(texts, spans):
        if listed and text is not None:
            parts, at = [], 0
            for span in listed.split(","):
                kind, start, end = span.split(":")
                start, end = int(start), int(end)
                if start >= at:
                    parts += [text[at:start], tags[kind]]
                at = max(at, end)
            text = "".join([*parts, text[at:]])
        out.append(text)
    return pd.Series(out, dtype=object)


def sanitise(docs: DataFrame, everywhere: bool = False, **thresholds) -> DataFrame:
    """``docs`` with patterns and generalised terms replaced by tags and removed terms left out.

    Overlapping spans become one, with the tag of the first. Columns and rows stay as they are.
    """
    own = docs.columns
    # Rows with spans are met again by id and hash of the text; equal rows have equal spans.
    some = _spans(docs, everywhere, **thresholds).where(F.size("everything") > 0).select(
        F.col("doc_id").alias("pii_id"), F.col("text_hash").alias("pii_hash"),
        _joined(F.col("everything")).alias("pii_spans"),
    )
    some = some.groupBy("pii_id", "pii_hash").agg(F.max("pii_spans").alias("pii_spans"))
    met = docs["doc_id"].eqNullSafe(some["pii_id"]) & (F.xxhash64(docs["text"]) == some["pii_hash"])
    joined = docs.join(some, met, "left")
    clean = _sanitised(docs["text"], some["pii_spans"]).alias("text")
    return joined.select(*[clean if c == "text" else docs[c] for c in own])
