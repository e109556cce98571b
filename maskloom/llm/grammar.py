"""Token ids in files, compressed by grammars of repeated pairs.

Documents are dealt to shards by ranges of doc_id. A shard is a run of blocks with whole
documents; each block has its own grammar. Re-Pair: frequent pairs of neighbouring symbols become
rules, round after round, until no pair has the least count. One round replaces many pairs at
once: going down the counts, a pair is taken if its left symbol is not the right one of a taken
pair and the other way round, so that no two taken pairs can overlap. A pair of equal symbols is
taken if no other taken pair has that symbol, and replaced from the left of each run.

The files are Parquet, one row per block: rules, expansion lengths, the remaining sequence and
the documents' lengths. Sums of expansion lengths find the symbols that cover any range of ids, so
one document is decoded without the rest of its block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.common import stored
from maskloom.llm.tokens import by_size, encoder

END_ID = 2
BLOCK_IDS = 1 << 20
# Symbols from here on are rules; ids of the tokenizer are below.
FIRST_RULE = 1 << 17
LEAST_COUNT = 32
_SLOT_BITS = 20

_FILE = (
    "shard int, block int, n_ids bigint, doc_ids array<bigint>, doc_lengths array<bigint>, "
    "rules binary, expansions binary, low binary, high binary"
)


def _places(symbols: np.ndarray, open_: np.ndarray, least: int):
    """(pairs, places, number of the pair at each place) of all pairs whose slot has the least count.

    Only the places ``open_`` are looked at; they hold all places of every pair that can be
    frequent. Of the overlapping places of an equal pair in a run, every other one counts, from
    the left. A fourth result has the places before that choice.
    """
    bits = min(_SLOT_BITS, max(8, len(open_).bit_length()))
    a, b = symbols[open_], symbols[open_ + 1]
    slot = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)
    full = np.flatnonzero(np.bincount(slot, minlength=1 << bits) >= least)
    number = np.full(1 << bits, -1, np.int32)
    number[full] = np.arange(len(full))
    which = number[slot]
    held = which >= 0
    often, a, b = open_[held], a[held], b[held]
    which = which[held]
    every = often
    equal = np.flatnonzero(a == b)
    if len(equal):
        # All places of a run share a slot, so they follow each other here, too.
        at = often[equal]
        start = np.ones(len(at), bool)
        start[1:] = at[1:] != at[:-1] + 1
        first = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        keep = np.ones(len(often), bool)
        keep[equal[(np.arange(len(at)) - first) % 2 == 1]] = False
        often, a, b, which = often[keep], a[keep], b[keep], which[keep]
    # The pair seen last stands for its slot; other pairs of the slot get numbers of their own.
    last = np.zeros(len(full), np.int64)
    last[which] = np.arange(len(which))
    keys = (a.astype(np.uint64) << np.uint64(32)) | b
    pairs = keys[last]
    other = np.flatnonzero(keys != pairs[which])
    more, inverse = np.unique(keys[other], return_inverse=True)
    which[other] = len(pairs) + inverse
    return np.concatenate([pairs, more]), often, which, every


def compress(ids: np.ndarray, least: int = LEAST_COUNT):
    """(rules as an array of symbol pairs, remaining sequence) of an array of ids."""
    symbols = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    count = 0
    # A pair of older symbols that was not frequent never will be: after a round, only places of
    # slots that were, and places beside a new symbol, are counted again.
    open_ = np.arange(max(len(symbols) - 1, 0))
    while len(open_):
        pairs, often, which, every = _places(symbols, open_, least)
        counts = np.bincount(which, minlength=len(pairs))
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] >= least]
        sides = pairs[order]
        left: set[int] = set()
        right: set[int] = set()
        taken = []
        for at, a, b in zip(
            order.tolist(), (sides >> np.uint64(32)).tolist(), (sides & np.uint64(0xFFFFFFFF)).tolist()
        ):
            if a not in right and b not in left and (a != b or (a not in left and b not in right)):
                left.add(a)
                right.add(b)
                taken.append(at)
        if not taken:
            break
        new = np.zeros(len(pairs), np.uint32)
        new[taken] = FIRST_RULE + count + np.arange(len(taken), dtype=np.uint32)
        to = new[which]
        hit = to > 0
        places = often[hit]
        rules.append(pairs[taken])
        count += len(taken)
        symbols = symbols.copy()
        symbols[places] = to[hit]
        keep = np.ones(len(symbols), bool)
        keep[places + 1] = False
        again = np.zeros(len(symbols), bool)
        again[every] = True
        again[places] = True
        # The symbol before a new one, which may be one that another pair has just swallowed.
        before = places[places > 0] - 1
        again[np.where(keep[before], before, before - 1)] = True
        symbols, again = symbols[keep], again[keep]
        open_ = np.flatnonzero(again[:-1])
    flat = np.concatenate(rules) if rules else np.empty(0, np.uint64)
    return np.stack([(flat >> np.uint64(32)).astype(np.uint32), flat.astype(np.uint32)], 1), symbols


def expansion_lengths(rules: np.ndarray) -> np.ndarray:
    lengths = np.ones(len(rules), np.int64)
    sides = rules.astype(np.int64) - FIRST_RULE
    for k, (a, b) in enumerate(sides.tolist()):
        lengths[k] = (lengths[a] if a >= 0 else 1) + (lengths[b] if b >= 0 else 1)
    return lengths


class Grammar:
    """A block's rules with all phrases written out; decodes any range of ids."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray):
        self.symbols, self.lengths = symbols, lengths
        self.starts = np.zeros(len(rules) + 1, np.int64)
        np.cumsum(lengths, out=self.starts[1:])
        self.phrases = np.empty(self.starts[-1], np.uint32)
        starts = self.starts.tolist()
        for k, pair in enumerate(rules.tolist()):
            at = starts[k]
            for s in pair:
                if s < FIRST_RULE:
                    self.phrases[at] = s
                    at += 1
                else:
                    low, high = starts[s - FIRST_RULE], starts[s - FIRST_RULE + 1]
                    self.phrases[at: at + high - low] = self.phrases[low:high]
                    at += high - low
        rule = symbols >= FIRST_RULE
        sizes = np.ones(len(symbols), np.int64)
        sizes[rule] = lengths[symbols[rule] - FIRST_RULE]
        self.ends = np.cumsum(sizes)

    def decode(self, low: int, high: int) -> np.ndarray:
        """Ids low to high (end exclusive) of the block."""
        if low >= high:
            return np.empty(0, np.uint32)
        first = int(np.searchsorted(self.ends, low, "right"))
        last = int(np.searchsorted(self.ends, high, "left")) + 1
        part = self.symbols[first:last]
        begin = int(self.ends[first - 1]) if first else 0
        sizes = np.diff(self.ends[first:last], prepend=begin)
        at = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.uint32)
        rule = part >= FIRST_RULE
        out[at[~rule]] = part[~rule]
        n = sizes[rule]
        if len(n):
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(at[rule], n) + inner] = self.phrases[
                np.repeat(self.starts[part[rule] - FIRST_RULE], n) + inner
            ]
        return out[low - begin: high - begin]


def encode_shards(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID,
                  block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of the id files of (doc_id, text), in ascending doc_id order (null ids last).

    Equal ids are ordered by a hash of their text; repeated rows are documents of their own. A
    null text has the end id alone. Other columns are ignored.
    """
    keyed = docs.select("doc_id", "text").withColumns(
        {"_null": F.col("doc_id").isNull(), "_tie": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}
    )
    keys = ["_null", "doc_id", "_tie", "_row"]
    ordered = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = np.uint32(end_id).tobytes()
        shard, block = TaskContext.get().partitionId(), 0
        names: list = []
        held: list[bytes] = []
        size = 0

        def flush():
            nonlocal block, size
            if held:
                ids = np.frombuffer(b"".join(held), np.uint32)
                rules, symbols = compress(ids)
                row = {
                    "shard": shard, "block": block, "n_ids": len(ids), "doc_ids": list(names),
                    "doc_lengths": [len(b) // 4 for b in held], "rules": rules.tobytes(),
                    "expansions": expansion_lengths(rules).tobytes(),
                    "low": symbols.astype(np.uint16).tobytes(),
                    "high": (symbols >> np.uint32(16)).astype(np.uint16).tobytes(),
                }
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)
                block += 1
            names.clear()
            held.clear()
            size = 0

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in by_size(texts):
                for doc_id, piece in zip(ids[low:high], encode(texts[low:high])):
                    names.append(doc_id)
                    held.append(piece + end)
                    size += len(piece) // 4 + 1
                if size >= block_ids:
                    yield from flush()
        yield from flush()

    return ordered.mapInArrow(run, _FILE)


_ARROW = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()),
     ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())),
     ("rules", pa.binary()), ("expansions", pa.binary()), ("low", pa.binary()), ("high", pa.binary())]
)
_OUT = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32())]
    + [(c, pa.int64()) for c in ("doc_id", "in_block", "n_tokens", "ids_crc32")]
)


def block_grammar(row: dict) -> Grammar:
    low = np.frombuffer(row["low"], np.uint16).astype(np.uint32)
    high = np.frombuffer(row["high"], np.uint16).astype(np.uint32)
    rules = np.frombuffer(row["rules"], np.uint32).reshape(-1, 2)
    return Grammar(rules, np.frombuffer(row["expansions"], np.int64), low | (high << np.uint32(16)))


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from blocks of ``encode_shards``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grammar = block_grammar(row)
                lengths = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                ids = memoryview(grammar.decode(0, row["n_ids"]).tobytes())
                sums = [
                    zlib.crc32(ids[4 * a: 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())
                ]
                n = len(lengths)
                yield pa.record_batch(
                    [pa.array(np.full(n, row["shard"], np.int32)), pa.array(np.full(n, row["block"], np.int32)),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(lengths),
                     pa.array(sums, pa.int64())],
                    schema=_OUT,
                )

    decoded = files.mapInArrow(
        run, "shard int, block int, doc_id bigint, in_block bigint, n_tokens bigint, ids_crc32 bigint"
    )
    # Ids before a shard, then before a block in its shard: two small tables of sums.
    sizes = files.select("shard", "block", "n_ids")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start")
    )
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.join(shards, "shard").select(
        "shard", "block",
        (F.col("shard_start") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("block_start"),
    )
    return decoded.join(blocks, ["shard", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_and_read(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the id files to the shared folder and read every document back from them."""
    return read_documents(stored(encode_shards(docs, tokenizer, end_id)))
