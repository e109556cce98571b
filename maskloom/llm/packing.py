"""Packing documents into training sequences by balanced attention cost.

A piece of l tokens costs l + l * l / (6 h) units: the linear part of a transformer layer of width
h and the quadratic part of attention. Pieces in descending length go to the cheapest sequence
that still has room for them. Documents longer than a sequence are cut at its length; a piece
for which no sequence has room is cut over the cheapest ones that have any.

Each task packs the documents of its partition in blocks of a bounded number of tokens, so there
is no shuffle, memory is bounded, and a task that is repeated gives the same sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from maskloom.llm.tokens import encoder, slices

LENGTH = 2048
END_ID = 1
BLOCK_TOKENS = 1 << 21
WIDTH = 1024
# Bytes of a worker's memo of encoded parts: packing follows stages that fill the executor's heap.
MEMO = 48 << 20

_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, ids binary"
)
_ARROW = pa.schema(
    [(c, pa.int64()) for c in "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()]
    + [("ids", pa.binary())]
)


def assign(lengths: list[int], room: int = LENGTH, width: int = WIDTH) -> tuple[list[tuple], int]:
    """Pieces (document, start, length, sequence, offset) of documents, and the number of sequences.

    The sequences are as few as hold all tokens; they lack less than one sequence's tokens in all.
    """
    pieces: list[tuple] = []
    rests: list[tuple[int, int, int]] = []
    used = 0
    for doc, tokens in enumerate(lengths):
        full = tokens // room
        for k in range(full):
            pieces.append((doc, k * room, room, used, 0))
            used += 1
        if tokens % room:
            rests.append((tokens % room, doc, full * room))
    bins = -(-sum(r[0] for r in rests) // room)
    left = np.full(bins, room, np.int64)
    cost = np.zeros(bins)
    rests.sort(key=lambda r: (-r[0], r[1]))
    for tokens, doc, start in rests:
        while tokens:
            fits = left >= tokens
            if not fits.any():
                fits = left > 0
            target = int(np.argmin(np.where(fits, cost, np.inf)))
            take = min(tokens, int(left[target]))
            pieces.append((doc, start, take, used + target, room - int(left[target])))
            left[target] -= take
            cost[target] += take + take * take / (6 * width)
            tokens -= take
            start += take
    return pieces, used + bins


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    length: int = LENGTH,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per piece of (doc_id, text): its place in its document and in its sequence.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers. ``sequence_id`` is
    unique over all partitions. Null and empty texts consist of the end id alone. Null ids and
    repeated rows are documents of their own; other columns are ignored. An empty table has no
    sequences. A block holds whole documents, so its memory is bounded by ``block_tokens`` and
    the longest document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, MEMO, True).encode
        end = np.uint32(end_id).tobytes()
        base = TaskContext.get().partitionId() << 32
        names: list = []
        held: list[bytes] = []
        tokens = 0

        def flush():
            nonlocal base, tokens
            lengths = [len(b) // 4 for b in held]
            pieces, used = assign(lengths, length)
            for low in range(0, len(pieces), 8192):
                part = pieces[low: low + 8192]
                ids = [held[d][4 * s: 4 * (s + n)] for d, s, n, _, _ in part]
                yield pa.record_batch(
                    [
                        pa.array([names[p[0]] for p in part], pa.int64()),
                        pa.array([p[1] for p in part], pa.int64()),
                        pa.array([p[2] for p in part], pa.int64()),
                        pa.array([zlib.crc32(b) for b in ids], pa.int64()),
                        pa.array([lengths[p[0]] for p in part], pa.int64()),
                        pa.array([base + p[3] for p in part], pa.int64()),
                        pa.array([p[4] for p in part], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    schema=_ARROW,
                )
            base += used
            names.clear()
            held.clear()
            tokens = 0

        for batch in batches:
            for part in slices(batch):
                for doc_id, piece in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    names.append(doc_id)
                    held.append(piece + end)
                    tokens += len(piece) // 4 + 1
                if tokens >= block_tokens:
                    yield from flush()
        yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)
