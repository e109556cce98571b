"""Binary masks as packed bits, and the pass that turns predictions into them.

A mask takes a bit per pixel, the first pixel in the highest bit of the first byte. Unpacking needs the
number of pixels, as the last byte may be padded with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from maskloom.functions.metrics import EPSILON

# Rows of stored predictions: the mask and the sums that scores are made of.
PREDICTION_SCHEMA = (
    "point_id string, pos bigint, h int, w int, mask binary, "
    "n bigint, tp double, st double, sp double, bce double"
)


def pack_bits(mask: np.ndarray) -> bytes:
    return np.packbits(np.asarray(mask) > 0).tobytes()


def unpack_bits(data: bytes, pixels: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=pixels).astype(float)


def pack_mask(mask: Column | str) -> Column:
    """Bits of the pixels above 0, as binary; a null mask stays null."""
    @pandas_udf("binary")
    def packed(masks: pd.Series) -> pd.Series:
        return masks.map(lambda m: None if m is None else pack_bits(m))

    return packed(mask)


def unpack_mask(data: Column | str, pixels: Column) -> Column:
    """The mask of ``pixels`` numbers 0.0 and 1.0 that ``pack_mask`` packed."""
    @pandas_udf("array<double>")
    def unpacked(packed: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else unpack_bits(d, int(n)) for d, n in zip(packed, sizes)])

    return unpacked(data, pixels)


def _numbers(row) -> np.ndarray:
    return np.asarray(row.values.to_numpy(zero_copy_only=False), float)


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, sums = [], []
        for i in range(batch.num_rows):
            t, p, mask = (_numbers(batch.column(name)[i]) for name in ("truth", "prob", "mask"))
            soft = np.clip(p, EPSILON, 1 - EPSILON)
            loss = -(t * np.log(soft) + (1 - t) * np.log(1 - soft))
            masks.append(pack_bits(mask))
            sums.append((len(p), float((t * p).sum()), float(t.sum()), float(p.sum()), float(loss.sum())))
        columns = [batch.column(name) for name in ("point_id", "pos", "h", "w")]
        columns.append(pa.array(masks, pa.binary()))
        kinds = (pa.int64(), *[pa.float64()] * 4)
        columns += [pa.array([s[k] for s in sums], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PREDICTION_SCHEMA.split(", ")])


def reduce_predictions(predicted: DataFrame) -> DataFrame:
    """Rows of ``PREDICTION_SCHEMA`` from (point_id, pos, h, w, truth, prob, mask).

    One pass over the pixels gives the packed mask and the sums of every picture; ``sums`` are those
    of ``operators.evaluate.pixel_sums`` grouped by point.
    """
    narrow = predicted.select(
        "point_id", F.col("pos").cast("bigint").alias("pos"), F.col("h").cast("int").alias("h"),
        F.col("w").cast("int").alias("w"), "truth", "prob", "mask",
    )
    return narrow.mapInArrow(_reduced, PREDICTION_SCHEMA)
