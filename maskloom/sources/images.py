"""Image folders: listing, decoding, pairing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, ShortType, StringType, StructField, StructType

from maskloom.operators.index import ordered_index

MASK_MARKER = "mask"

_DECODED = StructType(
    [
        StructField("path", StringType()),
        StructField("h", IntegerType()),
        StructField("w", IntegerType()),
        StructField("channels", IntegerType()),
        StructField("image", ArrayType(ShortType())),
    ]
)


def is_kind(path: Column, kind: str, marker: str = MASK_MARKER) -> Column:
    """Does a path name an ``image`` or a ``mask``? The whole path is tested, folders included."""
    if kind not in ("image", "mask"):
        raise ValueError(f"kind must be image or mask, not {kind!r}")
    marked = path.contains(marker)
    return marked if kind == "mask" else ~marked


def select_kind(files: DataFrame, kind: str, path: str = "path", marker: str = MASK_MARKER) -> DataFrame:
    """Files of one kind with their place (``idx``) in path order."""
    return ordered_index(files.filter(is_kind(F.col(path), kind, marker)), path)


def in_folders(path: Column, *folders: str) -> Column:
    """Does a path lie in one of the folders or below?"""
    if not folders:
        raise ValueError("no folder given")
    return reduce(or_, [path.startswith(folder.rstrip("/") + "/") for folder in folders])


def list_files(spark: SparkSession, *folders: str, pattern: str = "*.*") -> DataFrame:
    """(path) of the files in one or more folders; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(list(folders))
        .select("path")
    )


def read_encoded(
    spark: SparkSession,
    *folders: str,
    kind: str | None = None,
    pattern: str = "*.*",
    marker: str = MASK_MARKER,
) -> DataFrame:
    """Pictures as Spark's image source decodes them: (path, h, w, channels, image).

    ``image`` is binary, a byte per channel in blue-green-red(-alpha) order, which conversion takes
    as is. A file that cannot be decoded, or that has 16 bits a channel, is an error that names
    it: left out, it would shift the pairing of all files after it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(list(folders))
    raw = (
        spark.read.format("image")
        .option("dropInvalid", False)
        .option("pathGlobFilter", pattern)
        .load(list(folders))
    )
    if kind is not None:
        raw = raw.filter(is_kind(F.col("image.origin"), kind, marker))
        files = files.filter(is_kind(F.col("path"), kind, marker))
    # A PNG file has its bits per channel in byte 25; Spark's decoder keeps the low 8 of 16.
    png = F.substring("content", 1, 4) == F.unhex(F.lit("89504E47"))
    deep = files.filter(png & (F.substring("content", 25, 1) == F.unhex(F.lit("10")))).select("path").take(1)
    if deep:
        raise ValueError(f"{deep[0]['path']} has 16 bits a channel")
    return raw.select(
        F.when(F.col("image.height") < 0, F.raise_error(F.concat(F.lit("cannot decode "), F.col("image.origin"))))
        .otherwise(F.col("image.origin")).alias("path"),
        F.col("image.height").alias("h"),
        F.col("image.width").alias("w"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("image"),
    )


def read_images(spark: SparkSession, *folders: str, **options) -> DataFrame:
    """As ``read_encoded``, with ``image`` as numbers, channels interleaved in RGB(A) order."""
    return read_encoded(spark, *folders, **options).mapInArrow(_unpack, _DECODED)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes in blue-green-red order to numbers in red-green-blue order."""
    for batch in batches:
        pictures = []
        for data, channels in zip(batch.column("image"), batch.column("channels").to_pylist()):
            pixels = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, channels)
            if channels >= 3:
                pixels = pixels[:, [2, 1, 0, *range(3, channels)]]
            pictures.append(pixels.ravel().astype(np.int16))
        names = batch.schema.names
        columns = [
            pa.array(pictures, pa.list_(pa.int16())) if name == "image" else batch.column(name)
            for name in names
        ]
        yield pa.RecordBatch.from_arrays(columns, names)


def pair_by_position(left: DataFrame, right: DataFrame, idx: str = "idx") -> DataFrame:
    """Join the i-th row of both frames; unequal counts raise ``ValueError``.

    Meant for narrow rows: pair paths or ids first, then attach pixels.
    """
    if left.count() != right.count():
        raise ValueError("number of images and masks do not match")
    return left.join(right, idx)


def file_stem(path: Column) -> Column:
    """File name without folders and last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def pair_by_stem(images: DataFrame, masks: DataFrame, suffix: str = "") -> DataFrame:
    """Join files of the same name; ``suffix`` is what a mask name adds (such as ``_mask``)."""
    stem = file_stem(F.col("path"))
    mask_stem = F.regexp_replace(stem, f"{suffix}$", "") if suffix else stem
    left = images.select(stem.alias("stem"), F.col("path").alias("image_path"))
    right = masks.select(mask_stem.alias("stem"), F.col("path").alias("mask_path"))
    return left.join(right, "stem")
