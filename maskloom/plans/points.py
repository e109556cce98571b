"""From folders of pictures to a points table in one call.

File names are paired before anything is decoded; what has no partner, or a name that occurs twice, is
listed and not silently left out. Then every file is decoded and converted once, the tiles are kept in
the shared folder, and one join by (picture, tile) puts images, masks (as packed bits) and positions
together.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions.hashing import point_id
from maskloom.functions.masks import pack_mask, unpack_mask
from maskloom.operators.index import ordered_index
from maskloom.plans.convert import TILE, convert_images, convert_masks
from maskloom.session import shared_dir
from maskloom.sources.images import MASK_MARKER, file_stem, list_files, read_encoded, select_kind

REJECTED_SCHEMA = "path string, reason string"


@dataclass
class Pairing:
    """``pairs`` (idx, stem, image_path, mask_path) in the order of names, and ``rejected`` (path, reason)."""

    pairs: DataFrame
    rejected: DataFrame


def pair_files(images: DataFrame, masks: DataFrame, suffix: str = "") -> Pairing:
    """Pair files (path) of one name; ``suffix`` is what a mask name adds (such as ``_mask``).

    A file whose partner is missing, and all files of a name that one side has several times, are
    rejected. Extensions and folders do not count.
    """
    stem = file_stem(F.col("path"))
    mask_stem = F.regexp_replace(stem, f"{suffix}$", "") if suffix else stem

    def named(files: DataFrame, key) -> DataFrame:
        # A name that very many files share keeps one path here; the others are found again below.
        return files.groupBy(key.alias("stem")).agg(F.min("path").alias("path"), F.count("*").alias("n"))

    left, right = named(images, stem).alias("i"), named(masks, mask_stem).alias("m")
    both = left.join(right, "stem", "full_outer").select(
        "stem", F.col("i.path").alias("image_path"), F.col("m.path").alias("mask_path"),
        F.coalesce("i.n", F.lit(0)).alias("n_images"), F.coalesce("m.n", F.lit(0)).alias("n_masks"),
    )
    good = (F.col("n_images") == 1) & (F.col("n_masks") == 1)
    pairs = ordered_index(both.where(good).select("stem", "image_path", "mask_path"), "stem")
    reason = (
        F.when(F.col("n_images") > 1, "several images of this name").when(F.col("n_masks") > 1, "several masks of this name")
        .when(F.col("n_masks") == 0, "no mask").otherwise("no image")
    )
    bad = both.where(~good).select("stem", reason.alias("reason"))
    files = images.select("path", stem.alias("stem")).unionByName(masks.select("path", mask_stem.alias("stem")))
    return Pairing(pairs, files.join(bad, "stem").select("path", "reason"))


def _plain(path: Column) -> Column:
    """A path as both of Spark's file sources write it: one slash after the scheme."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/")


@dataclass
class Points:
    """``points`` (point_id, pos, h, w, image, truth) and what was left out (path, reason)."""

    points: DataFrame
    rejected: DataFrame


def build_points(
    spark: SparkSession,
    image_folder: str,
    mask_folder: str | None = None,
    *,
    path: str | None = None,
    source: str = "files",
    suffix: str = "",
    marker: str = MASK_MARKER,
    pattern: str = "*.*",
    tile: int = TILE,
    target: int = TILE,
    normalize: bool = False,
    tiles: str = "both",
    strict: bool = False,
) -> Points:
    """Read, pair, convert and write a points table to ``path`` (a new shared folder by default).

    Without ``mask_folder`` images and masks lie in one folder and ``marker`` in the path tells masks.
    ``tiles`` keeps ``both`` tiles of a picture, or the ``last`` one: the right one where there is one.
    Positions are dense, by name and tile. Files that cannot be decoded or have 16 bits a channel
    are an error that names them; pairs whose tiles do not match are rejected. ``strict`` makes
    any rejected file an error.
    """
    if tiles not in ("both", "last"):
        raise ValueError(f"tiles must be both or last, not {tiles!r}")
    if mask_folder is None:
        listed = list_files(spark, image_folder, pattern=pattern)
        kinds = [select_kind(listed, kind, marker=marker).select("path") for kind in ("image", "mask")]
    else:
        kinds = [list_files(spark, folder, pattern=pattern) for folder in (image_folder, mask_folder)]
    pairing = pair_files(*kinds, suffix)
    root = path or f"{shared_dir(spark).rstrip('/')}/points-{uuid.uuid4().hex}"

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    pairs, rejected = kept("pairs", pairing.pairs), kept("unpaired", pairing.rejected)
    if strict:
        first = rejected.first()
        if first:
            raise ValueError(f"{first['path']}: {first['reason']}")

    def converted(column: str, folder: str, convert, **options) -> DataFrame:
        names = pairs.select(F.col("idx"), _plain(F.col(column)).alias("path"))
        pictures = read_encoded(spark, folder, pattern=pattern).withColumn("path", _plain(F.col("path")))
        pictures = pictures.join(names, "path")
        return convert(pictures, tile=tile, target=target, keep=("idx",), **options)

    images = kept("images", converted("image_path", image_folder, convert_images, normalize=normalize))
    truths = converted("mask_path", mask_folder or image_folder, convert_masks)
    truths = kept("masks", truths.select("idx", "tile_no", pack_mask("image").alias("truth")))

    # From here on narrow rows decide; pixels move once, by (idx, tile_no).
    keys = ["idx", "tile_no"]
    tiles_of = images.select(*keys).join(truths.select(*keys, F.lit(1).alias("m")), keys, "full_outer").join(
        images.select(*keys, F.lit(1).alias("i")), keys, "left"
    )
    odd = kept("odd", tiles_of.where("m IS NULL OR i IS NULL").select("idx").distinct())
    differing = odd.join(pairs, "idx").select(
        F.explode(F.array("image_path", "mask_path")).alias("path"), F.lit("image and mask differ in shape").alias("reason")
    )
    if strict and not odd.isEmpty():
        raise ValueError(f"{differing.first()['path']}: image and mask differ in shape")
    whole = images.select(*keys).join(odd, "idx", "left_anti")
    if tiles == "last":
        whole = whole.groupBy("idx").agg(F.max("tile_no").alias("tile_no"))
    placed = kept("placed", ordered_index(whole.select(*keys), *keys, name="pos"))
    joined = images.join(truths, keys).join(placed, keys)
    points = joined.select(
        point_id(source, F.col("pos")).alias("point_id"), F.col("pos").cast("bigint").alias("pos"), "h", "w",
        "image", unpack_mask("truth", F.col("h") * F.col("w")).alias("truth"),
    )
    # In ranges of positions, so that readers of a range skip the other row groups.
    points = kept("points", points.repartitionByRange("pos").sortWithinPartitions("pos"))
    return Points(points, rejected.unionByName(differing))
