"""Turning decoded pictures into training points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from maskloom.functions import arrays as a
from maskloom.functions.pictures import TileKernel

TILE = 512


def gray_by_channels(channels: Column | str = "channels", image: str = "image") -> Column:
    """Gray pixels of a picture whose channel count is a column."""
    channels = F.col(channels) if isinstance(channels, str) else channels
    return (
        F.when(channels == 1, a.to_gray(image, 1))
        .when(channels == 3, a.to_gray(image, 3))
        .when(channels == 4, a.to_gray(image, 4))
        .otherwise(F.raise_error(F.concat(F.lit("pictures have 1, 3 or 4 channels, not "), channels.cast("string"))))
    )


def cut_tiles(pictures: DataFrame, tile: int = TILE, keep: Sequence[str] = ("path",)) -> DataFrame:
    """One row per non-empty tile: (keep..., tile_no, h, w, image)."""
    # A plain explode would add a filter that cuts every picture a second time.
    cut = pictures.select(*keep, F.explode_outer(a.tiles("image", "h", "w", tile)).alias("tile"))
    return cut.filter(F.col("tile").isNotNull()).select(*keep, "tile.*")


def _resized(tiles: DataFrame, target: int) -> DataFrame:
    """Bring tiles to target x target with array functions; tiles that fit stay as they are."""
    fits = (F.col("h") == target) & (F.col("w") == target)
    image = F.when(fits, F.col("image").cast("array<double>")).otherwise(
        a.resize_bilinear("image", "h", "w", target, target)
    )
    # The new shape comes in a second step: the lambdas above must see the old one.
    return tiles.withColumn("image", image).withColumns({"h": F.lit(target), "w": F.lit(target)})


def _in_batches(pictures: DataFrame, keep: Sequence[str], kernel: TileKernel) -> DataFrame:
    fields = [pictures.schema[name] for name in keep]
    fields += [StructField(name, IntegerType()) for name in ("tile_no", "h", "w")]
    fields.append(StructField("image", ArrayType(FloatType())))
    narrow = pictures.select(*keep, "h", "w", "channels", "image")
    return narrow.mapInArrow(kernel, StructType(fields))


def convert_images(
    pictures: DataFrame,
    tile: int = TILE,
    target: int = TILE,
    normalize: bool = False,
    double_scale: bool = False,
    method: str = "arrow",
    keep: Sequence[str] = ("path",),
) -> DataFrame:
    """Gray, cut, resize, normalise. Rows (keep..., tile_no, h, w, image), order (path, tile_no).

    Gray of a colour picture is in 0..1 already, so it is not divided again unless
    ``double_scale`` asks for it. ``arrow`` makes one pass over Arrow batches, also straight from
    undecoded bytes, and smooths before shrinking; ``sql`` stays in the JVM, does not smooth, and
    suits small pictures.
    """
    if method == "arrow":
        return _in_batches(
            pictures, keep, TileKernel(list(keep), tile, target, normalize, double_scale)
        )
    gray = pictures.withColumn("image", gray_by_channels()).withColumn(
        "_raw", (F.col("channels") == 1) | F.lit(double_scale)
    )
    tiles = _resized(cut_tiles(gray, tile, (*keep, "_raw")), target)
    if normalize:
        tiles = tiles.withColumn(
            "image", F.when(F.col("_raw"), a.normalize("image")).otherwise(F.col("image"))
        )
    return tiles.drop("_raw").withColumn("image", F.col("image").cast("array<float>"))


def convert_masks(
    pictures: DataFrame,
    tile: int = TILE,
    target: int = TILE,
    method: str = "arrow",
    keep: Sequence[str] = ("path",),
) -> DataFrame:
    """As ``convert_images``, ending in a 0/1 mask of the non-zero pixels."""
    if method == "arrow":
        return _in_batches(pictures, keep, TileKernel(list(keep), tile, target, mask=True))
    gray = pictures.withColumn("image", gray_by_channels())
    tiles = _resized(cut_tiles(gray, tile, keep), target)
    return tiles.withColumn("image", a.mask_of("image").cast("array<float>"))


def last_tile(
    pictures: DataFrame, tile: int = TILE, keep: Sequence[str] = ("path",)
) -> DataFrame:
    """One tile per picture: the right one where there is one, else the left. No shuffle."""
    tile_col = F.element_at(a.tiles("image", "h", "w", tile), -1)
    return pictures.select(*keep, tile_col.alias("tile")).select(*keep, "tile.*")


def paired_tiles(
    pictures: DataFrame, tile: int = TILE, idx: str = "idx", keep: Sequence[str] = ()
) -> DataFrame:
    """Both tiles at places 2i and 2i + 1, without resizing or normalising."""
    tiles = cut_tiles(pictures, tile, (*keep, idx))
    return tiles.withColumn("pos", F.col(idx) * 2 + F.col("tile_no")).drop(idx)


# --- augmentation ---------------------------------------------------------------------------

# The transforms by name, each (image, h, w) -> column.
TRANSFORMS = {
    "original": lambda image, h, w: F.col(image),
    "flip_lr": a.flip_lr,
    "flip_ud": a.flip_ud,
    "rot90": a.rot90,
    "invert": lambda image, h, w: a.invert(image),
    "invert_mask": lambda image, h, w: a.invert_mask(image),
}

Block = tuple[str, int, int | None]


def three_blocks() -> list[Block]:
    """Mirrored, upside down, original."""
    return [("flip_lr", 0, None), ("flip_ud", 0, None), ("original", 0, None)]


def inverted_blocks(cut: int = 100, invert: str = "invert") -> list[Block]:
    """Seven blocks: inverted, then both flips and the originals up to and from ``cut``."""
    return [
        (invert, 0, None),
        ("flip_lr", 0, cut),
        ("flip_ud", 0, cut),
        ("original", 0, cut),
        ("flip_lr", cut, None),
        ("original", cut, None),
        ("flip_ud", cut, None),
    ]


def rotated_blocks(cut: int = 200) -> list[Block]:
    """Eight blocks: turned, both flips and the originals up to and from ``cut``."""
    return [
        ("rot90", 0, cut),
        ("flip_lr", 0, cut),
        ("flip_ud", 0, cut),
        ("original", 0, cut),
        ("flip_lr", cut, None),
        ("original", cut, None),
        ("rot90", cut, None),
        ("flip_ud", cut, None),
    ]


def augment(
    points: DataFrame, n: int, blocks: Sequence[Block], image: str = "image", batch_axes: bool = False
) -> DataFrame:
    """Transformed copies of ``n`` points in block order: (block, pos, h, w, image), dense ``pos``.

    A block is (transform, start, stop) over the source positions. One scan makes all copies: each
    point carries the array of blocks it belongs to, and ``pos`` is block offset plus place inside
    the block. With ``batch_axes`` the flips act on the axes of the whole stack of images instead
    of each picture: mirroring turns a picture upside down, and turning upside down reverses the
    order of the images.
    """
    pos, h, w = F.col("pos"), F.col("h"), F.col("w")
    copies, offset = [], 0
    for number, (name, start, stop) in enumerate(blocks):
        end = n if stop is None else min(stop, n)
        source, transform = pos, name
        if batch_axes and name == "flip_lr":
            transform = "flip_ud"
        elif batch_axes and name == "flip_ud":
            source, transform = F.lit(n - 1) - pos, "original"
        turned = transform == "rot90"
        inside = (source >= start) & (source < end)
        copies.append(
            F.when(
                inside,
                F.struct(
                    F.lit(number).alias("block"),
                    (F.lit(offset) + source - F.lit(start)).cast("bigint").alias("pos"),
                    (w if turned else h).alias("h"),
                    (h if turned else w).alias("w"),
                    TRANSFORMS[transform](image, h, w).alias("image"),
                ),
            )
        )
        offset += max(0, end - start)
    made = points.select(F.explode_outer(F.array_compact(F.array(*copies))).alias("copy"))
    return made.filter(F.col("copy").isNotNull()).select("copy.*")
