"""Column functions on images kept as row-major arrays.

``h``, ``w`` and channel counts may be ints or columns. Row-wise work goes through ``slice``,
``reverse`` and ``flatten``, which copy whole rows; per-pixel lambdas stay one operation deep.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luminance weights of R, G and B (fixed values).
GRAY_WEIGHTS = (0.2125, 0.7154, 0.0721)
PIXEL_MAX = 255.0


def _col(value: int | str | Column) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def _upto(n: Column) -> Column:
    """0 .. n-1, empty for n = 0 (a plain sequence would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def rows_of(image, h, w) -> Column:
    """Image as an array of rows.

    The picture is bound as a lambda's variable: a computed one is then computed once, not again
    for each row.
    """
    h, w = _col(h), _col(w)
    whole = F.transform(
        F.array(_col(image)), lambda image: F.transform(_upto(h), lambda r: F.slice(image, r * w + 1, w))
    )
    return F.get(whole, F.lit(0))


# --- casts, thresholds, classes -------------------------------------------------------------


def to_float(image) -> Column:
    return _col(image).cast("array<float>")


def to_uint8(image) -> Column:
    """Truncate to whole intensities, toward zero; beyond 0..255 they wrap round, and NaN gives 0."""

    def whole(x: Column) -> Column:
        x = x.cast("double")
        return F.when(F.isnan(x), F.lit(0)).otherwise(x.cast("bigint").bitwiseAND(F.lit(255)).cast("int"))

    return F.transform(_col(image), whole)


def threshold(scores, cut: float = 0.5) -> Column:
    """1.0 for scores at or above the cut, else 0.0."""
    return F.transform(
        _col(scores), lambda x: F.when(x >= F.lit(cut), F.lit(1.0)).otherwise(F.lit(0.0))
    )


def argmax(scores) -> Column:
    """Index of the largest score, the first one on ties."""
    scores = _col(scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def one_hot(label, classes: int) -> Column:
    label = _col(label)
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == label, 1).otherwise(0)
    )


def normalize(image) -> Column:
    return F.transform(_col(image), lambda x: x / F.lit(PIXEL_MAX))


def mask_of(image) -> Column:
    """Any non-zero value is inside, interpolated edges included."""
    return F.transform(_col(image), lambda x: F.when(x != 0, 1.0).otherwise(0.0))


# --- channels -------------------------------------------------------------------------------


def channel(image, channels: int, k: int = 0) -> Column:
    """k-th channel of an interleaved image."""
    if channels == 1:
        return _col(image)
    image = _col(image)
    pixels = (F.size(image) / channels).cast("int")
    return F.transform(_upto(pixels), lambda i: F.get(image, i * channels + k))


def rgba_to_rgb(image, scale: float = PIXEL_MAX) -> Column:
    """Blend over white; interleaved RGB in 0..1."""
    image = _col(image)
    pixels = F.size(image) / 4

    def blend(j: Column) -> Column:
        base = F.floor(j / 3) * 4
        alpha = image[base + 3] / F.lit(scale)
        return (F.lit(1.0) - alpha) + alpha * (image[base + j % 3] / F.lit(scale))

    return F.transform(_upto((pixels * 3).cast("int")), blend)


def rgb_to_gray(image, scale: float = 1.0, bgr: bool = False) -> Column:
    """Luminance of an interleaved three-channel image, divided by ``scale``."""
    image = _col(image)
    red, green, blue = (2, 1, 0) if bgr else (0, 1, 2)
    wr, wg, wb = GRAY_WEIGHTS

    def luminance(i: Column) -> Column:
        def at(k: int) -> Column:
            return image[i * 3 + k].cast("double") / F.lit(scale)

        return at(red) * F.lit(wr) + at(green) * F.lit(wg) + at(blue) * F.lit(wb)

    return F.transform(_upto((F.size(image) / 3).cast("int")), luminance)


def to_gray(image, channels: int, bgr: bool = False) -> Column:
    """One intensity per pixel: as is for one channel, else luminance in 0..1 (alpha blended)."""
    if channels == 1:
        return _col(image).cast("array<double>")
    if channels == 3:
        return rgb_to_gray(image, PIXEL_MAX, bgr)
    if channels != 4:
        raise ValueError(f"cannot turn {channels} channels into gray")
    image = _col(image)
    order = (2, 1, 0) if bgr else (0, 1, 2)

    def luminance(i: Column) -> Column:
        alpha = image[i * 4 + 3] / F.lit(PIXEL_MAX)
        parts = [
            ((F.lit(1.0) - alpha) + alpha * (image[i * 4 + k] / F.lit(PIXEL_MAX))) * F.lit(weight)
            for k, weight in zip(order, GRAY_WEIGHTS)
        ]
        return parts[0] + parts[1] + parts[2]

    return F.transform(_upto((F.size(image) / 4).cast("int")), luminance)


# --- tiles ----------------------------------------------------------------------------------


def tiles(image, h, w, tile: int = 512) -> Column:
    """Left and right tile of the top ``tile`` rows, empty ones skipped.

    Left is the first ``tile`` columns, right all the columns after them, however many.
    Array of (tile_no, h, w, image).
    """
    image, h, w = _col(image), _col(h), _col(w)
    top = F.least(h, F.lit(tile))
    left_w = F.least(w, F.lit(tile))
    right_w = F.greatest(w - F.lit(tile), F.lit(0))

    def cut(start: int, width: Column) -> Column:
        return F.flatten(
            F.transform(_upto(top), lambda r: F.slice(image, r * w + (start + 1), width))
        )

    def tile_struct(no: int, start: int, width: Column) -> Column:
        return F.struct(
            F.lit(no).alias("tile_no"),
            top.cast("int").alias("h"),
            width.cast("int").alias("w"),
            cut(start, width).alias("image"),
        )

    both = F.array(tile_struct(0, 0, left_w), tile_struct(1, tile, right_w))
    return F.filter(both, lambda t: F.size(t["image"]) > 0)


# --- flips, turns, inversion ----------------------------------------------------------------


def flip_ud(image, h, w) -> Column:
    """Upside down."""
    return F.flatten(F.reverse(rows_of(image, h, w)))


def flip_lr(image, h, w) -> Column:
    """Mirror image."""
    return F.flatten(F.transform(rows_of(image, h, w), F.reverse))


def rot90(image, h, w) -> Column:
    """Quarter turn counter-clockwise; the result has ``w`` rows of ``h`` pixels."""
    image, h, w = _col(image), _col(h), _col(w)
    return F.flatten(
        F.transform(
            _upto(w),
            lambda r: F.transform(_upto(h), lambda c: image[(c * w + (w - 1 - r)).cast("int")]),
        )
    )


def invert(image) -> Column:
    """255 - x."""
    return F.transform(_col(image), lambda x: F.lit(255).cast("int") - x)


def invert_mask(mask) -> Column:
    """Logical not of a 0/1 mask."""
    return F.transform(_col(mask), lambda x: F.when(x == 0, 1.0).otherwise(0.0))


# --- resizing -------------------------------------------------------------------------------


def _mirror(i: Column, n: Column) -> Column:
    """Reflect an index about the border pixels (never further than one pixel outside here)."""
    inside = F.abs(i)
    return F.when(n == 1, F.lit(0)).otherwise(
        F.when(inside > n - 1, (n - 1) * 2 - inside).otherwise(inside)
    )


def resize_bilinear(image, h, w, out_h: int, out_w: int) -> Column:
    """Bilinear resize with half-pixel centres and borders reflected about the edge pixel.

    Separable: every input row is stretched, then pairs of stretched rows are mixed. No smoothing
    before shrinking; ``functions.resize`` has it.
    """
    image, h, w = _col(image).cast("array<double>"), _col(h).cast("int"), _col(w).cast("int")

    def source(i: Column, size: Column, out: int) -> tuple[Column, Column, Column]:
        at = (i + F.lit(0.5)) * size / F.lit(float(out)) - F.lit(0.5)
        low = F.floor(at).cast("int")
        return _mirror(low, size), _mirror(low + 1, size), at - low

    def stretch(row: Column) -> Column:
        def mix(j: Column) -> Column:
            low, high, share = source(j, w, out_w)
            return row[low] * (F.lit(1.0) - share) + row[high] * share

        return F.transform(F.sequence(F.lit(0), F.lit(out_w - 1)), mix)

    stretched = F.transform(rows_of(image, h, w), stretch)

    def mix_rows(rows: Column) -> Column:
        def mix(i: Column) -> Column:
            low, high, share = source(i, h, out_h)
            return F.zip_with(
                rows[low], rows[high], lambda a, b: a * (F.lit(1.0) - share) + b * share
            )

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(out_h - 1)), mix))

    # A one-element array binds the stretched rows once instead of once per output row.
    return F.transform(F.array(stretched), mix_rows)[0]


# --- checks ---------------------------------------------------------------------------------


def is_binary(mask) -> Column:
    """True when the mask holds nothing but 0 and 1."""
    return F.forall(_col(mask), lambda x: (x == 0) | (x == 1))
