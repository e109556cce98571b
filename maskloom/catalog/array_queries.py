"""Image and array operators (embeddings as 8 x 8, 4 x 16 and RGBA pictures)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from maskloom.catalog.common import SQL_PX, bytes_images, images, long_rows, query, r6, sql_double, sql_key
from maskloom.functions import arrays as a
from maskloom.functions.resize import resize_images
from maskloom.operators import evaluate as ev
from maskloom.operators import registry as reg
from maskloom.operators import sampling
from maskloom.operators.index import ordered_index
from maskloom.plans import convert


def _select(expression: str, where: str = "TRUE") -> str:
    """SQL of a per-pixel result."""
    return f"WITH {SQL_PX} SELECT pos, i, round({expression}, 6) AS v FROM px WHERE {where}"


def _moved(place: str, value: str = "x") -> str:
    """SQL of a picture whose pixels go to other places."""
    return f"WITH {SQL_PX} SELECT pos, CAST({place} AS BIGINT) AS i, round({value}::DOUBLE, 6) AS v FROM px"


# --- projections ----------------------------------------------------------------------------


@query(f"""WITH {SQL_PX} SELECT pos, i, round(x, 6) AS image, round(t, 6) AS mask, round(p, 6) AS pred,
       label::BIGINT AS label FROM px""")
def channel_stack(spark, folder):
    """Image joined with its mask and prediction by id, as channels of one point."""
    points = images(spark, folder)
    masks = points.select("point_id", "truth", "prob", "label")
    stacked = points.select("point_id", "pos", "image").join(masks, "point_id")
    pixels = stacked.select("pos", "image", "truth", "label", F.posexplode_outer("prob").alias("i", "p"))
    return pixels.select(
        "pos", F.col("i").cast("bigint").alias("i"), r6(F.col("image")[F.col("i")]).alias("image"),
        r6(F.col("truth")[F.col("i")]).alias("mask"), r6("p").alias("pred"),
        F.col("label").cast("bigint").alias("label"),
    )


@query(_select("floor((x + 1) * 100)::DOUBLE"))
def uint8_cast(spark, folder):
    """Fractional intensities truncated to whole numbers."""
    scaled = images(spark, folder).select(
        "pos", F.transform("image", lambda x: (x.cast("double") + 1) * 100).alias("image")
    )
    return long_rows(scaled.select("pos", a.to_uint8("image").alias("image")), "pos")


@query(_select("(x * 3.0::DOUBLE)::FLOAT::DOUBLE"))
def float_cast(spark, folder):
    """Doubles to single precision."""
    scaled = images(spark, folder).select(
        "pos", F.transform("image", lambda x: x.cast("double") * 3.0).alias("image")
    )
    return long_rows(scaled.select("pos", a.to_float("image").alias("image")), "pos")


@query(_select("CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"))
def threshold(spark, folder):
    """Soft prediction to a 0/1 mask at 0.5."""
    masks = images(spark, folder).select("pos", a.threshold("prob").alias("image"))
    return long_rows(masks, "pos")


@query(f"WITH {SQL_PX}, m AS (SELECT pos, max(x) AS top FROM px GROUP BY pos) "
       "SELECT pos, min(i) AS best FROM px JOIN m USING (pos) WHERE x = top GROUP BY pos")
def argmax(spark, folder):
    """Place of the largest of 64 scores."""
    return images(spark, folder).select("pos", a.argmax("image").cast("bigint").alias("best"))


@query("SELECT vec_id AS pos, k AS i, CASE WHEN k = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v "
       "FROM embeddings, range(10) AS r(k)")
def one_hot(spark, folder):
    """Class labels as vectors of ten."""
    coded = images(spark, folder).select("pos", a.one_hot("label", 10).alias("image"))
    return long_rows(coded, "pos")


@query("SELECT vec_id AS pos, label::BIGINT AS label FROM embeddings WHERE label = 1")
def verdict_rows(spark, folder):
    """Rows whose verdict is 1."""
    judged = images(spark, folder).select("pos", F.col("label").cast("bigint").alias("label"))
    return judged.filter(F.col("label") == 1)


# --- scalars on pictures --------------------------------------------------------------------


@query(_select("u / 255.0::DOUBLE"))
def normalize(spark, folder):
    return long_rows(bytes_images(spark, folder).select("pos", a.normalize("image").alias("image")), "pos")


@query(_select("CASE WHEN greatest(u - 128, 0) <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"))
def mask_cast(spark, folder):
    """Non-zero pixels are inside."""
    shifted = bytes_images(spark, folder).select(
        "pos", F.transform("image", lambda x: F.greatest(x - 128, F.lit(0))).alias("image")
    )
    return long_rows(shifted.select("pos", a.mask_of("image").alias("image")), "pos")


# 16 pixels of four channels each.
SQL_RGBA = f"""{SQL_PX}, rgba AS (
  SELECT pos, i // 4 AS q,
         max(CASE WHEN i % 4 = 0 THEN u END) / 255.0::DOUBLE AS cr,
         max(CASE WHEN i % 4 = 1 THEN u END) / 255.0::DOUBLE AS cg,
         max(CASE WHEN i % 4 = 2 THEN u END) / 255.0::DOUBLE AS cb,
         max(CASE WHEN i % 4 = 3 THEN u END) / 255.0::DOUBLE AS ca
  FROM px GROUP BY pos, i // 4
), rgb AS (
  SELECT pos, q, (1 - ca) + ca * cr AS br, (1 - ca) + ca * cg AS bg, (1 - ca) + ca * cb AS bb FROM rgba
)"""
_GRAY = "br * 0.2125::DOUBLE + bg * 0.7154::DOUBLE + bb * 0.0721::DOUBLE"


@query(f"""WITH {SQL_RGBA} SELECT pos, q * 3 + k AS i,
       round(CASE k WHEN 0 THEN br WHEN 1 THEN bg ELSE bb END, 6) AS v FROM rgb, range(3) AS c(k)""")
def rgba_to_rgb(spark, folder):
    """Alpha blended over white."""
    rgb = bytes_images(spark, folder).select("pos", a.rgba_to_rgb("image").alias("image"))
    return long_rows(rgb, "pos")


@query(f"WITH {SQL_RGBA} SELECT pos, q AS i, round({_GRAY}, 6) AS v FROM rgb")
def rgba_to_gray(spark, folder):
    gray = bytes_images(spark, folder).select("pos", a.to_gray("image", 4).alias("image"))
    return long_rows(gray, "pos")


@query(f"""WITH {SQL_PX} SELECT a.pos, a.i, round(a.u / 255.0::DOUBLE * 0.2125::DOUBLE
         + (255 - a.u) / 255.0::DOUBLE * 0.7154::DOUBLE + b.u / 255.0::DOUBLE * 0.0721::DOUBLE, 6) AS v
  FROM px a JOIN px b ON a.pos = b.pos AND b.i = 63 - a.i""")
def rgb_to_gray(spark, folder):
    """Colour pictures: red as is, green inverted, blue read backwards."""
    pictures = bytes_images(spark, folder)
    red, blue = F.col("image"), F.reverse("image")
    mixed = F.flatten(F.zip_with(red, blue, lambda r, b: F.array(r, F.lit(255) - r, b)))
    return long_rows(pictures.select("pos", mixed.alias("image")).select("pos", a.to_gray("image", 3).alias("image")), "pos")


@query(f"WITH {SQL_PX} SELECT pos, i // 4 AS i, round(u::DOUBLE, 6) AS v FROM px WHERE i % 4 = 0")
def channel0(spark, folder):
    """First channel instead of gray."""
    first = bytes_images(spark, folder).select("pos", a.channel("image", 4).alias("image"))
    return long_rows(first, "pos")


# --- tiles ----------------------------------------------------------------------------------


def _wide(spark, folder):
    """The same 64 numbers as a picture of 4 rows and 16 columns."""
    return bytes_images(spark, folder).withColumns({"h": F.lit(4), "w": F.lit(16)})


SQL_TILES = f"""{SQL_PX}, tiles AS (
  SELECT pos, (i % 16) // 8 AS tile_no, (i // 16) * 8 + (i % 16) % 8 AS i, i // 16 AS row,
         (i % 16) % 8 AS col, u::DOUBLE AS u FROM px
)"""


@query(f"""WITH {SQL_TILES} SELECT pos, tile_no::INTEGER AS tile_no, 4 AS h, 8 AS w, i,
       round(u, 6) AS v FROM tiles""")
def tile_split(spark, folder):
    """Left and right tile of a picture wider than the tile."""
    tiles = convert.cut_tiles(_wide(spark, folder), 8, ("pos",))
    return long_rows(tiles, "pos", "tile_no", "h", "w")


@query(f"""WITH {SQL_PX} SELECT pos, CASE WHEN c < 6 THEN 0 ELSE 1 END AS tile_no,
       CASE WHEN c < 6 THEN r * 6 + c ELSE r * 2 + c - 6 END AS i, round(u::DOUBLE, 6) AS v
  FROM px WHERE r < 6""")
def tile_uneven(spark, folder):
    """Tile of 6 on an 8 x 8 picture: rows past the tile are cut, the right tile is narrow."""
    tiles = convert.cut_tiles(bytes_images(spark, folder), 6, ("pos",))
    return long_rows(tiles, "pos", "tile_no")


@query(f"WITH {SQL_TILES} SELECT pos, i, round(u, 6) AS v FROM tiles WHERE tile_no = 1")
def convert_last_tile(spark, folder):
    """One tile per picture, the right one winning."""
    return long_rows(convert.last_tile(_wide(spark, folder), 8, ("pos",)), "pos")


@query(f"WITH {SQL_TILES} SELECT pos * 2 + tile_no AS pos, i, round(u, 6) AS v FROM tiles")
def convert_pairs(spark, folder):
    """Both tiles at places 2i and 2i + 1."""
    rows = _wide(spark, folder).withColumnRenamed("pos", "idx")
    return long_rows(convert.paired_tiles(rows, 8), "pos")


# --- resizing -------------------------------------------------------------------------------


def _axis(size: int, out: int, smooth: bool) -> list[tuple[int, int, float]]:
    """(out, in, weight) of a resize along one axis."""
    def mirror(k: int) -> int:
        period = 2 * (size - 1)
        k = abs(k) % period
        return period - k if k > size - 1 else k

    sigma = max(0.0, (size / out - 1) / 2) if smooth else 0.0
    reach = int(4 * sigma + 0.5)
    kernel = {d: math.exp(-0.5 * (d / sigma) ** 2) if sigma else 1.0 for d in range(-reach, reach + 1)}
    total = sum(kernel.values())
    weights: dict[tuple[int, int], float] = {}
    for o in range(out):
        at = (o + 0.5) * size / out - 0.5
        low = math.floor(at)
        for near, share in ((mirror(low), 1 - (at - low)), (mirror(low + 1), at - low)):
            for d, k in kernel.items():
                key = (o, mirror(near + d))
                weights[key] = weights.get(key, 0.0) + share * k / total
    return [(o, i, weight) for (o, i), weight in sorted(weights.items())]


def _sql_resize(source: str, h: int, w: int, out_h: int, out_w: int, smooth: bool) -> str:
    """Resize as a weighted sum over all source pixels; ``source`` has (pos, row, col, v)."""
    def values(rows):
        return ", ".join(f"({o}, {i}, {sql_double(weight)})" for o, i, weight in rows)

    return f"""wr(o, k, wt) AS (VALUES {values(_axis(h, out_h, smooth))}),
  wc(o, k, wt) AS (VALUES {values(_axis(w, out_w, smooth))}),
  resized AS (
    SELECT pos, (wr.o * {out_w} + wc.o)::BIGINT AS i, sum(wr.wt * wc.wt * v) AS v
    FROM {source} JOIN wr ON wr.k = row JOIN wc ON wc.k = col GROUP BY pos, wr.o, wc.o)"""


SQL_SQUARE = f"{SQL_PX}, square AS (SELECT pos, r AS row, c AS col, x AS v FROM px)"


@query(f"WITH {SQL_SQUARE}, {_sql_resize('square', 8, 8, 13, 16, False)} "
       "SELECT pos, i, round(v, 6) AS v FROM resized")
def resize_grow(spark, folder):
    """8 x 8 to 13 x 16 with array functions."""
    grown = images(spark, folder).select(
        "pos", a.resize_bilinear("image", "h", "w", 13, 16).alias("image")
    )
    return long_rows(grown, "pos")


@query(f"WITH {SQL_SQUARE}, {_sql_resize('square', 8, 8, 13, 16, False)} "
       "SELECT pos, i, round(v, 6) AS v FROM resized")
def resize_grow_batches(spark, folder):
    """The same in Arrow batches."""
    rows = images(spark, folder).select("pos", "h", "w", "image")
    return long_rows(resize_images(rows, 13, 16), "pos")


@query(f"WITH {SQL_SQUARE}, {_sql_resize('square', 8, 8, 4, 3, True)} "
       "SELECT pos, i, round(v, 6) AS v FROM resized")
def resize_shrink(spark, folder):
    """8 x 8 to 4 x 3, smoothed first."""
    rows = images(spark, folder).select("pos", "h", "w", "image")
    return long_rows(resize_images(rows, 4, 3), "pos")


def _gray_wide(spark, folder):
    return _wide(spark, folder).withColumn("channels", F.lit(1))


SQL_TILE_SIDES = f"""{SQL_TILES}, sides AS (
  SELECT pos * 2 + tile_no AS pos, row, col, u AS v FROM tiles)"""


@query(f"""WITH {SQL_TILE_SIDES}, {_sql_resize('sides', 4, 8, 8, 8, True)}
  SELECT pos // 2 AS pos, (pos % 2)::INTEGER AS tile_no, i, round((v / 255.0::DOUBLE)::FLOAT::DOUBLE, 6) AS v
  FROM resized""")
def convert_image(spark, folder):
    """Cut, resize, normalise: two tiles per wide picture."""
    done = convert.convert_images(
        _gray_wide(spark, folder), 8, 8, normalize=True, keep=("pos",)
    )
    return long_rows(done, "pos", "tile_no")


@query(f"""WITH {SQL_RGBA}, sides AS (SELECT pos, q // 4 AS row, q % 4 AS col, {_GRAY} AS v FROM rgb),
  {_sql_resize('sides', 4, 4, 8, 8, False)}
  SELECT pos, i, round((v / 255.0::DOUBLE)::FLOAT::DOUBLE, 6) AS v FROM resized""")
def convert_color(spark, folder):
    """Colour with alpha to gray tiles, divided by 255 a second time on request."""
    rgba = bytes_images(spark, folder).withColumns(
        {"h": F.lit(4), "w": F.lit(4), "channels": F.lit(4)}
    )
    done = convert.convert_images(
        rgba, 8, 8, normalize=True, double_scale=True, method="sql", keep=("pos",)
    )
    return long_rows(done, "pos")


@query(f"""WITH {SQL_TILE_SIDES}, hard AS (
    SELECT pos, row, col, CASE WHEN v > 150 THEN 255.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM sides),
  {_sql_resize('hard', 4, 8, 8, 8, False)}
  SELECT pos // 2 AS pos, (pos % 2)::INTEGER AS tile_no, i,
         CASE WHEN v <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM resized""")
def convert_mask(spark, folder):
    """Mask pictures: interpolated edges count as inside."""
    masks = _gray_wide(spark, folder).withColumn(
        "image", F.transform("image", lambda x: F.when(x > 150, 255).otherwise(0))
    )
    done = convert.convert_masks(masks, 8, 8, method="sql", keep=("pos",))
    return long_rows(done, "pos", "tile_no")


@query(f"""WITH {SQL_TILE_SIDES}, {_sql_resize('sides', 4, 8, 8, 8, True)}, kept AS (
    SELECT pos, count(*) AS n_pixels, sum(v / 255.0::DOUBLE) AS total FROM resized GROUP BY pos)
  SELECT row_number() OVER (ORDER BY pos) - 1 AS idx, pos // 2 AS pos, (pos % 2)::INTEGER AS tile_no,
         n_pixels, round(total, 4) AS total FROM kept""")
def convert_order(spark, folder):
    """Converted tiles in (file, tile) order."""
    done = convert.convert_images(_gray_wide(spark, folder), 8, 8, normalize=True, keep=("pos",))
    total = F.aggregate("image", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    narrow = done.select(
        "pos", "tile_no", F.size("image").cast("bigint").alias("n_pixels"), F.round(total, 4).alias("total")
    )
    return ordered_index(narrow, "pos", "tile_no")


# --- flips and augmentation -----------------------------------------------------------------


@query(_moved("r * 8 + 7 - c"))
def flip_lr(spark, folder):
    return long_rows(images(spark, folder).select("pos", a.flip_lr("image", "h", "w").alias("image")), "pos")


@query(_moved("(7 - r) * 8 + c"))
def flip_ud(spark, folder):
    return long_rows(images(spark, folder).select("pos", a.flip_ud("image", "h", "w").alias("image")), "pos")


@query(f"WITH {SQL_PX} SELECT pos, (15 - i % 16) * 4 + i // 16 AS i, round(x, 6) AS v FROM px")
def rot90(spark, folder):
    """Quarter turn of a 4 x 16 picture."""
    wide = images(spark, folder).withColumns({"h": F.lit(4), "w": F.lit(16)})
    return long_rows(wide.select("pos", a.rot90("image", "h", "w").alias("image")), "pos")


@query(_select("(255 - u)::DOUBLE"))
def invert(spark, folder):
    return long_rows(bytes_images(spark, folder).select("pos", a.invert("image").alias("image")), "pos")


@query(_select("1 - t"))
def invert_mask(spark, folder):
    return long_rows(images(spark, folder).select("pos", a.invert_mask("truth").alias("image")), "pos")


_PLACES = {
    "original": "i", "invert": "i", "flip_lr": "r * 8 + 7 - c", "flip_ud": "(7 - r) * 8 + c",
    "rot90": "(7 - c) * 8 + r",
}


def _sql_blocks(blocks) -> str:
    """SQL of an augmented set: one SELECT per block, numbered through."""
    parts = []
    for number, (name, start, stop) in enumerate(blocks):
        value = "255 - u" if name == "invert" else "u"
        where = f"pos >= {start}" + (f" AND pos < {stop}" if stop is not None else "")
        parts.append(
            f"SELECT {number} AS block, pos AS src, {_PLACES[name]} AS i, {value} AS v FROM px WHERE {where}"
        )
    return f"""WITH {SQL_PX}, copies AS ({' UNION ALL '.join(parts)})
      SELECT block, dense_rank() OVER (ORDER BY block, src) - 1 AS pos, CAST(i AS BIGINT) AS i,
             round(v::DOUBLE, 6) AS v FROM copies"""


def _augmented(spark, folder, blocks, **options):
    points = bytes_images(spark, folder)
    return long_rows(convert.augment(points, points.count(), blocks, **options), "block", "pos")


@query(_sql_blocks(convert.three_blocks()))
def augment_three(spark, folder):
    return _augmented(spark, folder, convert.three_blocks())


@query(_sql_blocks(convert.inverted_blocks()))
def augment_inverted(spark, folder):
    return _augmented(spark, folder, convert.inverted_blocks())


@query(_sql_blocks(convert.rotated_blocks()))
def augment_rotated(spark, folder):
    return _augmented(spark, folder, convert.rotated_blocks())


@query(f"""WITH {SQL_PX}, copies AS (
    SELECT 0 AS block, pos, (7 - r) * 8 + c AS i, u FROM px
    UNION ALL SELECT 1, n - 1 - pos + n, i, u FROM px, ecnt
    UNION ALL SELECT 2, pos + 2 * n, i, u FROM px, ecnt)
  SELECT block, pos, CAST(i AS BIGINT) AS i, round(u::DOUBLE, 6) AS v FROM copies""")
def augment_batch_axes(spark, folder):
    """Three blocks with flips taken along the axes of the whole stack."""
    return _augmented(spark, folder, convert.three_blocks(), batch_axes=True)


# --- checks ---------------------------------------------------------------------------------


@query(f"""WITH {SQL_PX} SELECT count(DISTINCT pos) AS n_masks,
       count(DISTINCT pos) FILTER (WHERE t NOT IN (0, 1)) AS n_bad,
       bool_and(t IN (0, 1)) AND bool_or(t = 0) AND bool_or(t = 1) AS is_binary FROM px""")
def binary_mask_check(spark, folder):
    return ev.binary_mask_check(images(spark, folder))


@query(f"WITH {SQL_PX} SELECT round(u::DOUBLE, 6) AS value, count(DISTINCT pos) AS n_images FROM px GROUP BY u")
def unique_values(spark, folder):
    """Distinct intensities with the number of pictures showing them."""
    found = ev.unique_values(bytes_images(spark, folder))
    return found.select(r6("value").alias("value"), "n_images")


@query(f"""WITH {SQL_PX} SELECT label::BIGINT AS label, count(DISTINCT pos) AS n_images, 1::BIGINT AS n_shapes,
       8 AS min_h, 8 AS max_h, 8 AS min_w, 8 AS max_w, round(min(x), 6) AS lowest,
       round(max(x), 6) AS highest FROM px GROUP BY label""")
def batch_profile(spark, folder):
    """Count, shapes and value range per class."""
    points = images(spark, folder).withColumn("label", F.col("label").cast("bigint"))
    profile = ev.batch_profile(points, by=("label",))
    return profile.withColumns({"lowest": r6("lowest"), "highest": r6("highest")})


@query("SELECT vec_id AS pos, list_sum(list_transform(embedding, lambda v: (v > 0)::INTEGER))::BIGINT AS inside "
       "FROM embeddings, (SELECT count(*) AS n FROM embeddings) WHERE vec_id < n // 2")
def first_images(spark, folder):
    """First half of the pictures by position, with the size of their masks."""
    points = images(spark, folder)
    inside = F.size(F.filter("truth", lambda x: x > 0)).cast("bigint")
    return sampling.head(points, points.count() // 2, "pos").select("pos", inside.alias("inside"))


@query(f"""WITH {SQL_PX}, o AS (
    SELECT point_id, row_number() OVER (ORDER BY {sql_key('shuffle')}, point_id) - 1 AS idx
    FROM (SELECT DISTINCT point_id FROM px))
  SELECT idx, i, round(x, 6) AS v FROM px JOIN o USING (point_id)""")
def stack_in_order(spark, folder):
    """All pictures of a shuffled collection in its order, of one shape."""
    points = images(spark, folder)
    collection = reg.shuffled(points.select("point_id", F.col("pos").alias("ord")))
    return long_rows(ev.stacked(collection, points), "idx")
