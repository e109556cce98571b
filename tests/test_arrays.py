import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.functions import arrays as a
from maskloom.functions.resize import resize_array, resize_images
from maskloom.plans import convert


def one(spark, image, column, **extra):
    h, w = np.shape(image)[:2]
    df = spark.createDataFrame([(h, w, np.ravel(image).tolist())], "h int, w int, image array<double>")
    return df.select(column.alias("v")).first()["v"]


def test_flips(spark):
    x = [[1.0, 2.0], [3.0, 4.0]]
    assert one(spark, x, a.flip_lr("image", "h", "w")) == [2, 1, 4, 3]
    assert one(spark, x, a.flip_ud("image", "h", "w")) == [3, 4, 1, 2]
    assert one(spark, x, a.rot90("image", "h", "w")) == [2, 4, 1, 3]


def test_flips_of_an_oblong_picture(spark):
    x = np.arange(15.0).reshape(3, 5)
    assert one(spark, x, a.rot90("image", "h", "w")) == np.rot90(x).ravel().tolist()
    assert one(spark, x, a.flip_lr("image", "h", "w")) == np.fliplr(x).ravel().tolist()


def test_threshold_is_inclusive(spark):
    assert one(spark, [[0.49, 0.5, 0.51]], a.threshold("image")) == [0, 1, 1]


def test_argmax_takes_the_first_of_ties(spark):
    assert one(spark, [[0.2, 0.4, 0.4]], a.argmax("image")) == 1


def test_gray(spark):
    assert one(spark, [[255.0, 0.0, 0.0]], a.to_gray("image", 3)) == pytest.approx([0.2125])
    assert one(spark, [[0.0, 0.0, 255.0]], a.to_gray("image", 3, bgr=True)) == pytest.approx([0.2125])
    # Fully transparent is white.
    assert one(spark, [[9.0, 9.0, 9.0, 0.0]], a.to_gray("image", 4)) == pytest.approx([1.0])
    with pytest.raises(ValueError):
        a.to_gray("image", 2)


def test_uint8_truncates(spark):
    assert one(spark, [[0.0, 0.99, 254.9]], a.to_uint8("image")) == [0, 0, 254]
    assert one(spark, [[-1.5, -0.5, 256.0, 300.7, float("nan")]], a.to_uint8("image")) == [255, 0, 0, 44, 0]


def test_inverted_masks(spark):
    assert one(spark, [[0.0, 1.0]], a.invert_mask("image")) == [1, 0]
    assert one(spark, [[0.0, 1.0]], a.invert("image")) == [255, 254]


def test_binary(spark):
    assert one(spark, [[0.0, 1.0]], a.is_binary("image"))
    assert not one(spark, [[0.0, 2.0]], a.is_binary("image"))


@pytest.mark.parametrize("shape, tile, expected", [((4, 16), 8, [(4, 8), (4, 8)]), ((4, 8), 8, [(4, 8)]),
                                                   ((9, 20), 8, [(8, 8), (8, 12)]), ((2, 3), 8, [(2, 3)])])
def test_tiles(spark, shape, tile, expected):
    x = np.arange(float(np.prod(shape))).reshape(shape)
    tiles = one(spark, x, a.tiles("image", "h", "w", tile))
    assert [(t["h"], t["w"]) for t in tiles] == expected
    cut = [x[:tile, :tile], x[:tile, tile:]]
    for t in tiles:
        assert t["image"] == cut[t["tile_no"]].ravel().tolist()


@pytest.mark.parametrize("target", [(16, 16), (13, 13), (8, 8), (5, 1), (11, 3)])
def test_array_resize_equals_batch_resize(spark, target):
    rng = np.random.default_rng(3)
    for shape in ((8, 8), (3, 7), (1, 6)):
        x = rng.random(shape)
        got = one(spark, x, a.resize_bilinear("image", "h", "w", *target))
        assert got == pytest.approx(resize_array(x, *target, smooth=False).ravel().tolist(), abs=1e-12)


def test_growing_reflects_about_the_border_pixel():
    # At -0.25 the mirrored coordinate is 0.25.
    x = np.array([[0.0, 4.0]])
    assert resize_array(x, 1, 4).tolist() == [[1.0, 1.0, 3.0, 3.0]]


def test_shrinking_smooths_and_keeps_the_mean_level():
    x = np.tile([0.0, 1.0], (16, 8))
    small = resize_array(x, 4, 4)
    assert abs(small.mean() - 0.5) < 0.02 and small.std() < 0.1
    assert resize_array(np.full((9, 9), 7.0), 2, 3) == pytest.approx(np.full((2, 3), 7.0))


def test_batches_are_cut_and_other_columns_kept(spark, monkeypatch):
    import maskloom.functions.resize as module

    monkeypatch.setattr(module, "BATCH_PIXELS", 8)
    df = spark.range(20, numPartitions=2).select(
        "id", F.lit(1).alias("h"), F.lit(2).alias("w"),
        F.array(F.col("id").cast("double"), F.col("id").cast("double")).alias("image"),
    )
    out = resize_images(df, 2, 3).orderBy("id").collect()
    assert [r["image"] for r in out] == [[float(i)] * 6 for i in range(20)]
    assert {(r["h"], r["w"]) for r in out} == {(2, 3)}


def test_tile_batches_are_cut(spark, monkeypatch):
    import maskloom.functions.pictures as module

    monkeypatch.setattr(module, "BATCH_PIXELS", 8)
    df = spark.range(9, numPartitions=2).select(
        "id", F.lit(1).alias("h"), F.lit(3).alias("w"), F.lit(1).alias("channels"),
        F.array(*[F.col("id").cast("short")] * 3).alias("image"),
    )
    out = convert.convert_images(df, 2, 2, keep=("id",)).orderBy("id", "tile_no").collect()
    assert [(r["id"], r["tile_no"]) for r in out] == [(i, t) for i in range(9) for t in (0, 1)]
    assert all(r["image"] == [float(r["id"])] * 4 for r in out)


def _picture(spark, x, channels=1):
    h, w = x.shape[:2]
    return spark.createDataFrame(
        [("f", h, w, channels, x.ravel().tolist())], "path string, h int, w int, channels int, image array<double>"
    )


def test_normalize_once_or_twice(spark):
    rgb = np.full((2, 2, 3), 255.0)
    once = convert.convert_images(_picture(spark, rgb, 3), 2, 2, normalize=True).first()["image"]
    twice = convert.convert_images(_picture(spark, rgb, 3), 2, 2, normalize=True, double_scale=True).first()["image"]
    assert once == pytest.approx([1.0] * 4) and twice == pytest.approx([1 / 255] * 4)
    gray = convert.convert_images(_picture(spark, np.full((2, 2), 255.0)), 2, 2, normalize=True).first()["image"]
    assert gray == pytest.approx([1.0] * 4)


@pytest.mark.parametrize("method", ["sql", "arrow"])
def test_masks_grow_at_interpolated_edges(spark, method):
    x = np.zeros((2, 2))
    x[0, 0] = 255
    mask = np.reshape(convert.convert_masks(_picture(spark, x), 2, 4, method).first()["image"], (4, 4))
    assert mask.sum() > 4 and mask[0, 0] == 1 and mask[2, 2] == 1


def test_augmentation_against_numpy(spark):
    n, cut = 7, 3
    x = np.arange(n * 4).reshape(n, 2, 2)
    points = spark.createDataFrame(
        [(i, 2, 2, x[i].ravel().tolist()) for i in range(n)], "pos long, h int, w int, image array<int>"
    )

    def run(blocks, **options):
        got = convert.augment(points, n, blocks, **options).orderBy("pos").collect()
        assert [r["pos"] for r in got] == list(range(len(got)))
        return [r["image"] for r in got]

    def flat(*parts):
        return np.concatenate(parts).reshape(-1, 4).tolist()

    lr, ud, rot = x[:, :, ::-1], x[:, ::-1, :], np.rot90(x, axes=(-2, -1))
    assert run(convert.three_blocks()) == flat(lr, ud, x)
    assert run(convert.inverted_blocks(cut)) == flat(255 - x, lr[:cut], ud[:cut], x[:cut], lr[cut:], x[cut:], ud[cut:])
    assert run(convert.rotated_blocks(cut)) == flat(
        rot[:cut], lr[:cut], ud[:cut], x[:cut], lr[cut:], x[cut:], rot[cut:], ud[cut:]
    )
    # On the whole stack the same calls act on other axes.
    blr, bud = np.fliplr(x), np.flipud(x)
    assert run(convert.three_blocks(), batch_axes=True) == flat(blr, bud, x)
    assert run(convert.inverted_blocks(cut), batch_axes=True) == flat(
        255 - x, blr[:cut], bud[:cut], x[:cut], blr[cut:], x[cut:], bud[cut:]
    )
    # A cut past the end leaves later blocks empty.
    assert len(run(convert.inverted_blocks(100))) == 4 * n
