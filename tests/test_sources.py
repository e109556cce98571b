import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.operators import evaluate as ev
from maskloom.operators import registry as reg
from maskloom.plans import convert
from maskloom.sources import images as img
from maskloom.sources import tables
from pictures import write_png


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    pictures = {
        "a.png": rng.integers(0, 256, (8, 8)),
        "b.png": rng.integers(0, 256, (4, 16, 3)),
        "c.png": rng.integers(0, 256, (2, 1, 4)),
    }
    for name, pixels in pictures.items():
        write_png(tmp_path / name, pixels)
        flat = np.zeros(pixels.shape[:2], int)
        flat[0] = 255
        write_png(tmp_path / name.replace(".png", "_mask.png"), flat)
    (tmp_path / "README").write_text("no extension")
    return tmp_path, pictures


def test_listing_by_kind(spark, folder):
    path, _ = folder
    files = img.list_files(spark, str(path))
    assert files.count() == 6
    picked = img.select_kind(files, "image").orderBy("idx").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in picked] == ["a.png", "b.png", "c.png"]
    assert img.select_kind(files, "mask").count() == 3
    with pytest.raises(ValueError):
        img.is_kind(F.lit("x"), "video")


def test_a_folder_called_masks_makes_everything_a_mask(spark, tmp_path):
    inner = tmp_path / "masks"
    inner.mkdir()
    write_png(inner / "x.png", np.zeros((2, 2)))
    files = img.list_files(spark, str(inner))
    assert img.select_kind(files, "image").count() == 0 and img.select_kind(files, "mask").count() == 1


def test_decoding(spark, folder):
    path, pictures = folder
    rows = {r["path"].rsplit("/", 1)[1]: r for r in img.read_images(spark, str(path), kind="image").collect()}
    assert set(rows) == set(pictures)
    for name, pixels in pictures.items():
        row = rows[name]
        assert (row["h"], row["w"]) == pixels.shape[:2]
        assert row["channels"] == (1 if pixels.ndim == 2 else pixels.shape[2])
        assert row["image"] == pixels.ravel().tolist()


def test_several_folders_are_ranked_together(spark, tmp_path):
    for name in ("train", "test"):
        (tmp_path / name).mkdir()
        for i in range(2):
            write_png(tmp_path / name / f"{i}.png", np.zeros((2, 2)))
    files = img.list_files(spark, str(tmp_path / "train"), str(tmp_path / "test"), pattern="*.png")
    ranked = img.select_kind(files, "image").orderBy("idx").collect()
    assert [r["path"][-10:] for r in ranked] == ["test/0.png", "test/1.png", "rain/0.png", "rain/1.png"]


def test_conversion_and_pairing_end_to_end(spark, folder):
    path, pictures = folder
    images = convert.convert_images(img.read_encoded(spark, str(path), kind="image"), 8, 8, normalize=True)
    masks = convert.convert_masks(img.read_encoded(spark, str(path), kind="mask"), 8, 8)
    # b.png is wider than a tile.
    assert images.count() == masks.count() == 4
    left = reg.ordered_collection(images.select("path", "tile_no", F.lit("i").alias("point_id")), "path", "tile_no")
    right = reg.ordered_collection(masks.select(F.col("path").alias("mask_path"), F.col("tile_no").alias("mask_tile")), "mask_path", "mask_tile")
    pairs = img.pair_by_position(left, right, "ord").orderBy("ord").collect()
    for r in pairs:
        assert r["mask_path"] == r["path"].replace(".png", "_mask.png") and r["tile_no"] == r["mask_tile"]
    sizes = images.select(F.size("image").alias("s"), F.array_max("image").alias("top")).collect()
    assert {r["s"] for r in sizes} == {64} and all(0 <= r["top"] <= 1 for r in sizes)
    a = images.filter(F.col("path").endswith("/a.png")).first()["image"]
    assert a == pytest.approx((pictures["a.png"] / 255).ravel().tolist(), abs=1e-6)


def test_bytes_and_numbers_convert_alike(spark, folder):
    path, _ = folder
    options = dict(tile=6, target=5, normalize=True)
    one = convert.convert_images(img.read_encoded(spark, str(path), kind="image"), **options)
    two = convert.convert_images(img.read_images(spark, str(path), kind="image"), **options)
    assert one.orderBy("path", "tile_no").collect() == two.orderBy("path", "tile_no").collect()
    # Growing needs no smoothing, so the JVM-only way gives the same.
    options["target"] = 16
    batches = convert.convert_images(img.read_images(spark, str(path), kind="image"), **options)
    arrays = convert.convert_images(img.read_images(spark, str(path), kind="image"), method="sql", **options)
    pairs = zip(batches.orderBy("path", "tile_no").collect(), arrays.orderBy("path", "tile_no").collect(), strict=True)
    for left, right in pairs:
        assert left[:4] == right[:4] and left["image"] == pytest.approx(right["image"], abs=1e-6)


def test_unequal_counts_are_an_error(spark):
    with pytest.raises(ValueError):
        img.pair_by_position(spark.range(3).withColumnRenamed("id", "idx"), spark.range(2).withColumnRenamed("id", "idx"))


def test_pairing_by_stem(spark, folder):
    path, _ = folder
    files = img.list_files(spark, str(path))
    paired = img.pair_by_stem(img.select_kind(files, "image"), img.select_kind(files, "mask"), "_mask")
    assert paired.count() == 3


def _points(spark, n=40):
    return spark.range(n).select(
        F.md5(F.col("id").cast("string")).alias("point_id"), F.col("id").alias("pos"),
        F.array(F.col("id").cast("float")).alias("image"),
    )


def test_first_points_are_filtered_in_the_scan(spark, tmp_path):
    tables.write_points(_points(spark), f"{tmp_path}/p")
    first = tables.read_points(spark, f"{tmp_path}/p", 7)
    assert first.count() == 7
    assert "PushedFilters: [IsNotNull(pos), LessThan(pos,7)]" in first._jdf.queryExecution().executedPlan().toString()


def test_bucketed_points_are_not_shuffled_in_a_join(spark, tmp_path):
    tables.write_points(_points(spark), f"{tmp_path}/b", table="bucketed_points", buckets=4)
    members = _points(spark).select("point_id").repartition(3)
    spark.sql("DROP TABLE bucketed_points")
    points = tables.open_bucketed(spark, f"{tmp_path}/b", "bucketed_again", "point_id string, pos bigint, image array<float>", 4)
    joined = points.hint("merge").join(members, "point_id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    scan_side = plan[: plan.index("bucketed_again")]
    assert "Exchange" not in scan_side and joined.count() == 40
    spark.sql("DROP TABLE bucketed_again")


def test_states_are_never_overwritten(spark, tmp_path):
    store = tables.SnapshotStore(spark, f"{tmp_path}/s")
    members = spark.createDataFrame([("A", "p", 0, None)], "collection string, point_id string, ord long, value int")
    store.save(members, "r", 0, 0)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store.save(members, "r", 0, 0)


def test_reading_one_collection_reads_one_folder(spark, tmp_path):
    store = tables.SnapshotStore(spark, f"{tmp_path}/s")
    members = spark.createDataFrame(
        [("A", "p", 0, None), ("B", "q", 0, None)], "collection string, point_id string, ord long, value int"
    )
    state = store.save(members, "r", 0, 0).filter("collection = 'B'")
    assert "PartitionFilters: [isnotnull(collection" in state._jdf.queryExecution().executedPlan().toString()
    assert state.count() == 1


def test_trace(spark, tmp_path):
    store = tables.SnapshotStore(spark, f"{tmp_path}/s")
    schema = "collection string, point_id string, ord long, value int"
    store.save(spark.createDataFrame([("A", "p", 0, None), ("B", "q", 0, None)], schema), "r", 1, 1)
    store.save(spark.createDataFrame([("B", "p", 1, None), ("B", "q", 0, None)], schema), "r", 1, 8)
    moved = tables.transitions(store.all()).collect()
    assert [(r["point_id"], r["previous"], r["collections"], r["step"]) for r in moved] == [("p", "A", "B", 8)]
    only = spark.createDataFrame([("q",)], "point_id string")
    assert tables.trace(store.all(), only).count() == 2


def test_versions(spark, tmp_path):
    taken = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("b", 2)], "name string, version int")
    assert {r["name"]: r["version"] for r in tables.first_free_version(taken).collect()} == {"a": 2, "b": 0}
    df = spark.range(3)
    assert [tables.write_version(df, f"{tmp_path}/v") for _ in range(3)] == [0, 1, 2]


def test_cluster_session_without_a_shared_folder_is_an_error():
    from maskloom.session import shared_dir

    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_broken_files_are_an_error_that_names_them(spark, tmp_path):
    write_png(tmp_path / "a.png", np.zeros((2, 2)))
    (tmp_path / "b.png").write_bytes(b"not a picture")
    with pytest.raises(Exception, match="cannot decode .*b.png"):
        img.read_images(spark, str(tmp_path)).collect()
    # The other kind is read all the same.
    write_png(tmp_path / "a_mask.png", np.ones((2, 2)))
    assert img.read_images(spark, str(tmp_path), kind="mask").count() == 1


def test_deep_pictures_are_refused(spark, tmp_path):
    write_png(tmp_path / "deep.png", np.array([[0, 300]]), bits=16)
    with pytest.raises(ValueError, match="deep.png has 16 bits"):
        img.read_images(spark, str(tmp_path))


def test_folders_by_path(spark):
    paths = spark.createDataFrame([("a/x",), ("a/b/y",), ("ab/z",), ("c/a/w",), (None,)], ["path"])
    got = paths.filter(img.in_folders(F.col("path"), "a/", "c")).collect()
    assert sorted(r.path for r in got) == ["a/b/y", "a/x", "c/a/w"]
    with pytest.raises(ValueError, match="no folder"):
        img.in_folders(F.col("path"))


def test_stacked_in_order_and_of_one_shape(spark):
    points = spark.createDataFrame(
        [("a", 1, 2, [1, 2]), ("b", 1, 2, [3, 4]), ("c", 2, 1, [5, 6])], "point_id string, h int, w int, image array<int>"
    )

    def held(*ids):
        rows = [(p, 10 * (k + 1)) for k, p in enumerate(ids)]
        return spark.createDataFrame(rows, "point_id string, ord long")

    got = ev.stacked(held("b", "a"), points).collect()
    assert [(r.idx, r.h, r.w, r.image) for r in got] == [(0, 1, 2, [3, 4]), (1, 1, 2, [1, 2])]
    for ids, message in ((("a", "c"), "different shapes"), (("a", "z"), "1 points without"), ((), "no images")):
        with pytest.raises(ValueError, match=message):
            ev.stacked(held(*ids), points)
