"""Folders to points, journals, change logs and packed masks."""

import threading

import numpy as np
import pytest
from pictures import write_png
from pyspark.sql import functions as F

from maskloom.functions.masks import pack_mask, reduce_predictions, unpack_mask
from maskloom.operators import evaluate as ev
from maskloom.plans import learners
from maskloom.plans.points import build_points, pair_files
from maskloom.sources.changes import ChangeStore, changed_rows
from maskloom.sources.journal import RESUMED, Entry, Journal, NumberedFiles


def picture(h, w, seed):
    return np.random.default_rng(seed).integers(0, 256, (h, w), dtype=np.uint8)


@pytest.fixture
def folders(tmp_path):
    images, masks = tmp_path / "scans", tmp_path / "labels"
    images.mkdir()
    masks.mkdir()
    pixels = {}
    for k, name in enumerate(("b", "a", "c")):
        pixels[name] = picture(4, 8, k), picture(4, 8, 10 + k) // 128
    pixels["d"] = picture(4, 4, 3), picture(4, 4, 13) // 128
    for name, (image, mask) in pixels.items():
        write_png(images / f"{name}.png", image)
        write_png(masks / f"{name}_mask.png", mask)
    return images, masks, pixels


def rows_of(points):
    return {r["pos"]: (np.array(r["image"]), np.array(r["truth"])) for r in points.collect()}


def test_points_from_folders(spark, folders):
    images, masks, pixels = folders
    built = build_points(spark, str(images), str(masks), suffix="_mask", tile=4, target=4, strict=True)
    got = rows_of(built.points)
    tiles = [(name, side) for name in "abcd" for side in range(pixels[name][0].shape[1] // 4)]
    assert sorted(got) == list(range(len(tiles))) == list(range(7))
    for pos, (name, side) in enumerate(tiles):
        image, mask = (p[:, 4 * side: 4 * side + 4].ravel() for p in pixels[name])
        assert got[pos][0].tolist() == image.tolist() and got[pos][1].tolist() == (mask != 0).astype(float).tolist()
    assert built.points.select("point_id").distinct().count() == 7 and built.rejected.count() == 0


def test_last_tiles_of_one_folder(spark, folders, tmp_path):
    _, _, pixels = folders
    whole = tmp_path / "whole"
    whole.mkdir()
    for name, (image, mask) in pixels.items():
        write_png(whole / f"{name}.png", image)
        write_png(whole / f"{name}_mask.png", mask)
    got = rows_of(build_points(spark, str(whole), suffix="_mask", tile=4, target=4, tiles="last", normalize=True).points)
    assert sorted(got) == [0, 1, 2, 3]
    for pos, name in enumerate("abcd"):
        assert np.allclose(got[pos][0], pixels[name][0][:, -4:].ravel() / 255, atol=1e-6)


def test_files_without_partner_are_listed(spark, folders):
    images, masks, _ = folders
    write_png(images / "lonely.png", picture(4, 8, 20))
    write_png(masks / "orphan_mask.png", picture(4, 8, 21))
    write_png(images / "wide.png", picture(4, 8, 22))
    write_png(masks / "wide_mask.png", picture(4, 4, 23))
    (images / "more").mkdir()
    write_png(images / "a.PNG", picture(4, 8, 24))
    built = build_points(spark, str(images), str(masks), suffix="_mask", tile=4, target=4)
    left = {(r["path"].rsplit("/", 1)[1], r["reason"]) for r in built.rejected.collect()}
    assert left == {
        ("lonely.png", "no mask"), ("orphan_mask.png", "no image"),
        ("wide.png", "image and mask differ in shape"), ("wide_mask.png", "image and mask differ in shape"),
        ("a.png", "several images of this name"), ("a.PNG", "several images of this name"),
        ("a_mask.png", "several images of this name"),
    }
    assert sorted(rows_of(built.points)) == list(range(5))
    with pytest.raises(ValueError, match="no mask|no image|several"):
        build_points(spark, str(images), str(masks), suffix="_mask", tile=4, target=4, strict=True)


@pytest.mark.parametrize("side", [0, 1])
def test_broken_and_deep_files_are_named(spark, folders, side):
    folder, name = folders[side], ("a.png", "a_mask.png")[side]
    write_png(folder / name, picture(4, 8, 1), bits=16)
    with pytest.raises(Exception, match=name):
        build_points(spark, str(folders[0]), str(folders[1]), suffix="_mask", tile=4, target=4)
    (folder / name).write_bytes(b"no picture")
    with pytest.raises(Exception, match=name):
        build_points(spark, str(folders[0]), str(folders[1]), suffix="_mask", tile=4, target=4)


def test_pairing_of_no_files(spark):
    none = spark.createDataFrame([], "path string")
    pairing = pair_files(none, none)
    assert pairing.pairs.count() == pairing.rejected.count() == 0


# --- packed masks ------------------------------------------------------------------------------


def test_masks_survive_packing(spark):
    draw = np.random.default_rng(4)
    rows = [(k, (draw.random(n) < 0.4).astype(float).tolist()) for k, n in enumerate((0, 1, 7, 8, 9, 64, 1000))]
    df = spark.createDataFrame([*rows, (99, None)], "k int, mask array<double>")
    back = df.select("k", "mask", F.size("mask").alias("n"), pack_mask("mask").alias("bits"))
    for r in back.select("k", "mask", "bits", unpack_mask("bits", F.col("n")).alias("again")).collect():
        assert r["again"] == r["mask"] and (r["mask"] is None or len(r["bits"]) == -(-len(r["mask"]) // 8))


def test_reduced_predictions_equal_pixel_sums(spark):
    rows = [(f"p{k}", k, 3, 5, picture(3, 5, k).ravel().tolist(), (picture(3, 5, 9 + k).ravel() // 128).astype(float).tolist()) for k in range(5)]
    df = spark.createDataFrame(rows, "point_id string, pos bigint, h int, w int, image array<int>, truth array<double>")
    predicted = learners.ThresholdModel(100.0, 0.05).transform(df)
    got = {r["point_id"]: r for r in reduce_predictions(predicted).collect()}
    for r in ev.pixel_sums(predicted, "point_id", pred="prob").collect():
        assert [got[r["point_id"]][c] for c in ("n", "tp", "st", "sp", "bce")] == pytest.approx([r[c] for c in ("n", "tp", "st", "sp", "bce")])


# --- journal and change log --------------------------------------------------------------------


def test_two_writers_never_share_a_number(spark, tmp_path):
    got = []
    def work():
        files = NumberedFiles(spark, str(tmp_path / "n"))
        got.extend(files.claim() for _ in range(10))
    threads = [threading.Thread(target=work) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == list(range(40))


def test_lowest_free_number(spark, tmp_path):
    files = NumberedFiles(spark, str(tmp_path / "n"))
    assert files.taken() == []
    for number in (0, 1, 3):
        assert files.create(number, "{}") and not files.create(number, "{}")
    assert files.claim(lowest=True) == 2 and files.claim() == 4 and files.taken() == [0, 1, 2, 3, 4]


def test_a_resumption_supersedes_what_followed(spark, tmp_path):
    journal = Journal(spark, str(tmp_path / "j"))
    assert journal.entries("r") == [] and journal.table().count() == 0
    first = [Entry("r", 1, s, "note", {"s": s}) for s in (1, 2, 3)]
    for e in first:
        journal.append([e, Entry("other", 9, 9, "note", None)])
    assert journal.entries("r") == first and journal.until("r", 1, 2) == first[:2]
    again = Entry("r", 1, 3, "note", ["again"])
    journal.append([Entry("r", 1, 2, RESUMED, None)])
    journal.append([again])
    assert journal.entries("r") == [*first[:2], again]


MEMBERS = "point_id string, ord bigint, value int, collection string"


def held(df):
    return sorted(tuple(r) for r in df.select("point_id", "ord", "value", "collection").collect())


def test_change_log_against_whole_states(spark, tmp_path):
    """Random moves: every state read from changes equals the state kept whole."""
    store = ChangeStore(spark, str(tmp_path / "s"))
    draw = np.random.default_rng(6)
    names = ["A", "B", "Z"]
    state = {f"p{k}": (names[draw.integers(3)], k, None) for k in range(60)}
    def frame(s):
        return spark.createDataFrame([(p, o, v, c) for p, (c, o, v) in s.items()], MEMBERS)
    parts = store.save("r", 0, 0, frame(state), names)
    known = {(0, 0): held(frame(state))}
    for step in range(1, 12):
        after = dict(state)
        ids = [f"p{k}" for k in draw.choice(60, 5, replace=False)]
        for p in ids:
            if p in after and draw.random() < 0.2:
                del after[p]
            else:
                after[p] = (names[draw.integers(3)], 1000 * step + int(draw.integers(100)), int(draw.integers(2)))
        touched = spark.createDataFrame([(p,) for p in ids], "point_id string")
        changes = changed_rows(frame(state), frame(after), touched)
        assert changes.count() <= 10
        parts = store.save("r", 0, step, changes=changes, before=parts)
        whole, many = store.compact(parts)
        if many:
            parts = store.save("r", 0, step, whole, many, before=parts)
        assert all(len(own) <= 9 for own in parts.values())
        state = after
        known[0, step] = held(frame(state))
    assert {key: held(store.load("r", *key)) for key in known} == known
    everything = {}
    for r in store.all().collect():
        everything.setdefault((r["cycle"], r["step"]), []).append((r["point_id"], r["ord"], r["value"], r["collection"]))
    assert {key: sorted(rows) for key, rows in everything.items()} == known
    with pytest.raises(ValueError):
        store.load("r", 5, 5)
