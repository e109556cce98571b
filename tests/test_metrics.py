import math

import pytest
from pyspark.sql import functions as F

from maskloom.functions import metrics as m
from maskloom.operators import evaluate as ev
from maskloom.operators import history as hist


def sums(spark, t, p, **options):
    df = spark.createDataFrame([("x", t, p)], "id string, truth array<double>, pred array<double>")
    return ev.pixel_sums(df, "id", **options)


def value(spark, t, p, column):
    return sums(spark, t, p).select(column).first()[0]


def test_small_case(spark):
    t, p = [1.0, 1.0, 0.0, 0.0], [1.0, 0.0, 1.0, 0.0]
    assert value(spark, t, p, m.dice()) == pytest.approx(0.5)
    assert value(spark, t, p, m.dice_loss()) == pytest.approx(0.4)
    assert value(spark, t, p, m.iou_loss()) == pytest.approx(2 / 3)
    assert value(spark, t, p, m.focal_tversky()) == pytest.approx(0.5**0.75, abs=1e-6)
    assert value(spark, t, p, m.hybrid_loss()) == pytest.approx(0.5**0.75 + 2 / 3, abs=1e-6)
    assert value(spark, t, p, m.pixel_accuracy()) == 0.5
    assert value(spark, t, p, m.mean_iou()) == pytest.approx(1 / 3)


def test_empty_masks(spark):
    t = p = [0.0, 0.0]
    assert value(spark, t, p, m.dice()) == 1
    assert value(spark, t, p, m.dice_loss()) == 0
    assert value(spark, t, p, m.iou()) == 1
    assert value(spark, t, p, m.focal_tversky()) == 0


def test_cross_entropy_clips(spark):
    assert value(spark, [1.0], [0.0], m.bce()) == pytest.approx(-math.log(1e-7))
    assert value(spark, [1.0, 0.0], [0.5, 0.5], m.bce()) == pytest.approx(math.log(2))
    assert value(spark, [1.0, 0.0], [0.5, 0.5], m.bce_dice_loss()) == pytest.approx(math.log(2) + 0.5)


def test_extra_losses(spark):
    got = sums(spark, [1.0, 0.0], [0.5, 3.0], extra={"huber": m.huber, "hinge": m.hinge, "poisson": m.poisson}).first()
    assert got["huber"] == pytest.approx(0.125 + 2.5)
    assert got["hinge"] == pytest.approx(0.5 + 4.0)
    assert got["poisson"] == pytest.approx(0.5 - math.log(0.5 + 1e-7) + 3.0)


def test_pixels_are_combined_before_the_shuffle(spark):
    plan = sums(spark, [1.0], [1.0])._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange")
    assert "partial_sum" in plan[exchange:]


def test_predictions_are_computed_once(spark):
    df = spark.createDataFrame([("x", [1.0], [1.0])], "id string, truth array<double>, raw array<double>")
    made = df.withColumn("pred", F.transform("raw", lambda x: F.exp(x)))
    plan = ev.pixel_sums(made, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("transform(") == 1


def test_pictures_without_pixels_have_no_sums(spark):
    assert sums(spark, [], []).count() == 0


def test_batches_of_32_count_equally_in_the_metric_only(spark):
    data = spark.range(40).select(
        F.col("id").alias("idx"), F.lit(1).alias("n"),
        F.when(F.col("id") < 32, 1.0).otherwise(0.0).alias("tp"),
        F.lit(1.0).alias("st"), F.lit(1.0).alias("sp"), F.lit(0.0).alias("bce"),
    )
    row = ev.evaluate_segmenter(data).first()
    assert row["metric"] == pytest.approx(0.5) and row["loss"] == pytest.approx(8 / 40)


def test_classes(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1]), (1, [0.8, 0.2])], "label int, scores array<double>")
    row = ev.evaluate_classes(df).first()
    assert row["metric"] == 0.5
    assert row["loss"] == pytest.approx(-(math.log(0.9) + math.log(0.2)) / 2)


def test_uniform_shapes(spark):
    df = spark.createDataFrame([(2, 2), (2, 3)], "h int, w int")
    with pytest.raises(ValueError):
        ev.require_uniform(df)
    with pytest.raises(ValueError):
        ev.require_uniform(df.limit(0))
    assert ev.require_uniform(df.limit(1)).count() == 1


def test_binary_check(spark):
    masks = spark.createDataFrame([([0.0, 1.0],), ([1.0, 1.0],)], "truth array<double>")
    assert ev.binary_mask_check(masks).first()["is_binary"]
    only_ones = masks.filter("truth[0] = 1")
    assert not ev.binary_mask_check(only_ones).first()["is_binary"]
    bad = spark.createDataFrame([([0.0, 2.0],)], "truth array<double>")
    assert ev.binary_mask_check(bad).first()["n_bad"] == 1


def _steps(spark, losses, run="r"):
    return spark.createDataFrame([(run, i, float(v)) for i, v in enumerate(losses)], "run string, step long, loss double")


@pytest.mark.parametrize("block", [1, 2, 3, 1 << 16])
@pytest.mark.parametrize(
    "losses, patience, epoch, stopped",
    [([5, 4, 4, 4, 3], 2, 3, True), ([5, 4, 3, 2], 2, 3, False), ([1, 2], 0, 1, True), ([3, 3, 3], 2, 2, True), ([7], 1, 0, False)],
)
def test_early_stop(spark, losses, patience, epoch, stopped, block):
    row = hist.early_stop(_steps(spark, losses), patience, block=block).first()
    assert (row["stop_epoch"], row["stopped"]) == (epoch, stopped)


def test_early_stop_against_replay(spark):
    import random

    rng = random.Random(5)
    data = [(run, run * 1000 + i, rng.random()) for run in range(6) for i in range(rng.randint(1, 60))]
    df = spark.createDataFrame(data, "run int, step long, loss double")
    for patience in (1, 3, 8):
        got = {r["run"]: r["stop_epoch"] for r in hist.early_stop(df, patience, block=7).collect()}
        for run in range(6):
            losses = [v for r, _, v in data if r == run]
            best, wait, stop = float("inf"), 0, len(losses) - 1
            for i, loss in enumerate(losses):
                if loss < best:
                    best, wait = loss, 0
                else:
                    wait += 1
                    if wait >= patience:
                        stop = i
                        break
            assert got[run] == stop


def test_best_checkpoint_takes_the_first_of_ties(spark):
    df = _steps(spark, [9, 8, 7, 6]).withColumn(
        "val_loss", F.element_at(F.array(*map(F.lit, (3.0, 1.0, 1.0, 2.0))), (F.col("step") + 1).cast("int"))
    )
    assert hist.best_checkpoint(df).first()["best_epoch"] == 1
