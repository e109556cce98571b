"""Fits by additive sums: against plain numpy steps, own losses, early ends, rows without numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.plans import learners, trainer

SCHEMA = "a double, b double, y double, extra string"


def _table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def examples(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + x @ [1.5, -2.0])))).astype(float)
    rows = [(float(p), float(q), float(t), "x") for (p, q), t in zip(x, y)]
    return x, y, _table(spark, rows[:300]), _table(spark, rows[300:])


def _plain(x, y, steps, reg):
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(3), np.diag([0, reg, reg])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        bends = (x * (p * (1 - p))[:, None]).T @ x / len(x) + penalty
        w = w - np.linalg.solve(bends, x.T @ (p - y) / len(x) + penalty @ w)
    return w


def test_newton_steps_are_those_of_numpy(examples):
    x, y, train, _ = examples
    seen = []
    trainer.fit_linear(train, None, ["a", "b"], "y", epochs=4, reg=0.1, callbacks=[lambda *r: seen.append(r[5])])
    for steps, weights in enumerate(seen):
        assert np.allclose(weights, _plain(x[:300], y[:300], steps, 0.1), atol=1e-9)


def test_a_loss_without_derivatives_fits_as_one_with_them(examples):
    _, _, train, val = examples
    own = trainer.Loss(trainer.LOG_LOSS.value)
    want = trainer.fit_linear(train, val, ["a", "b"], "y", epochs=5, patience=5)
    got = trainer.fit_linear(train, val, ["a", "b"], "y", loss=own, epochs=5, patience=5)
    assert np.allclose(got.weights, want.weights, atol=1e-4)


@pytest.mark.parametrize("method,rate", [("newton", 1.0), ("gradient", 4.0)])
def test_another_loss_is_lowered(examples, method, rate):
    _, _, train, val = examples
    fitted = trainer.fit_linear(
        train, val, ["a", "b"], "y", loss="squared", method=method, rate=rate, epochs=8,
        metric=lambda z, t: F.abs(trainer.sigmoid(z) - t),
    )
    losses = [row[1] for row in fitted.history]
    assert losses[0] == 0.25 and min(losses) < 0.15
    assert fitted.history[0][2] == 0.5


def test_patience_ends_the_fit_and_the_best_epoch_is_kept(spark, examples):
    _, _, train, val = examples
    # On turned targets every step makes the validation loss worse.
    worse = val.withColumn("y", F.lit(1.0) - F.col("y"))
    fitted = trainer.fit_linear(train, worse, ["a", "b"], "y", epochs=10, patience=2)
    assert fitted.stopped and fitted.best_epoch == 0 and fitted.weights == (0.0, 0.0, 0.0)
    assert [row[0] for row in fitted.history] == [0, 1, 2]


def test_a_callback_ends_the_fit(examples):
    _, _, train, val = examples
    fitted = trainer.fit_linear(train, val, ["a", "b"], "y", callbacks=[lambda epoch, *_: epoch == 1])
    assert fitted.stopped and len(fitted.history) == 2


def test_rows_without_numbers_repeats_and_empty_tables(spark, examples):
    _, _, train, _ = examples
    holes = _table(spark, [(None, 1.0, 1.0, None), (1.0, float("nan"), 0.0, ""), (1.0, 1.0, None, "z")])
    want = trainer.fit_linear(train, None, ["a", "b"], "y", epochs=3)
    got = trainer.fit_linear(train.union(holes).union(train), None, ["a", "b"], "y", epochs=3)
    assert np.allclose(got.weights, want.weights, atol=1e-9)
    empty = trainer.fit_linear(holes, holes, ["a", "b"], "y")
    assert empty.weights == (0.0, 0.0, 0.0) and empty.history == []


def test_names_that_clash_with_the_trainers_own(examples):
    _, _, train, _ = examples
    renamed = train.select(F.col("a").alias("x1"), F.col("b").alias("t"), F.col("y").alias("part"), "extra")
    want = trainer.fit_linear(train, None, ["a", "b"], "y", epochs=2)
    got = trainer.fit_linear(renamed, None, ["x1", "t"], "part", epochs=2)
    assert np.allclose(got.weights, want.weights, atol=1e-12)


def test_a_constant_feature_does_not_break_the_step(examples):
    _, _, train, _ = examples
    fitted = trainer.fit_linear(train.withColumn("a", F.lit(1.0)), None, ["a", "b"], "y", epochs=6)
    assert np.isfinite(fitted.weights).all() and min(row[1] for row in fitted.history) < 0.69


def test_pixel_rows_are_the_pixel_features(spark):
    rng = np.random.default_rng(7)
    rows = [
        (f"p{k}", h, w, rng.random(h * w).tolist(), rng.integers(0, 2, h * w).astype(float).tolist())
        for k, (h, w) in enumerate([(1, 1), (1, 5), (4, 1), (3, 7), (6, 6)])
    ] + [("none", 2, 2, None, None), ("empty", 0, 0, [], [])]
    df = spark.createDataFrame(rows, "point_id string, h int, w int, image array<double>, truth array<double>")
    want = learners.pixel_features(df).select("x", "mean3", "t").toPandas().sort_values("x").to_numpy(float)
    got = learners.pixel_rows(df).toPandas().sort_values("x").to_numpy(float)
    assert got.shape == want.shape == (1 + 5 + 4 + 21 + 36, 3) and np.allclose(got, want, atol=1e-12)


def test_a_picture_of_another_size_is_an_error(spark):
    df = spark.createDataFrame([(2, 2, [1.0], [1.0])], "h int, w int, image array<double>, truth array<double>")
    with pytest.raises(Exception, match="holds 1 pixels"):
        learners.pixel_rows(df).collect()


def test_fitted_models_come_back_from_their_description(spark):
    model = learners.PairLinearModel(0.5, (0.1, 1.0, 2.0, 3.0, 4.0, 5.0))
    held = learners.describe_model(model, "unused")
    assert held["kind"] == "pair_additive" and learners.restore_model(held) == model
