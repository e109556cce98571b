"""Linear models fitted by additive sums: one aggregate over the rows per epoch.

An epoch asks for the sums of loss, metric, gradient and (for Newton steps) curvature of training
and validation rows. They are combined map-side, so what is exchanged and collected is two rows
whatever the number of examples; the step itself is solved on a matrix of the features.

A loss is a column expression of the score ``z`` (a logit) and the target; without derivatives of
its own they are taken by central differences, so any smooth expression will do. Training and
validation examples are all used; one whose target or a feature is null or NaN counts nowhere.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Expression = Callable[[Column, Column], Column]
# Called with (epoch, loss, metric, val_loss, val_metric, weights); True ends the fit.
Callback = Callable[[int, float, float, float | None, float | None, tuple], bool | None]

# Step of the central differences: second differences of a loss near 1 keep about six digits.
GAP = 1e-3


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


@dataclass(frozen=True)
class Loss:
    """``value(z, t)`` and its first and second derivative by z."""

    value: Expression
    slope: Expression | None = None
    bend: Expression | None = None

    def first(self, z: Column, t: Column) -> Column:
        if self.slope is not None:
            return self.slope(z, t)
        return (self.value(z + GAP, t) - self.value(z - GAP, t)) / (2 * GAP)

    def second(self, z: Column, t: Column) -> Column:
        if self.bend is not None:
            return self.bend(z, t)
        if self.slope is not None:
            return (self.slope(z + GAP, t) - self.slope(z - GAP, t)) / (2 * GAP)
        ends = self.value(z + GAP, t) + self.value(z - GAP, t)
        return (ends - F.lit(2.0) * self.value(z, t)) / (GAP * GAP)


def _log_loss(z: Column, t: Column) -> Column:
    # log(1 + exp(z)) - t z, without overflow.
    return F.greatest(z, F.lit(0.0)) - t * z + F.log1p(F.exp(-F.abs(z)))


LOG_LOSS = Loss(
    _log_loss,
    lambda z, t: sigmoid(z) - t,
    lambda z, t: sigmoid(z) * (F.lit(1.0) - sigmoid(z)),
)
SQUARED = Loss(lambda z, t: (sigmoid(z) - t) * (sigmoid(z) - t))
LOSSES = {"log": LOG_LOSS, "squared": SQUARED}


def accuracy(z: Column, t: Column) -> Column:
    """1 where the score lies on the target's side of zero."""
    return ((z >= 0) == (t > 0.5)).cast("double")


@dataclass
class Fit:
    """What a fit settled on: the weights of the best epoch, intercept first, and all epochs."""

    weights: tuple[float, ...]
    best_epoch: int
    stopped: bool
    # (epoch, loss, metric, val_loss, val_metric), measured with the weights of that epoch.
    history: list[tuple] = field(default_factory=list)


def _sums(rows: DataFrame, features: Sequence[str], weights: np.ndarray, loss: Loss, metric: Expression, newton: bool):
    """Per part ("train", "val"): number of rows and means of all that an epoch asks for."""
    t = F.col("t")
    score = F.lit(float(weights[0]))
    for name, weight in zip(features, weights[1:]):
        score = score + F.lit(float(weight)) * F.col(name)
    inputs = [F.lit(1.0), *[F.col(name) for name in features]]
    wanted = [F.count("*").alias("n"), F.avg("_l").alias("loss"), F.avg("_m").alias("metric")]
    trained = F.col("part") == "train"
    wanted += [F.avg(F.when(trained, F.col("_g") * x)).alias(f"g{k}") for k, x in enumerate(inputs)]
    steps = {"_l": loss.value(F.col("_z"), t), "_m": metric(F.col("_z"), t), "_g": loss.first(F.col("_z"), t)}
    if newton:
        steps["_h"] = loss.second(F.col("_z"), t)
        wanted += [
            F.avg(F.when(trained, F.col("_h") * inputs[j] * inputs[k])).alias(f"h{j}_{k}")
            for j in range(len(inputs)) for k in range(j, len(inputs))
        ]
    scored = rows.withColumn("_z", score).withColumns(steps)
    return {r["part"]: r.asDict() for r in scored.groupBy("part").agg(*wanted).collect()}


def _step(found: dict, weights: np.ndarray, reg: float, newton: bool, rate: float) -> np.ndarray:
    """The next weights; the penalty spares the intercept."""
    n = len(weights)
    penalty = np.full(n, reg)
    penalty[0] = 0.0
    gradient = np.array([found[f"g{k}"] for k in range(n)]) + penalty * weights
    if not newton:
        return weights - rate * gradient
    bends = np.zeros((n, n))
    for j in range(n):
        for k in range(j, n):
            bends[j, k] = bends[k, j] = found[f"h{j}_{k}"]
    bends += np.diag(penalty)
    # A loss that is not convex in z may bend downwards: such directions are taken by their size.
    values, vectors = np.linalg.eigh(bends)
    if values[0] <= 1e-12 * max(abs(values[-1]), 1e-300):
        values = np.maximum(np.abs(values), 1e-6 * max(np.abs(values).max(), 1e-300))
        return weights - rate * (vectors @ ((vectors.T @ gradient) / values))
    return weights - rate * np.linalg.solve(bends, gradient)


def fit_linear(
    train: DataFrame,
    val: DataFrame | None,
    features: Sequence[str],
    target: str,
    loss: str | Loss = "log",
    metric: Expression = accuracy,
    epochs: int = 20,
    patience: int = 2,
    reg: float = 0.0,
    method: str = "newton",
    rate: float = 1.0,
    callbacks: Sequence[Callback] = (),
) -> Fit:
    """Fit ``target`` in [0, 1] by a linear score of the features.

    Epoch k is measured with the weights before its step, so epoch 0 stands for all-zero weights.
    The fit ends after ``patience`` epochs in a row without a lower loss on the validation rows
    (without any, on the training rows), or when a callback returns True, and gives the weights of
    the epoch with the lowest such loss, the first on ties. Without training rows the weights are zero.
    """
    if method not in ("newton", "gradient"):
        raise ValueError(f"method must be newton or gradient, not {method!r}")
    loss = LOSSES[loss] if isinstance(loss, str) else loss
    newton = method == "newton"

    def part(df: DataFrame, name: str) -> DataFrame:
        inputs = [F.col(f"`{f}`").cast("double").alias(f"x{k}") for k, f in enumerate(features)]
        return df.select(*inputs, F.col(f"`{target}`").cast("double").alias("t"), F.lit(name).alias("part"))

    rows = part(train, "train")
    if val is not None:
        rows = rows.unionByName(part(val, "val"))
    rows = rows.dropna()
    names = [f"x{k}" for k in range(len(features))]
    weights = np.zeros(len(features) + 1)
    best, out = None, Fit(tuple(weights.tolist()), 0, False)
    for epoch in range(epochs):
        sums = _sums(rows, names, weights, loss, metric, newton)
        if "train" not in sums:
            break
        own, other = sums["train"], sums.get("val", {})
        row = (epoch, own["loss"], own["metric"], other.get("loss"), other.get("metric"))
        out.history.append(row)
        watched = other.get("loss", own["loss"])
        if best is None or watched < best:
            best, out.best_epoch, out.weights = watched, epoch, tuple(weights.tolist())
        asked = [call(*row, tuple(weights.tolist())) for call in callbacks]
        if epoch - out.best_epoch >= max(patience, 1) or any(asked):
            out.stopped = True
            break
        weights = _step(own, weights, reg, newton, rate)
        if not np.isfinite(weights).all():
            out.stopped = True
            break
    return out
