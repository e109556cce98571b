"""Segmenters and discriminators: the two learner roles of the curation loop.

A segmenter is fitted on (point_id, h, w, image, truth) and adds ``prob`` and ``mask``; a
discriminator is fitted on pairs (point_id, h, w, image, mask, label), label 1 for machine
masks, and returns (point_id, label, scores, verdict).
"""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions import arrays as a
from maskloom.functions import metrics as m
from maskloom.plans import trainer
from maskloom.session import cut_lineage

HISTORY_SCHEMA = (
    "model string, epoch int, loss double, metric double, val_loss double, val_metric double"
)


class SegmenterModel(Protocol):
    history: list[tuple]

    def transform(self, df: DataFrame) -> DataFrame: ...


class Segmenter(Protocol):
    def fit(self, train: DataFrame, val: DataFrame) -> SegmenterModel: ...


class DiscriminatorModel(Protocol):
    history: list[tuple]

    def transform(self, pairs: DataFrame) -> DataFrame: ...


class Discriminator(Protocol):
    def fit(self, train: DataFrame, val: DataFrame) -> DiscriminatorModel: ...


# --- threshold segmenter --------------------------------------------------------------------


def cut_bin(x: str, cuts: Sequence[float]) -> Column:
    """How many of the ascending cuts the column ``x`` reaches, by bisection."""

    def bisect(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return (
            f"CASE WHEN {x} >= {float(cuts[middle])!r}D THEN {bisect(middle + 1, high)} "
            f"ELSE {bisect(low, middle)} END"
        )

    return F.expr(bisect(0, len(cuts)))


def cut_histogram(df: DataFrame, cuts: Sequence[float], *by: str, image="image", truth="truth") -> DataFrame:
    """(by..., bin, n, st): pixels and true pixels between neighbouring cuts.

    One pass over the pixels whatever the number of cuts; what is exchanged is a row per bin.
    """
    raw = df.select(*by, F.col(truth).alias("_truth"), F.posexplode_outer(image).alias("_i", "_raw"))
    long = raw.filter(F.col("_i").isNotNull()).select(
        *by, F.get("_truth", "_i").cast("double").alias("_t"), F.col("_raw").cast("double").alias("_x")
    )
    return long.groupBy(*by, cut_bin("_x", cuts).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("_t").alias("st")
    )


def cut_scores(histogram: DataFrame, cuts: Sequence[float], *by: str) -> DataFrame:
    """(by..., cut, tp, sp, st, dice) for every cut: suffix sums over the few bins."""
    tops = F.explode(
        F.transform(
            F.sequence(F.lit(1), F.lit(len(cuts))),
            lambda k: F.struct(
                k.alias("k"), F.array(*[F.lit(float(c)) for c in cuts])[k - 1].alias("cut")
            ),
        )
    )
    bins = histogram.select(*by, "bin", "n", "st", tops.alias("at"))
    reached = F.col("bin") >= F.col("at.k")
    sums = bins.groupBy(*by, F.col("at.cut").alias("cut")).agg(
        F.sum(F.when(reached, F.col("st")).otherwise(0.0)).alias("tp"),
        F.sum(F.when(reached, F.col("n")).otherwise(0)).cast("double").alias("sp"),
        F.sum("st").alias("st"),
    )
    return sums.withColumn("dice", m.dice())


@dataclass
class ThresholdModel:
    """Pixels at or above ``cut`` are inside; the soft score is a sigmoid around the cut."""

    cut: float
    slope: float = 20.0
    history: list[tuple] = field(default_factory=list)

    def prob(self, image="image") -> Column:
        image = F.col(image) if isinstance(image, str) else image

        def sigmoid(x: Column) -> Column:
            gap = x.cast("double") - F.lit(self.cut)
            return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-self.slope) * gap))

        return F.transform(image, sigmoid)

    def mask(self, image="image") -> Column:
        image = F.col(image) if isinstance(image, str) else image
        return F.transform(
            image, lambda x: F.when(x.cast("double") >= F.lit(self.cut), 1.0).otherwise(0.0)
        )

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"prob": self.prob(), "mask": self.mask()})


@dataclass
class ThresholdSegmenter:
    """Picks the cut of a grid with the best Dice on the training images.

    Every epoch scans the pixels once for the whole grid, then narrows the grid around the best
    cut. Fitting ends early after ``patience`` epochs without a lower training loss. Without
    ``low`` and ``high`` the grid lies inside the range of the training pixels, half a step from
    its ends.
    """

    low: float | None = None
    high: float | None = None
    steps: int = 20
    epochs: int = 1
    patience: int = 2
    slope: float = 20.0

    def grid(self, low: float, high: float) -> list[float]:
        width = (high - low) / (self.steps - 1)
        return [round(low + k * width, 12) for k in range(self.steps)]

    def range_of(self, train: DataFrame) -> tuple[float, float]:
        ends = train.agg(
            F.min(F.array_min("image")).cast("double").alias("low"),
            F.max(F.array_max("image")).cast("double").alias("high"),
        ).first()
        if ends["low"] is None:
            raise ValueError("there are no training pixels")
        margin = (ends["high"] - ends["low"]) / (2 * self.steps)
        low = ends["low"] + margin if self.low is None else self.low
        return low, ends["high"] - margin if self.high is None else self.high

    def fit(self, train: DataFrame, val: DataFrame) -> ThresholdModel:
        both = train.select("image", "truth", F.lit("train").alias("part")).unionByName(
            val.select("image", "truth", F.lit("val").alias("part"))
        )
        low, high = self.range_of(train)
        best, history, waited = None, [], 0
        for epoch in range(self.epochs):
            cuts = self.grid(low, high)
            rows = cut_scores(cut_histogram(both, cuts, "part"), cuts, "part").collect()
            dice = {(r["part"], r["cut"]): r["dice"] for r in rows}
            # The lowest cut wins ties.
            cut = max(cuts, key=lambda c: (dice.get(("train", c), 0.0), -c))
            score = dice.get(("train", cut), 0.0)
            val_score = dice.get(("val", cut))
            val_loss = None if val_score is None else 1 - val_score
            history.append(("threshold", epoch, 1 - score, score, val_loss, val_score))
            if best is None or score > best[0]:
                best, waited = (score, cut), 0
            else:
                waited += 1
                if waited >= self.patience:
                    break
            width = (high - low) / (self.steps - 1)
            low, high = cut - width, cut + width
        return ThresholdModel(best[1], self.slope, history)


# --- logistic pixel segmenter ---------------------------------------------------------------


def pixel_features(df: DataFrame, *keep: str, truth: str | None = "truth") -> DataFrame:
    """Long form (keep..., i, x, mean3[, t]): intensity and the mean of the 3 x 3 neighbourhood.

    Pixels outside the picture do not count. Neighbours are read from the image carried along
    each generated row, inside one generated-code stage.
    """
    image, i, h, w = F.col("_image"), F.col("i"), F.col("h"), F.col("w")
    extra = [F.col(truth).alias("_truth")] if truth else []
    long = df.select(
        *keep, "h", "w", F.col("image").alias("_image"), *extra,
        F.posexplode_outer("image").alias("i", "x"),
    ).filter(F.col("i").isNotNull())
    row, col = F.floor(i / w), i % w
    total, count = F.lit(0.0), F.lit(0)
    for dr in (-1, 0, 1):
        for dc in (-1, 0, 1):
            inside = (row + dr >= 0) & (row + dr < h) & (col + dc >= 0) & (col + dc < w)
            value = F.get(image, (i + dr * w + dc).cast("int")).cast("double")
            total = total + F.when(inside, value).otherwise(0.0)
            count = count + inside.cast("int")
    columns = [*keep, "i", F.col("x").cast("double").alias("x"), (total / count).alias("mean3")]
    if truth:
        columns.append(F.get("_truth", i).cast("double").alias("t"))
    return long.select(*columns)


def _pixel_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        images, truths, heights, widths = (batch.column(k) for k in range(4))
        for k in range(batch.num_rows):
            if not images[k].is_valid:
                continue
            x = images[k].values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            h, w = heights[k].as_py(), widths[k].as_py()
            if h is None or w is None or len(x) != h * w:
                raise ValueError(f"a picture of {h} x {w} holds {len(x)} pixels")
            if not len(x):
                continue
            t = np.full(len(x), np.nan)
            if truths[k].is_valid:
                known = truths[k].values.cast(pa.float64()).to_numpy(zero_copy_only=False)[: len(x)]
                t[: len(known)] = known
            # Sums over three rows, then over three columns; the frame around the picture adds nothing.
            framed = np.pad(x.reshape(h, w), 1)
            rows = framed[:-2] + framed[1:-1] + framed[2:]
            total = rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]
            beside = [np.minimum(np.arange(n), 1) + np.minimum(np.arange(n)[::-1], 1) + 1 for n in (h, w)]
            mean3 = total / np.outer(*beside)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x, mean3.ravel(), t)], names=["x", "mean3", "t"])


def pixel_rows(df: DataFrame) -> DataFrame:
    """(x, mean3, t) per pixel as ``pixel_features`` gives them, by an Arrow kernel a picture at a time.

    A missing number is NaN here. Spark cannot unfold the features into each use of them, as it does
    with column expressions, so a fit may name them often.
    """
    return df.select("image", "truth", "h", "w").mapInArrow(_pixel_batches, "x double, mean3 double, t double")


@dataclass
class PixelLogisticModel:
    intercept: float
    weights: tuple[float, float]
    history: list[tuple] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """Scores by array functions: no pixel leaves its row."""
        image, h, w = F.col("image"), F.col("h"), F.col("w")

        def score(x: Column, i: Column) -> Column:
            row, col = F.floor(i / w), i % w
            total, count = F.lit(0.0), F.lit(0)
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    inside = (row + dr >= 0) & (row + dr < h) & (col + dc >= 0) & (col + dc < w)
                    value = F.get(image, (i + dr * w + dc).cast("int")).cast("double")
                    total = total + F.when(inside, value).otherwise(0.0)
                    count = count + inside.cast("int")
            z = (
                F.lit(self.intercept)
                + F.lit(self.weights[0]) * x.cast("double")
                + F.lit(self.weights[1]) * (total / count)
            )
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

        return df.withColumn("prob", F.transform(image, score)).withColumn(
            "mask", a.threshold("prob")
        )


@dataclass
class PixelLogisticSegmenter:
    """Logistic regression of the mask on intensity and neighbourhood mean, fitted by MLlib.

    ``epochs`` bounds the optimiser's passes; its objective per pass is the history.
    """

    epochs: int = 20
    reg: float = 0.0

    def fit(self, train: DataFrame, val: DataFrame) -> PixelLogisticModel:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        rows = VectorAssembler(inputCols=["x", "mean3"], outputCol="features").transform(
            pixel_features(train)
        )
        fitted = LogisticRegression(
            featuresCol="features", labelCol="t", maxIter=self.epochs, regParam=self.reg
        ).fit(rows.select("features", "t"))
        model = PixelLogisticModel(
            float(fitted.intercept), tuple(float(c) for c in fitted.coefficients)
        )
        objective = fitted.summary.objectiveHistory
        model.history = [
            ("pixel_logistic", k, float(loss), None, None, None) for k, loss in enumerate(objective)
        ]
        return model


@dataclass
class AdditivePixelSegmenter:
    """The same model fitted by additive sums: validation loss ends the fit, and the loss, the metric
    and callbacks may be one's own (see ``trainer.fit_linear``)."""

    epochs: int = 20
    patience: int = 2
    reg: float = 0.0
    loss: str | trainer.Loss = "log"
    metric: trainer.Expression = trainer.accuracy
    method: str = "newton"
    rate: float = 1.0
    callbacks: Sequence[trainer.Callback] = ()

    def fit(self, train: DataFrame, val: DataFrame) -> PixelLogisticModel:
        fitted = trainer.fit_linear(
            pixel_rows(train), pixel_rows(val), ("x", "mean3"), "t", self.loss, self.metric,
            self.epochs, self.patience, self.reg, self.method, self.rate, self.callbacks,
        )
        history = [("pixel_additive", *row) for row in fitted.history]
        return PixelLogisticModel(fitted.weights[0], fitted.weights[1:], history)


# --- pair features --------------------------------------------------------------------------


def pair_features(pairs: DataFrame, cut: float, *keep: str, mask: str = "mask") -> DataFrame:
    """Per (image, mask) pair: share inside, mean intensity inside and outside, edges per pixel,
    and agreement with the mask that a plain cut would give.

    Additive over pixels, so a pair is one row before the shuffle.
    """
    keys = ["point_id", *keep]
    long = pairs.select(
        *keys, "h", "w", F.col("image").alias("_image"), F.col(mask).alias("_mask"),
        F.posexplode_outer(mask).alias("_i", "_m"),
    ).filter(F.col("_i").isNotNull())
    i, w, h = F.col("_i"), F.col("w"), F.col("h")
    x = F.get("_image", i).cast("double")
    inside = F.col("_m") > 0
    right = F.when(i % w < w - 1, F.get("_mask", i + 1) != F.col("_m")).otherwise(F.lit(False))
    below = F.when(i < (h - 1) * w, F.get("_mask", i + w) != F.col("_m")).otherwise(F.lit(False))
    agrees = (x >= F.lit(float(cut))) == inside
    sums = long.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(inside.cast("int")).alias("n_in"),
        F.sum(F.when(inside, x).otherwise(0.0)).alias("x_in"),
        F.sum(F.when(inside, 0.0).otherwise(x)).alias("x_out"),
        F.sum(right.cast("int") + below.cast("int")).alias("edges"),
        F.sum(agrees.cast("int")).alias("n_agree"),
    )
    n_out = F.col("n") - F.col("n_in")
    return sums.select(
        *keys,
        (F.col("n_in") / F.col("n")).alias("area"),
        F.when(F.col("n_in") > 0, F.col("x_in") / F.col("n_in")).otherwise(0.0).alias("mean_in"),
        F.when(n_out > 0, F.col("x_out") / n_out).otherwise(0.0).alias("mean_out"),
        (F.col("edges") / F.col("n")).alias("edge_rate"),
        (F.col("n_agree") / F.col("n")).alias("agreement"),
    )


FEATURES = ("area", "mean_in", "mean_out", "edge_rate", "agreement")


# --- agreement discriminator ----------------------------------------------------------------


@dataclass
class AgreementModel:
    """Machine (1) when the mask agrees with the plain cut on more than ``tau`` of the pixels."""

    cut: float
    tau: float
    slope: float = 20.0
    history: list[tuple] = field(default_factory=list)

    def transform(self, pairs: DataFrame) -> DataFrame:
        features = pair_features(pairs, self.cut, "label")
        gap = F.col("agreement") - F.lit(self.tau)
        machine = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-self.slope) * gap))
        return features.select(
            "point_id", "label", F.array(F.lit(1.0) - machine, machine).alias("scores")
        ).withColumn("verdict", a.argmax("scores"))


@dataclass
class AgreementDiscriminator:
    """One-feature rule: the agreement bound with the best training accuracy, lowest on ties.

    Bounds lie between the agreements that ``levels`` pixels can have; None takes the number of
    pixels of the largest training picture, so that one pixel is enough to tell two sides apart.
    """

    cut: float
    levels: int | None = None
    slope: float = 20.0

    def fit(self, train: DataFrame, val: DataFrame) -> AgreementModel:
        levels = self.levels or train.agg(F.max(F.size("image"))).first()[0] or 1
        taus = [(k - 0.5) / levels for k in range(levels + 1)]
        rows = self._counts(train, val, levels)

        def accuracies(part: str) -> list[float] | None:
            """Accuracy at each bound: right are machine pairs above it and others below it."""
            own = [row[1:] for row in rows if row[0] == part]
            total = sum(n for _, _, n in own)
            change = [0] * (levels + 3)
            for label, reached, n in own:
                change[reached] += -n if label == 1 else n
            right, out = sum(n for label, _, n in own if label == 1), []
            for k in range(levels + 1):
                right += change[k]
                out.append(right / total if total else 0.0)
            return out if total else None

        of_train, of_val = accuracies("train"), accuracies("val")
        best = max(range(len(taus)), key=lambda k: (of_train[k] if of_train else 0.0, -k))
        score, val_score = (x[best] if x else None for x in (of_train, of_val))
        history = [
            (
                "agreement", 0,
                None if score is None else 1 - score, score,
                None if val_score is None else 1 - val_score, val_score,
            )
        ]
        return AgreementModel(self.cut, taus[best], self.slope, history)

    def _counts(
        self, train: DataFrame, val: DataFrame, levels: int
    ) -> list[tuple[str, int, int, int]]:
        """Pairs per part, label and number of bounds reached: at most 4 * (levels + 2) rows."""
        both = train.withColumn("part", F.lit("train")).unionByName(
            val.withColumn("part", F.lit("val"))
        )
        features = pair_features(both, self.cut, "part", "label")
        # Bound k lies at (k - 0.5) / levels.
        reached = F.floor(F.col("agreement") * levels + 0.5).cast("int") + 1
        rows = features.groupBy("part", "label", reached.alias("bin")).count()
        return [(r["part"], r["label"], r["bin"], r["count"]) for r in rows.collect()]


# --- logistic pair discriminator ------------------------------------------------------------


@dataclass
class PairLogisticModel:
    cut: float
    fitted: object
    history: list[tuple] = field(default_factory=list)

    def transform(self, pairs: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        scored = self.fitted.transform(pair_features(pairs, self.cut, "label"))
        return scored.select(
            "point_id", "label", vector_to_array("probability").alias("scores")
        ).withColumn("verdict", a.argmax("scores"))


@dataclass
class PairLogisticDiscriminator:
    """Logistic regression on the pair features, fitted by MLlib.

    ``grid`` maps parameter names to candidate values; the best by validation accuracy is kept.
    """

    cut: float
    epochs: int = 50
    reg: float = 0.01
    grid: dict[str, list] | None = None

    def fit(self, train: DataFrame, val: DataFrame) -> PairLogisticModel:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.evaluation import MulticlassClassificationEvaluator
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.tuning import ParamGridBuilder

        logistic = LogisticRegression(labelCol="label", maxIter=self.epochs, regParam=self.reg)
        pipeline = Pipeline(
            stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), logistic]
        )
        builder = ParamGridBuilder()
        for name, values in (self.grid or {}).items():
            builder = builder.addGrid(logistic.getParam(name), values)
        rows = pair_features(train, self.cut, "label").cache()
        val_rows = pair_features(val, self.cut, "label").cache()
        accuracy = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
        best, history = None, []
        for k, params in enumerate(builder.build()):
            fitted = pipeline.fit(rows, params)
            score = accuracy.evaluate(fitted.transform(rows))
            val_score = accuracy.evaluate(fitted.transform(val_rows))
            history.append(("pair_logistic", k, 1 - score, score, 1 - val_score, val_score))
            if best is None or val_score > best[0]:
                best = (val_score, fitted)
        rows.unpersist()
        val_rows.unpersist()
        return PairLogisticModel(self.cut, best[1], history)


@dataclass
class PairLinearModel:
    """Logistic score of the pair features; ``weights`` has the intercept first."""

    cut: float
    weights: tuple[float, ...]
    history: list[tuple] = field(default_factory=list)

    def transform(self, pairs: DataFrame) -> DataFrame:
        score = F.lit(self.weights[0])
        for name, weight in zip(FEATURES, self.weights[1:]):
            score = score + F.lit(weight) * F.col(name)
        machine = trainer.sigmoid(score)
        return pair_features(pairs, self.cut, "label").select(
            "point_id", "label", F.array(F.lit(1.0) - machine, machine).alias("scores")
        ).withColumn("verdict", a.argmax("scores"))


@dataclass
class AdditivePairDiscriminator:
    """Logistic rule on the pair features, fitted by additive sums with early stopping."""

    cut: float
    epochs: int = 20
    patience: int = 2
    reg: float = 0.01
    loss: str | trainer.Loss = "log"
    metric: trainer.Expression = trainer.accuracy
    method: str = "newton"
    rate: float = 1.0
    callbacks: Sequence[trainer.Callback] = ()

    def fit(self, train: DataFrame, val: DataFrame) -> PairLinearModel:
        # A pair is a row of five numbers, read once per epoch: written, not computed again.
        rows, val_rows = (cut_lineage(pair_features(df, self.cut, "label")) for df in (train, val))
        fitted = trainer.fit_linear(
            rows, val_rows, FEATURES, "label", self.loss, self.metric,
            self.epochs, self.patience, self.reg, self.method, self.rate, self.callbacks,
        )
        return PairLinearModel(self.cut, fitted.weights, [("pair_additive", *row) for row in fitted.history])


# --- choosing learners by name --------------------------------------------------------------

SEGMENTERS: dict[str, Callable[..., Segmenter]] = {
    "threshold": ThresholdSegmenter,
    "pixel_logistic": PixelLogisticSegmenter,
    "pixel_additive": AdditivePixelSegmenter,
}
DISCRIMINATORS: dict[str, Callable[..., Discriminator]] = {
    "agreement": AgreementDiscriminator,
    "pair_logistic": PairLogisticDiscriminator,
    "pair_additive": AdditivePairDiscriminator,
}


def make_segmenter(choice: str | Segmenter = "threshold", **settings) -> Segmenter:
    """A segmenter by name and settings; an object is passed through."""
    return SEGMENTERS[choice](**settings) if isinstance(choice, str) else choice


def make_discriminator(choice: str | Discriminator = "agreement", **settings) -> Discriminator:
    return DISCRIMINATORS[choice](**settings) if isinstance(choice, str) else choice


# --- models as entries of a journal ---------------------------------------------------------

MODELS = {
    "threshold": (ThresholdModel, ("cut", "slope")),
    "pixel_logistic": (PixelLogisticModel, ("intercept", "weights")),
    "agreement": (AgreementModel, ("cut", "tau", "slope")),
    "pair_logistic": (PairLogisticModel, ("cut",)),
    "pair_additive": (PairLinearModel, ("cut", "weights")),
}


def describe_model(model, folder: str) -> dict:
    """What ``restore_model`` needs, as JSON can hold it; an MLlib part is saved under ``folder``.

    A model of another class that has ``describe()`` gives its own numbers, for ``restore`` of its
    class; one without leaves its class name only.
    """
    for kind, (cls, names) in MODELS.items():
        if type(model) is cls:
            held = {"kind": kind, **{name: getattr(model, name) for name in names}}
            if kind == "pair_logistic":
                held["fitted"] = f"{folder}/{uuid.uuid4().hex}"
                model.fitted.write().save(held["fitted"])
            return held
    cls = f"{type(model).__module__}:{type(model).__qualname__}"
    if hasattr(model, "describe") and hasattr(type(model), "restore"):
        return {"kind": "own", "class": cls, "numbers": model.describe()}
    return {"kind": "unknown", "class": cls}


def restore_model(held: dict):
    """The model that ``describe_model`` described; None if it could not be described."""
    if held["kind"] == "unknown":
        return None
    if held["kind"] == "own":
        module, _, name = held["class"].partition(":")
        cls = importlib.import_module(module)
        for part in name.split("."):
            cls = getattr(cls, part)
        return cls.restore(held["numbers"])
    cls, names = MODELS[held["kind"]]
    values = {name: tuple(held[name]) if isinstance(held[name], list) else held[name] for name in names}
    if held["kind"] == "pair_logistic":
        from pyspark.ml import PipelineModel

        values["fitted"] = PipelineModel.load(held["fitted"])
    return cls(**values)
