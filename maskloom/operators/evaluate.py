"""Reducing pixels to sums, and scoring over images, batches and collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.functions import metrics as m
from maskloom.functions.arrays import argmax
from maskloom.operators.index import position_index

BATCH_SIZE = 32
_SUMS = ("n", "tp", "st", "sp", "bce")


def pixels(df: DataFrame, *keep: str, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Long form (keep..., t, p). Generation and what follows share one generated-code stage.

    A plain ``posexplode`` would add a filter that computes ``pred`` once more, and below any join.
    """
    paired = df.select(*keep, F.col(truth).alias("_truth"), F.posexplode_outer(pred).alias("_i", "p"))
    return paired.filter(F.col("_i").isNotNull()).select(
        *keep, F.get("_truth", "_i").cast("double").alias("t"), F.col("p").cast("double")
    )


def pixel_sums(
    df: DataFrame,
    *by: str,
    truth: str = "truth",
    pred: str = "pred",
    extra: dict[str, m.PixelLoss] | None = None,
    with_bce: bool = True,
) -> DataFrame:
    """Additive sums per group of images; without ``by`` over everything.

    Partial aggregation turns an image into one row of sums before the shuffle, so pixels are
    never exchanged. ``extra`` adds summed per-pixel losses of the caller.
    """
    t, p = F.col("t"), F.col("p")
    sums = [
        F.count("*").alias("n"),
        F.sum(t * p).alias("tp"),
        F.sum(t).alias("st"),
        F.sum(p).alias("sp"),
    ]
    if with_bce:
        sums.append(F.sum(m.cross_entropy(t, p)).alias("bce"))
    for name, loss in (extra or {}).items():
        sums.append(F.sum(loss(t, p)).alias(name))
    long = pixels(df, *by, truth=truth, pred=pred)
    return long.groupBy(*by).agg(*sums) if by else long.agg(*sums)


def regroup(sums: DataFrame, *by: str | Column) -> DataFrame:
    """Add up sums into larger groups."""
    present = [c for c in _SUMS if c in sums.columns]
    return sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in present])


def batch_sums(indexed_sums: DataFrame, batch_size: int = BATCH_SIZE, idx: str = "idx") -> DataFrame:
    """Sums per evaluation batch: consecutive ``batch_size`` images by dense position."""
    batch = F.floor(F.col(idx) / F.lit(batch_size)).alias("batch")
    counted = indexed_sums.withColumn("_images", F.lit(1))
    present = [c for c in _SUMS if c in indexed_sums.columns]
    return counted.groupBy(batch).agg(
        F.sum("_images").alias("images"), *[F.sum(c).alias(c) for c in present]
    )


def evaluate_segmenter(
    indexed_sums: DataFrame,
    batch_size: int = BATCH_SIZE,
    loss: Column | None = None,
    metric: Column | None = None,
) -> DataFrame:
    """One row (loss, metric) as an evaluation in batches reports them.

    The loss is the mean over images, each carrying the loss of its batch; the metric is the plain
    mean over batches, so a short last batch counts as much as a full one.
    """
    loss = m.bce_dice_loss() if loss is None else loss
    metric = m.dice() if metric is None else metric
    batches = batch_sums(indexed_sums, batch_size).select(
        "images", loss.alias("loss"), metric.alias("metric")
    )
    return batches.agg(
        (F.sum(F.col("loss") * F.col("images")) / F.sum("images")).alias("loss"),
        F.avg("metric").alias("metric"),
    )


def evaluate_classes(df: DataFrame, label: str = "label", scores: str = "scores") -> DataFrame:
    """One row (loss, metric): categorical cross-entropy and accuracy."""
    return df.agg(
        F.avg(m.categorical_cross_entropy(F.col(label), F.col(scores))).alias("loss"),
        F.avg((argmax(scores) == F.col(label)).cast("double")).alias("metric"),
    )


def score_series(scores: DataFrame) -> DataFrame:
    """(run, cycle, classifier, discriminator): the metric of each model per cycle."""
    return (
        scores.groupBy("run", "cycle")
        .pivot("model", ["classifier", "discriminator"])
        .agg(F.max("metric"))
    )


def batch_profile(df: DataFrame, image: str = "image", by: tuple[str, ...] = ()) -> DataFrame:
    """Count, distinct shapes, lowest and highest value of a set of images."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_images"),
        F.count_distinct("h", "w").alias("n_shapes"),
        F.min("h").alias("min_h"),
        F.max("h").alias("max_h"),
        F.min("w").alias("min_w"),
        F.max("w").alias("max_w"),
        F.min(F.array_min(image)).cast("double").alias("lowest"),
        F.max(F.array_max(image)).cast("double").alias("highest"),
    )


def require_uniform(df: DataFrame) -> DataFrame:
    """Raise unless all images have one shape; returns the frame unchanged."""
    shapes = df.select("h", "w").distinct().take(2)
    if len(shapes) != 1:
        raise ValueError("images of different shapes" if shapes else "no images")
    return df


def stacked(collection: DataFrame, points: DataFrame, image: str = "image") -> DataFrame:
    """(idx, h, w, image) of a collection's points in its order, all of one shape.

    Places are found on the ids alone, and shapes are checked without the pixels. A point without a row
    in ``points`` raises ``ValueError``.
    """
    ids = position_index(collection.select("point_id", "ord")).select("point_id", "idx")
    rows = ids.join(points.select("point_id", "h", "w", F.col(image).alias("image")), "point_id", "left")
    lacking, shapes = rows.agg(
        F.count_if(F.col("h").isNull()), F.count_distinct(F.struct("h", "w"))
    ).first()
    if lacking:
        raise ValueError(f"{lacking} points without an image")
    if shapes != 1:
        raise ValueError("images of different shapes" if shapes else "no images")
    return rows.select("idx", "h", "w", "image").orderBy("idx")


def unique_values(df: DataFrame, image: str = "image") -> DataFrame:
    """Distinct pixel values with the number of images holding each."""
    return (
        df.select(F.explode_outer(F.array_distinct(image)).alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy(F.col("value").cast("double").alias("value"))
        .agg(F.count("*").alias("n_images"))
    )


def binary_mask_check(df: DataFrame, mask: str = "truth") -> DataFrame:
    """One row: do the masks together hold exactly the values 0 and 1?"""
    return df.agg(
        F.count("*").alias("n_masks"),
        F.sum(F.when(F.forall(mask, lambda x: (x == 0) | (x == 1)), 0).otherwise(1)).alias("n_bad"),
        (
            F.bool_and(F.forall(mask, lambda x: (x == 0) | (x == 1)))
            & F.bool_or(F.exists(mask, lambda x: x == 0))
            & F.bool_or(F.exists(mask, lambda x: x == 1))
        ).alias("is_binary"),
    )


def prediction_rows(
    indexed: DataFrame, num_samples: int = 100, idx: str = "idx"
) -> DataFrame:
    """Image, truth and prediction of the first points by position, for looking at."""
    return indexed.filter(F.col(idx) < num_samples)
