"""Segmentation losses and metrics as expressions over pixel sums.

``operators.evaluate.pixel_sums`` reduces pixels to a few additive columns once; every metric
below is arithmetic on them. The same expression therefore serves one image, one batch or a
whole collection, depending only on how the sums were grouped.

Sums used: ``n`` pixels, ``tp`` = sum of t*p, ``st`` = sum of t, ``sp`` = sum of p, ``bce`` =
summed cross-entropy, with t the truth and p the (possibly soft) prediction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clipping and smoothing constants of the usual deep-learning losses (fixed values).
EPSILON = 1e-7
DICE_SMOOTH = 1e-9
DICE_LOSS_SMOOTH = 1.0
TVERSKY_ALPHA = 0.5
TVERSKY_GAMMA = 4 / 3

PixelLoss = Callable[[Column, Column], Column]


# --- per-pixel losses: (truth, prediction) -> column ----------------------------------------


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))


def cross_entropy(t: Column, p: Column) -> Column:
    p = clipped(p)
    return -(t * F.log(p) + (F.lit(1.0) - t) * F.log(F.lit(1.0) - p))


def huber(t: Column, p: Column, delta: float = 1.0) -> Column:
    gap = F.abs(t - p)
    return F.when(gap <= delta, F.lit(0.5) * gap * gap).otherwise(
        F.lit(delta) * gap - F.lit(0.5 * delta * delta)
    )


def hinge(t: Column, p: Column) -> Column:
    """Labels 0/1 are read as -1/+1."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - (t * 2.0 - 1.0) * p)


def poisson(t: Column, p: Column) -> Column:
    return p - t * F.log(p + F.lit(EPSILON))


def categorical_cross_entropy(label: Column, scores: Column) -> Column:
    """-ln of the score of the true class, after normalising and clipping the scores."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return -F.log(clipped(scores[label.cast("int")] / total))


# --- metrics over sums ----------------------------------------------------------------------


def dice(smooth: float = DICE_SMOOTH) -> Column:
    return (F.lit(2.0) * F.col("tp") + F.lit(smooth)) / (F.col("st") + F.col("sp") + F.lit(smooth))


def dice_loss(smooth: float = DICE_LOSS_SMOOTH) -> Column:
    return F.lit(1.0) - dice(smooth)


def bce() -> Column:
    return F.col("bce") / F.col("n")


def bce_dice_loss() -> Column:
    return bce() + (F.lit(1.0) - dice())


def focal_tversky(alpha: float = TVERSKY_ALPHA, gamma: float = TVERSKY_GAMMA) -> Column:
    missed = F.col("st") - F.col("tp")
    extra = F.col("sp") - F.col("tp")
    index = (F.col("tp") + F.lit(EPSILON)) / (
        F.col("tp") + F.lit(alpha) * missed + F.lit(1 - alpha) * extra + F.lit(EPSILON)
    )
    # Rounding can push a perfect index a hair above one, where the power is undefined.
    return F.pow(F.greatest(F.lit(1.0) - index, F.lit(0.0)), F.lit(1 / gamma))


def iou() -> Column:
    """Intersection over union; 1 when both masks are empty."""
    union = F.col("st") + F.col("sp") - F.col("tp")
    return F.when(union == 0, F.lit(1.0)).otherwise(F.col("tp") / union)


def iou_loss() -> Column:
    return F.lit(1.0) - iou()


def hybrid_loss() -> Column:
    return focal_tversky() + iou_loss()


def pixel_accuracy() -> Column:
    """Share of correctly labelled pixels, for hard masks."""
    true_negative = F.col("n") - F.col("st") - F.col("sp") + F.col("tp")
    return (F.col("tp") + true_negative) / F.col("n")


def mean_iou() -> Column:
    """Mean of the IoU of the inside and of the outside class, for hard masks."""
    true_negative = F.col("n") - F.col("st") - F.col("sp") + F.col("tp")
    outside_union = F.col("n") - F.col("tp")
    outside = F.when(outside_union == 0, F.lit(1.0)).otherwise(true_negative / outside_union)
    return (iou() + outside) / F.lit(2.0)
