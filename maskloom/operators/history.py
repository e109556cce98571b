"""Early stopping and best checkpoints over training histories.

One run may hold a large share of all epochs, so running minima are taken in two levels: inside
blocks of bounded size, and over one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.operators.index import ordered_index

# Rows of one window group.
BLOCK = 1 << 16


def epoch_index(df: DataFrame, run: str, *order: str | Column) -> DataFrame:
    """Add ``step``: a global rank in which the epochs of a run are consecutive."""
    return ordered_index(df, run, *order, name="step")


def _carried(df: DataFrame, run: str, value: Column, fold) -> DataFrame:
    """Per (run, block): the fold of ``value`` over all earlier blocks of the run."""
    blocks = df.groupBy(run, "_block").agg(fold(value).alias("_fold"))
    earlier = Window.partitionBy(run).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(run, "_block", fold("_fold").over(earlier).alias("_carry"))


def with_last_improvement(
    df: DataFrame, run: str = "run", step: str = "step", loss: str = "loss", block: int = BLOCK
) -> DataFrame:
    """Add ``improved`` (strictly below every earlier loss) and ``last_improved`` (its step)."""
    inside = Window.partitionBy(run, "_block").orderBy(step)
    blocked = df.withColumn("_block", F.floor(F.col(step) / F.lit(block)))
    lows = _carried(blocked, run, F.col(loss), F.min)
    before = F.min(loss).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    flagged = (
        blocked.join(lows, [run, "_block"])
        .withColumn("_low", F.least(before, F.col("_carry")))
        .withColumn("improved", F.col("_low").isNull() | (F.col(loss) < F.col("_low")))
        .drop("_low", "_carry")
    )
    mark = F.when(F.col("improved"), F.col(step))
    marks = _carried(flagged, run, mark, F.max)
    latest = F.max(mark).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        flagged.join(marks, [run, "_block"])
        .withColumn("last_improved", F.greatest(latest, F.col("_carry")))
        .drop("_carry", "_block")
    )


def early_stop(
    df: DataFrame,
    patience: int = 2,
    run: str = "run",
    step: str = "step",
    loss: str = "loss",
    block: int = BLOCK,
) -> DataFrame:
    """(run, stop_epoch, stopped): last epoch that is run, counted from 0.

    A run stops at the first epoch that is ``patience`` epochs past the last strict improvement of
    the loss, and otherwise at its last one.
    """
    marked = with_last_improvement(df, run, step, loss, block)
    due = (F.col(step) - F.col("last_improved")) >= max(patience, 1)
    ends = marked.groupBy(run).agg(
        F.min(step).alias("_start"),
        F.max(step).alias("_end"),
        F.min(F.when(due, F.col(step))).alias("_stop"),
    )
    return ends.select(
        run,
        (F.coalesce("_stop", "_end") - F.col("_start")).alias("stop_epoch"),
        F.col("_stop").isNotNull().alias("stopped"),
        F.col("_start").alias("start_step"),
    )


def best_checkpoint(
    df: DataFrame,
    stops: DataFrame | None = None,
    run: str = "run",
    step: str = "step",
    val_loss: str = "val_loss",
    block: int = BLOCK,
) -> DataFrame:
    """(run, best_epoch, best_val_loss): lowest validation loss, the first on ties.

    With ``stops`` from ``early_stop`` only the epochs that were run count.
    """
    blocked = df.withColumn("_block", F.floor(F.col(step) / F.lit(block)))
    if stops is not None:
        # Limits are joined per block of a run, so that a long run is spread over many keys.
        limits = blocked.select(run, "_block").distinct().join(
            stops.select(run, (F.col("start_step") + F.col("stop_epoch")).alias("_stop")), run
        )
        blocked = blocked.join(limits, [run, "_block"]).filter(F.col(step) <= F.col("_stop"))
    # An epoch after the stop is no candidate, and the first epoch always ran.
    best = blocked.groupBy(run).agg(
        F.min(F.struct(F.col(val_loss).alias("v"), F.col(step).alias("s"))).alias("_best"),
        F.min(step).alias("_start"),
    )
    return best.select(
        run,
        (F.col("_best.s") - F.col("_start")).alias("best_epoch"),
        F.col("_best.v").alias("best_val_loss"),
    )
