"""The same loop over several settings, compared by its scores."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.operators.index import ordered_index
from maskloom.plans.loop import CurationLoop, LoopSettings


def matrix(base: LoopSettings, **choices: Iterable) -> list[LoopSettings]:
    """Settings for every combination of the choices, with a run name made of them."""
    keys = list(choices)
    return [
        replace(
            base,
            run="-".join([base.run, *(f"{k}{i}" for k, (i, _) in zip(keys, picked))]),
            **{k: value for k, (_, value) in zip(keys, picked)},
        )
        for picked in product(*(list(enumerate(choices[k])) for k in keys))
    ]


def run_experiments(
    points: DataFrame, settings: Iterable[LoopSettings], runs: int = 1, **loop_arguments
) -> DataFrame:
    """Scores of all runs. A run is a series of Spark jobs over the whole points table."""
    tables = [
        CurationLoop(points, one, **loop_arguments).run(runs).scores_table() for one in settings
    ]
    return reduce(DataFrame.unionByName, tables)


def leaderboard(scores: DataFrame, model: str = "classifier") -> DataFrame:
    """(place, run, cycles, last_metric, best_metric), best last metric first."""
    per_run = (
        scores.filter(F.col("model") == model)
        .groupBy("run")
        .agg(
            F.max("cycle").alias("cycles"),
            F.max_by("metric", "cycle").alias("last_metric"),
            F.max("metric").alias("best_metric"),
        )
    )
    return ordered_index(per_run, F.col("last_metric").desc(), "run", name="place")
