"""Mixing sources to target weights by weighted sampling without replacement.

Efraimidis and Spirakis: a document with uniform u and quality weight w gets the exponential key
-ln(u) / w, and the smallest keys are selected. A source whose target exceeds its size is taken in
whole epochs first; the rest of its target is selected by key, up to the word that meets the
budget. Only DataFrame functions are used.

Heavy sources: keys fall into a fixed number of slots of exp(-key), an even spread for like
weights; sums per (source, slot) are combined before the shuffle, and the running sum of a document
is the sum of earlier slots plus a window inside its own slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the contract: weights of sources in order, and the most epochs.
SOURCE_WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
# How much likelier good, unlabelled and poor documents are in the partial epoch.
GOOD, PLAIN, POOR = 1.5, 1.0, 0.5
SLOTS = 4096
# 13 hex digits are 52 bits, exact as a double.
_UNIT = float(1 << 52)

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1] from seed and id, the same on every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 1.0) / _UNIT


def targets(sizes: DataFrame, weights: tuple = SOURCE_WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Shares stop at ``most`` times the source's size. Sources in order of size per weight reach
    their stop one after another, so the stopped ones are a prefix of that order: the level of
    each is the rest of all words over the rest of all weights. One narrow row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.select(
        "source", "source_size",
        F.get(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))).cast("long").alias("_w"),
    )
    stop = F.col("source_size") * most
    by_stop = Window.orderBy(stop / F.col("_w"), F.col("source").isNull(), "source")
    upto = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_stop.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum(stop).over(upto), F.lit(0))
    level = rest.cast("double") / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(upto), F.lit(0)))
    leveled = ranked.withColumn("_level", level).withColumn(
        "_stopped", stop.cast("double") <= F.col("_w") * F.col("_level")
    )
    free = F.min(F.when(~F.col("_stopped"), F.struct(stop / F.col("_w"), F.col("source").isNull(), "source", "_level")))
    level_all = free.over(whole)["_level"]
    return leveled.select(
        "source", "source_size",
        F.when(F.col("_stopped"), stop.cast("double")).otherwise(F.col("_w") * level_all).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: tuple = SOURCE_WEIGHTS,
    most: int = MAX_EPOCHS,
    seed: int = 42,
) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with mix_size, mix_source_size, mix_target, mix_epochs,
    mix_extra and mix_taken; columns of these names are replaced.

    ``quality`` (doc_id, quality 0/1) may cover some documents; several rows of a document are
    averaged. Whole copies are mix_epochs; mix_extra words more are taken of the document, which
    are all its words but for the one document per source at the budget's end.

    A null text has size 0 and takes nothing. Documents with a null id share one u and are
    ordered by their text. Repeated rows are documents of their own. Empty tables give no rows.
    """
    own = [c for c in docs.columns if not c.startswith("mix_")]
    sized = docs.select(*own).withColumns(
        {"mix_size": word_count(F.col("text")), "mix_tie": F.xxhash64("text")}
    )
    sums = sized.groupBy("source").agg(F.sum("mix_size").alias("source_size"))
    plan = targets(sums, weights, most).select(
        F.col("source").alias("mix_source"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
    )
    if quality is not None:
        known = quality.groupBy(F.col("doc_id").alias("mix_id")).agg(F.avg("quality").alias("mix_q"))
        sized = sized.join(known, F.col("doc_id") == F.col("mix_id"), "left").drop("mix_id")
        q = F.coalesce(F.lit(POOR) + F.col("mix_q") * (GOOD - POOR), F.lit(PLAIN))
    else:
        q = F.lit(PLAIN)
    keyed = sized.withColumn("mix_key", -F.log(uniform(F.col("doc_id"), seed)) / q)
    keyed = keyed.withColumn("mix_slot", F.floor((1 - F.exp(-F.col("mix_key"))) * SLOTS).cast("int"))
    slots = keyed.groupBy("source", "mix_slot").agg(F.sum("mix_size").alias("mix_sum"))
    earlier = Window.partitionBy("source").orderBy("mix_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(
        F.col("source").alias("mix_source"), F.col("mix_slot"),
        F.coalesce(F.sum("mix_sum").over(earlier), F.lit(0)).alias("mix_before"),
    )
    slots = slots.join(plan, slots.mix_source.eqNullSafe(plan.mix_source)).drop(plan.mix_source)
    placed = keyed.alias("d").join(
        slots.alias("s"),
        F.col("d.source").eqNullSafe(F.col("s.mix_source")) & (F.col("d.mix_slot") == F.col("s.mix_slot")),
    ).select("d.*", "s.mix_before", "s.mix_source_size", "s.mix_target")
    inside = (
        Window.partitionBy("source", "mix_slot")
        .orderBy("mix_key", "doc_id", "mix_size", "mix_tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.col("mix_before") + F.coalesce(F.sum("mix_size").over(inside), F.lit(0))
    budget = F.round("mix_target").cast("long")
    epochs = F.when(F.col("mix_source_size") > 0, F.floor(budget / F.col("mix_source_size"))).otherwise(0)
    left = F.col("mix_budget") - F.col("mix_epochs") * F.col("mix_source_size")
    extra = F.greatest(F.lit(0), F.least("mix_size", left - F.col("mix_upto")))
    return (
        placed.withColumn("mix_upto", before)
        .withColumn("mix_budget", budget)
        .withColumn("mix_epochs", epochs.cast("long"))
        .withColumn("mix_extra", extra.cast("long"))
        .withColumn("mix_taken", F.col("mix_epochs") * F.col("mix_size") + F.col("mix_extra"))
        .select(*own, "mix_size", "mix_source_size", "mix_target", "mix_epochs", "mix_extra", "mix_taken")
    )


def mix_rows(docs: DataFrame, quality: DataFrame | None = None, **settings) -> DataFrame:
    """The rows of the mix with the columns of ``docs``.

    What is taken is worked out on ids and sizes; texts are shuffled once, to meet it. Rows that
    share id and text are all taken as often as the one that is taken most.
    """
    key = F.xxhash64("text").alias("mix_hash")
    narrow = docs.select("doc_id", "source", "text", key.alias("hash_of_text"))
    taken = mix_sources(narrow, quality, **settings).groupBy(
        F.col("doc_id").alias("mix_id"), F.col("hash_of_text").alias("mix_hash")
    ).agg(F.max("mix_size").alias("mix_size"), F.max("mix_epochs").alias("mix_epochs"), F.max("mix_extra").alias("mix_extra"))
    taken = taken.where("mix_epochs > 0 OR mix_extra > 0")
    met = docs["doc_id"].eqNullSafe(taken["mix_id"]) & (F.xxhash64(docs["text"]) == taken["mix_hash"])
    size, epochs, extra = (taken[c] for c in ("mix_size", "mix_epochs", "mix_extra"))
    # One entry per copy; true for the copy that ends at the budget, which is cut at a word.
    none = F.array().cast("array<boolean>")
    whole = F.array_repeat(F.lit(False), (epochs + (extra >= size).cast("long")).cast("int"))
    part = F.when((extra > 0) & (extra < size), F.array(F.lit(True))).otherwise(none)
    copies = F.concat(F.when(size > 0, whole).otherwise(none), part)
    words = F.split(docs["text"], r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    leading = F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(1), extra.cast("int"))), "")
    # The cut text stands beside the whole one until the copies are told apart.
    rows = docs.join(taken, met).select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.when(F.size(part) > 0, leading).alias("cut"),
        F.explode(copies).alias("is_cut"),
    )
    return rows.select(*[
        F.when(F.col("is_cut"), F.col("cut")).otherwise(F.col("row.text")).alias("text") if c == "text" else F.col(f"row.`{c}`")
        for c in docs.columns
    ])
