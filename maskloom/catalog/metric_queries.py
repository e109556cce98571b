"""Metrics, losses and training histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.catalog.common import SQL_PX, images, query, r6, table
from maskloom.functions import arrays as a
from maskloom.functions import metrics as m
from maskloom.operators import evaluate as ev
from maskloom.operators import history as hist

_EPS = "1e-7::DOUBLE"
_CLIP = f"least(greatest(p, {_EPS}), 1 - {_EPS})"
_BCE = f"-(t * ln({_CLIP}) + (1 - t) * ln(1 - {_CLIP}))"


def _sums(by: str) -> str:
    """SQL of pixel sums by an expression."""
    return f"""sums AS (SELECT {by} AS k, count(*) AS n, sum(t * p) AS tp, sum(t) AS st, sum(p) AS sp,
       sum({_BCE}) AS bce FROM px GROUP BY 1)"""


_DICE = "(2 * tp + 1e-9::DOUBLE) / (st + sp + 1e-9::DOUBLE)"
_IOU = "CASE WHEN st + sp - tp = 0 THEN 1 ELSE tp / (st + sp - tp) END"
_TVERSKY = ("pow(greatest(1 - (tp + 1e-7::DOUBLE) / (tp + 0.5::DOUBLE * (st - tp) + 0.5::DOUBLE * (sp - tp)"
            " + 1e-7::DOUBLE), 0), 0.75::DOUBLE)")


def _soft(spark, folder):
    return images(spark, folder).withColumnRenamed("prob", "pred")


def _hard(spark, folder):
    return images(spark, folder).withColumn("pred", a.threshold("prob"))


@query(f"WITH {SQL_PX}, {_sums('pos')} SELECT k AS pos, round({_DICE}, 6) AS dice FROM sums")
def dice_image(spark, folder):
    """Dice of every picture."""
    return ev.pixel_sums(_soft(spark, folder), "pos").select("pos", r6(m.dice()).alias("dice"))


@query(f"WITH {SQL_PX}, {_sums('pos // 32')} SELECT k AS batch, round({_DICE}, 6) AS dice FROM sums")
def dice_batch32(spark, folder):
    """Dice of every batch of 32 pictures."""
    sums = ev.pixel_sums(_soft(spark, folder), "pos")
    return ev.batch_sums(sums, idx="pos").select("batch", r6(m.dice()).alias("dice"))


@query(f"WITH {SQL_PX}, {_sums('0')} SELECT round({_DICE}, 6) AS dice, n FROM sums")
def dice_global(spark, folder):
    """Dice over all pixels of the collection."""
    return ev.pixel_sums(_soft(spark, folder)).select(r6(m.dice()).alias("dice"), "n")


@query(f"""WITH {SQL_PX}, {_sums('pos')} SELECT k AS pos,
  round(1 - (2 * tp + 1) / (st + sp + 1), 6) AS dice_loss FROM sums""")
def dice_loss(spark, folder):
    sums = ev.pixel_sums(_soft(spark, folder), "pos", with_bce=False)
    return sums.select("pos", r6(m.dice_loss()).alias("dice_loss"))


@query(f"WITH {SQL_PX}, {_sums('pos')} SELECT k AS pos, round(bce / n, 6) AS bce FROM sums")
def bce(spark, folder):
    return ev.pixel_sums(_soft(spark, folder), "pos").select("pos", r6(m.bce()).alias("bce"))


@query(f"WITH {SQL_PX}, {_sums('pos')} SELECT k AS pos, round(bce / n + (1 - {_DICE}), 6) AS loss FROM sums")
def bce_dice(spark, folder):
    return ev.pixel_sums(_soft(spark, folder), "pos").select("pos", r6(m.bce_dice_loss()).alias("loss"))


@query(f"WITH {SQL_PX}, {_sums('pos')} SELECT k AS pos, round({_TVERSKY}, 6) AS loss FROM sums")
def focal_tversky(spark, folder):
    sums = ev.pixel_sums(_soft(spark, folder), "pos", with_bce=False)
    return sums.select("pos", r6(m.focal_tversky()).alias("loss"))


@query(f"WITH {SQL_PX}, {_sums('pos')} SELECT k AS pos, round(1 - {_IOU}, 6) AS loss FROM sums")
def iou_loss(spark, folder):
    sums = ev.pixel_sums(_soft(spark, folder), "pos", with_bce=False)
    return sums.select("pos", r6(m.iou_loss()).alias("loss"))


@query(f"WITH {SQL_PX}, {_sums('pos')} SELECT k AS pos, round({_TVERSKY} + (1 - {_IOU}), 6) AS loss FROM sums")
def hybrid_loss(spark, folder):
    sums = ev.pixel_sums(_soft(spark, folder), "pos", with_bce=False)
    return sums.select("pos", r6(m.hybrid_loss()).alias("loss"))


@query(f"""WITH {SQL_PX}, c AS (
    SELECT label, count(*) FILTER (WHERE t = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE t = 0 AND p >= 0.5) AS fp,
           count(*) FILTER (WHERE t = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE t = 0 AND p < 0.5) AS tn
    FROM px GROUP BY label)
  SELECT label::BIGINT AS label, round(tp / (tp + fp + fn), 6) AS iou,
         round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
         round((tp / (tp + fp + fn) + tn / (tn + fp + fn)) / 2, 6) AS mean_iou FROM c""")
def iou_accuracy(spark, folder):
    """IoU, pixel accuracy and mean IoU of the hard masks per class of pictures."""
    sums = ev.pixel_sums(_hard(spark, folder), "label", with_bce=False)
    return sums.select(
        F.col("label").cast("bigint").alias("label"), r6(m.iou()).alias("iou"),
        r6(m.pixel_accuracy()).alias("accuracy"), r6(m.mean_iou()).alias("mean_iou"),
    )


@query(f"""WITH {SQL_PX} SELECT label::BIGINT AS label,
  round(avg(CASE WHEN abs(t - p) <= 0.5 THEN 0.5::DOUBLE * (t - p) * (t - p)
            ELSE 0.5::DOUBLE * abs(t - p) - 0.125::DOUBLE END), 6) AS huber,
  round(avg(greatest(0, 1 - (2 * t - 1) * p)), 6) AS hinge,
  round(avg(p - t * ln(p + {_EPS})), 6) AS poisson FROM px GROUP BY label""")
def huber_hinge_poisson(spark, folder):
    """Per-pixel losses handed in as functions of (truth, prediction)."""
    losses = {"huber": lambda t, p: m.huber(t, p, 0.5), "hinge": m.hinge, "poisson": m.poisson}
    sums = ev.pixel_sums(_soft(spark, folder), "label", extra=losses, with_bce=False)
    return sums.select(
        F.col("label").cast("bigint").alias("label"),
        *[r6(F.col(name) / F.col("n")).alias(name) for name in losses],
    )


@query(f"""WITH {SQL_PX}, s AS (
    SELECT pos, i % 10 AS k, any_value(label) AS label, sum(x + 1) AS score FROM px GROUP BY pos, i % 10),
  j AS (SELECT pos, arg_max(k, (score, -k)) AS verdict, any_value(label) AS label, sum(score) AS total,
               max(CASE WHEN k = label THEN score END) AS hit FROM s GROUP BY pos)
  SELECT round(avg(-ln(least(greatest(hit / total, {_EPS}), 1 - {_EPS}))), 6) AS loss,
         round(avg((verdict = label)::INTEGER), 6) AS metric FROM j""")
def cce_accuracy(spark, folder):
    """Categorical cross-entropy and accuracy of ten scores per picture, each a sum of pixels."""

    def score(k):
        mine = F.filter("image", lambda _, i: i % 10 == k)
        return F.aggregate(mine, F.lit(0.0), lambda acc, x: acc + x.cast("double") + 1)

    scores = F.transform(F.sequence(F.lit(0), F.lit(9)), score)
    scored = images(spark, folder).select("label", scores.alias("scores"))
    return ev.evaluate_classes(scored).select(r6("loss").alias("loss"), r6("metric").alias("metric"))


@query("""WITH j AS (SELECT d.lang, quality, toxic FROM labels JOIN documents d USING (doc_id))
  SELECT lang, count(*) AS n, round(sum(quality * toxic) * 2 / (sum(quality) + sum(toxic)), 6) AS dice,
         round(avg((quality = toxic)::INTEGER), 6) AS accuracy FROM j GROUP BY lang""")
def label_agreement(spark, folder):
    """Two binary labels per document compared by language."""
    joined = table(spark, folder, "labels").join(
        table(spark, folder, "documents").select("doc_id", "lang"), "doc_id"
    )
    t, p = F.col("quality").cast("double"), F.col("toxic").cast("double")
    sums = joined.groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(t * p).alias("tp"), F.sum(t).alias("st"), F.sum(p).alias("sp")
    )
    return sums.select(
        "lang", "n", r6(m.dice(0.0)).alias("dice"), r6(m.pixel_accuracy()).alias("accuracy")
    )


@query(f"""WITH {SQL_PX}, {_sums('pos // 32')}, b AS (
    SELECT n / 64 AS images, bce / n + (1 - {_DICE}) AS loss, {_DICE} AS metric FROM sums)
  SELECT round(sum(loss * images) / sum(images), 6) AS loss, round(avg(metric), 6) AS metric FROM b""")
def segmenter_evaluation(spark, folder):
    """Loss and metric as an evaluation in batches of 32 reports them."""
    sums = ev.pixel_sums(_soft(spark, folder), "pos").withColumnRenamed("pos", "idx")
    return ev.evaluate_segmenter(sums).select(r6("loss").alias("loss"), r6("metric").alias("metric"))


# --- training histories ---------------------------------------------------------------------


def _history(spark, folder):
    """Events as epochs: run = user, loss = value, validation loss = the counter in the properties."""
    events = table(spark, folder, "events")
    rows = events.select(
        F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("loss"),
        F.get_json_object("props", "$.k").cast("double").alias("val_loss"),
    )
    return hist.epoch_index(rows, "run", "ts", "event_id")


SQL_HISTORY = """
hist AS (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch,
         value AS loss, CAST(props->>'$.k' AS DOUBLE) AS val_loss FROM events
), low AS (
  SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM hist
), marked AS (
  SELECT *, max(CASE WHEN prev IS NULL OR loss < prev THEN epoch END)
         OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS last_improved FROM low
), stops AS (
  SELECT run, coalesce(min(CASE WHEN epoch - last_improved >= 5 THEN epoch END), max(epoch)) AS stop_epoch,
         min(CASE WHEN epoch - last_improved >= 5 THEN epoch END) IS NOT NULL AS stopped
  FROM marked GROUP BY run
)
"""


@query(f"WITH {SQL_HISTORY} SELECT run, stop_epoch, stopped FROM stops")
def early_stop(spark, folder):
    """Epoch at which each run stops with a patience of 5."""
    return hist.early_stop(_history(spark, folder), 5).select("run", "stop_epoch", "stopped")


@query(f"""WITH {SQL_HISTORY}, ran AS (SELECT hist.* FROM hist JOIN stops USING (run) WHERE epoch <= stop_epoch)
  SELECT run, arg_min(epoch, (val_loss, epoch)) AS best_epoch, min(val_loss) AS best_val_loss FROM ran GROUP BY run""")
def best_checkpoint(spark, folder):
    """Epoch with the lowest validation loss among those run."""
    rows = _history(spark, folder)
    return hist.best_checkpoint(rows, hist.early_stop(rows, 5))


@query(f"WITH {SQL_HISTORY} SELECT run, arg_min(epoch, (val_loss, epoch)) AS best_epoch, "
       "min(val_loss) AS best_val_loss FROM hist GROUP BY run")
def best_checkpoint_all(spark, folder):
    """The same over all epochs."""
    return hist.best_checkpoint(_history(spark, folder))
