"""Steps of the curation loop, learners, and whole runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from maskloom.catalog.common import (
    SQL_POINTS, SQL_PX, images, order_points, query, r6, sql_double, sql_key, sql_share, table,
)
from maskloom.catalog.split_queries import SQL_SETUP
from maskloom.functions import masks
from maskloom.functions import metrics as m
from maskloom.operators import curation as cur
from maskloom.operators import evaluate as ev
from maskloom.operators import registry as reg
from maskloom.operators import splits
from maskloom.operators.sampling import draw_one
from maskloom.plans import experiments, learners
from maskloom.plans.loop import (
    BASE, BUILT_C, FOUND, JUDGED, PREDICTED, RELABELED, SETUP, SPLIT_C, TRAINED, UPDATED, CurationLoop, LoopSettings,
)
from maskloom.session import cut_lineage, shared_dir
from maskloom.sources import tables

W = splits.DEFAULT_WEIGHTS
LIMIT = 250_000.0


# --- membership steps on orders -------------------------------------------------------------
# An order above LIMIT stands for a point judged machine.


def _state(spark, folder):
    """(points, n, registry with A_test_pred, sizes) after the prediction step."""
    points = order_points(spark, folder)
    n = points.count()
    members = splits.setup_split(points, n, W).withColumn("value", F.lit(None).cast("int"))
    predicted = members.filter(F.col("collection") == "A_test").withColumn(
        "collection", F.lit("A_test_pred")
    )
    sizes = dict(zip(("A_train", "A_val", "A_test"), splits.a_part_sizes(n, W)))
    sizes.update(zip("ABZ", splits.abz_sizes(n, W)))
    return points, n, reg.register_all(members, predicted, ["A_test_pred"]), sizes


def _c(spark, folder):
    points, n, members, sizes = _state(spark, folder)
    machine, expert = cur.members_of(members, "A_test_pred"), cur.members_of(members, "B")
    c_rows = cur.build_c(machine, expert, sizes["A_test"], sizes["B"])
    shuffled = cut_lineage(cur.shuffle_c(c_rows, 1))
    return points, n, members, sizes, cur.slice_c(shuffled, splits.c_part_sizes(n, W))


def _d(spark, folder):
    points, n, members, sizes, parts = _c(spark, folder)
    c_test = reg.collection_of(parts, "C_test")
    judged = points.select("point_id", (F.col("value") > LIMIT).cast("int").alias("verdict"))
    return members, sizes, cur.machine_labels(c_test, judged)


def _sql_c(cycle: int = 1, state: str = "members", suffix: str = "") -> str:
    """C of a cycle, its random order and its parts, from a membership table expression."""
    return f"""
c{suffix} AS (
  SELECT point_id, ord AS place, 1 AS value, 0 AS side FROM {state} WHERE collection = 'A_test'
  UNION ALL SELECT point_id, ord, 0, 1 FROM {state} WHERE collection = 'B'
), c_ranked{suffix} AS (
  SELECT *, row_number() OVER (ORDER BY {sql_key(f'shuffle{cycle}')}, point_id) - 1 AS idx FROM c{suffix}
), cs{suffix} AS (
  SELECT {sql_share('n', W.B, W.B_train)} AS c_tr, {sql_share('n', W.B, W.B_val)} AS c_va,
         {sql_share('n', W.B, W.B_test)} AS c_te FROM cnt
), parts{suffix} AS (
  SELECT CASE WHEN idx < c_tr THEN 'C_train' WHEN idx < c_tr + c_va THEN 'C_val' ELSE 'C_test' END
           AS collection, point_id, value,
         CASE WHEN idx < c_tr THEN idx WHEN idx < c_tr + c_va THEN idx - c_tr
              ELSE idx - c_tr - c_va END AS ord
  FROM c_ranked{suffix}, cs{suffix} WHERE idx < c_tr + c_va + c_te
)"""


def _sql_update(cycle: int = 1, state: str = "members", suffix: str = "") -> str:
    """Sample of D with origins, refills, and the state after the moves; needs d (point_id, value)."""
    return f"""
d_ranked{suffix} AS (
  SELECT point_id, value, count(*) OVER () AS n_d,
         row_number() OVER (ORDER BY {sql_key(f'relabel{cycle}')}, point_id) - 1 AS idx FROM d{suffix}
), selected{suffix} AS (
  SELECT s.point_id, s.value, s.idx,
         CASE WHEN a.point_id IS NOT NULL THEN 'A_test' WHEN b.point_id IS NOT NULL THEN 'B' END AS origin
  FROM d_ranked{suffix} s
  LEFT JOIN (SELECT point_id FROM {state} WHERE collection = 'A_test') a ON a.point_id = s.point_id
  LEFT JOIN (SELECT point_id FROM {state} WHERE collection = 'B') b ON b.point_id = s.point_id
  WHERE idx < n_d // 3
), fills{suffix} AS (
  SELECT z.point_id, s.idx, s.origin FROM (
    SELECT point_id, row_number() OVER (ORDER BY {sql_key(f'fill{cycle}')}, point_id) - 1 AS idx
    FROM {state} WHERE collection = 'Z') z JOIN selected{suffix} s USING (idx)
), tops{suffix} AS (
  SELECT max(ord) FILTER (WHERE collection = 'A_train') AS t_train,
         max(ord) FILTER (WHERE collection = 'A_test') AS t_test,
         max(ord) FILTER (WHERE collection = 'B') AS t_b FROM {state}
), updated{suffix} AS (
  SELECT CASE WHEN s.point_id IS NOT NULL AND collection = s.origin THEN 'A_train'
              WHEN f.point_id IS NOT NULL AND collection = 'Z' THEN f.origin ELSE collection END
           AS collection, m.point_id,
         CASE WHEN s.point_id IS NOT NULL AND collection = s.origin THEN t_train + 1 + s.idx
              WHEN f.point_id IS NOT NULL AND collection = 'Z'
                THEN CASE f.origin WHEN 'A_test' THEN t_test ELSE t_b END + 1 + f.idx
              ELSE ord END AS ord
  FROM {state} m LEFT JOIN selected{suffix} s ON s.point_id = m.point_id
  LEFT JOIN fills{suffix} f ON f.point_id = m.point_id, tops{suffix}
)"""


SQL_SELECTED = _sql_update()

SQL_ORDERS_D = f"""{SQL_POINTS}, {SQL_SETUP}, {_sql_c()}, d AS (
  SELECT parts.point_id, parts.value, parts.ord FROM parts JOIN pts USING (point_id)
  WHERE collection = 'C_test' AND pts.value > {LIMIT}::DOUBLE
)"""


@query(f"""WITH {SQL_POINTS}, {SQL_SETUP}, {_sql_c()}
  SELECT point_id, side, place, value FROM c""")
def build_c(spark, folder):
    """Machine and expert rows in one collection, labelled."""
    _, _, members, sizes = _state(spark, folder)
    machine, expert = cur.members_of(members, "A_test_pred"), cur.members_of(members, "B")
    c_rows = cur.build_c(machine, expert, sizes["A_test"], sizes["B"])
    return c_rows.select("point_id", "place.side", F.col("place.ord").alias("place"), "value")


@query(f"""WITH {SQL_POINTS}, {SQL_SETUP}, {_sql_c()}
  SELECT collection, point_id, ord, value FROM parts""")
def c_parts(spark, folder):
    """Parts of shuffled C with their labels."""
    return _c(spark, folder)[4]


@query(f"WITH {SQL_ORDERS_D} SELECT point_id, ord, value FROM d")
def machine_labels(spark, folder):
    """D: rows of C_test judged machine."""
    return _d(spark, folder)[2].select("point_id", "ord", "value")


@query(f"WITH {SQL_ORDERS_D}, {SQL_SELECTED} SELECT point_id, value, idx, origin FROM selected")
def relabel_sample(spark, folder):
    """Sample of D with rank and origin."""
    members, _, d_rows = _d(spark, folder)
    return cur.select_for_relabel(d_rows, members, 30, 1)


def _updated(members, d_rows):
    selected = cur.select_for_relabel(d_rows, members, 30, 1)
    ranked = cut_lineage(selected.withColumn("rank", F.col("idx")))
    n_moved = ranked.count()
    moves = cur.relabel_moves(ranked).unionByName(cur.refill_moves(ranked, members, n_moved, 1))
    return reg.move(members, moves)


@query(f"WITH {SQL_ORDERS_D}, {SQL_SELECTED} SELECT collection, point_id, ord FROM updated")
def move_refill(spark, folder):
    """Sampled points move to A_train and are replaced from Z."""
    members, _, d_rows = _d(spark, folder)
    moved = _updated(members, d_rows).filter(F.col("collection") != "A_test_pred")
    return moved.select("collection", "point_id", "ord")


@query(f"""WITH {SQL_ORDERS_D}, {SQL_SELECTED}, again AS (
    SELECT point_id, count(*) OVER () AS n_d,
           row_number() OVER (ORDER BY {sql_key('relabel2')}, point_id) - 1 AS idx FROM d)
  SELECT point_id FROM again WHERE idx < n_d // 3 AND point_id NOT IN
    (SELECT point_id FROM updated WHERE collection IN ('A_test', 'B'))""")
def lost_points(spark, folder):
    """Ids of a second sample from the same D that have left A_test and B meanwhile."""
    members, _, d_rows = _d(spark, folder)
    d_rows = cut_lineage(d_rows)
    return cur.lost_points(cur.select_for_relabel(d_rows, _updated(members, d_rows), 30, 2))


def _sql_balance(before: str, state: str) -> str:
    """Which points of A_train, B and A_test change places, by the cases of the rule.

    ``before`` gives the sizes (tr, b, te). A donor keeps one more than the third; with two sets
    above it both give to the smallest, else the middle one is filled first.
    """
    return f"""bal_before AS ({before}),
  bal_set AS (
    SELECT *, row_number() OVER (ORDER BY size DESC, place) AS r FROM (
      SELECT 'A_train' AS name, tr AS size, 0 AS place FROM bal_before
      UNION ALL SELECT 'B', b, 1 FROM bal_before UNION ALL SELECT 'A_test', te, 2 FROM bal_before)),
  bal_three AS (
    SELECT max(name) FILTER (WHERE r = 1) AS big, max(name) FILTER (WHERE r = 2) AS mid,
           max(name) FILTER (WHERE r = 3) AS low, max(size) FILTER (WHERE r = 2) AS n_mid,
           max(size) FILTER (WHERE r = 3) AS n_low, sum(size) // 3 AS third,
           greatest(0, max(size) FILTER (WHERE r = 1) - sum(size) // 3 - 1) AS spare_big,
           greatest(0, max(size) FILTER (WHERE r = 2) - sum(size) // 3 - 1) AS spare_mid FROM bal_set),
  bal_plan AS (
    SELECT big AS donor, low AS receiver, 0 AS low_idx, spare_big AS end_idx, 1 AS r FROM bal_three WHERE n_mid > third
    UNION ALL SELECT mid, low, 0, spare_mid, 2 FROM bal_three WHERE n_mid > third
    UNION ALL SELECT big, mid, 0, least(third - n_mid, spare_big), 1 FROM bal_three WHERE n_mid <= third
    UNION ALL SELECT big, low, least(third - n_mid, spare_big),
                     least(third - n_mid + third - n_low, spare_big), 1 FROM bal_three WHERE n_mid <= third),
  bal_donor AS (
    SELECT donor, row_number() OVER (ORDER BY min(r)) - 1 AS number, count(*) OVER () AS donors
    FROM bal_plan WHERE end_idx > low_idx GROUP BY donor),
  bal_ranked AS (
    SELECT collection, point_id, ord,
           row_number() OVER (PARTITION BY collection ORDER BY {sql_key('balance1')}, point_id) - 1 AS idx
    FROM {state} WHERE collection IN ('A_train', 'B', 'A_test')),
  bal_top AS (SELECT collection AS receiver, max(ord) AS top FROM {state} GROUP BY collection),
  balanced AS (
    SELECT coalesce(receiver, collection) AS collection, point_id,
           CASE WHEN receiver IS NULL THEN ord ELSE top + 1 + idx * donors + number END AS ord
    FROM bal_ranked LEFT JOIN bal_plan ON bal_plan.donor = collection AND idx >= low_idx AND idx < end_idx
    LEFT JOIN bal_donor ON bal_donor.donor = collection LEFT JOIN bal_top USING (receiver))"""


@query(f"""WITH {SQL_POINTS}, {SQL_SETUP}, {_sql_balance('SELECT tr, b, te FROM sz', 'members')}
  SELECT collection, point_id, ord FROM balanced""")
def rebalance(spark, folder):
    """A_train, B and A_test brought towards equal sizes."""
    _, _, members, sizes = _state(spark, folder)
    plan = cur.balance_plan({name: sizes[name] for name in cur.BALANCED})
    moved = reg.move(members, cur.balance_moves(members, plan, 1))
    return moved.filter(F.col("collection").isin(*cur.BALANCED)).select("collection", "point_id", "ord")


@query(f"""WITH {SQL_POINTS}, {SQL_SETUP}, pick AS (
    SELECT arg_min(point_id, {sql_key('transfer')} || point_id) AS point_id FROM members WHERE collection = 'Z'),
  m AS (SELECT CASE WHEN collection = 'Z' AND point_id IN (SELECT point_id FROM pick) THEN 'B'
               ELSE collection END AS collection, point_id FROM members)
  SELECT collection, count(*) AS n_points,
         count(*) FILTER (WHERE point_id IN (SELECT point_id FROM pick)) AS n_picked
  FROM m GROUP BY collection""")
def transfer_one(spark, folder):
    """One random point from Z to B."""
    _, _, members, _ = _state(spark, folder)
    members = members.filter(F.col("collection") != "A_test_pred")
    picked = draw_one(cur.members_of(members, "Z"), "transfer").withColumn("hit", F.lit(1))
    moved = cur.transfer_one(members, "Z", "B").join(F.broadcast(picked), "point_id", "left")
    return moved.groupBy("collection").agg(
        F.count("*").alias("n_points"), F.count("hit").alias("n_picked")
    )


# --- learners on pictures -------------------------------------------------------------------

# A grid without 0, so that the best cut differs from the truth's.
GRID = dict(low=-0.19, high=0.19, steps=20)
CUTS = learners.ThresholdSegmenter(**GRID).grid(GRID["low"], GRID["high"])
SQL_CUTS = "cuts(cut) AS (VALUES " + ", ".join(f"({sql_double(c)})" for c in CUTS) + ")"
_DICE = "(2 * tp + 1e-9::DOUBLE) / (st + sp + 1e-9::DOUBLE)"


@query(f"""WITH {SQL_PX}, {SQL_CUTS}, s AS (
    SELECT label, cut, sum(CASE WHEN x >= cut THEN t ELSE 0 END) AS tp,
           count(*) FILTER (WHERE x >= cut)::DOUBLE AS sp, sum(t) AS st FROM px, cuts GROUP BY label, cut)
  SELECT label::BIGINT AS label, round(cut, 6) AS cut, tp, sp, st, round({_DICE}, 6) AS dice FROM s""")
def threshold_segmenter(spark, folder):
    """Dice of every cut of a grid per class of pictures, from one pass over the pixels."""
    points = images(spark, folder)
    scores = learners.cut_scores(learners.cut_histogram(points, CUTS, "label"), CUTS, "label")
    return scores.select(
        F.col("label").cast("bigint").alias("label"), r6("cut").alias("cut"), "tp", "sp", "st",
        r6("dice").alias("dice"),
    )


@query(f"""WITH {SQL_PX} SELECT p.pos, p.i, round(any_value(p.x), 6) AS x, round(avg(q.x), 6) AS mean3,
       round(any_value(p.t), 6) AS t
  FROM px p JOIN px q ON p.pos = q.pos AND abs(p.r - q.r) <= 1 AND abs(p.c - q.c) <= 1 GROUP BY p.pos, p.i""")
def pixel_features(spark, folder):
    """Intensity and neighbourhood mean of every pixel."""
    rows = learners.pixel_features(images(spark, folder), "pos")
    return rows.select(
        "pos", F.col("i").cast("bigint").alias("i"), r6("x").alias("x"), r6("mean3").alias("mean3"),
        r6("t").alias("t"),
    )


# Pairs for the discriminators: odd classes carry a machine mask (cut at 0.02), the others the truth.
PAIR_CUT = 0.02


def _pairs(spark, folder):
    points = images(spark, folder)
    machine = F.col("label") % 2
    cut = F.transform("image", lambda x: F.when(x.cast("double") >= PAIR_CUT, 1.0).otherwise(0.0))
    return points.select(
        "point_id", "pos", "h", "w", "image",
        F.when(machine == 1, cut).otherwise(F.col("truth")).alias("mask"), machine.alias("label"),
    )


SQL_PAIRS = f"""{SQL_PX}, pair AS (
  SELECT pos, i, r, c, x, label % 2 AS label,
         CASE WHEN label % 2 = 1 THEN (x >= {sql_double(PAIR_CUT)})::INTEGER ELSE t::INTEGER END AS m FROM px
), agree AS (
  SELECT pos, label, avg((m = (x >= {sql_double(PAIR_CUT)})::INTEGER)::INTEGER) AS agreement,
         avg(m) AS area, coalesce(avg(x) FILTER (WHERE m = 1), 0) AS mean_in,
         coalesce(avg(x) FILTER (WHERE m = 0), 0) AS mean_out FROM pair GROUP BY pos, label
), edge AS (
  SELECT a.pos, count(*) AS edges FROM pair a JOIN pair b
    ON a.pos = b.pos AND ((b.r = a.r AND b.c = a.c + 1) OR (b.c = a.c AND b.r = a.r + 1))
  WHERE a.m <> b.m GROUP BY a.pos
)"""


@query(f"""WITH {SQL_PAIRS} SELECT pos, label::BIGINT AS label, round(area, 6) AS area,
       round(mean_in, 6) AS mean_in, round(mean_out, 6) AS mean_out,
       round(coalesce(edges, 0) / 64.0::DOUBLE, 6) AS edge_rate, round(agreement, 6) AS agreement
  FROM agree LEFT JOIN edge USING (pos)""")
def pair_features(spark, folder):
    """Features of every (picture, mask) pair."""
    rows = learners.pair_features(_pairs(spark, folder), PAIR_CUT, "pos", "label")
    return rows.select(
        "pos", F.col("label").cast("bigint").alias("label"),
        *[r6(name).alias(name) for name in learners.FEATURES],
    )


@query(f"""WITH {SQL_PAIRS}, taus AS (SELECT k, (k - 0.5::DOUBLE) / 64 AS tau FROM range(65) AS r(k)),
  acc AS (SELECT k, any_value(tau) AS tau, avg(((agreement >= tau)::INTEGER = label)::INTEGER) AS accuracy
          FROM agree, taus GROUP BY k),
  best AS (SELECT arg_max(tau, (accuracy, -k)) AS tau FROM acc)
  SELECT pos, label::BIGINT AS label, (agreement > tau)::INTEGER AS verdict,
         round(1 / (1 + exp(-20 * (agreement - tau))), 6) AS machine FROM agree, best""")
def rule_discriminator(spark, folder):
    """Agreement rule fitted on all pairs, and its verdicts."""
    pairs = _pairs(spark, folder)
    model = learners.AgreementDiscriminator(PAIR_CUT).fit(pairs, pairs)
    judged = model.transform(pairs).join(pairs.select("point_id", "pos"), "point_id")
    return judged.select(
        "pos", F.col("label").cast("bigint").alias("label"), F.col("verdict").cast("int").alias("verdict"),
        r6(F.col("scores")[1]).alias("machine"),
    )


@query()
def mllib_segmenter(spark, folder):
    """Logistic pixel model fitted on one half of the pictures, Dice on the other by class."""
    points = images(spark, folder)
    half = points.count() // 2
    first, second = points.filter(F.col("pos") < half), points.filter(F.col("pos") >= half)
    model = learners.make_segmenter("pixel_logistic", epochs=10).fit(first, second)
    sums = ev.pixel_sums(model.transform(second), "label", pred="mask", with_bce=False)
    return sums.select("label", r6(m.dice()).alias("dice"))


@query()
def mllib_discriminator(spark, folder):
    """Logistic pair model over a small grid of penalties, and its confusion counts."""
    pairs = _pairs(spark, folder)
    half = pairs.count() // 2
    first, second = pairs.filter(F.col("pos") < half), pairs.filter(F.col("pos") >= half)
    model = learners.make_discriminator(
        "pair_logistic", cut=PAIR_CUT, grid={"regParam": [0.001, 0.1]}
    ).fit(first, second)
    return model.transform(second).groupBy("label", "verdict").agg(F.count("*").alias("n"))


# --- fits by additive sums ------------------------------------------------------------------
# The counterparts take the same steps over all rows, one table of sums and weights per epoch.

EPOCHS, REG, RATE = 5, 0.01, 2.0


def _sql_sums(k: int, rows: str, features: tuple[str, ...], newton: bool) -> str:
    """Table s{k}: means of log loss, accuracy, gradient and curvature at the weights of w{k}."""
    inputs = ("1.0::DOUBLE", *features)
    score = " + ".join(f"w{j} * {x}" for j, x in enumerate(inputs))
    means = [f"avg(CASE WHEN part = 'train' THEN (q - t) * {x} END) AS g{j}" for j, x in enumerate(inputs)]
    if newton:
        means += [
            f"avg(CASE WHEN part = 'train' THEN q * (1 - q) * {inputs[i]} * {inputs[j]} END) AS h{i}{j}"
            for i in range(len(inputs)) for j in range(i, len(inputs))
        ]
    loss = "greatest(z, 0) - t * z + ln(1 + exp(-abs(z)))"
    return f"""s{k} AS MATERIALIZED (
    SELECT {', '.join(means)},
           avg({loss}) FILTER (WHERE part = 'train') AS loss, avg({loss}) FILTER (WHERE part = 'val') AS val_loss,
           avg(((z >= 0) = (t > 0.5))::INTEGER) FILTER (WHERE part = 'train') AS metric,
           avg(((z >= 0) = (t > 0.5))::INTEGER) FILTER (WHERE part = 'val') AS val_metric
    FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-z)) AS q
          FROM (SELECT *, {score} AS z FROM {rows}, w{k})))"""


def _sql_newton(k: int) -> str:
    """Table w{k + 1}: a Newton step for an intercept and two weights, by Cramer's rule."""
    r = sql_double(REG)
    a = [["h00", "h01", "h02"], ["h01", f"(h11 + {r})", "h12"], ["h02", "h12", f"(h22 + {r})"]]
    b = ["g0", f"(g1 + {r} * w1)", f"(g2 + {r} * w2)"]

    def det(m) -> str:
        (p, q, s), (d, e, f), (x, y, z) = m
        return f"({p} * ({e} * {z} - {f} * {y}) - {q} * ({d} * {z} - {f} * {x}) + {s} * ({d} * {y} - {e} * {x}))"

    def replaced(j: int):
        return [[b[i] if c == j else a[i][c] for c in range(3)] for i in range(3)]

    steps = ", ".join(f"w{j} - {det(replaced(j))} / {det(a)} AS w{j}" for j in range(3))
    return f"w{k + 1} AS MATERIALIZED (SELECT {steps} FROM s{k}, w{k})"


def _sql_gradient(k: int, n: int) -> str:
    """Table w{k + 1}: a plain gradient step, the penalty sparing the intercept."""
    r, rate = sql_double(REG), sql_double(RATE)
    steps = [f"w0 - {rate} * g0 AS w0"] + [f"w{j} - {rate} * (g{j} + {r} * w{j}) AS w{j}" for j in range(1, n)]
    return f"w{k + 1} AS MATERIALIZED (SELECT {', '.join(steps)} FROM s{k}, w{k})"


def _sql_fit(rows: str, features: tuple[str, ...], newton: bool) -> str:
    n = len(features) + 1
    tables = [f"w0 AS (SELECT {', '.join(f'0.0::DOUBLE AS w{j}' for j in range(n))})"]
    for k in range(EPOCHS):
        tables += [_sql_sums(k, rows, features, newton), _sql_newton(k) if newton else _sql_gradient(k, n)]
    return ", ".join(tables)


def _sql_epochs(n: int) -> str:
    weights = ", ".join(f"round(w{j}, 6) AS w{j}" for j in range(n))
    return " UNION ALL ".join(
        f"SELECT {k} AS epoch, round(loss, 6) AS loss, round(metric, 6) AS metric, round(val_loss, 6) AS val_loss, "
        f"round(val_metric, 6) AS val_metric, {weights} FROM s{k}, w{k}" for k in range(EPOCHS)
    )


def _epochs(spark, fit):
    """The epochs of a fit with their weights, as its callback sees them."""
    seen = []
    fit(lambda *row: seen.append((*row[:5], *row[5])))
    n = len(seen[0]) - 5
    names = ["loss", "metric", "val_loss", "val_metric", *[f"w{j}" for j in range(n)]]
    schema = "epoch int, " + ", ".join(f"{name} double" for name in names)
    return spark.createDataFrame(seen, schema).select("epoch", *[r6(name).alias(name) for name in names])


@query(f"""WITH {SQL_PX}, near AS (
    SELECT a.pos, a.i, avg(b.x) AS mean3 FROM px a JOIN px b
      ON a.pos = b.pos AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.pos, a.i
  ), fitted AS MATERIALIZED (
    SELECT x, mean3, t, CASE WHEN pos < n // 2 THEN 'train' ELSE 'val' END AS part
    FROM px JOIN near USING (pos, i), ecnt
  ), {_sql_fit('fitted', ('x', 'mean3'), True)} {_sql_epochs(3)}""")
def additive_segmenter(spark, folder):
    """Newton steps of the pixel model over one half of the pictures, watched on the other."""
    points = images(spark, folder)
    half = points.count() // 2
    first, second = points.filter(F.col("pos") < half), points.filter(F.col("pos") >= half)
    return _epochs(spark, lambda seen: learners.make_segmenter(
        "pixel_additive", epochs=EPOCHS, reg=REG, callbacks=[seen], patience=EPOCHS
    ).fit(first, second))


@query(f"""WITH {SQL_PAIRS}, fitted AS MATERIALIZED (
    SELECT area, mean_in, mean_out, coalesce(edges, 0) / 64.0::DOUBLE AS edge_rate, agreement,
           label::DOUBLE AS t, CASE WHEN pos < n // 2 THEN 'train' ELSE 'val' END AS part
    FROM agree LEFT JOIN edge USING (pos), ecnt
  ), {_sql_fit('fitted', learners.FEATURES, False)} {_sql_epochs(6)}""")
def additive_discriminator(spark, folder):
    """Gradient steps of the pair model over one half of the pairs, watched on the other."""
    pairs = _pairs(spark, folder)
    half = pairs.count() // 2
    first, second = pairs.filter(F.col("pos") < half), pairs.filter(F.col("pos") >= half)
    return _epochs(spark, lambda seen: learners.make_discriminator(
        "pair_additive", cut=PAIR_CUT, epochs=EPOCHS, reg=REG, method="gradient", rate=RATE, callbacks=[seen],
        patience=EPOCHS,
    ).fit(first, second))


# --- whole runs -----------------------------------------------------------------------------


def _loop(spark, folder, path=None, **settings) -> CurationLoop:
    return CurationLoop(
        images(spark, folder).select("point_id", "pos", "h", "w", "image", "truth"),
        LoopSettings(**settings),
        segmenter=learners.ThresholdSegmenter(**GRID),
        path=path,
    )


def _sql_cycle(cycle: int, state: str, suffix: str, truth: str = "t") -> str:
    """One cycle step by step. The rule and its cut are those of the first cycle.

    ``truth`` is what the segmenter is trained on.
    """
    rule = f"""
taus AS (SELECT k, (k - 0.5::DOUBLE) / 64 AS tau FROM range(65) AS r(k)),
rule AS (
  SELECT arg_max(tau, (accuracy, -k)) AS tau FROM (
    SELECT k, any_value(tau) AS tau, avg(((agreement >= tau)::INTEGER = value)::INTEGER) AS accuracy
    FROM judged{suffix}, taus WHERE collection = 'C_train' GROUP BY k)
), """
    return f"""
train_dice{suffix} AS (
  SELECT cut, {_DICE} AS dice FROM (
    SELECT cut, sum(CASE WHEN x >= cut THEN {truth} ELSE 0 END) AS tp,
           count(*) FILTER (WHERE x >= cut)::DOUBLE AS sp, sum({truth}) AS st
    FROM px JOIN {state} USING (point_id), cuts WHERE collection = 'A_train' GROUP BY cut)
), model{suffix} AS (SELECT arg_max(cut, (dice, -cut)) AS cut FROM train_dice{suffix}),
{_sql_c(cycle, state, suffix)}, judged{suffix} AS (
  SELECT q.collection, q.point_id, q.value, q.ord,
         avg(((x >= first.cut) = CASE WHEN q.value = 1 THEN x >= now.cut ELSE t = 1 END)::INTEGER) AS agreement
  FROM parts{suffix} q JOIN px USING (point_id), model AS first, model{suffix} AS now GROUP BY ALL
), {rule if cycle == 1 else ''} d{suffix} AS (
  SELECT point_id, value FROM judged{suffix}, rule WHERE collection = 'C_test' AND agreement > tau
), {_sql_update(cycle, state, suffix)}"""


def _sql_metrics(cycle: int, state: str, suffix: str) -> str:
    """Scores of both models in a cycle: scores (cycle, model, loss, metric)."""
    return f"""
places{suffix} AS (
  SELECT point_id, row_number() OVER (ORDER BY ord) - 1 AS idx FROM {state} WHERE collection = 'A_test'
), soft{suffix} AS (
  SELECT idx // 32 AS batch, idx, t, 1 / (1 + exp(-20 * (x - cut))) AS p
  FROM px JOIN places{suffix} USING (point_id), model{suffix}
), sums{suffix} AS (
  SELECT batch, count(DISTINCT idx) AS images, sum(t * p) AS tp, sum(t) AS st, sum(p) AS sp,
         avg(-(t * ln(least(greatest(p, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE))
               + (1 - t) * ln(1 - least(greatest(p, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE)))) AS bce
  FROM soft{suffix} GROUP BY batch
), probs{suffix} AS (
  SELECT value, 1 / (1 + exp(-20 * (agreement - tau))) AS p FROM judged{suffix}, rule
  WHERE collection = 'C_test'
), scores{suffix} AS (
  SELECT {cycle} AS cycle, 'classifier' AS model, sum((bce + 1 - {_DICE}) * images) / sum(images) AS loss,
         avg({_DICE}) AS metric FROM sums{suffix}
  UNION ALL SELECT {cycle}, 'discriminator',
         avg(-ln(least(greatest(CASE value WHEN 1 THEN p ELSE 1 - p END, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE))),
         avg(((p > 0.5) = (value = 1))::INTEGER) FROM probs{suffix}
)"""


SQL_LOOP_START = f"""
pts AS (SELECT md5('embeddings:' || vec_id) AS point_id, vec_id AS pos FROM embeddings),
cnt AS (SELECT count(*) AS n FROM embeddings), {SQL_SETUP}, {SQL_PX}, {SQL_CUTS}"""
SQL_LOOP = f"{SQL_LOOP_START}, {_sql_cycle(1, 'members', '')}"
SQL_TWO = f"{SQL_LOOP}, {_sql_metrics(1, 'members', '')}, {_sql_cycle(2, 'updated', '2')}, {_sql_metrics(2, 'updated', '2')}"


def _sql_states(cycle: int, state: str, suffix: str) -> str:
    """All collections of every point just before and after the moves: was and now."""
    derived = f"""
  SELECT point_id, 'A_test_pred' AS collection FROM {state} WHERE collection = 'A_test'
  UNION ALL SELECT point_id, 'C' FROM c{suffix}
  UNION ALL SELECT point_id, collection FROM parts{suffix}
  UNION ALL SELECT point_id, 'C_test_pred' FROM parts{suffix} WHERE collection = 'C_test'
  UNION ALL SELECT point_id, 'D' FROM d{suffix}
  UNION ALL SELECT point_id, 'D_relabeled' FROM selected{suffix}"""

    def listed(rows: str) -> str:
        return f"""SELECT point_id, string_agg(collection, ',' ORDER BY collection) AS names FROM (
  SELECT point_id, collection FROM {rows} UNION ALL {derived}) GROUP BY point_id"""

    return f"was{suffix} AS ({listed(state)}), now{suffix} AS ({listed(f'updated{suffix}')})"


def _sql_changes(cycle: int, suffix: str) -> str:
    return f"""SELECT {cycle} AS cycle, was{suffix}.names AS previous, now{suffix}.names AS collections,
       count(*) AS n_points FROM was{suffix} JOIN now{suffix} USING (point_id)
  WHERE was{suffix}.names <> now{suffix}.names GROUP BY ALL"""


def _sql_sizes(cycle: int, state: str, suffix: str) -> str:
    """Sizes of the collections at the end of a cycle."""
    before = f"(SELECT count(*) FROM {state} WHERE collection = 'A_test')"
    return f"""
  SELECT {cycle} AS cycle, collection AS name, count(*) AS value FROM updated{suffix} GROUP BY collection
  UNION ALL SELECT {cycle}, 'A_test_pred', {before}
  UNION ALL SELECT {cycle}, 'C', count(*) FROM c{suffix}
  UNION ALL SELECT {cycle}, collection, count(*) FROM parts{suffix} GROUP BY collection
  UNION ALL SELECT {cycle}, 'C_test_pred', count(*) FROM parts{suffix} WHERE collection = 'C_test'
  UNION ALL SELECT {cycle}, 'D', count(*) FROM d{suffix}
  UNION ALL SELECT {cycle}, 'D_relabeled', count(*) FROM selected{suffix}"""


@query(f"WITH {SQL_LOOP} SELECT collection, point_id, ord FROM updated")
def loop_one_cycle(spark, folder):
    """Membership after one whole cycle."""
    loop = _loop(spark, folder).run(1)
    return loop.base.select("collection", "point_id", "ord")


@query(f"WITH {SQL_LOOP} SELECT collection, point_id, ord FROM updated")
def loop_resume(spark, folder):
    """The same cycle left after the judging step and continued from the stored state."""
    loop = _loop(spark, folder, store_after_each_step=True).run(1)
    again = _loop(spark, folder)
    again.resume(loop.n_points, 1, JUDGED, loop.store)
    again.find_machine_labels()
    again.relabel()
    return again.base.select("collection", "point_id", "ord")


def _sql_counts(cycle: int, suffix: str) -> str:
    """Counters of a cycle as rows (kind, name, id, value)."""
    return f"""
  UNION ALL SELECT 'count', 'machine_labels', '{cycle}', (SELECT count(*) FROM d{suffix})::DOUBLE
  UNION ALL SELECT 'count', 'selected', '{cycle}', count(*)::DOUBLE FROM selected{suffix}
  UNION ALL SELECT 'count', 'lost', '{cycle}', count(*) FILTER (WHERE origin IS NULL)::DOUBLE FROM selected{suffix}
  UNION ALL SELECT 'count', 'filled', '{cycle}', count(*)::DOUBLE FROM fills{suffix}
  UNION ALL SELECT 'metric', model, cycle::VARCHAR, round(metric, 6) FROM scores{suffix}
  UNION ALL SELECT 'loss', model, cycle::VARCHAR, round(loss, 6) FROM scores{suffix}"""


SQL_RESUMED = f"""WITH {SQL_TWO}
  SELECT 'member' AS kind, collection AS name, point_id AS id, ord::DOUBLE AS value FROM updated2
  {_sql_counts(1, '')} {_sql_counts(2, '2')}"""


def _resumed(spark, folder, step: int):
    """Two cycles, left after a step of the first one and continued by another object.

    Odd steps are continued in the run's own store, even ones in a new folder.
    """
    loop = _loop(spark, folder, store_after_each_step=True)
    if step == SETUP:
        loop.setup_data()
    else:
        loop.run(1, until=step)
    again = _loop(spark, folder, loop.path if step % 2 else None)
    again.resume(None, loop.cycle, step, None if step % 2 else loop.store).proceed(2)
    members = again.base.select(
        F.lit("member").alias("kind"), F.col("collection").alias("name"), F.col("point_id").alias("id"),
        F.col("ord").cast("double").alias("value"),
    )
    cycle = F.col("cycle").cast("string")
    counters = again.stats_table()
    lost = again.lost_table().groupBy("cycle").agg(F.count("*").alias("n_lost"))
    counters = counters.join(lost, "cycle", "left").withColumn("lost", F.coalesce("n_lost", F.lit(0)))
    rows = members
    for name in ("machine_labels", "selected", "lost", "filled"):
        rows = rows.unionByName(counters.select(
            F.lit("count").alias("kind"), F.lit(name).alias("name"), cycle.alias("id"),
            F.col(name).cast("double").alias("value"),
        ))
    for name in ("metric", "loss"):
        rows = rows.unionByName(again.scores_table().select(
            F.lit(name).alias("kind"), F.col("model").alias("name"), cycle.alias("id"), r6(name).alias("value"),
        ))
    return rows


@query(SQL_RESUMED)
def loop_resume_setup(spark, folder):
    """Two cycles continued after the set-up."""
    return _resumed(spark, folder, SETUP)


@query(SQL_RESUMED)
def loop_resume_predicted(spark, folder):
    """Two cycles continued after the prediction."""
    return _resumed(spark, folder, PREDICTED)


@query(SQL_RESUMED)
def loop_resume_built_c(spark, folder):
    """Two cycles continued after C was built and shuffled."""
    return _resumed(spark, folder, BUILT_C)


@query(SQL_RESUMED)
def loop_resume_split_c(spark, folder):
    """Two cycles continued after C was cut into its parts."""
    return _resumed(spark, folder, SPLIT_C)


@query(SQL_RESUMED)
def loop_resume_trained(spark, folder):
    """Two cycles continued after the discriminator was trained."""
    return _resumed(spark, folder, TRAINED)


@query(SQL_RESUMED)
def loop_resume_judged(spark, folder):
    """Two cycles continued after C_test was judged."""
    return _resumed(spark, folder, JUDGED)


@query(SQL_RESUMED)
def loop_resume_found(spark, folder):
    """Two cycles continued after D was found."""
    return _resumed(spark, folder, FOUND)


@query(SQL_RESUMED)
def loop_resume_relabeled(spark, folder):
    """Two cycles continued after the sample was relabelled, before it moved."""
    return _resumed(spark, folder, RELABELED)


@query(SQL_RESUMED)
def loop_resume_updated(spark, folder):
    """Two cycles continued between them."""
    return _resumed(spark, folder, UPDATED)


@query(f"""WITH {SQL_TWO}, p AS (
    SELECT 1 AS cycle, point_id, cut FROM members, model WHERE collection = 'A_test'
    UNION ALL SELECT 2, point_id, cut FROM updated, model2 WHERE collection = 'A_test')
  SELECT cycle, pos, i, (x >= cut)::INTEGER::DOUBLE AS v FROM p JOIN px USING (point_id)""")
def stored_predictions(spark, folder):
    """Predicted masks of A_test in two cycles, read back from their packed bits."""
    stored = _loop(spark, folder).run(2).predicted_masks()
    mask = masks.unpack_mask("mask", F.col("h") * F.col("w"))
    long = stored.select("cycle", "pos", mask.alias("pixels")).select("cycle", "pos", F.posexplode("pixels").alias("i", "v"))
    return long.select("cycle", "pos", F.col("i").cast("bigint").alias("i"), "v")


@query(f"""WITH {SQL_LOOP}, {_sql_metrics(1, 'members', '')}
  SELECT cycle, model, round(loss, 6) AS loss, round(metric, 6) AS metric FROM scores""")
def loop_scores(spark, folder):
    """Loss and metric of both models in one cycle."""
    loop = _loop(spark, folder).run(1)
    return loop.scores_table().select("cycle", "model", r6("loss").alias("loss"), r6("metric").alias("metric"))


@query(f"""WITH {SQL_TWO} SELECT 1 AS cycle, (SELECT count(*) FROM d) AS machine_labels, count(*) AS selected,
       count(*) FILTER (WHERE origin IS NULL) AS lost, count(*) AS removed, count(*) AS filled FROM selected
  UNION ALL SELECT 2, (SELECT count(*) FROM d2), count(*), count(*) FILTER (WHERE origin IS NULL),
       count(*), count(*) FROM selected2""")
def cycle_stats(spark, folder):
    """Counters of two cycles."""
    return _loop(spark, folder).run(2).stats_table().select(
        "cycle", "machine_labels", "selected", "lost", "removed", "filled"
    )


@query(f"""WITH {SQL_TWO}, sizes AS (
    SELECT 0 AS cycle, collection AS name, count(*) AS value FROM members GROUP BY collection
    UNION ALL {_sql_sizes(1, 'members', '')} UNION ALL {_sql_sizes(2, 'updated', '2')})
  SELECT cycle, 'size' AS kind, name, value::DOUBLE AS value FROM sizes
  UNION ALL SELECT cycle, 'metric', model, round(metric, 6) FROM scores
  UNION ALL SELECT cycle, 'metric', model, round(metric, 6) FROM scores2""")
def loop_two_cycles(spark, folder):
    """Sizes of all collections and scores of both models over two cycles."""
    loop = _loop(spark, folder).run(2)
    counts = loop.store.all().groupBy("cycle", "collection").agg(
        F.count("*").cast("double").alias("value")
    )
    sizes = counts.select("cycle", F.lit("size").alias("kind"), F.col("collection").alias("name"), "value")
    metrics = loop.scores_table().select(
        "cycle", F.lit("metric").alias("kind"), F.col("model").alias("name"), r6("metric").alias("value")
    )
    return sizes.unionByName(metrics)


@query(f"WITH {SQL_TWO} SELECT collection, point_id, ord FROM updated2")
def loop_second_state(spark, folder):
    """Membership after the second cycle."""
    loop = _loop(spark, folder).run(2)
    return loop.base.select("collection", "point_id", "ord")


_SIZES = ", ".join(
    f"count(*) FILTER (WHERE collection = '{name}') AS {short}"
    for name, short in (("A_train", "tr"), ("B", "b"), ("A_test", "te"))
)


@query(f"""WITH {SQL_LOOP}, {_sql_balance(f'SELECT {_SIZES} FROM updated', 'updated')}
  SELECT collection, point_id, ord FROM balanced
  UNION ALL SELECT collection, point_id, ord FROM updated WHERE collection IN ('A', 'A_val', 'Z')""")
def loop_balanced(spark, folder):
    """Membership after one cycle with balancing."""
    return _loop(spark, folder, balance=True).run(1).base.select("collection", "point_id", "ord")


@query(f"""WITH {SQL_TWO}
  SELECT 2 AS cycle, collection, point_id, ord FROM updated2
  UNION ALL SELECT 1, collection, point_id, ord FROM updated
  UNION ALL SELECT 0, collection, point_id, ord FROM members""")
def state_changes(spark, folder):
    """Base collections of every stored state of two cycles, merged from the log of changes."""
    loop = _loop(spark, folder).run(2)
    base = loop.store.all().filter(F.col("collection").isin(*BASE))
    return base.select("cycle", "collection", "point_id", "ord")


@query(f"""WITH {SQL_TWO}, {_sql_states(1, 'members', '')}, {_sql_states(2, 'updated', '2')}
  {_sql_changes(1, '')} UNION ALL {_sql_changes(2, '2')}""")
def loop_trace(spark, folder):
    """Changes of collections over two cycles with every step stored."""
    loop = _loop(spark, folder, store_after_each_step=True).run(2)
    changed = tables.transitions(loop.store.all())
    return changed.filter(F.col("step") == UPDATED).groupBy("cycle", "previous", "collections").agg(
        F.count("*").alias("n_points")
    )


@query(f"""WITH {SQL_LOOP_START}, {_sql_cycle(1, 'members', '', '(1 - t)')}
  SELECT point_id, selected.value AS label, sum(1 - t) AS area FROM selected JOIN px USING (point_id)
  GROUP BY point_id, selected.value""")
def loop_manual_labels(spark, folder):
    """Relabelled points with masks drawn by hand: here the inverted truth."""
    points = images(spark, folder)
    by_hand = points.select(
        "point_id", F.transform("truth", lambda t: F.lit(1.0) - t).alias("truth")
    )
    loop = _loop(spark, folder)
    loop.labels = by_hand
    loop.run(1)
    area = F.aggregate("mask", F.lit(0.0), lambda acc, x: acc + x)
    return loop.relabeled_pixels().select("point_id", "label", area.alias("area"))


def _sql_history(cycle: int, state: str, suffix: str) -> str:
    return f"""
  SELECT {cycle} AS cycle, dice AS metric, val_dice AS val_metric
  FROM train_dice{suffix} JOIN model{suffix} USING (cut), (
    SELECT {_DICE} AS val_dice FROM (
      SELECT sum(CASE WHEN x >= cut THEN t ELSE 0 END) AS tp,
             count(*) FILTER (WHERE x >= cut)::DOUBLE AS sp, sum(t) AS st
      FROM px JOIN {state} USING (point_id), model{suffix} WHERE collection = 'A_val'))"""


@query(f"""WITH {SQL_TWO}, h AS ({_sql_history(1, 'members', '')} UNION ALL {_sql_history(2, 'updated', '2')})
  SELECT cycle, 0 AS epoch, round(1 - metric, 6) AS loss, round(metric, 6) AS metric,
         round(1 - val_metric, 6) AS val_loss, round(val_metric, 6) AS val_metric FROM h""")
def training_history(spark, folder):
    """Per-epoch history of the segmenter over two cycles, appended to a table and read back."""
    loop = _loop(spark, folder).run(2)
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    tables.append_history(loop.history_table(), path)
    stored = spark.read.parquet(path).filter(F.col("model") == "threshold")
    numbers = ("loss", "metric", "val_loss", "val_metric")
    return stored.select("cycle", "epoch", *[r6(name).alias(name) for name in numbers])


@query("""WITH s AS (
    SELECT l_returnflag AS run, l_linenumber AS cycle,
           CASE l_linestatus WHEN 'O' THEN 'classifier' ELSE 'discriminator' END AS model,
           l_discount AS metric FROM lineitem)
  SELECT run, cycle, round(max(metric) FILTER (WHERE model = 'classifier'), 6) AS classifier,
         round(max(metric) FILTER (WHERE model = 'discriminator'), 6) AS discriminator
  FROM s GROUP BY run, cycle""")
def score_series(spark, folder):
    """Metric of both models side by side; line items stand in for scores."""
    scores = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("run"), F.col("l_linenumber").alias("cycle"),
        F.when(F.col("l_linestatus") == "O", "classifier").otherwise("discriminator").alias("model"),
        F.col("l_discount").alias("metric"),
    )
    return ev.score_series(scores).select(
        "run", "cycle", r6("classifier").alias("classifier"), r6("discriminator").alias("discriminator")
    )


@query("""WITH s AS (SELECT l_suppkey AS run, l_linenumber AS cycle, max(l_extendedprice) AS metric
             FROM lineitem GROUP BY 1, 2),
  r AS (SELECT run, max(cycle) AS cycles, arg_max(metric, cycle) AS last_metric, max(metric) AS best_metric
        FROM s GROUP BY run)
  SELECT run, cycles, round(last_metric, 6) AS last_metric, round(best_metric, 6) AS best_metric,
         row_number() OVER (ORDER BY last_metric DESC, run) - 1 AS place FROM r""")
def leaderboard(spark, folder):
    """Runs ranked by their last metric; suppliers stand in for runs."""
    scores = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("cycle"))
        .agg(F.max("l_extendedprice").alias("metric"))
        .withColumn("model", F.lit("classifier"))
    )
    return experiments.leaderboard(scores).select(
        "run", "cycles", r6("last_metric").alias("last_metric"), r6("best_metric").alias("best_metric"), "place"
    )


@query()
def experiment_matrix(spark, folder):
    """One cycle for two sets of weights and two percentages, ranked."""
    points = images(spark, folder).select("point_id", "pos", "h", "w", "image", "truth")
    # A variant set of shares (fixed values).
    variant = splits.Weights(0.5, 0.1, 0.2, 0.7, 0.35, 0.6, 0.1, 0.3, 0.15)
    settings = experiments.matrix(
        LoopSettings(run="exp"), weights=[W, variant], percent_to_replace=[10, 30]
    )
    scores = experiments.run_experiments(
        points, settings, segmenter=learners.ThresholdSegmenter(**GRID)
    )
    return experiments.leaderboard(scores)


@query(f"""WITH {SQL_PX} SELECT pos, i, round(x, 6) AS image, t AS truth,
       CASE WHEN x >= 0.01::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pred
  FROM px, ecnt WHERE pos < n // 3""")
def prediction_rows(spark, folder):
    """Image, truth and predicted mask of the first third of the pictures."""
    points = images(spark, folder)
    predicted = learners.ThresholdModel(0.01).transform(points)
    rows = ev.prediction_rows(predicted, points.count() // 3, "pos")
    return rows.select("pos", "image", "truth", F.posexplode_outer("mask").alias("i", "pred")).select(
        "pos", F.col("i").cast("bigint").alias("i"), r6(F.col("image")[F.col("i")]).alias("image"),
        F.col("truth")[F.col("i")].alias("truth"), "pred",
    )
