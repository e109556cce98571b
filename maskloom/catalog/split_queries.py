"""Splits, order, shuffles, samples (orders as points)."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.catalog.common import SQL_POINTS, order_points, query, sql_key, sql_share, table
from maskloom.operators import index, sampling, splits
from maskloom.operators import registry as reg

W = splits.DEFAULT_WEIGHTS

# Membership of A, B, Z and the parts of A under the default weights.
SQL_SETUP = f"""
sz AS (
  SELECT n, {sql_share('n', W.A)} AS a, {sql_share('n', W.B)} AS b, {sql_share('n', W.Z)} AS z,
         {sql_share('n', W.A, W.A_train)} AS tr, {sql_share('n', W.A, W.A_val)} AS va,
         {sql_share('n', W.A, W.A_test)} AS te
  FROM cnt
), members AS (
  SELECT 'A' AS collection, point_id, pos AS ord FROM pts, sz WHERE pos < a
  UNION ALL SELECT 'B', point_id, pos - a FROM pts, sz WHERE pos >= a AND pos < a + b
  UNION ALL SELECT 'Z', point_id, pos - a - b FROM pts, sz WHERE pos >= a + b AND pos < a + b + z
  UNION ALL SELECT 'A_train', point_id, pos FROM pts, sz WHERE pos < tr
  UNION ALL SELECT 'A_val', point_id, pos - tr FROM pts, sz WHERE pos >= tr AND pos < tr + va
  UNION ALL SELECT 'A_test', point_id, pos - tr - va FROM pts, sz
    WHERE pos >= tr + va AND pos < tr + va + te
)
"""


@query(f"WITH {SQL_POINTS}, {SQL_SETUP} SELECT collection, count(*) AS n_points, "
       "min(ord) AS first_ord, max(ord) AS last_ord FROM members "
       "WHERE collection IN ('A', 'B', 'Z') GROUP BY collection")
def split_abz(spark, folder):
    """A, B and Z by weight, in input order."""
    points = order_points(spark, folder)
    members = splits.abz_split(points, points.count(), W)
    return members.groupBy("collection").agg(
        F.count("*").alias("n_points"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")
    )


@query(f"WITH {SQL_POINTS}, {SQL_SETUP} SELECT collection, point_id, ord FROM members")
def split_setup(spark, folder):
    """Whole set-up with its six collections, as membership rows."""
    points = order_points(spark, folder)
    return splits.setup_split(points, points.count(), W)


@query(f"""WITH {SQL_POINTS}, s AS (
  SELECT {sql_share('n', 0.4)} AS a, {sql_share('n', 0.2)} AS b, {sql_share('n', 0.4)} AS z,
         {sql_share('n', 0.4, 0.1)} AS tr, {sql_share('n', 0.4, 0.4)} AS va,
         {sql_share('n', 0.4, 0.5)} AS te FROM cnt)
  SELECT CASE WHEN pos < a THEN 'A' WHEN pos < a + b THEN 'B' ELSE 'Z' END AS collection,
         count(*) AS n_points,
         count(*) FILTER (WHERE pos < tr) AS n_train,
         count(*) FILTER (WHERE pos >= tr AND pos < tr + va) AS n_val,
         count(*) FILTER (WHERE pos >= tr + va AND pos < least(tr + va + te, a)) AS n_test
  FROM pts, s WHERE pos < a + b + z GROUP BY 1""")
def split_fallback(spark, folder):
    """Shares without weights."""
    points = order_points(spark, folder)
    members = splits.setup_split(points, points.count(), None)
    whole = F.when(F.col("collection").isin("A", "B", "Z"), F.col("collection")).otherwise("A")
    counted = [
        F.sum((F.col("collection") == name).cast("bigint")).alias(alias)
        for name, alias in (("A_train", "n_train"), ("A_val", "n_val"), ("A_test", "n_test"))
    ]
    total = F.sum(F.col("collection").isin("A", "B", "Z").cast("bigint")).alias("n_points")
    return members.groupBy(whole.alias("collection")).agg(total, *counted)


@query(f"""WITH {SQL_POINTS}, ranked AS (
    SELECT point_id, row_number() OVER (ORDER BY {sql_key('split')}, point_id) - 1 AS idx FROM pts)
  SELECT CASE WHEN idx < n // 2 THEN 'train' WHEN idx < n // 2 + n // 5 THEN 'val' ELSE 'test' END
         AS collection, point_id,
         CASE WHEN idx < n // 2 THEN idx WHEN idx < n // 2 + n // 5 THEN idx - n // 2
              ELSE idx - n // 2 - n // 5 END AS ord
  FROM ranked, cnt WHERE idx < n // 2 + n // 5 + n // 4""")
def split_train_val_test(spark, folder):
    """Counts after a seeded shuffle; the counts leave some points out."""
    members = order_points(spark, folder).select("point_id", F.col("pos").alias("ord"))
    n = members.count()
    return splits.train_val_test_split(members, n // 2, n // 5, n // 4, shuffle=True)


@query(f"""WITH {SQL_POINTS}
  SELECT CASE WHEN pos < n // 2 THEN 'train' WHEN pos < n // 2 + n // 5 THEN 'val' ELSE 'test' END
         AS collection, count(*) AS n_points, min(pos) AS first_pos, max(pos) AS last_pos
  FROM pts, cnt WHERE pos < n // 2 + n // 5 + n // 4 GROUP BY 1""")
def split_in_order(spark, folder):
    """The same counts without a shuffle, places taken from ``ord``."""
    points = order_points(spark, folder)
    members = points.select("point_id", F.col("pos").alias("ord"))
    n = members.count()
    parts = splits.train_val_test_split(members, n // 2, n // 5, n // 4, shuffle=False)
    return parts.join(points.select("point_id", "pos"), "point_id").groupBy("collection").agg(
        F.count("*").alias("n_points"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )


@query(f"""WITH {SQL_POINTS}, {SQL_SETUP}, c AS (
    SELECT point_id, 1 AS value FROM members WHERE collection = 'A_test'
    UNION ALL SELECT point_id, 0 FROM members WHERE collection = 'B'),
  ranked AS (
    SELECT *, row_number() OVER (ORDER BY {sql_key('shuffle')}, point_id) - 1 AS idx FROM c),
  cs AS (SELECT {sql_share('n', W.B, W.B_train)} AS tr, {sql_share('n', W.B, W.B_val)} AS va,
                {sql_share('n', W.B, W.B_test)} AS te FROM cnt)
  SELECT CASE WHEN idx < tr THEN 'C_train' WHEN idx < tr + va THEN 'C_val' ELSE 'C_test' END
           AS collection, point_id,
         CASE WHEN idx < tr THEN idx WHEN idx < tr + va THEN idx - tr ELSE idx - tr - va END AS ord
  FROM ranked, cs WHERE idx < tr + va + te""")
def split_c(spark, folder):
    """C shuffled and cut into its parts."""
    points = order_points(spark, folder)
    n = points.count()
    members = splits.setup_split(points, n, W)
    c_rows = members.filter(F.col("collection").isin("A_test", "B")).select("point_id")
    return splits.c_split(c_rows, splits.c_part_sizes(n, W))


@query(f"WITH {SQL_POINTS} SELECT point_id, row_number() OVER (ORDER BY day, pos) - 1 AS idx FROM pts")
def ordered_positions(spark, folder):
    """Exact rank by arbitrary keys through one range shuffle."""
    points = order_points(spark, folder).select("point_id", "day", "pos")
    return index.ordered_index(points, "day", "pos").select("point_id", "idx")


@query(f"WITH {SQL_POINTS} SELECT point_id, row_number() OVER "
       f"(ORDER BY {sql_key('shuffle')}, point_id) - 1 AS ord FROM pts")
def shuffle_order(spark, folder):
    """Seeded permutation of a collection."""
    points = order_points(spark, folder).select("point_id", F.col("pos").alias("ord"))
    return reg.shuffled(points)


@query(f"""WITH {SQL_POINTS}, ranked AS (
    SELECT point_id, row_number() OVER (ORDER BY {sql_key('relabel')}, point_id) - 1 AS idx FROM pts)
  SELECT point_id, idx FROM ranked, cnt WHERE idx < n // 3""")
def sample_percent(spark, folder):
    """30 percent without replacement: n // 3 points."""
    return sampling.sample_percent(order_points(spark, folder).select("point_id"), 30)


@query(f"""WITH {SQL_POINTS}, draws AS (
    SELECT pos AS draw,
           CAST(('0x' || substr({sql_key('draw', 'pos')}, 1, 15)) AS BIGINT) % n AS at
    FROM pts, cnt WHERE pos < n // 2)
  SELECT draw, point_id FROM draws JOIN pts ON pts.pos = draws.at""")
def sample_with_replacement(spark, folder):
    """50 percent with replacement: n // 2 draws."""
    points = order_points(spark, folder).select("point_id", F.col("pos").alias("idx"))
    return sampling.sample_with_replacement(points, 50)


@query(f"WITH {SQL_POINTS} SELECT arg_min(point_id, {sql_key('draw_one')} || point_id) AS point_id FROM pts")
def draw_one(spark, folder):
    """One random point."""
    return sampling.draw_one(order_points(spark, folder).select("point_id"))


@query(f"WITH {SQL_POINTS} SELECT point_id, pos, round(value, 6) AS value FROM pts, cnt WHERE pos < n // 4")
def head_n(spark, folder):
    """First n points by position."""
    points = order_points(spark, folder)
    first = sampling.head(points, points.count() // 4, "pos")
    return first.select("point_id", "pos", F.round("value", 6).alias("value"))


@query("""WITH lines AS (
    SELECT l_orderkey, l_linenumber, l_linenumber / 10::DOUBLE AS "A", (l_suppkey % 5 + 2) / 10::DOUBLE AS a_test,
           CASE WHEN l_returnflag = 'A' THEN l_tax ELSE 0::DOUBLE END AS off_b,
           CASE WHEN l_returnflag = 'R' THEN l_tax ELSE 0::DOUBLE END AS off_a,
           CASE WHEN l_linestatus = 'F' THEN l_discount ELSE 0::DOUBLE END AS off_parts,
           CASE WHEN l_partkey % 4 = 0 THEN l_discount ELSE 0::DOUBLE END AS off_z
    FROM lineitem), w AS (
    SELECT *, 0.1::DOUBLE AS a_train, 0.9::DOUBLE - a_test + off_a AS a_val, "A" * a_test + off_b AS b,
           0.7::DOUBLE AS b_train, 0.1::DOUBLE AS b_val, 0.2::DOUBLE + off_parts AS b_test FROM lines), z AS (
    SELECT *, 1::DOUBLE - "A" - b + off_z AS z FROM w)
  SELECT l_orderkey, l_linenumber, CASE
    WHEN abs(a_train + a_val + a_test - 1::DOUBLE) > 1e-8::DOUBLE + 1e-6::DOUBLE THEN 'A_train + A_val + A_test must be 1'
    WHEN abs(b_train + b_val + b_test - 1::DOUBLE) > 1e-8::DOUBLE + 1e-6::DOUBLE THEN 'B_train + B_val + B_test must be 1'
    WHEN abs("A" + b + z - 1::DOUBLE) > 1e-8::DOUBLE + 1e-6::DOUBLE THEN 'A + B + Z must be 1'
    WHEN abs("A" * a_test - b) > 1e-8::DOUBLE + 1e-6::DOUBLE * abs(b) THEN 'A * A_test must be B'
    WHEN z < 0.1::DOUBLE THEN 'Z must be at least 0.1' END AS rule FROM z""")
def weight_rules(spark, folder):
    """First rule that the weights of each order line break; the lines stand in for settings to be tried."""
    lines = table(spark, folder, "lineitem")

    def only(condition, amount):
        return F.when(condition, F.col(amount)).otherwise(F.lit(0.0))

    shares = lines.select(
        "l_orderkey", "l_linenumber", (F.col("l_linenumber") / 10.0).alias("A"),
        ((F.col("l_suppkey") % 5 + 2) / 10.0).alias("A_test"),
        only(F.col("l_returnflag") == "A", "l_tax").alias("off_b"), only(F.col("l_returnflag") == "R", "l_tax").alias("off_a"),
        only(F.col("l_linestatus") == "F", "l_discount").alias("off_parts"),
        only(F.col("l_partkey") % 4 == 0, "l_discount").alias("off_z"),
    )
    weights = shares.select(
        "*", F.lit(0.1).alias("A_train"), (F.lit(0.9) - F.col("A_test") + F.col("off_a")).alias("A_val"),
        (F.col("A") * F.col("A_test") + F.col("off_b")).alias("B"), F.lit(0.7).alias("B_train"),
        F.lit(0.1).alias("B_val"), (F.lit(0.2) + F.col("off_parts")).alias("B_test"),
    ).withColumn("Z", F.lit(1.0) - F.col("A") - F.col("B") + F.col("off_z"))
    return weights.select("l_orderkey", "l_linenumber", splits.broken_rule().alias("rule"))
