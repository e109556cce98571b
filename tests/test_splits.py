import pytest
from pyspark.sql import functions as F

from maskloom.operators import splits
from maskloom.operators.index import ordered_index, position_index, random_index
from maskloom.operators.sampling import percent_divisor, sample_percent

VARIANT = splits.Weights(0.5, 0.1, 0.2, 0.7, 0.35, 0.6, 0.1, 0.3, 0.15)


@pytest.mark.parametrize(
    "weights, n, abz, parts, c_parts",
    [
        (splits.DEFAULT_WEIGHTS, 1000, (500, 300, 200), (50, 150, 300), (210, 30, 60)),
        (splits.DEFAULT_WEIGHTS, 6392, (3196, 1917, 1278), (319, 958, 1917), (1342, 191, 383)),
        (VARIANT, 1000, (500, 350, 150), (50, 100, 350), (210, 34, 105)),
        (None, 1000, (400, 200, 400), (40, 160, 200), (80, 20, 100)),
    ],
)
def test_sizes(weights, n, abz, parts, c_parts):
    assert splits.abz_sizes(n, weights) == abz
    assert splits.a_part_sizes(n, weights) == parts
    assert splits.c_part_sizes(n, weights) == c_parts


@pytest.mark.parametrize(
    "change, message",
    [
        (dict(A_val=0.5), "A_train"),
        (dict(B_val=0.5), "B_train"),
        (dict(Z=0.3), "A . B . Z"),
        (dict(A_train=0.2, A_test=0.5), r"A \* A_test"),
        (dict(A=0.6, A_train=0.1, A_val=0.3, B=0.36, Z=0.04), "at least"),
    ],
)
def test_broken_weights(change, message):
    with pytest.raises(ValueError, match=message):
        splits.validate_weights({**splits.DEFAULT_WEIGHTS.as_dict(), **change})


def test_broken_rules_of_a_table_equal_those_of_single_weights(spark):
    base = splits.DEFAULT_WEIGHTS.as_dict()
    tried = [base] + [{**base, name: base[name] + off} for name in base for off in (-0.2, 1e-7, 1e-9, 0.15)]
    tried.append({**base, "B": 0.4, "A_test": 0.8, "A_val": 0.1, "Z": 0.1})
    tried.append({**base, "B": 0.2, "Z": 0.3})
    tried.append({**base, "A": 0.7, "A_val": 0.55, "A_test": 0.35, "B": 0.245, "Z": 0.055})

    def message(weights):
        try:
            splits.validate_weights(weights)
        except ValueError as error:
            return str(error)

    rows = spark.createDataFrame([(k, *w.values()) for k, w in enumerate(tried)], ["k", *base])
    got = {r.k: r.rule for r in rows.select("k", splits.broken_rule().alias("rule")).collect()}
    assert [got[k] for k in range(len(tried))] == [message(w) for w in tried] and len(set(got.values())) == 6
    lacking = rows.limit(1).withColumn("Z", F.lit(None).cast("double"))
    assert lacking.select(splits.broken_rule()).first()[0] == "A + B + Z must be 1"


def test_reserve_of_exactly_a_tenth_is_accepted():
    weights = splits.Weights(0.6, 0.25, 0.25, 0.5, 0.3, 0.7, 0.1, 0.2, 0.1)
    assert splits.validate_weights(weights)


def test_weights_within_tolerance_may_truncate_apart():
    weights = splits.Weights(0.4, 0.35, 0.3, 0.35, 0.14, 0.7, 0.1, 0.2, 0.46)
    assert splits.a_part_sizes(1000, weights)[2] == 139
    assert splits.abz_sizes(1000, weights)[1] == 140


def test_ratios_must_sum_to_one():
    with pytest.raises(ValueError):
        splits.c_part_sizes(1000, None, (0.4, 0.2, 0.5))


def _points(spark, n):
    return spark.range(n).select(F.concat(F.lit("p"), "id").alias("point_id"), F.col("id").alias("pos"))


def test_setup_drops_the_remainder_and_keeps_order(spark):
    rows = splits.setup_split(_points(spark, 1001), 1001, splits.DEFAULT_WEIGHTS).collect()
    held = {}
    for r in rows:
        held.setdefault(r["collection"], []).append((r["ord"], r["point_id"]))
    assert {k: len(v) for k, v in held.items()} == {
        "A": 500, "B": 300, "Z": 200, "A_train": 50, "A_val": 150, "A_test": 300
    }
    assert [p for _, p in sorted(held["A_test"])] == [f"p{i}" for i in range(200, 500)]
    assert sorted(o for o, _ in held["B"]) == list(range(300))


def test_slices_past_the_end_are_short(spark):
    sizes = splits.abz_split(_points(spark, 600), 1000, splits.DEFAULT_WEIGHTS)
    assert {r[0]: r[1] for r in sizes.groupBy("collection").count().collect()} == {"A": 500, "B": 100}


def test_split_needs_no_shuffle(spark):
    plan = splits.setup_split(_points(spark, 1000), 1000)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("percent, taken", [(10, 10), (20, 20), (30, 33), (34, 50), (50, 50), (51, 100), (80, 100), (100, 100)])
def test_percent(percent, taken):
    assert 100 // percent_divisor(percent) == taken


def test_percent_above_hundred_is_an_error():
    with pytest.raises(ZeroDivisionError):
        percent_divisor(101)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_order_does_not_depend_on_partitioning(spark, parts):
    points = _points(spark, 500)
    expected = {r["point_id"]: r["idx"] for r in random_index(points, "s").collect()}
    got = {r["point_id"]: r["idx"] for r in random_index(points.repartition(parts), "s").collect()}
    assert got == expected and sorted(got.values()) == list(range(500))


def test_first_is_a_prefix_of_the_full_order(spark):
    points = _points(spark, 700)
    full = {r["point_id"]: r["idx"] for r in random_index(points, "s").collect()}
    for k in (0, 1, 99, 700, 1000):
        some = {r["point_id"]: r["idx"] for r in random_index(points, "s", first=k).collect()}
        assert some == {p: i for p, i in full.items() if i < k}
    assert sample_percent(points, 30).count() == 233


def test_ordered_index_with_one_heavy_key(spark):
    # Half of all rows share the first key.
    rows = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id")
    )
    ranked = ordered_index(rows.repartition(13), "k", "id")
    assert ranked.orderBy("k", "id").select("idx").rdd.flatMap(lambda r: r).collect() == list(range(4000))


def test_position_index_spans_buckets(spark):
    ords = spark.range(0, 1_000_000, 50).select(F.col("id").alias("ord"))
    ranked = position_index(ords).filter(F.col("idx") != F.col("ord") / 50)
    assert ranked.count() == 0


def test_position_index_within_groups(spark):
    rows = spark.range(300).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") * 7).alias("ord"))
    wrong = position_index(rows, within="g").filter(F.col("idx") != F.floor(F.col("ord") / 21))
    assert wrong.count() == 0


def test_source_ranges_prune_row_groups(spark, tmp_path):
    ranges = splits.source_ranges("A_val", 1000, splits.DEFAULT_WEIGHTS)
    assert ranges == [(50, 200)]
    assert splits.source_ranges("A_test", 1000, splits.DEFAULT_WEIGHTS) == [(200, 500), (800, 1000)]
    assert splits.source_ranges("C_test", 1000, splits.DEFAULT_WEIGHTS) == [(200, 500), (500, 800), (800, 1000)]
    assert (0, 50) in splits.source_ranges("D", 1000, splits.DEFAULT_WEIGHTS, balance=True)
    _points(spark, 1000).write.parquet(f"{tmp_path}/p")
    read = spark.read.parquet(f"{tmp_path}/p").filter(splits.in_ranges(F.col("pos"), ranges))
    assert read.count() == 150
    assert "PushedFilters: [IsNotNull(pos), GreaterThanOrEqual(pos,50), LessThan(pos,200)]" in (
        read._jdf.queryExecution().executedPlan().toString()
    )


def test_all_points_are_split_without_a_number(spark):
    points = _points(spark, 1500)
    whole = splits.setup_split(points, weights=splits.DEFAULT_WEIGHTS)
    assert sorted(whole.collect()) == sorted(splits.setup_split(points, 1500, splits.DEFAULT_WEIGHTS).collect())
    assert splits.abz_split(points, weights=splits.DEFAULT_WEIGHTS).count() == 1500
