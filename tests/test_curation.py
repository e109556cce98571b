import random

import pytest
from pyspark.sql import functions as F

from maskloom.catalog.common import images
from maskloom.functions.hashing import point_id
from maskloom.operators import curation as cur
from maskloom.operators import registry as reg
from maskloom.operators import splits
from maskloom.plans import learners
from maskloom.plans.loop import BASE, UPDATED, CurationLoop, LoopSettings
from conftest import SMALL


def planned(sizes):
    plan = cur.balance_plan(sizes)
    after = dict(sizes)
    for donor, receiver, count in plan:
        after[donor] -= count
        after[receiver] += count
    return {(d, r): c for d, r, c in plan}, after


@pytest.mark.parametrize("before, after, moves", [((10, 10, 1), [8, 8, 5], 4), ((8, 8, 5), [8, 8, 5], 0), ((30, 3, 3), [13, 12, 11], 17)])
def test_balance_examples(before, after, moves):
    sizes = dict(zip(cur.BALANCED, before))
    plan, ended = planned(sizes)
    assert sorted(ended.values(), reverse=True) == after and sum(plan.values()) == moves


@pytest.mark.parametrize(
    "before, plan",
    [
        # Two sets above the third of 12: both keep 13, the smallest takes the rest.
        ((20, 15, 1), {("A_train", "A_test"): 7, ("B", "A_test"): 2}),
        # Only B above the third of 10: A_test, the middle one, is filled first.
        ((2, 21, 7), {("B", "A_test"): 3, ("B", "A_train"): 7}),
        # A remainder of two stays with the donor once both others have the third.
        ((0, 0, 5), {("A_test", "A_train"): 1, ("A_test", "B"): 1}),
        ((4, 4, 4), {}),
        ((5, 4, 3), {}),
    ],
)
def test_balance_by_hand(before, plan):
    assert planned(dict(zip(cur.BALANCED, before)))[0] == plan


def test_balance_properties():
    rng = random.Random(2)
    cases = [(a, b, c) for a in range(16) for b in range(16) for c in range(16)]
    cases += [tuple(rng.randint(0, 3000) for _ in range(3)) for _ in range(200)]
    for case in cases:
        sizes = dict(zip(cur.BALANCED, case))
        plan, after = planned(sizes)
        third = sum(case) // 3
        assert sum(after.values()) == sum(case) and all(count > 0 for count in plan.values())
        assert not {d for d, _ in plan} & {r for _, r in plan}
        low = sorted(after.values())
        assert low[2] <= third + 1 or low[:2] == [third, third]
        # The middle set is filled before the smallest one gets anything.
        middle = sorted(cur.BALANCED, key=lambda name: -sizes[name])[1]
        if sizes[middle] < third and after[middle] < third:
            assert all(r == middle for _, r in plan)


def test_balance_of_very_large_sets_is_quick():
    _, after = planned({"A_train": 10**9, "B": 10**9, "A_test": 7})
    assert max(after.values()) - min(after.values()) < 10


def test_uneven_sides_are_an_error(spark):
    empty = spark.createDataFrame([], "point_id string, ord long")
    with pytest.raises(ValueError):
        cur.build_c(empty, empty, 3, 4)
    assert cur.build_c(empty, empty, 3, 4, strict=False).count() == 0


@pytest.fixture(scope="module")
def points(spark):
    return images(spark, SMALL).select("point_id", "pos", "h", "w", "image", "truth")


GRID = dict(low=-0.19, high=0.19, steps=20)


def make(points, **settings):
    return CurationLoop(points, LoopSettings(**settings), segmenter=learners.ThresholdSegmenter(**GRID))


def held(members):
    out = {}
    for r in members.collect():
        out.setdefault(r["collection"], {})[r["point_id"]] = r["ord"]
    return out


@pytest.fixture(scope="module")
def two_cycles(points):
    return make(points, store_after_each_step=True).run(2)


def test_every_point_is_in_one_collection_and_sizes_are_conserved(two_cycles):
    states = two_cycles.store.all().filter(F.col("step").isin(0, UPDATED)).collect()
    by_cycle = {}
    for r in states:
        by_cycle.setdefault(r["cycle"], {}).setdefault(r["collection"], set()).add(r["point_id"])
    assert set(by_cycle) == {0, 1, 2}
    first = by_cycle[0]
    for state in by_cycle.values():
        parts = [state[name] for name in BASE if name != "A"]
        assert sum(map(len, parts)) == len(set.union(*parts)) == 500
        assert state["A"] == first["A"] and state["A_val"] == first["A_val"]
        assert len(state["A_test"]) == len(state["B"]) == 150
        if "C" in state:
            assert state["C_test"] <= state["C"]
            assert not state["C_train"] & state["C_test"] and not state["C_val"] & state["C_test"]
            assert state["D"] <= state["C_test"] and state["D_relabeled"] <= state["D"]


def test_moved_points_go_last_and_are_replaced(two_cycles):
    states = {}
    for r in two_cycles.store.all().filter(F.col("step").isin(0, UPDATED)).collect():
        states.setdefault(r["cycle"], {}).setdefault(r["collection"], {})[r["point_id"]] = r["ord"]
    for cycle, stats in zip((1, 2), two_cycles.stats):
        before, after = states[cycle - 1], states[cycle]
        moved = set(after["A_train"]) - set(before["A_train"])
        assert len(moved) == stats[3] == stats[5] == stats[6] and stats[4] == 0
        assert moved == set(after["D_relabeled"])
        assert min(after["A_train"][p] for p in moved) > max(before["A_train"].values())
        fills = set(before["Z"]) - set(after["Z"])
        assert len(fills) == len(moved) and fills <= set(after["A_test"]) | set(after["B"])
        for name in ("A_test", "B"):
            assert len(moved & set(before[name])) == len(fills & set(after[name]))
        assert stats[3] == len(after["D"]) // 3


def test_all_steps_are_stored(two_cycles):
    steps = {(r["cycle"], r["step"]) for r in two_cycles.store.all().select("cycle", "step").distinct().collect()}
    assert steps == {(0, 0)} | {(c, s) for c in (1, 2) for s in range(1, 9)}


def test_members_lie_in_their_source_ranges(points, two_cycles):
    places = {r["point_id"]: r["pos"] for r in points.select("point_id", "pos").collect()}
    for r in two_cycles.store.all().collect():
        ranges = splits.source_ranges(r["collection"], 500, two_cycles.settings.weights)
        assert any(start <= places[r["point_id"]] < end for start, end in ranges)


def test_own_loss_and_metric(points):
    from maskloom.functions import metrics as m

    loop = make(points)
    loop.loss, loop.metric = m.hybrid_loss(), m.iou()
    loop.setup_data()
    loop.run_segmenter()
    _, _, _, loss, metric = loop.scores[0]
    assert 0 < metric < 1 and loss > 1 - metric


def test_discriminator_is_trained_once(two_cycles):
    trained = [row for row in two_cycles.history if row[2] == "agreement"]
    assert len(trained) == 1 and len(two_cycles.scores) == 4
    assert [r["cycle"] for r in two_cycles.scores_table().filter("model = 'classifier'").orderBy("cycle").collect()] == [1, 2]


def test_same_seed_other_partitions(points, two_cycles):
    again = make(points.repartition(5)).run(2)
    assert held(again.members) == held(two_cycles.members)
    for a, b in zip(again.scores, two_cycles.scores, strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:])


def test_other_seed_other_choice(points, two_cycles):
    other = make(points, seed=7).run(1)
    first = {r["point_id"] for r in two_cycles.store.load("run", 1, UPDATED).filter("collection = 'C_test'").collect()}
    assert held(other.members)["C_test"].keys() != first


def test_balanced_loop(points):
    # Balanced sides may differ by one point, so the second C cannot be strict.
    loop = make(points, balance=True, strict=False).run(2)
    sizes = [loop.sizes[name] for name in cur.BALANCED]
    assert max(sizes) - min(sizes) <= 3 and sum(loop.sizes[n] for n in BASE if n != "A") == 500
    assert loop.stats[0][7] > 0
    places = {r["point_id"]: r["pos"] for r in points.select("point_id", "pos").collect()}
    for r in loop.base.collect():
        ranges = splits.source_ranges(r["collection"], 500, loop.settings.weights, balance=True)
        assert any(start <= places[r["point_id"]] < end for start, end in ranges)
    ords = [(r["collection"], r["ord"]) for r in loop.base.collect()]
    assert len(ords) == len(set(ords))


def test_without_refill_the_origins_shrink(points):
    loop = make(points, fillup=False).run(1)
    assert loop.sizes["Z"] == 100 and loop.sizes["A_test"] + loop.sizes["B"] == 300 - loop.stats[0][5]


def test_short_reserve_is_an_error_before_any_write(points):
    loop = make(points)
    loop.setup_data()
    loop.cycle = 1
    loop.run_segmenter()
    loop.run_discriminator()
    loop.find_machine_labels()
    before = held(loop.base)
    loop.sizes["Z"] = 0
    with pytest.raises(ValueError, match="Z holds 0"):
        loop.relabel()
    assert held(loop.base) == before


class NeverMachine:
    """A discriminator that calls nothing machine from its second cycle on, or from the start."""

    history: list = []

    def __init__(self, cycles_before=0):
        self.left = cycles_before

    def fit(self, train, val):
        return self

    def transform(self, pairs):
        machine = F.lit(1.0 if self.left > 0 else 0.0)
        self.left -= 1
        scored = pairs.select("point_id", "label", F.array(F.lit(1.0) - machine, machine).alias("scores"))
        return scored.withColumn("verdict", F.col("scores")[1].cast("int"))


def test_no_machine_labels_stop_the_loop(points):
    loop = make(points)
    loop.discriminator = NeverMachine()
    loop.run(3)
    assert len(loop.stats) == 1 and loop.stats[0][2] == 0
    assert "D" not in loop.derived and loop.relabel()["selected"] == 0


def test_without_the_stop_rule_the_old_d_is_sampled_again_and_ids_are_lost(points):
    loop = make(points, stop_on_empty=False, percent_to_replace=50)
    loop.discriminator = NeverMachine(1)
    loop.run(2)
    assert loop.stats[0][2] == 30 and loop.stats[1][2] == 0
    lost = {r["point_id"] for r in loop.lost_table().collect()}
    # Half of D moved in the first cycle; some of those are drawn again.
    first = {r["point_id"] for r in loop.store.load("run", 1, UPDATED).filter("collection = 'D_relabeled'").collect()}
    assert lost and lost <= first and loop.stats[1][4] == len(lost)
    assert loop.stats[1][5] == loop.stats[1][3] - len(lost)
    assert {r["cycle"] for r in loop.lost_table().collect()} == {2}


def test_resuming_gives_the_same_result(points, two_cycles):
    again = make(points)
    again.resume(500, 1, 5, two_cycles.store)
    assert again.find_machine_labels() == two_cycles.stats[0][2]
    again.relabel()
    expected = two_cycles.store.load("run", 1, UPDATED).filter(F.col("collection").isin(*BASE))
    assert held(again.base) == held(expected)


def test_labels_by_hand_are_trained_on(points):
    by_hand = points.select("point_id", F.transform("truth", lambda t: F.lit(1.0) - t).alias("truth"))
    loop = make(points)
    loop.labels = by_hand
    loop.run(1)
    row = loop.relabeled_pixels().join(points.select("point_id", "truth"), "point_id").first()
    assert row["mask"] == [1 - t for t in row["truth"]]
    trained = loop._pixels("A_train").select("point_id", F.col("truth").alias("t")).join(points, "point_id").first()
    assert trained["t"] == [1 - t for t in trained["truth"]]


def test_machine_images_can_be_truncated(points):
    scaled = points.withColumn("image", F.transform("image", lambda x: (x + 1.5).cast("float")))
    grid = dict(low=1.31, high=1.69, steps=20)
    loop = CurationLoop(scaled, LoopSettings(machine_uint8=True), segmenter=learners.ThresholdSegmenter(**grid))
    loop.setup_data()
    loop.cycle = 1
    loop.run_segmenter()
    loop.build_c()
    rows = loop._pairs("C_test").collect()
    machine = [r for r in rows if r["label"] == 1]
    expert = [r for r in rows if r["label"] == 0]
    assert machine and expert
    assert all(x == int(x) for r in machine for x in r["image"])
    assert any(x != int(x) for r in expert for x in r["image"])


def test_small_memberships_are_broadcast_and_large_ones_are_not(points, monkeypatch):
    members = points.select("point_id", F.col("pos").alias("ord"))

    def hinted(n):
        return "strategy=broadcast" in cur.attach(points, members, n)._jdf.queryExecution().optimizedPlan().toString()

    assert hinted(cur.BROADCAST_ROWS) and not hinted(cur.BROADCAST_ROWS + 1)


@pytest.fixture(scope="module")
def chunked(spark, points, tmp_path_factory):
    from maskloom.sources import tables

    folder = tmp_path_factory.mktemp("chunks")
    monkey = pytest.MonkeyPatch()
    monkey.setattr(tables, "CHUNK", 16)
    yield tables.write_chunked(points, f"{folder}/points", "points_in_chunks", 16)
    monkey.undo()
    spark.sql("DROP TABLE points_in_chunks")


def test_large_memberships_meet_chunks_without_moving_pixels(spark, chunked, monkeypatch):
    monkeypatch.setattr(cur, "BROADCAST_ROWS", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        members = chunked.where("pos % 3 = 0").select("point_id", (F.col("pos") * 2).alias("ord"))
        inside = chunked.filter(splits.in_ranges(F.col("pos"), [(100, 300)]))
        rows = cur.attach(inside, members, 1)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        got = {r["pos"]: r["ord"] for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {p: 2 * p for p in range(100, 300) if p % 3 == 0}
    # The scan that reads the pixels has no exchange and no sort above it.
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "image" in line.split("PartitionFilters")[0])
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789"))
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if own < depth:
            depth = own
            assert "Exchange" not in line and "Sort " not in line, plan
    assert "PushedFilters: [" in lines[at] and "pos" in lines[at].split("PushedFilters")[1]


def test_loop_over_chunks_gives_the_same(chunked, two_cycles, monkeypatch):
    monkeypatch.setattr(cur, "BROADCAST_ROWS", 0)
    again = make(chunked).run(1)
    expected = two_cycles.store.load("run", 1, UPDATED).filter(F.col("collection").isin(*BASE))
    assert held(again.base) == held(expected)
    assert [s[3:] for s in again.scores] == [pytest.approx(s[3:]) for s in two_cycles.scores[:2]]


def test_transfer(spark):
    registry = spark.createDataFrame([("Z", "a", 0), ("Z", "b", 1), ("B", "c", 0)], "collection string, point_id string, ord long")
    moved = held(cur.transfer_one(registry, "Z", "B"))
    assert len(moved["Z"]) == 1 and len(moved["B"]) == 2
    assert held(cur.transfer_one(registry.filter("collection = 'B'"), "Z", "B")) == {"B": {"c": 0}}


def test_epochs_refine_and_stop(points):
    train, val = points.filter("pos < 100"), points.filter("pos >= 100 and pos < 200")
    model = learners.ThresholdSegmenter(**GRID, epochs=8, patience=2).fit(train, val)
    losses = [row[2] for row in model.history]
    assert losses == sorted(losses, reverse=True) or len(losses) < 8
    assert abs(model.cut) < 0.01 and model.history[0][1] == 0


def test_learners_by_name():
    assert isinstance(learners.make_segmenter("threshold", steps=5), learners.ThresholdSegmenter)
    own = learners.PixelLogisticSegmenter()
    assert learners.make_segmenter(own) is own
    assert isinstance(learners.make_discriminator("pair_logistic", cut=0.1), learners.PairLogisticDiscriminator)
    with pytest.raises(KeyError):
        learners.make_segmenter("unknown")


def test_loop_with_additive_learners(points):
    chosen = {"segmenter": "pixel_additive", "discriminator": "pair_additive"}
    loop = CurationLoop(points, LoopSettings(store_after_each_step=True), **chosen).run(1)
    classifier, discriminator = loop.scores
    assert classifier[4] > 0.9 and 0.3 <= discriminator[4] <= 1
    epochs = [row for row in loop.history if row[2] == "pixel_additive"]
    assert len(epochs) >= 3 and all(row[6] is not None for row in epochs)
    again = CurationLoop(points, loop.settings, path=loop.path, **chosen)
    again.resume(None, cycle=1, step=4)
    assert again.segmenter_model.weights == loop.segmenter_model.weights


def test_loop_with_mllib_learners(points):
    loop = CurationLoop(points, LoopSettings(), segmenter="pixel_logistic", discriminator="pair_logistic").run(1)
    classifier, discriminator = loop.scores
    assert classifier[4] > 0.9 and 0.3 <= discriminator[4] <= 1
    assert loop.predictions(3).count() == 3


def test_agreement_bound_follows_the_size_of_the_pictures(spark):
    """Expert masks that differ in half a percent of 128 x 128 pixels are told apart."""
    rng = random.Random(4)
    rows = []
    for k in range(12):
        image = [rng.random() for _ in range(128 * 128)]
        mask = [float(x >= 0.5) for x in image]
        if k % 2 == 0:
            for at in rng.sample(range(len(mask)), 80):
                mask[at] = 1 - mask[at]
        rows.append((f"p{k}", 128, 128, image, mask, k % 2))
    pairs = spark.createDataFrame(rows, "point_id string, h int, w int, image array<double>, mask array<double>, label int")
    fine = learners.AgreementDiscriminator(0.5).fit(pairs, pairs)
    coarse = learners.AgreementDiscriminator(0.5, levels=64).fit(pairs, pairs)
    assert fine.history[0][3] == 1.0 and coarse.history[0][3] == 0.5


def test_threshold_grid_follows_the_pixels(spark):
    rows = [(f"p{k}", 2, 2, [0.0, 100.0, 160.0, 255.0], [0.0, 0.0, 1.0, 1.0]) for k in range(3)]
    bright = spark.createDataFrame(rows, "point_id string, h int, w int, image array<double>, truth array<double>")
    model = learners.ThresholdSegmenter().fit(bright, bright)
    assert 100 < model.cut <= 160 and model.history[0][3] == 1.0
    with pytest.raises(ValueError):
        learners.ThresholdSegmenter().fit(bright.limit(0), bright)
