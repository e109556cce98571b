import pytest
from pyspark.sql import functions as F

from maskloom.operators import registry as reg

P1, P2, P3 = "p1", "p2", "p3"


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.fixture
def walk(spark):
    """c1 holds p1 and p3 and is unnamed; c2 holds p2."""
    return rows(spark, [("c1", P1, 0), ("c1", P3, 1), ("c2", P2, 0)], "collection string, point_id string, ord long")


def order(df, name):
    picked = reg.collection_of(df, name).orderBy("ord").collect()
    return [r["point_id"] for r in picked]


def test_walk_through(spark, walk):
    moves = rows(spark, [(P2, "c2", "c1", 0)], "point_id string, source string, target string, rank long")
    moved = reg.move(walk, moves)
    assert order(moved, "c1") == [P1, P3, P2] and order(moved, "c2") == []

    box = reg.Registry(moved)
    new = rows(spark, [(P1, 0), (P1, 1)], "point_id string, pos long")
    box = box.add("c2", new)
    assert order(box.members, "c2") == [P1]

    assert box.find(P1) == ["c1", "c2"]
    assert box.find("p10") == []
    members = box.members.withColumnRenamed("collection", "collection_id")
    catalog = rows(spark, [("c1", None, 0), ("c2", "second", 1)], "collection_id string, name string, reg_no int")
    named = reg.find_named(members, catalog).filter(F.col("point_id") == P1)
    assert {r["name"]: r["collection_id"] for r in named.collect()} == {"unknown0": "c1", "second": "c2"}


def test_move_of_a_missing_point_is_an_error(spark, walk):
    moves = rows(spark, [(P2, "c1", "c2", 0)], "point_id string, source string, target string, rank long")
    with pytest.raises(KeyError):
        reg.move(walk, moves)


def test_move_into_a_collection_that_holds_the_id(spark, walk):
    walk = walk.unionByName(rows(spark, [("c2", P1, 5)], walk.schema))
    moves = rows(spark, [(P1, "c1", "c2", 0)], "point_id string, source string, target string, rank long")
    moved = reg.move(walk, moves)
    assert order(moved, "c1") == [P3] and order(moved, "c2") == [P2, P1]
    assert moved.filter("point_id = 'p1'").first()["ord"] == 5


MOVES = "point_id string, source string, target string, rank long"


def test_a_moved_value_replaces_the_held_one(spark):
    schema = "collection string, point_id string, ord long, value string"
    both = rows(spark, [("c1", P1, 0, "new"), ("c2", P1, 5, "old"), ("c2", P2, 6, "x")], schema)
    got = reg.move(both, rows(spark, [(P1, "c1", "c2", 0)], MOVES)).collect()
    assert sorted(map(tuple, got)) == [("c2", P1, 5, "new"), ("c2", P2, 6, "x")]


def test_a_move_into_its_own_collection_puts_the_point_last(spark, walk):
    moved = reg.move(walk, rows(spark, [(P1, "c1", "c1", 0)], MOVES))
    assert order(moved, "c1") == [P3, P1] and order(moved, "c2") == [P2]


def test_a_second_move_of_a_point(spark, walk):
    moves = rows(spark, [(P1, "c1", "c2", 3), (P1, "c1", "c3", 1)], MOVES)
    with pytest.raises(KeyError):
        reg.move(walk, moves)
    moved = reg.move(walk, moves, strict=False)
    assert order(moved, "c3") == [P1] and order(moved, "c2") == [P2] and order(moved, "c1") == [P3]


def test_swap_of_equal_ids(spark):
    schema = "collection string, point_id string, ord long, value string"
    both = rows(spark, [("c1", P1, 0, "one"), ("c2", P1, 0, "two")], schema)
    moved = reg.move(both, rows(spark, [(P1, "c1", "c2", 0), (P1, "c2", "c1", 0)], MOVES)).collect()
    assert sorted((r["collection"], r["value"]) for r in moved) == [("c1", "two"), ("c2", "one")]


def test_add_keeps_values(spark):
    members = rows(spark, [("c1", P1, 0, "a")], "collection string, point_id string, ord long, value string")
    box = reg.Registry(members).add("c1", rows(spark, [(P2, 0, "b")], "point_id string, pos long, value string"))
    assert {r["point_id"]: r["value"] for r in box.members.collect()} == {P1: "a", P2: "b"}


def test_duplicate_keys(spark):
    values = rows(spark, [(0, "v0"), (1, "v1"), (2, "v2")], "pos long, value string")
    keys = rows(spark, [(0, "a"), (1, "b"), (2, "a")], "pos long, point_id string")
    made = reg.from_values(values, keys).orderBy("ord").collect()
    assert [(r["point_id"], r["value"]) for r in made] == [("a", "v2"), ("b", "v1")]


def test_values_without_keys_get_stable_ids(spark):
    values = rows(spark, [(0, "x"), (1, "y")], "pos long, value string")
    first, second = reg.from_values(values).collect(), reg.from_values(values).collect()
    assert sorted(first) == sorted(second) and len({r["point_id"] for r in first}) == 2


def test_upsert(spark):
    old = rows(spark, [("a", 0, "x"), ("b", 1, "y")], "point_id string, ord long, value string")
    new = rows(spark, [("c", 0, "z"), ("a", 1, None)], "point_id string, pos long, value string")
    got = {r["point_id"]: (r["ord"], r["value"]) for r in reg.upsert(old, new).collect()}
    assert got["a"] == (0, None) and got["b"] == (1, "y") and got["c"] == (2, "z")


def test_upsert_into_an_empty_collection(spark):
    old = rows(spark, [], "point_id string, ord long, value string")
    new = rows(spark, [("c", 0, "z")], "point_id string, pos long, value string")
    assert [tuple(r) for r in reg.upsert(old, new).collect()] == [("c", 0, "z")]


def test_remove(spark, walk):
    c1 = reg.collection_of(walk, "c1")
    ids = rows(spark, [(P1,)], "point_id string")
    assert [r["point_id"] for r in reg.remove(c1, ids).collect()] == [P3]
    with pytest.raises(KeyError):
        reg.remove(c1, rows(spark, [(P2,)], "point_id string"))


def test_get(spark, walk):
    c1 = reg.collection_of(walk, "c1")
    assert reg.get_at(c1, 0).first()["point_id"] == P1
    assert reg.get_at(c1, -1).first()["point_id"] == P3
    for outside in (2, -3):
        with pytest.raises(IndexError):
            reg.get_at(c1, outside)
    assert reg.get_point(c1, P3).first()["ord"] == 1
    with pytest.raises(KeyError):
        reg.get_point(c1, P2)


@pytest.mark.parametrize("parts", [2, 4096])
def test_get_at_in_wide_and_clustered_orders(spark, monkeypatch, parts):
    """Places found range by range equal the sorted list, negative and far orders included."""
    monkeypatch.setattr(reg, "ORD_BUCKET", 4)
    monkeypatch.setattr(reg, "PARTS", parts)
    ords = sorted({*range(-9, 3), *range(500, 505), 77, -(10**12), 10**15, 10**15 + 1})
    c = rows(spark, [(f"p{o}", o) for o in reversed(ords)], "point_id string, ord long")
    for at in (0, 1, 9, 13, len(ords) - 2, -1, -len(ords)):
        hit = reg.get_at(c, at).collect()
        assert [(r.point_id, r.idx) for r in hit] == [(f"p{ords[at]}", at % len(ords))]
    with pytest.raises(IndexError):
        reg.get_at(c.limit(0), 0)


def test_register_replaces_and_unknown_names_are_none(spark, walk):
    box = reg.Registry(walk).register(rows(spark, [("n", 0)], "point_id string, ord long"), "c2")
    assert order(box.members, "c2") == ["n"]
    assert box.get("nowhere") is None and box.names() == ["c1", "c2"]
    assert box.sizes() == {"c1": 2, "c2": 1}
    assert reg.Registry.empty(spark).names() == []


def test_alignment(spark, walk):
    c1 = reg.collection_of(walk, "c1")
    assert reg.order_mismatches(c1, c1.withColumn("ord", F.col("ord") * 9)).count() == 0
    assert reg.order_mismatches(c1, c1.withColumn("ord", -F.col("ord"))).count() == 2
    assert reg.order_mismatches(c1, c1.limit(1)).count() == 1
