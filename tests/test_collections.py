"""The stored catalog of collections."""

from maskloom.sources.collections import CollectionCatalog


def members(spark, *ids):
    return spark.createDataFrame([(i, k, None) for k, i in enumerate(ids)], "point_id string, ord int, value int")


def test_registrations_in_order(spark, tmp_path):
    catalog = CollectionCatalog(spark, str(tmp_path / "c"))
    assert catalog.table().count() == catalog.members().count() == 0 and catalog.get("A") is None
    numbers = [
        catalog.register(members(spark, "a", "b"), "A"), catalog.register(members(spark, "b", "c")),
        catalog.register(members(spark, "d"), "A"), catalog.register(members(spark, "c", "e"), "B"),
        catalog.register(members(spark), "empty"),
    ]
    assert numbers == [0, 1, 2, 3, 4]
    # Another object, as another session would have it.
    again = CollectionCatalog(spark, str(tmp_path / "c"))
    assert [tuple(r)[:2] for r in again.table().orderBy("reg_no").collect()] == [(1, None), (2, "A"), (3, "B"), (4, "empty")]
    assert again.registrations().count() == 5
    assert [tuple(r) for r in again.get("A").collect()] == [("d", 0, None)] and again.get("empty").count() == 0
    held = sorted((r["reg_no"], r["point_id"], r["ord"]) for r in again.members().collect())
    assert held == [(1, "b", 0), (1, "c", 1), (2, "d", 0), (3, "c", 0), (3, "e", 1)]
    wanted = spark.createDataFrame([(i,) for i in "abcdex"], "point_id string")
    found = {r["point_id"]: (r["reg_no"], r["name"]) for r in again.find(wanted).collect()}
    assert found == {"b": (1, None), "c": (1, None), "d": (2, "A"), "e": (3, "B")}
