"""Registry and snapshot operators (orders and customers as points)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from maskloom.catalog.common import SQL_POINTS, images, order_points, query, sql_key, table
from maskloom.catalog.split_queries import SQL_SETUP
from maskloom.functions.hashing import point_id
from maskloom.operators import registry as reg
from maskloom.operators import splits
from maskloom.operators.index import ordered_index, position_index
from maskloom.session import shared_dir
from maskloom.sources import images as img
from maskloom.sources import tables
from maskloom.sources.collections import CollectionCatalog


def _setup(spark, folder):
    points = order_points(spark, folder)
    return splits.setup_split(points, points.count(), splits.DEFAULT_WEIGHTS)


def _buyers(spark, folder):
    """One point per customer with orders: place of the first order, value of the last."""
    rows = order_points(spark, folder).select(
        point_id("customer", F.col("customer")).alias("point_id"), "pos", "value"
    )
    return reg.from_points(rows)


# Some customers have no order above this price, so that both branches of a merge have rows.
LARGE = 450000


def _large_buyers(spark, folder):
    """As ``_buyers``, of the orders above ``LARGE``."""
    rows = order_points(spark, folder).where(F.col("value") > LARGE).select(
        point_id("customer", F.col("customer")).alias("point_id"), "pos", "value"
    )
    return reg.from_points(rows)


def _customers(spark, folder):
    return table(spark, folder, "customer").select(
        point_id("customer", F.col("c_custkey")).alias("point_id"),
        F.col("c_custkey").alias("pos"),
        F.col("c_acctbal").alias("value"),
    )


SQL_BUYERS = f"""
buyers AS (
  SELECT md5('customer:' || customer) AS point_id, min(pos) AS ord, arg_max(value, pos) AS value
  FROM pts GROUP BY customer
), large AS (
  SELECT md5('customer:' || customer) AS point_id, min(pos) AS ord, arg_max(value, pos) AS value
  FROM pts WHERE value > {LARGE} GROUP BY customer
), custs AS (
  SELECT md5('customer:' || c_custkey) AS point_id, c_custkey AS pos, c_acctbal AS value FROM customer
)
"""


@query("SELECT md5('customer:' || c_custkey) AS point_id, c_custkey AS pos FROM customer")
def registry_points(spark, folder):
    """Stable ids from source and position."""
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("pos"))
    return reg.make_points(rows, "customer").select("point_id", "pos")


@query(f"WITH {SQL_POINTS}, {SQL_BUYERS} SELECT point_id, ord, round(value, 6) AS value FROM buyers")
def registry_dedup(spark, folder):
    """A repeated id keeps its first place and takes its last value."""
    return _buyers(spark, folder).select("point_id", "ord", F.round("value", 6).alias("value"))


@query(f"WITH {SQL_POINTS}, {SQL_BUYERS} SELECT point_id, ord, round(value, 6) AS value FROM buyers")
def registry_from_values(spark, folder):
    """Values with keys by position; repeated keys collapse."""
    points = order_points(spark, folder)
    keys = points.select("pos", point_id("customer", F.col("customer")).alias("point_id"))
    made = reg.from_values(points.select("pos", "value"), keys)
    return made.select("point_id", "ord", F.round("value", 6).alias("value"))


@query(f"""WITH {SQL_POINTS}, {SQL_BUYERS}, merged AS (
    SELECT coalesce(b.point_id, c.point_id) AS point_id,
           CASE WHEN b.ord IS NULL THEN 1 ELSE 0 END AS late, coalesce(b.ord, c.pos) AS place,
           coalesce(c.value, b.value) AS value
    FROM large b FULL JOIN custs c ON b.point_id = c.point_id)
  SELECT point_id, row_number() OVER (ORDER BY late, place) - 1 AS idx, round(value, 6) AS value
  FROM merged""")
def registry_upsert(spark, folder):
    """All customers added to those with large orders: known ones updated in place, others appended."""
    merged = reg.upsert(_large_buyers(spark, folder), _customers(spark, folder))
    return position_index(merged).select("point_id", "idx", F.round("value", 6).alias("value"))


@query(f"WITH {SQL_POINTS}, {SQL_BUYERS} SELECT point_id, pos FROM custs "
       "WHERE point_id NOT IN (SELECT point_id FROM large)")
def registry_remove(spark, folder):
    """Customers left after removing those with large orders."""
    everyone = _customers(spark, folder).select("point_id", "pos")
    return reg.remove(everyone, _large_buyers(spark, folder))


@query(f"WITH {SQL_POINTS}, {SQL_BUYERS} SELECT point_id FROM custs EXCEPT SELECT point_id FROM large")
def registry_missing(spark, folder):
    """Ids whose removal would be an error."""
    return reg.missing_ids(_large_buyers(spark, folder), _customers(spark, folder))


@query(f"""WITH {SQL_POINTS}, {SQL_BUYERS}, r AS (
    SELECT point_id, row_number() OVER (ORDER BY ord) - 1 AS idx, count(*) OVER () AS total FROM buyers)
  SELECT 'first' AS place, point_id, idx FROM r WHERE idx = 0
  UNION ALL SELECT 'last', point_id, idx FROM r WHERE idx = total - 1
  UNION ALL SELECT 'eleventh', point_id, idx FROM r WHERE idx = 10""")
def registry_get_index(spark, folder):
    """Points at places 0, -1 and 10."""
    buyers = _buyers(spark, folder)
    rows = [
        reg.get_at(buyers, at).select(F.lit(place).alias("place"), "point_id", "idx")
        for place, at in (("first", 0), ("last", -1), ("eleventh", 10))
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"WITH {SQL_POINTS} SELECT point_id, pos, round(value, 6) AS value FROM pts "
       "WHERE point_id = md5('orders:7')")
def registry_get_point(spark, folder):
    """Point by id."""
    wanted = order_points(spark, folder).filter(F.col("pos") == 7).first()["point_id"]
    hit = reg.get_point(order_points(spark, folder), wanted)
    return hit.select("point_id", "pos", F.round("value", 6).alias("value"))


@query(f"""WITH {SQL_POINTS}, {SQL_SETUP}, m AS (
    SELECT collection, point_id FROM members WHERE collection <> 'Z'
    UNION ALL SELECT 'Z', point_id FROM pts WHERE status = 'P')
  SELECT collection, count(*) AS n_points FROM m GROUP BY collection""")
def registry_register(spark, folder):
    """A collection registered under a used name replaces the older one."""
    pending = order_points(spark, folder).filter(F.col("status") == "P")
    return reg.sizes(
        reg.register(_setup(spark, folder), pending.select("point_id", F.col("pos").alias("ord")), "Z")
    )


@query(f"WITH {SQL_POINTS}, {SQL_SETUP} SELECT DISTINCT collection FROM members")
def registry_names(spark, folder):
    return reg.names(_setup(spark, folder))


@query(f"WITH {SQL_POINTS}, {SQL_SETUP} SELECT collection, count(*) AS n_points FROM members GROUP BY 1")
def registry_sizes(spark, folder):
    return reg.sizes(_setup(spark, folder))


@query(f"""WITH {SQL_POINTS}, {SQL_SETUP}
  SELECT point_id, ord FROM members WHERE collection = 'A_test'""")
def registry_get(spark, folder):
    """Collection by name."""
    return reg.collection_of(_setup(spark, folder), "A_test").select("point_id", "ord")


@query(f"WITH {SQL_POINTS}, {SQL_SETUP} SELECT point_id FROM pts WHERE status = 'F' AND point_id IN "
       "(SELECT point_id FROM members WHERE collection = 'B')")
def registry_contains(spark, folder):
    """Finished orders that B holds."""
    finished = order_points(spark, folder).filter(F.col("status") == "F").select("point_id")
    return reg.contains(reg.collection_of(_setup(spark, folder), "B"), finished)


@query(f"""WITH {SQL_POINTS}, s AS (
    SELECT point_id, row_number() OVER (ORDER BY {sql_key('shuffle')}, point_id) - 1 AS idx FROM pts)
  SELECT s.idx, pts.point_id AS left_id, s.point_id AS right_id
  FROM s JOIN pts ON pts.pos = s.idx WHERE pts.point_id <> s.point_id""")
def registry_order_check(spark, folder):
    """Places at which a collection and its shuffle differ."""
    rows = order_points(spark, folder).select("point_id", F.col("pos").alias("ord"))
    return reg.order_mismatches(rows, reg.shuffled(rows))


# Finished orders of A_test and B move behind A_train, in order of position.
SQL_MOVED = """
base AS (SELECT * FROM members WHERE collection <> 'A'),
top AS (SELECT max(ord) AS top FROM base WHERE collection = 'A_train'),
moved AS (
  SELECT CASE WHEN collection IN ('A_test', 'B') AND status = 'F' THEN 'A_train' ELSE collection END
           AS collection, base.point_id,
         CASE WHEN collection IN ('A_test', 'B') AND status = 'F' THEN top + 1 + pos ELSE ord END AS ord
  FROM base JOIN pts USING (point_id), top
)
"""


def _moved(spark, folder):
    base = _setup(spark, folder).filter(F.col("collection") != "A")
    finished = order_points(spark, folder).filter(F.col("status") == "F")
    moves = (
        base.filter(F.col("collection").isin("A_test", "B"))
        .join(finished, "point_id")
        .select(
            "point_id", F.col("collection").alias("source"), F.lit("A_train").alias("target"),
            F.col("pos").alias("rank"),
        )
    )
    return reg.move(base, moves, strict=False)


@query(f"WITH {SQL_POINTS}, {SQL_SETUP}, {SQL_MOVED} SELECT collection, point_id, ord FROM moved")
def registry_move(spark, folder):
    """Bulk move between collections."""
    return _moved(spark, folder).select("collection", "point_id", "ord")


@query(f"""WITH {SQL_POINTS}, {SQL_SETUP}
  SELECT point_id, string_agg(collection, ',' ORDER BY collection) AS collections
  FROM members GROUP BY point_id""")
def registry_find(spark, folder):
    """Collections of every point."""
    found = reg.find_all(_setup(spark, folder))
    return found.select("point_id", F.concat_ws(",", "collections").alias("collections"))


@query(f"""WITH {SQL_POINTS}, {SQL_SETUP}, reg AS (
    SELECT DISTINCT collection, md5(collection) AS collection_id,
           CASE WHEN collection IN ('A', 'A_test', 'Z') THEN collection END AS name FROM members),
  hits AS (
    SELECT point_id, name, row_number() OVER (PARTITION BY point_id ORDER BY collection_id) - 1 AS hit
    FROM members JOIN reg USING (collection))
  SELECT point_id, coalesce(name, 'unknown' || hit) AS name FROM hits""")
def registry_find_named(spark, folder):
    """Collections of every point by name, unnamed ones numbered."""
    members = _setup(spark, folder).withColumn("collection_id", F.md5("collection"))
    catalog = members.select(
        "collection_id",
        F.when(F.col("collection").isin("A", "A_test", "Z"), F.col("collection")).alias("name"),
        F.col("collection_id").alias("reg_no"),
    ).distinct()
    return reg.find_named(members, catalog).select("point_id", "name")


# --- tables ---------------------------------------------------------------------------------


def _stored(spark, folder):
    """Set-up and moved state, written as snapshots of two cycles."""
    store = tables.SnapshotStore(spark, f"{shared_dir(spark)}/states-{uuid.uuid4().hex}")
    first = _setup(spark, folder).filter(F.col("collection") != "A")
    store.save(first.withColumn("value", F.lit(None).cast("int")), "orders", 0, 0)
    store.save(_moved(spark, folder).withColumn("value", F.lit(None).cast("int")), "orders", 1, 8)
    return store


@query(f"""WITH {SQL_POINTS}, {SQL_SETUP}, {SQL_MOVED}
  SELECT moved.point_id, 1 AS cycle, 8 AS step, base.collection AS previous,
         moved.collection AS collections
  FROM moved JOIN base USING (point_id) WHERE moved.collection <> base.collection""")
def snapshot_trace(spark, folder):
    """Points that changed their collection between two stored states."""
    changed = tables.transitions(_stored(spark, folder).all())
    return changed.select("point_id", "cycle", "step", "previous", "collections")


@query(f"WITH {SQL_POINTS}, {SQL_SETUP}, {SQL_MOVED} "
       "SELECT collection, count(*) AS n_points, max(ord) AS top FROM moved GROUP BY collection")
def snapshot_resume(spark, folder):
    """Sizes read from the latest stored state."""
    state = _stored(spark, folder).load("orders", 1, 8)
    return state.groupBy("collection").agg(F.count("*").alias("n_points"), F.max("ord").alias("top"))


@query("""WITH taken AS (SELECT DISTINCT l_partkey AS name, l_linenumber::BIGINT AS version FROM lineitem),
  cand AS (SELECT DISTINCT name, 0::BIGINT AS version FROM taken UNION SELECT name, version + 1 FROM taken)
  SELECT name, min(version) AS version FROM cand
  WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.name = cand.name AND t.version = cand.version)
  GROUP BY name""")
def next_version(spark, folder):
    """First free number per artifact name; line numbers stand in for versions."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("name"), F.col("l_linenumber").alias("version")
    )
    return tables.first_free_version(rows)


@query("SELECT count(*) AS n_points, sum(pos)::BIGINT AS sum_pos, round(sum(s), 6) AS pixel_sum FROM "
       "(SELECT vec_id AS pos, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS s FROM embeddings)")
def points_store(spark, folder):
    """Points written to parquet and read back."""
    path = f"{shared_dir(spark)}/points-{uuid.uuid4().hex}"
    tables.write_points(images(spark, folder), path)
    stored = tables.read_points(spark, path)
    total = F.aggregate("image", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return stored.agg(
        F.count("*").alias("n_points"), F.sum("pos").alias("sum_pos"),
        F.round(F.sum(total), 6).alias("pixel_sum"),
    )


@query("""WITH ranked AS (
    SELECT page_id, url, row_number() OVER (ORDER BY url, page_id) - 1 AS idx
    FROM pages WHERE NOT contains(url, 'example.net'))
  SELECT page_id, idx FROM ranked""")
def file_listing(spark, folder):
    """Paths without a marker, ranked by path; page addresses stand in for file names."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    chosen = pages.filter(img.is_kind(F.col("url"), "image", "example.net"))
    return ordered_index(chosen, "url", "page_id").select("page_id", "idx")


@query("""WITH files AS (SELECT page_id, regexp_extract(url, '^http://([^/]*)', 1) AS host, url FROM pages),
  paths AS (SELECT page_id, regexp_extract(host, '[^.]*$', 0) || '/' || url || '#' || page_id AS path FROM files)
  SELECT page_id, row_number() OVER (ORDER BY path) - 1 AS idx FROM paths
  WHERE (path LIKE 'net/%' OR path LIKE 'org/%') AND NOT contains(path, '/de/')""")
def folders_listing(spark, folder):
    """Files of two folders ranked together by path; the last part of a page's host stands in for its folder."""
    host = F.regexp_extract("url", "^http://([^/]*)", 1)
    path = F.concat_ws("", F.regexp_extract(host, "[^.]*$", 0), F.lit("/"), "url", F.lit("#"), "page_id")
    files = table(spark, folder, "pages").select("page_id", path.alias("path"))
    both = files.filter(img.in_folders(F.col("path"), "net", "org/"))
    return img.select_kind(both, "image", marker="/de/").select("page_id", "idx")


@query("""WITH i AS (SELECT page_id, row_number() OVER (ORDER BY url, page_id) - 1 AS idx FROM pages),
  m AS (SELECT page_id, row_number() OVER (ORDER BY length(html), page_id) - 1 AS idx FROM pages)
  SELECT i.page_id AS image_id, m.page_id AS mask_id, idx FROM i JOIN m USING (idx)""")
def file_pairs(spark, folder):
    """Two equally long listings paired by place."""
    pages = table(spark, folder, "pages")
    left = ordered_index(pages.select("url", "page_id"), "url", "page_id")
    right = ordered_index(
        pages.select(F.length("html").alias("size"), "page_id"), "size", "page_id"
    )
    return img.pair_by_position(
        left.select("idx", F.col("page_id").alias("image_id")),
        right.select("idx", F.col("page_id").alias("mask_id")),
    )


@query(f"""WITH {SQL_POINTS}, held AS (
    SELECT 1 AS reg_no, NULL AS name, * FROM pts WHERE pos % 3 = 1
    UNION ALL SELECT 2, 'kept', * FROM pts WHERE pos % 5 = 0
    UNION ALL SELECT 3, 'replaced', * FROM pts WHERE pos % 2 = 0)
  SELECT point_id, min(reg_no) AS reg_no, arg_min(coalesce(name, ''), reg_no) AS name, count(*) AS n_held
  FROM held GROUP BY point_id""")
def stored_catalog(spark, folder):
    """Collections registered with and without a name, one replaced: who holds each point first."""
    points = order_points(spark, folder)
    rows = points.select("point_id", F.col("pos").alias("ord"), F.lit(None).cast("int").alias("value"))
    catalog = CollectionCatalog(spark, f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}")
    catalog.register(rows.where("ord % 7 = 0"), "replaced")
    catalog.register(rows.where("ord % 3 = 1"))
    catalog.register(rows.where("ord % 5 = 0"), "kept")
    catalog.register(rows.where("ord % 2 = 0"), "replaced")
    counts = catalog.members().groupBy("point_id").agg(F.count("*").alias("n_held"))
    first = catalog.find(points.select("point_id")).select(
        "point_id", "reg_no", F.coalesce("name", F.lit("")).alias("name")
    )
    return first.join(counts, "point_id")
