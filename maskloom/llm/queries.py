"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            SQL[build.__name__] = sql
        return build

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- 9: mixing ------------------------------------------------------------------------------

SQL_MIX = r"""
WITH d AS (
  SELECT doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size * 3 / w, source IS NULL, source) AS rk FROM r
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM o
), p AS (
  SELECT source, source_size,
         CASE WHEN source_size * 3 <= w * level THEN (source_size * 3)::DOUBLE
              ELSE w * (SELECT level FROM l WHERE source_size * 3 > w * level ORDER BY rk LIMIT 1) END AS target
  FROM l
), b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget,
                CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM p),
q AS (SELECT doc_id, avg(quality) AS quality FROM labels GROUP BY doc_id),
k AS (
  SELECT d.*, -ln((CAST('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13) AS BIGINT)::DOUBLE + 1) / 4503599627370496.0::DOUBLE)
         / coalesce(0.5 + quality, 1.0) AS key
  FROM d LEFT JOIN q ON d.doc_id = q.doc_id
), u AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS upto
  FROM k
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - upto)) AS BIGINT) AS taken
FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source
"""


@query(SQL_MIX)
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from maskloom.llm.mixing import mix_sources

    docs = documents(spark, folder).select("doc_id", "source", "text")
    return mix_sources(docs, table(spark, folder, "labels")).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
    )


# --- 2: packing -----------------------------------------------------------------------------


@query()
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    from maskloom.llm.packing import pack

    return pack(documents(spark, folder)).drop("ids")


# --- 4: token-id files ----------------------------------------------------------------------


@query()
def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from maskloom.llm.grammar import encode_and_read

    return encode_and_read(documents(spark, folder))


# --- 8: near duplicates ---------------------------------------------------------------------


@query()
def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from maskloom.llm.minhash import near_duplicates

    return near_duplicates(documents(spark, folder))


# --- 6: exact top-k -------------------------------------------------------------------------

SQL_TOP = """
WITH v AS (
  SELECT vec_id, list_sum([
           CASE WHEN embedding[i] > 0 THEN (1::HUGEINT << (i - 1)) ELSE 0::HUGEINT END FOR i IN range(1, 65)])::HUGEINT AS code
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), d AS (
  SELECT q.vec_id AS query_id, v.vec_id, bit_count(xor(q.code, v.code))::BIGINT AS distance
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q, (SELECT DISTINCT * FROM v) v
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""


@query(SQL_TOP)
def op6_top_k(spark: SparkSession, folder: str) -> DataFrame:
    from maskloom.llm.hamming import nearest_codes

    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest_codes(vectors, vectors.where("vec_id % 50 = 0"))


# --- 10: conversations ----------------------------------------------------------------------

SQL_CHAT = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
         count(*) OVER (PARTITION BY conv_id) AS n_turns,
         md5(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n')) AS h
  FROM t
), x AS (
  SELECT *, string_agg(h, ',') OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS prefix,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered
  FROM p
), e AS (SELECT prefix, min(conv_id) AS conv_id FROM x WHERE place = n_turns GROUP BY prefix),
k AS (SELECT conv_id FROM e WHERE prefix NOT IN (SELECT prefix FROM x WHERE place < n_turns))
SELECT conv_id, place, n_turns, role, rendered,
       CAST(sum(length(rendered)) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) - length(rendered) AS BIGINT) AS start
FROM x WHERE conv_id IN (SELECT conv_id FROM k)
"""


@query(SQL_CHAT)
def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    from maskloom.llm.chat import collapse_snapshots

    return collapse_snapshots(table(spark, folder, "conversations"))


# --- 1: personal data -----------------------------------------------------------------------


@query()
def op1_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    from maskloom.llm.pii import find_personal_data

    return find_personal_data(documents(spark, folder), everywhere=True)


# --- 3: toxicity ----------------------------------------------------------------------------


@query()
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from maskloom.llm.toxicity import score, train

    docs = documents(spark, folder)
    return score(docs, train(docs, table(spark, folder, "labels")))


# --- 7: repeated strings --------------------------------------------------------------------


@query()
def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    from maskloom.llm.suffix import remove_repeats

    return remove_repeats(documents(spark, folder))


# --- 5: near-equal vectors ------------------------------------------------------------------


@query()
def op5_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    from maskloom.llm.graph import near_vectors

    return near_vectors(table(spark, folder, "embeddings"))


# --- 11: whitening --------------------------------------------------------------------------


@query()
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from maskloom.llm.whitening import fit, whiten

    vectors = table(spark, folder, "embeddings")
    model = fit(vectors)
    explained = F.array(*[F.lit(float(x)) for x in model.explained]) if len(model.values) else F.array().cast("array<double>")
    return whiten(vectors, model).select(
        "vec_id", "n", F.col("deviation").cast("long").alias("deviation"),
        F.posexplode(F.arrays_zip("whitened", explained.alias("explained"))).alias("place", "c"),
    ).select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation",
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


# --- 12: lexical search ---------------------------------------------------------------------

SQL_LEXICAL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), l AS (SELECT doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
t AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM l),
p AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf, any_value(m) AS m
  FROM (SELECT doc_id, unnest(terms) AS term, 100 - 25 + (25 * n * docs) // total AS m FROM l, t)
  GROUP BY doc_id, term
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM p, t GROUP BY term
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) GROUP BY item_id, doc_id
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM s WHERE score > 0
)
SELECT * FROM r WHERE rank <= 20
"""


@query(SQL_LEXICAL)
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    from maskloom.llm.lexical import build, search

    return search(build(documents(spark, folder)), table(spark, folder, "benchmark"))


# --- 13: nearest neighbours -----------------------------------------------------------------


@query()
def op13_nearest(spark: SparkSession, folder: str) -> DataFrame:
    from maskloom.llm.tree import nearest_vectors

    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest_vectors(vectors, vectors.where("vec_id % 20 = 0"))
