"""The registered queries over the smallest tables: against SQL, or against plain versions."""

import hashlib

import numpy as np
import pytest
from brute import base_spans, crc, near_documents, near_vectors, repeats, span_text, token_ids
from conftest import SMALL
from oracle import compare, connect

from maskloom.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    return [tuple(r) for r in docs.collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), connect(SMALL), SQL[name]) is None


def test_a_query_of_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_personal_data(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op1_personal_data"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        base = base_spans(text or "")
        assert got[i].base_sha256 == hashlib.sha256(span_text(base).encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [
            sum(k == kind for _, k, _ in base) for kind in range(4)
        ]
        assert set(span_text(base).split(",")) <= set(got[i].spans.split(","))


def test_packing(spark, rows):
    pieces = QUERIES["op2_packing"](spark, SMALL).toPandas()
    ids = dict(zip([i for i, _ in rows], token_ids([t for _, t in rows], 1)))
    for doc, part in pieces.groupby("doc_id"):
        at = 0
        for p in part.sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids[doc]) // 4
            assert p.ids_crc32 == crc(ids[doc][4 * at: 4 * (at + p.length)])
            at += p.length
        assert 4 * at == len(ids[doc])
    assert set(pieces.doc_id) == set(ids)
    for _, part in pieces.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 2048
    tokens = sum(map(len, ids.values())) // 4
    assert pieces.sequence_id.nunique() <= -(-tokens // 2048) + 1


def test_token_files(spark, rows):
    got = QUERIES["op4_token_files"](spark, SMALL).orderBy("doc_id").collect()
    ids = token_ids([t for _, t in rows], 2)
    start = 0
    for r, (i, _), want in zip(got, rows, ids, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(want) // 4, crc(want))
        start += r.n_tokens


def test_near_vectors(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = near_vectors([tuple(r) for r in vectors])
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op5_near_vectors"](spark, SMALL).collect()}
    assert got == want


def test_repeats(spark, rows):
    got = sorted(tuple(r) for r in QUERIES["op7_repeats"](spark, SMALL).collect())
    assert got == sorted(repeats(rows))


def test_near_duplicates(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op8_near_duplicates"](spark, SMALL).collect()}
    assert got == near_documents(rows)


def test_toxicity(spark):
    from pyspark.sql import functions as F

    got = QUERIES["op3_toxicity"](spark, SMALL)
    assert got.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert got.where("NOT score BETWEEN 0 AND 1 OR (score >= 0.5) != (predicted = 1)").count() == 0
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    assert got.where(F.col("held_out") != held).count() == 0
