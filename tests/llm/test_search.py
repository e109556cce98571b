"""Whitening, lexical search and the search tree: against plain versions, and their edge cases."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL

from maskloom.llm import lexical, tree, whitening
from maskloom.llm.queries import QUERIES

VECTORS = "vec_id bigint, embedding array<float>, label int, n bigint, score double, cell int, code string"


def frame(spark, rows):
    """Vectors with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, 1, 2, 3.0, 4, "c") for i, v in rows], VECTORS)


@pytest.fixture(scope="module")
def embeddings(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)


# --- 11 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("matrix", [
    np.random.default_rng(1).standard_normal((40, 24)), np.eye(7), np.kron(np.eye(4), np.ones((3, 3))),
    np.diag([3.0, 3.0, 3.0, 1.0]), np.ones((1, 1)), np.random.default_rng(2).standard_normal((3, 12)),
])
def test_eigenvectors(matrix):
    v = matrix.T @ matrix
    values, rows = whitening.principal(v, 32)
    known = np.linalg.eigvalsh(v)[::-1]
    assert len(values) == (known > 1e-10 * known[0]).sum()
    assert np.allclose(values, known[: len(values)], rtol=1e-12, atol=1e-12 * known[0])
    assert np.abs(rows @ rows.T - np.eye(len(rows))).max() < 1e-12
    assert np.abs(v @ rows.T - rows.T * values).max() < 1e-12 * known[0]


def test_sturm_counts_equal_numbers_of_eigenvalues():
    a = np.random.default_rng(3).standard_normal((15, 15))
    diagonal, off, _ = whitening.tridiagonal(a + a.T)
    known = np.linalg.eigvalsh(a + a.T)
    at = np.linspace(known[0] - 1, known[-1] + 1, 50)
    assert whitening.below(diagonal, off, at).tolist() == [(known < x).sum() for x in at]


def test_whitening_query(spark, embeddings):
    ids, c = embeddings
    x = np.floor(64 * c).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    v = np.cov((x - 1_000_000).T, bias=True)
    known, columns = np.linalg.eigh(v)
    known, columns = known[::-1], columns[:, ::-1]
    got = QUERIES["op11_whitening"](spark, SMALL).toPandas()
    assert len(got) == 32 * n and set(got.n) == {n}
    spread = dict(zip(ids.tolist(), ((n * x - sums) ** 2).sum(1).tolist()))
    assert (got.deviation == got.vec_id.map(spread)).all()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = (x - sums / n) @ columns[:, :32] / np.sqrt(known[:32])
    sign = np.sign((wide * want).sum(0))
    assert np.abs(wide * sign - want).max() < 1e-6
    explained = got.groupby("component").explained.agg(["min", "max"])
    assert (explained["min"] == explained["max"]).all()
    assert np.allclose(explained["max"], known[:32] / known.sum(), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_cases(spark):
    rows = [
        (1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [math.nan, 1.0]),
        (6, [math.inf, 1.0]), (7, [1.0, 2.0, 3.0]), (8, []), (9, [-1.0, 0.5]), (10, [1e30, 0.0]),
    ]
    got = sorted(whitening.whiten(frame(spark, rows)).collect(), key=lambda r: r.vec_id or 0)
    assert [r.vec_id for r in got] == [None, 1, 1, 9]
    x = np.array([[0, 0], [64, 128], [64, 128], [-64, 32]]) + 1_000_000
    assert [int(r.deviation) for r in got] == ((4 * x - x.sum(0)) ** 2).sum(1).tolist()
    w = np.array([r.whitened for r in got])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(2)).max() < 1e-12


def test_whitening_large_entries_stay_exact(spark):
    rows = [(1, [1e16, 0.0]), (2, [-1e16, 5.0]), (3, [3e15, 1.0])]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(frame(spark, rows)).collect()}
    x = [[int(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    assert got == {i + 1: sum((3 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}


def test_whitening_without_variance(spark):
    same = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(int(r.deviation), r.whitened) for r in same] == [(0, []), (0, [])]
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []


# --- 12 --------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_search(docs, items, k=20):
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n_docs, total = len(terms), sum(len(t) for _, t in terms)
    df = Counter(w for _, t in terms for w in set(t))
    counted = [(i, Counter(t), 100 - 25 + (25 * len(t) * n_docs) // total) for i, t in terms]
    out = []
    for item, text in items:
        asked = Counter(w for w in TERM.findall((text or "").translate(LOWER)) if w in df)
        weights = {w: c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) for w, c in asked.items()}
        scores = [
            (sum(x * ((10 ** 9 * tf[w]) // (1000 * tf[w] + 12 * m)) for w, x in weights.items() if w in tf), i)
            for i, tf, m in counted
        ]
        scores = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(scores[:k])]
    return out


def searched(spark, docs, items, k=20):
    d = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in docs], "doc_id bigint, text string, n int, segment string, m int")
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id bigint, text string, item int")
    return [tuple(r) for r in lexical.search(lexical.build(d), q, k).collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_lexical_cases(spark):
    long = "Wort Fluss " * 40_000 + "rare"
    docs = [
        (1, "A b c"), (2, "a B c"), (2, "a B c"), (None, "a b c"), (4, None), (5, ""), (6, " .,;\n"),
        (7, long), (8, "été ETE Été 日本語 x1"), (9, "a\x00b a_b"), (10, "b"),
    ]
    items = [
        (1, "a a b"), (2, "nothing here"), (3, None), (None, "Été"), (4, ""), (5, "RARE fluss wort"), (1, "a a b"), (6, "日本語 X1 b"),
    ]
    assert order(searched(spark, docs, items)) == order(plain_search(docs, [*dict.fromkeys(items)]))


def test_lexical_ties_beyond_the_list(spark):
    docs = [(i, "same words here") for i in range(200, 0, -1)] + [(500, "other")]
    got = order(searched(spark, docs, [(1, "words"), (2, "other words")], 5))
    assert got == order(plain_search(docs, [(1, "words"), (2, "other words")], 5))
    assert [r[2] for r in got[:5]] == [1, 2, 3, 4, 5]


def test_lexical_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, None)], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []


def test_lexical_many_segments_and_blocks(spark, monkeypatch):
    draw = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    share = 1 / np.arange(1, 301)
    docs = [(i, " ".join(draw.choice(words, draw.integers(1, 200), p=share / share.sum()))) for i in range(600)]
    items = [(i, " ".join(draw.choice(words, 12))) for i in range(30)]
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 100)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    index = lexical.build(d, segment_bytes=4000)
    assert index.places.count() > 20
    q = spark.createDataFrame(items, "item_id bigint, text string")
    assert order(tuple(r) for r in lexical.search(index, q).collect()) == order(plain_search(docs, items))


def test_strata_below_the_floor_stay_closed():
    import pandas as pd

    m = np.array([80] * 50 + [400] * 50)
    postings = pd.DataFrame({
        "term": ["t"], "m": [np.array([80, 400])], "tf": [np.array([3, 1])], "n": [np.array([50, 50])],
        "docs": [np.arange(100)],
    })
    segment = lexical.Segment(postings, list(range(100)), m)
    near, far = lexical.impacts(np.array([3, 1]), np.array([80, 400])).tolist()
    assert segment.best(["t"], np.array([2]), 3, 1) == [(2 * near, i) for i in range(3)]
    assert segment.best(["t"], np.array([2]), 60, 2 * far) == [(2 * near, i) for i in range(50)] + [(2 * far, i) for i in range(50, 60)]
    assert segment.best(["t"], np.array([2]), 60, 2 * far + 1) == [(2 * near, i) for i in range(50)]
    assert segment.best(["t"], np.array([2]), 60, 2 * near + 1) == []


# --- 13 --------------------------------------------------------------------------------------


def plain_nearest(rows, queries, k=20):
    """Rows and queries are distinct usable (id, vector)."""
    out = {}
    for i, q in queries:
        scores = sorted((-float((np.array(v) * np.array(q)).sum()), j) for j, v in rows if j != i)[:k]
        out[i] = [(j, -s) for s, j in scores]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def test_nearest_query(spark, embeddings):
    ids, x = embeddings
    rows = list(zip(ids.tolist(), x))
    want = plain_nearest(rows, [(i, v) for i, v in rows if i % 20 == 0])
    got = by_query(QUERIES["op13_nearest"](spark, SMALL).collect())
    assert got.keys() == want.keys()
    vectors = dict(rows)
    for i, found in got.items():
        assert len(found) == 20
        assert all(abs(s - float((vectors[i] * vectors[j]).sum())) < 1e-12 for j, s in found)
    hits = [len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 20 for i in want]
    assert np.mean(hits) >= 0.9


def test_nearest_cases(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 2.0]), (40, [0.0, -1.0]), (None, [1.0, 1.0]),
        (6, None), (60, [0.0, 0.0]), (8, [None, 1.0]), (80, [math.nan, 1.0]), (9, [math.inf, 1.0]), (10, [1.0]), (11, []), (100, [2.0, 2.0]),
    ]
    vectors = frame(spark, rows)
    got = by_query(tree.nearest_vectors(vectors, vectors.where("vec_id % 20 = 0"), 3).collect())
    usable = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 2.0]), (40, [0.0, -1.0]), (100, [2.0, 2.0])]
    assert got == plain_nearest(usable, [r for r in usable if r[0] % 20 == 0], 3)
    assert len(by_query(tree.nearest_vectors(vectors, vectors.where("vec_id % 20 = 0")).collect())[0]) == 5


def test_nearest_empty(spark):
    some = frame(spark, [(1, [1.0, 0.0])])
    assert tree.nearest_vectors(frame(spark, []), some).collect() == []
    assert tree.nearest_vectors(some, some).collect() == []
    assert tree.nearest_vectors(some, frame(spark, [])).collect() == []
    assert tree.nearest_vectors(some, frame(spark, [(2, None)])).collect() == []


def test_nearest_many_copies_cells_and_slices(spark, monkeypatch):
    draw = np.random.default_rng(7)
    vectors = draw.standard_normal((3000, 16)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[1000:2000] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    for name, size in (("CELL_ROWS", 300), ("SLICE_ROWS", 100), ("LEAF_ROWS", 16), ("QUERY_BLOCK", 10)):
        monkeypatch.setattr(tree, name, size)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    asked = df.where("vec_id % 20 = 0")
    got = by_query(tree.nearest_vectors(df, asked).collect())
    want = plain_nearest([(i, np.array(v, float)) for i, v in rows], [(i, np.array(v, float)) for i, v in rows if i % 20 == 0])
    hits = [len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 20 for i in want]
    assert got.keys() == want.keys() and np.mean(hits) >= 0.9
    # Copies of a query tie; the smallest ids other than its own are found.
    assert [j for j, _ in got[1000]] == [0, *range(1001, 1020)]
    # At its widest the search is exact.
    full = by_query(tree.nearest_vectors(df, asked, width=tree.Width(10 ** 6, 10 ** 6, 1.0)).collect())
    assert {i: [j for j, _ in f] for i, f in full.items()} == {i: [j for j, _ in f] for i, f in want.items()}


def test_width_grows_until_recall_is_reached(spark):
    draw = np.random.default_rng(8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw.standard_normal((1500, 32)))], "vec_id bigint, embedding array<double>")
    index = tree.build(df)
    queries = index.entries.where("low % 20 = 0")
    narrow, wide = tree.calibrate(index, queries, recall=0.3), tree.calibrate(index, queries, recall=0.99)
    assert narrow.leaves < wide.leaves and wide.recall >= 0.99
