"""A large group of near copies around the threshold: whole components from few pairs per document."""

import random

from brute import near_documents

from maskloom.llm import minhash

N = 1_200


def _around_the_threshold():
    """Copies of one text of 120 words with one to six words changed: similarities of 0.4 to 0.95."""
    rng = random.Random(11)
    base = [f"word{k}" for k in range(120)]
    rows = []
    for i in range(N):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(1, 6)):
            words[at] = f"new{i}x{at}"
        rows.append((i, " ".join(words)))
    return rows


def test_components_of_a_group_around_the_threshold(spark, monkeypatch):
    rows = _around_the_threshold()
    written = []

    def counted(df):
        out = real(df)
        if out.columns == ["a", "b"]:
            written.append(out.count())
        return out

    real = minhash.stored
    monkeypatch.setattr(minhash, "stored", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == near_documents(rows)
    # All pairs would be 719,400; what the joins write grows with the members.
    assert len(written) >= 4 and sum(written) <= 40 * N
