"""The pipeline's stages on a small table, each against a plain version of what it decides."""

from brute import near_documents, token_ids
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from maskloom.llm.common import stored
from maskloom.llm.mixing import word_count
from maskloom.llm.toxicity import score, train


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near duplicates", "personal data", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    clean = stored(stages["toxicity"](spark, docs, SMALL))
    want = {r.doc_id for r in score(docs, train(docs, labels)).where("predicted = 0").collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == want

    single = stored(stages["near duplicates"](spark, clean, SMALL))
    groups = near_documents([(r.doc_id, r.text) for r in clean.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, low) in groups.items() if i == low)

    private = stored(stages["personal data"](spark, single, SMALL))
    assert private.columns == columns and private.count() == single.count()

    mixed = stored(stages["mixing"](spark, private, SMALL))
    total = private.agg(F.sum(word_count(F.col("text")))).first()[0]
    assert mixed.columns == columns
    assert abs(mixed.agg(F.sum(word_count(F.col("text")))).first()[0] - total) <= 30

    packed = stages["packing"](spark, mixed, SMALL).collect()
    texts = [r.text for r in mixed.collect()]
    assert sum(r.length for r in packed) == sum(map(len, token_ids(texts, 1))) // 4


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def _odd(spark, docs):
    """Rows with nulls, blanks, repeats and a very long text, and columns with the operators' own names."""
    words = " ".join(f"w{k % 7919} v{k}" for k in range(40_000))
    rows = [
        (None, "a text whose id is not known at all", "en", "web"),
        (None, None, None, None),
        (900_001, None, "en", "web"),
        (900_002, "", "en", None),
        (900_003, " \t\n", None, "web"),
        (900_004, "one row that stands here two times over, word for word", "en", "web"),
        (900_004, "one row that stands here two times over, word for word", "en", "web"),
        (900_005, words + " mail to jane@example.org", "en", "web"),
        (900_006, "no source but an address, call +44 20 7946 0958 now", "en", None),
    ]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    odd = odd.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    both = docs.unionByName(odd.select(*[F.col(f.name).cast(f.dataType) for f in docs.schema]))
    clashing = ("row", "cut", "is_cut", "mix_id", "mix_size", "pii_id", "pii_spans", "text_hash", "digest", "n", "_id",
                "score", "predicted", "root", "component_id", "kept", "size", "spans", "sequence_id", "ids")
    return both.withColumns({name: F.concat(F.lit(f"{name} "), F.col("lang")) for name in clashing})


def _others(df):
    """The rows without their text, as a sorted list."""
    return sorted(map(repr, df.drop("text").collect()))


def test_odd_rows_and_clashing_names(spark):
    docs = stored(_odd(spark, spark.read.parquet(f"{SMALL}/documents.parquet")))
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    clean = stored(stages["toxicity"](spark, docs, SMALL))
    assert clean.columns == docs.columns
    want = score(docs, train(docs, labels)).where("predicted = 0").select("doc_id").collect()
    assert sorted(map(repr, clean.select("doc_id").collect())) == sorted(map(repr, want))

    # What follows is held against all odd rows, whatever the model makes of them.
    single = stored(stages["near duplicates"](spark, docs, SMALL))
    assert single.columns == docs.columns
    kept = [r.doc_id for r in single.collect()]
    assert kept.count(None) == 2 and kept.count(900_004) == 1
    assert {900_001, 900_002, 900_003, 900_005, 900_006} <= set(kept)
    assert len(kept) == len(set(kept)) + 1

    private = stored(stages["personal data"](spark, single, SMALL))
    assert private.columns == docs.columns and _others(private) == _others(single)
    texts = {r.doc_id: r.text for r in private.where("doc_id >= 900000").collect()}
    assert texts[900_001] is None and texts[900_002] == "" and texts[900_003] == " \t\n"
    assert "jane@example.org" not in texts[900_005] and len(texts[900_005]) > 400_000
    assert "7946" not in texts[900_006]

    mixed = stored(stages["mixing"](spark, private, SMALL))
    assert mixed.columns == docs.columns
    words = word_count(F.col("text"))
    assert mixed.where(words == 0).count() == 0
    before, after = (df.agg(F.sum(words)).first()[0] for df in (private, mixed))
    assert abs(after - before) <= 30
    assert set(_others(mixed)) <= set(_others(private))

    for rows in (mixed, private):
        packed = stages["packing"](spark, rows, SMALL).collect()
        lengths = [len(ids) for ids in token_ids([r.text for r in rows.collect()], 1)]
        assert sum(r.length for r in packed) == sum(lengths) // 4
