"""The pipeline's stages on planted rows, and that the whole ends in shards."""

import random

import corpus_pipeline as pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and"]) if k % 3 else f"w{r.randrange(9999)}" for k in range(n))


def documents(spark):
    rows = [(i, words(i, 60), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(70, words(1, 60), "en", "s0", 1), (71, words(1, 60) + " more", "en", "s1", 1), (72, "1234 !!", "en", None, 1)]
    rows += [(73, words(9000, 12) + " " + words(9001, 30), "en", "s1", 1), (74, None, "en", "s1", 1), (None, words(5, 50), "en", "s1", 1)]
    rows += [(2, words(2, 60), "en", "s2", 1)]
    return spark.createDataFrame(rows, DOCS)


def test_stages(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, words(9000, 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = str(tmp_path)
    spoken = pipeline.language(spark, docs, d)
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    assert ids(spoken) == sorted([*range(60), 2, 70, 71, 73, None], key=str)
    alone = pipeline.near_duplicates(spark, spoken, d)
    assert ids(alone) == sorted([*range(60), 73], key=str)
    cleaned = pipeline.clean(spark, alone, d)
    assert ids(cleaned) == sorted(range(60), key=str)
    mixed = pipeline.mix(spark, cleaned, d)
    for df in (spoken, alone, cleaned, mixed):
        assert df.columns == docs.columns
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 3
    out = pipeline.run(spark, d)
    assert out.count() == mixed.count()
    assert [n for n, _ in pipeline.STAGES] == ["language", "near duplicates", "decontamination", "mixing", "sharding"]


def test_stages_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_named_like_their_own(spark, tmp_path):
    extra = ["_told", "_at", "_times", "_copy", "count", "class_id", "size", "_shard"]
    docs = documents(spark).selectExpr("*", *[f"doc_id AS `{c}`" for c in extra])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, words(9000, 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    for _, work in pipeline.STAGES[:-1]:
        kept = work(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        assert kept.where(" OR ".join(f"`{c}` <> doc_id" for c in extra)).count() == 0
    assert kept.count() > 0
