"""The pipeline's stages, each on what the one before kept, and the whole against them."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from hakuspark.llm.packing import CAPACITY
from tests.llm.test_ops import base, brute_components, clash

SF = "/root/testdata/sf0.001"


def staged(spark, docs, tmp_path):
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(out)
        yield name, docs, (docs := spark.read.parquet(out))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.unionByName(docs.limit(5)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(1).withColumns({"doc_id": F.lit(9999).cast("long"), "text": F.lit("12345 67890 !!")})).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    steps = {name: (a, b) for name, a, b in staged(spark, odd, tmp_path)}
    assert list(steps) == [n for n, _ in corpus_pipeline.STAGES]
    for name, (a, b) in list(steps.items())[:-1]:
        assert b.columns == a.columns == docs.columns
    a, b = steps["language_id"]
    assert a.count() - b.count() == 3 and b.where("doc_id = 9999 or text is null").count() == 0
    a, b = steps["near_dedup"]
    data = [(i, r["text"]) for i, r in enumerate(a.orderBy(F.col("doc_id").asc_nulls_last()).collect())]
    assert b.count() == sum(kept for *_, kept in brute_components(data, 5))
    a, b = steps["secrets"]
    texts = {r["doc_id"]: r["text"] for r in b.collect()}
    assert b.count() == a.count() and not any(base(t.replace("[SECRET]", "\n")) for t in texts.values())
    assert all(texts[r["doc_id"]] == r["text"] for r in a.collect() if not base(r["text"]) and "[SECRET]" not in texts[r["doc_id"]])
    assert b.where(F.length("text") != F.col("n_chars")).count() == 0
    a, b = steps["packing"]
    assert {r["doc_id"] for r in b.select("doc_id").distinct().collect()} == set(texts)
    sizes = np.array([r["n"] for r in b.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()])
    assert ((sizes == CAPACITY) | (sizes & (sizes - 1) == 0)).all()


def test_run_is_the_stages(spark, tmp_path):
    last = [b for *_, b in staged(spark, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path)][-1]
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.select("doc_id", "doc_tokens").distinct().collect())) == sorted(map(tuple, last.select("doc_id", "doc_tokens").distinct().collect()))
    assert whole.columns == last.columns and set(columns) <= set(whole.columns) and corpus_pipeline.ORACLE_SQL is None


def test_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for df in (clash(docs), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, SF).columns == df.columns


def test_unlabelled(spark):
    """Without any label all documents with letters stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    odd = docs.unionByName(docs.limit(1).withColumn("text", F.lit("12 34!"))).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    kept = corpus_pipeline.identify_language(spark, odd, SF)
    assert kept.columns == docs.columns and kept.count() == docs.count()
