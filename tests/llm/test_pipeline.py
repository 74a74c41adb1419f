"""The stages' decisions, one after the other."""

import collections

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from popspark.llm import minhash, mixing, pii, quality


def test_registered_and_ordered():
    found = __spark_entry__.queries()
    assert [sum(q.startswith(f"op{n}_") for q in found) for n in range(1, 11)] == [1] * 10 and "pipeline" in found
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "mix", "bpe"]


def test_stages_take_effect(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit(1))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "bpe":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        if name == "quality":
            model = quality.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
            assert docs.count() == quality.score(before, model).where(F.col("score") >= quality.THRESHOLD).count()
        if name == "near_duplicates":
            assert docs.count() == minhash.near_duplicates(before).where("kept").count() < before.count()
        if name == "pii":
            assert docs.count() == before.count()
            assert pii.find(docs.select("doc_id", "text"), spark.createDataFrame([], "term string, share double")).where("size(_found) > 0").count() == 0
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        if name == "mix":
            want = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect() if r["copies"]}
            assert collections.Counter(r["doc_id"] for r in docs.collect()) == want
    assert kept["bpe"].count() == kept["mix"].count()


def test_dedup_stage_on_repeated_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "quite another text with words"), (2, "a b c d e f"), (3, None), (3, None), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.deduplicate(docs).collect()), key=str)
    assert got == sorted([(1, "a b c d e f"), (1, "quite another text with words"), (3, None), (None, "a b c d e f")], key=str)
