import os

import pytest

import corpus_pipeline
from creditloom.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark, corpus, frame):
    root = str(tmp_path_factory.mktemp("tables"))
    docs = frame(corpus, source=True).selectExpr("*", "'en' AS lang", "CAST(length(text) AS bigint) AS n_chars")
    docs.write.parquet(os.path.join(root, "documents.parquet"))
    items = [(1, " ".join((corpus[7][1] or "").split()[:30]) or "none at all"), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(os.path.join(root, "benchmark.parquet"))
    return root


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stage(function(spark, docs, folder), name.replace(" ", "-"))
        assert after.columns == docs.columns
        assert after.count() <= before
        docs, before = after, after.count()
    assert before > 0
    last = corpus_pipeline.run(spark, folder)
    assert last.columns == [*docs.columns, "copy_position"]
    assert {r[0] for r in last.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_names():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(ORACLES) <= set(QUERIES)
