import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from creditloom import staging


def fake_session(master, conf, checkpoints=None):
    context = SimpleNamespace(
        master=master, applicationId="app-1", getCheckpointDir=lambda: checkpoints
    )
    return SimpleNamespace(conf=SimpleNamespace(get=conf.get), sparkContext=context)


def test_the_named_folder_is_used():
    named = fake_session("spark://host:7077", {"spark.checkpoint.dir": "hdfs://x/y/"})
    assert staging.staging_root(named) == "hdfs://x/y"
    first, second = (staging.staging_path(named, "t") for _ in range(2))
    assert first.startswith("hdfs://x/y/creditloom/app-1/t-") and first != second


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        staging.staging_root(fake_session("spark://host:7077", {}))
    with pytest.raises(RuntimeError):
        staging.staging_root(fake_session("local-cluster[2,1,1024]", {}))


def test_folder_set_on_the_context():
    session = fake_session("spark://host:7077", {}, "hdfs://x/checkpoints/1")
    assert staging.staging_root(session) == "hdfs://x/checkpoints/1"


def test_own_folder_for_one_local_process():
    local = fake_session("local[2]", {})
    assert staging.staging_root(local) == staging.staging_root(local)


def test_staged_rows_are_the_same(spark):
    df = spark.range(100).select(
        F.col("id"), (F.col("id") / 7).alias("Owner's Equity (a, b; c)"), F.lit(None).cast("int").alias("n")
    )
    staged = staging.stage(df, "test")
    assert staged.schema.names == df.schema.names
    assert sorted(map(tuple, staged.collect())) == sorted(map(tuple, df.collect()))
    assert "test-" in staged.inputFiles()[0]


def test_staged_tables_can_be_removed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(staging, "staging_root", lambda _: str(tmp_path))
    staging.stage(spark.range(3), "gone")
    assert list(tmp_path.rglob("part-*"))
    staging.remove_staged(spark)
    assert not list(tmp_path.rglob("part-*"))


def test_staged_tables_leave_no_shuffle_files(spark):
    jvm = spark.sparkContext._jvm.org.apache.spark

    def shuffled():
        files = jvm.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = [files.apply(i).getName() for i in range(files.size())]
        return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    before = shuffled()
    kept = staging.stage(spark.range(10_000).repartition(4, "id"), "kept")
    for _ in range(100):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert kept.count() == 10_000
