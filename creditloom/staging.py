"""Intermediate tables in the cluster's shared folder.

A staged table cuts the lineage, is read back with column pruning and survives the
loss of executors. The folder is the one named in ``spark.checkpoint.dir``, or else the one
set with ``SparkContext.setCheckpointDir``. A folder of our own is made only when neither is
set and Spark runs in one local process.
"""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staging_root(spark: SparkSession) -> str:
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    # ``local-cluster`` has executors of its own, as a cluster does.
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="creditloom-")
    return _local_roots[app]


def staging_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{staging_root(spark)}/creditloom/{app}/{name}-{uuid.uuid4().hex}"


def files_state(spark: SparkSession, folder: str) -> int:
    """Changes when a file of a table is added, removed or written anew: a hash of the
    names, sizes and times that the file system lists."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    found = []
    todo = [path]
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    while todo:
        for status in system.listStatus(todo.pop()):
            if status.isDirectory():
                todo.append(status.getPath())
            else:
                name = status.getPath().toString()
                found.append((name, status.getLen(), status.getModificationTime()))
    return hash(tuple(sorted(found)))


def remove_path(spark: SparkSession, folder: str) -> None:
    """Delete a staged table that nothing reads any more, such as the last round's."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def remove_staged(spark: SparkSession) -> None:
    """Delete the staged tables of this application; call it when their results are written."""
    remove_path(spark, f"{staging_root(spark)}/creditloom/{spark.sparkContext.applicationId}")


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """SQL settings for the queries that run inside, put back afterwards."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind when they end. Spark would else
    keep them until the JVM happens to collect the query."""
    with settings(spark, {_CLEANUP: "true"}):
        yield


def stage_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``stage``, with the table's folder, for ``remove_path``."""
    path = staging_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and return it as a scan of that table."""
    return stage_at(df, name)[0]
