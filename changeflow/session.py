"""Session defaults and the shared scratch folder."""

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


_LOCAL = []
_SCOPE = threading.local()


def build_session(app_name="changeflow", master=None, **conf):
    """A session with the settings the operators are planned for.

    On a cluster leave ``master`` unset and size ``spark.sql.shuffle.partitions``
    to a few times the executor cores: adaptive execution merges partitions that
    turn out small and splits skewed join partitions, it never adds map tasks.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark):
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Every executor must see it. Only a session on one machine may lack the setting (a test); it
    gets a temporary folder, one for the process, removed when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder all executors share; master is {master}")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="changeflow-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def written(df, name, partition_by=()):
    """Write a table that several steps read to the shared folder, and read it back.

    Unlike a cache it survives lost executors, and its size is known to the plans
    that read it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch_path(spark, name):
    """A path under the shared folder that no other call returns."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    if getattr(_SCOPE, "paths", None) is not None:
        _SCOPE.paths.append(path)
    return path


@contextlib.contextmanager
def passing_tables(spark):
    """Remove the tables ``written`` inside, once they have been read; for each batch of a stream."""
    before, _SCOPE.paths = getattr(_SCOPE, "paths", None), []
    try:
        yield
    finally:
        paths, _SCOPE.paths = _SCOPE.paths, before
        for path in paths:
            remove_folder(spark, path)


def remove_folder(spark, path):
    """Remove a folder of any file system Spark can write to."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
