"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on (first two) or is tuned for. Set them where the session is built.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Duplicate keys in a JSON object: the last one wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Building a plan is several times faster without a call site for every column.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# For a cluster: start every shuffle wide and let adaptive execution merge what turns out small, so
# that no partition outgrows an executor's memory on large inputs.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
}


# The scratch paths of the innermost scope of this thread; None outside of any.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def build_session(master: str | None = None, app: str = "parley", **extra: str) -> SparkSession:
    """A session with :data:`SETTINGS`; pass :data:`CLUSTER_SETTINGS` too, or your own, on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made for a local master, whose tasks see it. On
    any other master that is an error: each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {context.master} share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="parley-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below :func:`shared_dir`, remembered by the innermost :func:`scratch_scope`."""
    path = os.path.join(shared_dir(spark), f"{purpose}-{uuid.uuid4().hex}")
    made = _SCOPE.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Drop the scratch tables that are made inside, once the block is over, whether it failed or not.

    Write what shall outlive the block to a path of your own, inside of it: tables are dropped only after
    that job has ended, so a task that is tried again still finds what it reads. Scopes nest, and each thread
    has its own. What a killed driver leaves behind is for the folder's retention rule.
    """
    token = _SCOPE.set([])
    try:
        yield
    finally:
        made = _SCOPE.get()
        _SCOPE.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for name in made:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def written_once(df: DataFrame, purpose: str) -> DataFrame:
    """Compute ``df`` once into a table in the shared folder and read it from there.

    Several readers then share one pass over the source, each with its own column pruning, and a lost
    executor costs a re-read instead of the whole lineage. The optimizer also learns the true size: a
    small table is broadcast, and one above ``spark.sql.autoBroadcastJoinThreshold`` is not.
    """
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
