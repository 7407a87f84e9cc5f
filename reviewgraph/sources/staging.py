"""Cutting lineage between the steps of a long job."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that name a folder which driver and executors share, the first one that is set counts.
SHARED = ("spark.checkpoint.dir", "spark.sql.warehouse.dir")

# What is written to be read a few times is packed more tightly than Spark's default does.
CODEC = "zstd"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's own folder below the shared one."""
    roots = (spark.conf.get(name, None) for name in SHARED)
    root = next(r for r in roots if r)
    return f"{root.rstrip('/')}/staged-{spark.sparkContext.applicationId}"


@contextmanager
def cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs inside delete their shuffle files when they are done; the setting is put back."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` as a table below ``folder`` (default: the shared one) and read it back.

    Readers of the result prune columns and push filters into the files, and losing executors
    does not cause the steps before it to run again. What the steps before have shuffled is deleted
    as soon as it is written, so a long job holds the files of one step at a time.
    :func:`release` deletes the shared ones.
    """
    root = (folder or shared_folder(df.sparkSession)).rstrip("/")
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    with cleaned_shuffles(df.sparkSession):
        df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what this session has staged in the shared folder; staged frames end with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
