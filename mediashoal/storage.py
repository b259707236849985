"""Intermediate tables in the folder that all executors share.

Iterative operators cut lineage by writing a Parquet table there and reading it
back, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Most rows and bytes of an Arrow batch; with whole texts or images in a row, 10,000 rows
#: would be too many.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
_scopes: list[list[str]] = []


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once: one setting for all operators, as Spark
    reads it when a plan runs and not when it is made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where unset, a local one, but only if there
    are no executors on other machines that could not see it."""
    base = spark.conf.get(CHECKPOINT_DIR, "")
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        else:
            base = tempfile.mkdtemp(prefix="mediashoal-")
            spark.sparkContext.setCheckpointDir(base)
            base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """Of this application's tables."""
    return f"{shared_dir(spark)}/mediashoal/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = path or fresh_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table through the store that holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are deleted at the end: write or collect the result
    before it."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            release(spark, path)


def sweep(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; only when no result that reads them
    is needed. Those of other applications in the same folder stay."""
    release(spark, own_dir(spark))
