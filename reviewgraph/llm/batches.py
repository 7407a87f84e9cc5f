"""What functions that run in Python need: this package on all workers, batches of bounded size."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_BYTES = "8m"
# Fixed value: the setting that bounds a batch's bytes in the JVM.
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_sent: set[str] = set()


def _send_package(spark: SparkSession) -> None:
    """Adds this package's modules to the session's Python files, once."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as file:
        for module in sorted(root.rglob("*.py")):
            file.write(module, module.relative_to(root.parent))
    context.addPyFile(str(target))
    _sent.add(context.applicationId)


def bounded_batches(spark: SparkSession) -> None:
    """Readies a session for Python functions: Arrow batches are cut by bytes as well as rows."""
    _send_package(spark)
    spark.conf.set(SETTING, BATCH_BYTES)


def slices(batch: pa.RecordBatch, lengths: list[int], most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose lengths add up to most, or single longer rows."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)
