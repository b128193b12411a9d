"""Session settings while the steps of an operator run: Arrow batch sizes, shuffle files."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500, size: int = 16 << 20) -> Iterator[None]:
    """Arrow batches of few rows and bytes while steps run whose rows hold whole texts or sets."""
    with _settings(spark, {_ROWS: str(rows), _BYTES: str(size)}):
        yield


def release(spark: SparkSession) -> None:
    """After a step that ended in a written table: let Spark delete its shuffle files.

    Spark does so once the driver has collected the step's plan, which otherwise may take
    until the whole job is over.
    """
    for _ in range(2):  # the driver's Python lets go first, its JVM after that
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
