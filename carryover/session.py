"""Session settings that the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings only: nothing here sizes the cluster. The number of
# shuffle partitions stays with whoever starts the session; adaptive execution
# merges small ones and splits the ones a hot key has made large.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Options that only a builder may set. Plans here are wide and built by code: do not
# record a call site per expression.
STATIC = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

# Removes the shuffle files of a query at its end.
REMOVAL = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import this package wherever the driver was started.

    Other machines need it installed or sent along with the job.
    """
    root, settings = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in settings.get("PYTHONPATH", "").split(os.pathsep):
        settings["PYTHONPATH"] = os.pathsep.join(filter(None, (root, settings.get("PYTHONPATH"))))
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    reachable(spark)
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value and spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def build(app: str = "carryover", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, **STATIC, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the cluster names it.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local checkpoint is lost together with the machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="carryover-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, below the application's own: that goes as a whole when its results were read."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a result that several later steps read to the shared checkpoint folder and read it back.

    Cuts the lineage like a checkpoint, survives lost executors and stays columnar, so
    later steps still read only the columns they need.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job that is set up and run in here go when it ends, not when the driver next collects its garbage.

    For operators that run many jobs and read the results of none twice but by ``materialise``.
    """
    before = spark.conf.get(REMOVAL, None)
    spark.conf.set(REMOVAL, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVAL)
        else:
            spark.conf.set(REMOVAL, before)
