"""Log triage on a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from carryover.sources.audit_log import triage


def read_log(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def triage_stream(spark: SparkSession, log: str, out: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Triage log files as they arrive into parquet; the file sink makes each batch exactly-once."""
    rows = triage(read_log(spark, log))
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
