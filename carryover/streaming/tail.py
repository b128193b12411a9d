"""The last lines of a log that is still being written.

Lines are dealt to slots by the hash of their position. A slot's state is the heap of its
last ``n`` lines, never more, however long the log is. When a batch changes a heap, the
whole heap is written as that batch's file of the slot; a batch that is run again after a
failure overwrites its own files with the same rows. The last lines of the log are the last
``n`` of the slots' newest heaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from carryover.sources.audit_log import last_lines

SLOTS = 16
_HEAP = "positions array<bigint>, lines array<string>"
_OUT = "slot int, position bigint, line string"


def _keep(n: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        heap = list(zip(*state.get)) if state.exists else []
        before = sorted(heap)
        for part in parts:
            heap = heapq.nlargest(n, heap + list(zip(part["position"], part["line"])))
        now = sorted((int(p), line) for p, line in heap)
        if now != before:
            positions, lines = [p for p, _ in now], [line for _, line in now]
            state.update((positions, lines))
            yield pd.DataFrame({"slot": key[0], "position": positions, "line": lines})

    return run


def last_lines_stream(lines: DataFrame, out: str, checkpoint: str, *, position: str, line: str = "value", n: int = 200,
                      slots: int = SLOTS, once: bool = True) -> StreamingQuery:
    """Keep the last ``n`` lines of a stream by ``position``; lines without a position take no part.

    Starts the query. Stopped or failed, it goes on from ``checkpoint`` where it was; the number of
    ``slots`` has to stay. Read the result with :func:`last_lines_of`.
    """
    if n < 1:
        raise ValueError("the line count must be positive")
    placed = lines.where(F.col(position).isNotNull()).select(
        F.pmod(F.xxhash64(F.col(position).cast("bigint")), F.lit(slots)).cast("int").alias("slot"), F.col(position).cast("bigint").alias("position"),
        F.coalesce(F.col(line), F.lit("")).alias("line"))
    heaps = placed.groupBy("slot").applyInPandasWithState(_keep(n), _OUT, _HEAP, "update", GroupStateTimeout.NoTimeout)
    write = lambda heap, batch: heap.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch}")
    writer = heaps.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def last_lines_of(spark: SparkSession, out: str, n: int = 200) -> DataFrame:
    """(position, line) of the last ``n`` lines that a stream has kept below ``out``."""
    heaps = spark.read.schema(f"{_OUT}, batch bigint").parquet(out)
    # at most one heap of n lines per slot and batch
    newest = heaps.withColumn("_last", F.max("batch").over(Window.partitionBy("slot"))).where("batch = _last")
    return last_lines(newest.select("position", "line"), "position", n)
