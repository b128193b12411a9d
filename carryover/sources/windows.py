"""Id windows: the grain at which a copy is confirmed and resumed.

A window is a partition directory. Writing it again replaces exactly that
directory, so a run that died between write and confirmation simply repeats the
window. The ledger names confirmed windows and is appended to only after the
window's values were read back and compared.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover.operators.digest import grouped_digest

# Ids per window and, unless a caller says otherwise, the most windows a table may span.
WINDOW_IDS = 50_000
MAX_WINDOWS = 200_000
# Windows per write, so that one write opens a bounded number of directories.
BATCH = 5_000


class TooManyWindows(ValueError):
    pass


class Unconfirmed(RuntimeError):
    """Windows whose stored rows are not the source's."""


def window_id(key: Column, low: int, size: int = WINDOW_IDS) -> Column:
    """Number of the window ``(low - 1 + n*size, low - 1 + (n+1)*size]`` a key falls in."""
    offset = key.cast("bigint") - F.lit(low)
    return ((offset - F.pmod(offset, F.lit(size))).cast("decimal(20,0)") / F.lit(size)).cast("bigint")


def check_span(low: int, high: int, size: int = WINDOW_IDS, max_windows: int = MAX_WINDOWS) -> int:
    windows = -(-(high - low + 1) // size)
    if windows > max_windows:
        raise TooManyWindows(f"ids {low} to {high} need {windows} windows, more than {max_windows}")
    return windows


def bounds(df: DataFrame, key: str) -> tuple[int, int] | None:
    low, high = df.agg(F.min(key), F.max(key)).first()
    return None if low is None else (low, high)


def window_plan(df: DataFrame, key: str, size: int = WINDOW_IDS, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(window, low_exclusive, high_inclusive, rows) for the windows that hold rows."""
    span = bounds(df, key)
    if span is None:
        return df.limit(0).select(*[F.lit(None).cast("bigint").alias(c)
                                    for c in ("window", "low_exclusive", "high_inclusive", "rows")])
    low, high = span
    check_span(low, high, size, max_windows)
    start = F.lit(low - 1) + F.col("window") * size
    return (df.groupBy(window_id(F.col(key), low, size).alias("window")).agg(F.count(F.lit(1)).alias("rows"))
            .select("window", start.alias("low_exclusive"), F.least(start + size, F.lit(high)).alias("high_inclusive"),
                    "rows"))


class WindowLedger:
    """Confirmed windows of one copy as small JSON files in shared storage, bound to the input's digest."""

    def __init__(self, spark: SparkSession, path: str, token: str):
        self.spark, self.token = spark, token
        self.path = f"{path.rstrip('/')}/{hashlib.sha256(token.encode()).hexdigest()[:16]}"

    def confirmed(self) -> DataFrame:
        schema = "table_name string, window bigint"
        try:
            return self.spark.read.schema(schema).json(self.path)
        except Exception as error:  # only a ledger that does not exist yet means "nothing confirmed"
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def confirm(self, windows: DataFrame, table: str) -> None:
        windows.select(F.lit(table).alias("table_name"), "window").coalesce(1).write.mode("append").json(self.path)


def copy_windows(src: DataFrame, key: str, path: str, table: str, ledger: WindowLedger, *,
                 size: int = WINDOW_IDS, limit: int | None = None, max_windows: int = MAX_WINDOWS,
                 scales: Mapping[str, int] | None = None) -> int:
    """Copy the windows the ledger has not confirmed and return how many were confirmed.

    ``BATCH`` windows go in one distributed write; ``limit`` copies only the first few (a
    cautious first run, to be continued). The rebalance hint gives each window few files
    and splits one that is too large for a task. A window is confirmed after its rows
    were read back and their digest agreed with the source's; otherwise
    :class:`Unconfirmed` is raised and the next run repeats it. ``scales`` are the decimal
    scales of floating-point columns, as the digest needs them.
    """
    span = bounds(src, key)
    if span is None:
        return 0
    low, high = span
    check_span(low, high, size, max_windows)
    plan = window_plan(src, key, size, max_windows).select("window")
    done = ledger.confirmed().where(F.col("table_name") == table).select("window")
    todo = plan.join(done, "window", "left_anti").orderBy("window")
    # at most ``max_windows`` numbers
    open_windows = [r.window for r in (todo if limit is None else todo.limit(limit)).collect()]
    numbered = src.withColumn("window", window_id(F.col(key), low, size))
    confirmed = 0
    for at in range(0, len(open_windows), BATCH):
        chosen = open_windows[at:at + BATCH]
        first, last = chosen[0], chosen[-1]
        wanted = src.sparkSession.createDataFrame([(w,) for w in chosen], "window bigint")
        rows = (numbered.where(F.col(key).between(low + first * size, low + (last + 1) * size - 1))
                .join(F.broadcast(wanted), "window", "left_semi").select(*src.columns, "window"))
        (rows.hint("rebalance", "window").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("window").parquet(path))
        stored = (src.sparkSession.read.parquet(path).withColumn("window", F.col("window").cast("bigint"))
                  .where(F.col("window").between(first, last)).join(F.broadcast(wanted), "window", "left_semi"))
        measure = lambda df: grouped_digest(df, ["window"], src.columns, scales=scales)
        mine = measure(rows)
        numbers = [c for c in mine.columns if c != "window"]
        theirs = measure(stored.select(*[F.col(c).cast(t).alias(c) for c, t in src.dtypes], "window"))
        arrived = mine.join(theirs, ["window", *numbers]).where(F.col("unhashed") == 0).select("window")
        ledger.confirm(arrived, table)
        count = ledger.confirmed().where(F.col("table_name") == table).join(F.broadcast(wanted), "window", "left_semi").distinct().count()
        confirmed += count
        if count < len(chosen):
            raise Unconfirmed(f"{len(chosen) - count} windows of {table} do not hold the source's values")
    return confirmed


def manifest(spec_columns: list[str], digest: str) -> str:
    """Token a ledger is bound to: another mapping or another input starts a new ledger."""
    return json.dumps({"columns": spec_columns, "digest": digest}, sort_keys=True)
