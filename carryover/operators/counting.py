"""Many conditional counts over one table in a single scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_counts(df: DataFrame, label_names: Sequence[str], checks: Sequence[tuple[tuple, Column]],
                    count_name: str = "rows") -> DataFrame:
    """One row per check: its labels and how many rows satisfy its predicate.

    The checks share one aggregate, hence one scan; the result has as many rows
    as there are checks.
    """
    counted = df.agg(*[F.count_if(F.coalesce(test, F.lit(False))).alias(f"_c{i}") for i, (_, test) in enumerate(checks)])
    entries = [F.struct(*[F.lit(v).alias(n) for n, v in zip(label_names, labels)],
                        F.col(f"_c{i}").alias(count_name)) for i, (labels, _) in enumerate(checks)]
    return counted.select(F.inline(F.array(*entries)))


def count_frame(df: DataFrame, name: str = "rows") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def capped_keys(df: DataFrame, keys: Sequence[str], limit: int = 50) -> DataFrame:
    """The first keys behind a count, in key order. The cap is the report's own."""
    return df.select(*keys).orderBy(*keys).limit(limit)


def beside(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side, without a join.

    The rows are stacked and folded into one, so the frames' jobs run at the same time
    and no condition-free join is planned. Column names must differ.
    """
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
