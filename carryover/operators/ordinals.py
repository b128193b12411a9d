"""Dense ordinals over a whole table or within a key, without a one-task sort.

Rows are cut into ranges of the ordering column: at approximate quantiles, each part between
two of them at quantiles of its own rows, and only what is still too large after that evenly by
value. So a range stays near ``rows_per_range`` rows however large the table and however its
values cluster. Each range is numbered on its own and shifted by the number of rows in the
ranges below it. The range is a pure function
of the row's value, so a recomputed task gives the same numbers and nothing has to be
pinned in a cache.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carryover.operators.skew import HOT_ROWS, hot_keys, key_hash
from carryover.session import materialise

# A range is one window group, small enough for a task's memory.
ROWS_PER_RANGE = 500_000
# Quantiles that reach the driver, and quantiles of the rows between two of them.
QUANTILES, INNER = 1024, 64


@dataclass(frozen=True)
class Cuts:
    """Edges from the smallest to the largest value, the edges within each part, and the even pieces below those.

    ``inner`` has one row per part: _bucket and _edges, ``cells`` cells long.
    """

    edges: tuple[float, ...]
    pieces: int
    inner: DataFrame | None = None
    cells: int = 1


def _quantiles(value: str, count: int, accuracy: int) -> Column:
    fractions = ", ".join(f"{i / count}D" for i in range(count + 1))
    return F.expr(f"percentile_approx({value}, array({fractions}), {accuracy})")


def _bucketed(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """Add _value and _bucket, the part that it lies in."""
    valued = df.withColumn("_value", F.col(column).cast("double"))
    inner = edges[1:-1]
    if not inner:
        return valued.withColumn("_bucket", F.lit(0))
    cut = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="_value", outputCol="_bucket").transform(valued)
    return cut.withColumn("_bucket", F.col("_bucket").cast("int"))


def cut_points(df: DataFrame, column: str, rows_per_range: int | None = None) -> Cuts:
    """Where ranges of about ``rows_per_range`` rows begin."""
    rows, found = df.agg(F.count(column), _quantiles(f"double(`{column}`)", QUANTILES, 10000)).first()
    ranges = -(-rows // (rows_per_range or ROWS_PER_RANGE)) if rows else 1
    parts = min(QUANTILES, ranges)
    step = QUANTILES / parts
    edges = sorted({found[min(QUANTILES, round(i * step))] for i in range(parts + 1)}) if rows else []
    pieces = -(-ranges // parts)
    if pieces == 1 or len(edges) < 2:
        return Cuts(tuple(edges), pieces)
    cells = min(INNER, pieces)
    # at most QUANTILES rows of INNER + 1 edges
    within = _bucketed(df.where(F.col(column).isNotNull()), column, edges).groupBy("_bucket").agg(_quantiles("_value", cells, 50 * cells).alias("_edges"))
    return Cuts(tuple(edges), -(-pieces // cells), materialise(within, "cuts"), cells)


def with_range(df: DataFrame, column: str, cuts: Cuts, name: str = "_range") -> DataFrame:
    """Add the number of the range ``column`` lies in; rows outside the edges belong to the outer ranges."""
    if len(cuts.edges) < 2:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    cut = _bucketed(df, column, cuts.edges)
    value, place = F.col("_value"), F.col("_bucket").cast("bigint")
    if cuts.inner is None:
        edge = F.array(*[F.lit(e) for e in cuts.edges])
        low, high = F.get(edge, F.col("_bucket")), F.get(edge, F.col("_bucket") + 1)
    else:
        cut = cut.join(cuts.inner, "_bucket", "left")
        above = F.slice("_edges", 2, cuts.cells - 1) if cuts.cells > 1 else F.array().cast("array<double>")
        cut = cut.withColumn("_cell", F.coalesce(F.size(F.filter(above, lambda e: e <= F.col("_value"))), F.lit(0)))
        low, high = F.get("_edges", F.col("_cell")), F.get("_edges", F.col("_cell") + 1)
        place = place * cuts.cells + F.col("_cell")
    even = F.when(high > low, F.floor((value - low) / (high - low) * cuts.pieces)).otherwise(0)
    piece = F.least(F.lit(cuts.pieces - 1), F.greatest(F.lit(0), F.coalesce(even, F.lit(0))))
    return cut.withColumn(name, place * cuts.pieces + piece).drop("_value", "_bucket", "_edges", "_cell")


def in_order(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with numbers that ascend in ``order``, unique but with gaps, written down so that they stay."""
    return materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "ordered")


def with_ordinal(df: DataFrame, order: str, name: str = "ordinal", *, rows_per_range: int | None = None,
                 cuts: Cuts | None = None) -> DataFrame:
    """Add 1, 2, 3 ... in the order of the unique numeric column ``order``."""
    if cuts is None:
        cuts = cut_points(df, order, rows_per_range)
    ranged = with_range(df, order, cuts)
    local = F.row_number().over(Window.partitionBy("_range").orderBy(order)).cast("bigint")
    # one row per range
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    below = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_below"))
    return (ranged.withColumn("_local", local).join(below, "_range")
            .withColumn(name, F.col("_local") + F.col("_below")).drop("_range", "_local", "_below"))


def with_group_ordinal(df: DataFrame, keys: Sequence[str], order: str, name: str = "ordinal", *,
                       hot_rows: int | None = None, rows_per_range: int | None = None) -> DataFrame:
    """Add 1, 2, 3 ... within each key in the order of the unique numeric column ``order``.

    Only a hot key is cut into ranges; every other key is one small window group.
    NULL key parts count as equal, as they do in a group-by.
    """
    hot_rows = hot_rows or HOT_ROWS
    hot = materialise(hot_keys(df, keys, hot_rows), "hot")
    if hot.isEmpty():
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("bigint"))
    cuts = cut_points(df.join(hot, key_hash(keys) == F.col("_kh"), "left_semi"), order, rows_per_range or hot_rows)
    tagged = df.withColumn("_kh", key_hash(keys)).join(hot, "_kh", "left")
    tagged = with_range(tagged, order, cuts)
    tagged = tagged.withColumn("_range", F.when(F.col("_spread").isNull(), 0).otherwise(F.col("_range")))
    local = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)).cast("bigint")
    # sizes of the (key, range) cells of hot keys
    cells = (tagged.where(F.col("_spread").isNotNull()).groupBy(*keys, "_range")
             .agg(F.count(F.lit(1)).alias("_n")))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range"))
    below = cells.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)],
                         F.col("_range").alias("_brange"), (upto - F.col("_n")).alias("_below"))
    condition: Column = F.col("_range") == F.col("_brange")
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_b{i}"))
    numbered = tagged.withColumn("_local", local).join(below, condition, "left")
    return (numbered.withColumn(name, F.col("_local") + F.coalesce("_below", F.lit(0)))
            .drop("_kh", "_spread", "_range", "_local", "_brange", "_below", *[f"_b{i}" for i in range(len(keys))]))
