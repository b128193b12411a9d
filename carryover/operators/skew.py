"""Joins and ranks that stay balanced when one key holds a large share of the rows.

The pattern throughout a migration is a lookup: many rows on the left, at most one row
per key on the right. A small right side is broadcast by Spark after it checked its size;
of a sort-merge join adaptive execution splits the partitions a hot left key has made
large. Where a run is known to have hot keys and no adaptive execution, ``hot_rows`` spreads
every key above that many rows over slots, so no left row is dropped or counted twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is cut into ranges when its rows are numbered.
HOT_ROWS = 1_000_000


def key_hash(columns: Sequence[Column | str]) -> Column:
    return F.xxhash64(*columns)


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> DataFrame:
    """(_kh, _spread): every key with more than ``hot_rows`` rows, by hash, and the number of slots it needs."""
    hot_rows = hot_rows or HOT_ROWS
    counted = df.groupBy(key_hash(keys).alias("_kh")).agg(F.count(F.lit(1)).alias("_n"))
    return counted.where(F.col("_n") > hot_rows).select("_kh", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_spread"))


def lookup(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], *, scatter: Sequence[str],
           how: str = "left", null_safe: bool = False, hot_rows: int | None = None,
           counted: DataFrame | None = None) -> DataFrame:
    """Join ``left`` to ``right``, which must hold at most one row per key.

    Right-hand key columns do not appear in the result. With ``hot_rows`` the keys above it
    are counted (on ``counted``, a cheaper frame with the same key columns, if given) and
    spread by ``scatter``, left columns that differ between rows of one key.
    """
    left_keys = [a for a, _ in on]
    types = dict(left.dtypes)
    keyed = right.select(*[F.col(b).cast(types[a]).alias(f"_r{i}") for i, (a, b) in enumerate(on)],
                         *[c for c in right.columns if c not in {b for _, b in on}])
    condition = None
    if hot_rows is not None:
        hot = hot_keys(counted if counted is not None else left, left_keys, hot_rows)
        slot = F.pmod(key_hash(scatter), F.coalesce("_spread", F.lit(1))).cast("int")
        left = left.withColumn("_kh", key_hash(left_keys)).join(hot, "_kh", "left").withColumn("_slot", slot).drop("_kh", "_spread")
        keyed = keyed.withColumn("_kh", key_hash([f"_r{i}" for i in range(len(on))])).join(hot, "_kh", "left")
        keyed = keyed.withColumn("_rslot", F.explode(F.sequence(F.lit(0), F.coalesce("_spread", F.lit(1)) - 1))).drop("_kh", "_spread")
        condition = F.col("_slot") == F.col("_rslot")
    for i, a in enumerate(left_keys):
        same = F.col(a).eqNullSafe(F.col(f"_r{i}")) if null_safe else F.col(a) == F.col(f"_r{i}")
        condition = same if condition is None else condition & same
    return left.join(keyed, condition, how).drop("_slot", "_rslot", *[f"_r{i}" for i in range(len(on))])


def one_per_key(df: DataFrame, keys: Sequence[str], order: Column, keep: Sequence[str], largest: bool = True) -> DataFrame:
    """The best row of each key by ``order`` (a struct), as a map-side combined aggregate.

    Unlike a window this never brings a key's rows together, so a key of any size is fine.
    """
    pick = F.max_by if largest else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*keep), order).alias("_best")).select(*keys, "_best.*")
