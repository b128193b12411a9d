"""Where values with no home are kept."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carryover.spec import ARCHIVED_PREFIX, TableClass, TableSpec, unknown_columns

# The homes of a preserved table by class.
HOMES = {TableClass.ARCHIVE: ("archive", "live"), TableClass.DROP: ("archive", "live"),
         TableClass.REFERENCE: ("archive",), TableClass.MERGE: ("archive",), TableClass.COPY: ()}
UNKNOWN_HOMES = ("archive", "live")


def homes_of(cls: TableClass | None) -> tuple[str, ...]:
    return UNKNOWN_HOMES if cls is None else HOMES[cls]


def preserve_table(df: DataFrame, cls: TableClass | None, paths: dict[str, str]) -> list[str]:
    """Write a table verbatim to each home its class asks for; an empty unknown table is only named."""
    if cls is None and df.isEmpty():
        return []
    homes = homes_of(cls)
    for home in homes:
        df.write.mode("overwrite").parquet(paths[home])
    return list(homes)


def preserve_plan(tables: DataFrame) -> DataFrame:
    """(table_name, home, copied) per home; ``tables`` has table_name, class (NULL when unknown) and rows."""
    homes = F.when(F.col("class").isNull(), F.array(*[F.lit(h) for h in UNKNOWN_HOMES]))
    for cls, where in HOMES.items():
        homes = homes.when(F.col("class") == cls.value, F.array(*[F.lit(h) for h in where]).cast("array<string>"))
    return tables.select("table_name", "class", "rows", F.explode(homes).alias("home")).withColumn(
        "copied", ~(F.col("class").isNull() & (F.col("rows") == 0)))


def context_columns(spec: TableSpec, df: DataFrame) -> list[str]:
    """Columns that identify a captured row: the window key, else the first three mapped ones."""
    wanted = [spec.chunk_by] if spec.chunk_by else list(spec.columns)[:3]
    spelling = {c.lower(): c for c in df.columns}
    sources = [spec.renames.get(c, c).lower() for c in wanted]
    return [spelling[c] for c in sources if c in spelling]


def dropped_shadow(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Dropped columns with their context, only rows where one of them holds a non-default value."""
    kept = list(dict.fromkeys([*context_columns(spec, df), *sorted(spec.dropped)]))
    anything = reduce(lambda a, b: a | b, [F.coalesce(p(), F.lit(False)) for p in spec.dropped.values()])
    return df.where(anything).select(*kept)


def unknown_shadow(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Columns the mapping never heard of, with their context, only rows where one holds a value."""
    extra = unknown_columns(spec, df)
    if not extra:
        return df.limit(0).select(*context_columns(spec, df))
    anything = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in extra])
    return df.where(anything).select(*dict.fromkeys([*context_columns(spec, df), *extra]))


def archived_columns(df: DataFrame, columns: Sequence[str], prefix: str = ARCHIVED_PREFIX) -> DataFrame:
    """The table with a preserved copy of each homeless column under the archive prefix."""
    return df.select("*", *[F.col(c).alias(prefix + c) for c in columns])
