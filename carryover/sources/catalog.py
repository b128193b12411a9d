"""Sets of tables: loading them and describing what they hold."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_catalog(spark: SparkSession, path: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Parquet tables ``<path>/<name>.parquet`` by name; nothing is read until it is used."""
    root = path.rstrip("/")
    return {name: spark.read.parquet(f"{root}/{name}.parquet") for name in names}


def catalog_profile(tables: Mapping[str, DataFrame], *, distinct: bool = False) -> DataFrame:
    """(table_name, ordinal, column_name, data_type, nullable, rows, nulls[, distinct_estimate]).

    One aggregate per table. Distinct counts are sketches: an exact count of every
    column would shuffle the whole table once per column.
    """
    out = None
    for name in sorted(tables):
        df = tables[name]
        aggregates = [F.count(F.lit(1)).alias("_rows")]
        aggregates += [F.count(c).alias(f"_v{i}") for i, c in enumerate(df.columns)]
        if distinct:
            aggregates += [F.approx_count_distinct(c).alias(f"_d{i}") for i, c in enumerate(df.columns)]
        entries = []
        for i, f in enumerate(df.schema):
            fields = [F.lit(name).alias("table_name"), F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("column_name"),
                      F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(f.nullable).alias("nullable"),
                      F.col("_rows").alias("rows"), (F.col("_rows") - F.col(f"_v{i}")).alias("nulls")]
            if distinct:
                fields.append(F.col(f"_d{i}").alias("distinct_estimate"))
            entries.append(F.struct(*fields))
        row = df.agg(*aggregates).select(F.inline(F.array(*entries)))
        out = row if out is None else out.unionByName(row)
    return out


# Order of lossless widenings within a family of types.
WIDENINGS = (("tinyint", "smallint", "int", "bigint"), ("float", "double"), ("date", "timestamp_ntz"))


def schema_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(table_name, column_name, change, expected_type, actual_type, rows) of two profiles.

    ``missing table`` before ``missing column``; a type change that only widens is named
    as such, because it needs no decision.
    """
    e = expected.select("table_name", "column_name", F.col("data_type").alias("expected_type"), F.lit(True).alias("_e"))
    a = actual.select("table_name", "column_name", F.col("data_type").alias("actual_type"),
                      F.col("rows").alias("_rows"), F.lit(True).alias("_a"))
    tables = actual.select("table_name").distinct().withColumn("_table", F.lit(True))
    joined = e.join(a, ["table_name", "column_name"], "full_outer").join(tables, "table_name", "left")
    wider = F.lit(False)
    for family in WIDENINGS:
        order = F.array(*[F.lit(t) for t in family])
        here, there = F.array_position(order, F.col("actual_type")), F.array_position(order, F.col("expected_type"))
        wider = wider | ((here > 0) & (there > here))
    change = (F.when(F.col("_table").isNull(), "missing table").when(F.col("_a").isNull(), "missing column")
              .when(F.col("_e").isNull(), "unexpected column")
              .when(F.col("expected_type") == F.col("actual_type"), None)
              .when(wider, "lossless widening").otherwise("type change"))
    return joined.select("table_name", "column_name", change.alias("change"), "expected_type", "actual_type",
                         F.col("_rows").alias("rows")).where(F.col("change").isNotNull())


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_name, size) of the files below a folder; contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", F.col("length").alias("size")))
    return files.select("path", F.substring_index("path", "/", -1).alias("file_name"), "size")


def pristine_check(counts: DataFrame, expectations: DataFrame) -> DataFrame:
    """(table_name, class, rows, expected, state).

    Copied tables hold exactly their seed, merged ones at least that, tolerated tables
    are not judged. At most one startup-created row is subtracted, and only from
    copied or merged tables that are counted. ``expectations`` has table_name, class,
    expected, tolerated and startup_rows.
    """
    joined = counts.join(expectations, "table_name")
    own = F.col("rows") - F.least(F.coalesce("startup_rows", F.lit(0)), F.lit(1))
    adjusted = F.greatest(own, F.lit(0))
    state = (F.when(F.col("tolerated"), "tolerated")
             .when((F.col("class") == "merge") & (adjusted < F.col("expected")), "too few")
             .when((F.col("class") != "merge") & (adjusted != F.col("expected")), "not pristine")
             .otherwise("pristine"))
    return joined.select("table_name", "class", adjusted.cast("bigint").alias("rows"), "expected", state.alias("state"))


