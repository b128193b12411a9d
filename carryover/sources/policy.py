"""Which tables and columns a reporting account may see, and what it was granted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Restricted(PermissionError):
    pass


def column_policy_view(df: DataFrame, table: str, *, hidden: Mapping[str, Sequence[str]],
                       restricted: Sequence[str]) -> DataFrame:
    """The table without its hidden columns; a restricted table, or one with nothing left, is refused."""
    if table.lower() in {t.lower() for t in restricted}:
        raise Restricted(f"{table} is restricted")
    lowered = {c.lower() for c in {k.lower(): v for k, v in hidden.items()}.get(table.lower(), ())}
    kept = [c for c in df.columns if c.lower() not in lowered]
    if not kept:
        raise Restricted(f"{table} has no column left to report")
    return df.select(*kept)


def grant_audit(policy: DataFrame, grants: DataFrame, existing: DataFrame) -> DataFrame:
    """(table_name, column_name, problem) where grants and policy disagree.

    ``policy``: table_name, column_name, rule (``open``, ``hidden`` or ``restricted``).
    ``grants``: table_name, column_name (NULL grants the whole table).
    ``existing``: table_name, column_name. Names compare folded.
    """
    def folded(frame: DataFrame, mark: str, *more: str) -> DataFrame:
        return frame.select(F.lower("table_name").alias("_t"), F.lower("column_name").alias("_c"), *more,
                            F.lit(True).alias(mark)).distinct()

    rules = folded(policy, "_ruled", "rule")
    shape = rules.groupBy("_t").agg(F.max(F.col("rule") == "hidden").alias("_has_hidden"),
                                    F.max(F.col("rule") == "restricted").alias("_restricted"))
    have = folded(existing, "_exists")
    tables = have.select("_t").distinct().withColumn("_table_exists", F.lit(True))
    held = folded(grants, "_granted")
    whole = held.where(F.col("_c").isNull()).select("_t").distinct().withColumn("_whole", F.lit(True))
    single = held.where(F.col("_c").isNotNull())
    whole_problems = (whole.join(shape, "_t", "left").join(tables, "_t", "left").select(
        F.col("_t").alias("table_name"), F.lit(None).cast("string").alias("column_name"),
        F.when(F.col("_table_exists").isNull(), "grant on absent table")
        .when(F.col("_restricted").isNull(), "not in the policy").when(F.col("_restricted"), "restricted table")
        .when(F.col("_has_hidden"), "whole table with hidden columns").alias("problem")))
    cells = (single.join(rules, ["_t", "_c"], "full_outer").join(have, ["_t", "_c"], "left")
             .join(shape, "_t", "left").join(whole, "_t", "left"))
    needs_columns = F.col("_has_hidden") & ~F.col("_restricted")
    reached = F.col("_granted") | F.col("_whole")
    cell_problems = cells.select(
        F.col("_t").alias("table_name"), F.col("_c").alias("column_name"),
        F.when(F.col("_granted") & F.col("_exists").isNull(), "grant on absent column")
        .when(F.col("_granted") & F.col("_restricted").isNull(), "not in the policy")
        .when(F.col("_granted") & (F.coalesce("rule", F.lit("open")) == "hidden"), "hidden column")
        .when(F.col("_granted") & F.col("_restricted"), "restricted table")
        .when((F.col("rule") == "open") & F.col("_exists") & needs_columns & reached.isNull(), "not granted")
        .when((F.col("rule") == "open") & F.col("_exists") & ~needs_columns & F.col("_granted") & F.col("_whole").isNull(),
              "only some columns")
        .when((F.col("rule") == "open") & F.col("_exists") & ~needs_columns & reached.isNull(), "not granted")
        .alias("problem"))
    return whole_problems.unionByName(cell_problems).where(F.col("problem").isNotNull())
