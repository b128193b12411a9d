"""Checks become findings, findings become a verdict and a report.

A check that could not run is its own answer: it appears with a NULL count, is
never read as zero, and blocks like a failure nobody has signed off.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKER, ADVISORY, INFO = "blocker", "advisory", "info"
FINDING = ["finding_id", "severity", "table_name", "column_name", "rows", "accept"]


def finding(check: DataFrame, finding_id: str, severity: str, table: str, column: str | None = None,
            accept: str | None = None, rows: str = "rows") -> DataFrame:
    """A one-row check as a finding, kept only when it counted something (or could not count)."""
    text = lambda v: F.lit(v).cast("string")
    return check.select(text(finding_id).alias("finding_id"), text(severity).alias("severity"),
                        text(table).alias("table_name"), text(column).alias("column_name"),
                        F.col(rows).cast("bigint").alias("rows"), text(accept).alias("accept")) \
        .where(F.col("rows").isNull() | (F.col("rows") > 0))


def unchecked(spark, finding_id: str, table: str) -> DataFrame:
    """A check that could not run."""
    return spark.range(1).select(F.lit(finding_id).alias("finding_id"), F.lit(BLOCKER).alias("severity"),
                                 F.lit(table).alias("table_name"), F.lit(None).cast("string").alias("column_name"),
                                 F.lit(None).cast("bigint").alias("rows"), F.lit(None).cast("string").alias("accept"))


def findings(checks: Iterable[DataFrame]) -> DataFrame:
    out = None
    for check in checks:
        row = check.select(*FINDING)
        out = row if out is None else out.unionByName(row)
    return out


def preflight_verdict(found: DataFrame, accepted: Sequence[str] = ()) -> DataFrame:
    """One row: verdict, exit code and how many blockers are hard, outstanding and acknowledged."""
    blocks = F.col("severity") == BLOCKER
    flagged = F.col("accept").isNotNull()
    signed = flagged & (F.col("accept").isin(*accepted) if accepted else F.lit(False))
    counts = found.agg(F.count_if(blocks & ~flagged).alias("hard"),
                       F.count_if(blocks & flagged & ~signed).alias("outstanding"),
                       F.count_if(blocks & signed).alias("acknowledged"))
    verdict = (F.when(F.col("hard") > 0, "no-go").when(F.col("outstanding") > 0, "go-with-acknowledgements")
               .otherwise("go"))
    code = F.when(F.col("hard") > 0, 2).when(F.col("outstanding") > 0, 1).otherwise(0)
    return counts.select(verdict.alias("verdict"), code.alias("exit_code"), "hard", "outstanding", "acknowledged")


def transfer_verdict(comparison: DataFrame, accepted: Sequence[str] = ()) -> DataFrame:
    """A disagreement and a gap are separate sign-offs; accepting one does not accept the other."""
    counts = comparison.agg(F.count_if(F.col("status") == "verified").alias("verified"),
                            F.count_if(F.col("status") == "failed").alias("failed"),
                            F.count_if(F.col("status") == "unverified").alias("unverified"))
    differs = (F.col("failed") > 0) & F.lit("content-transfer" not in accepted)
    gap = ((F.col("unverified") > 0) | (F.col("verified") + F.col("failed") == 0)) & \
        F.lit("no-content-digests" not in accepted)
    stop = F.when(differs, "content-transfer").when(gap, "no-content-digests")
    return counts.select("verified", "failed", "unverified", stop.alias("needs"),
                         F.when(stop.isNull(), "proceed").otherwise("stop").alias("verdict"))


def import_report(arrived: DataFrame, elsewhere: DataFrame, not_checked: DataFrame, found: DataFrame,
                  verdict: DataFrame) -> DataFrame:
    """(section, severity, item, rows) with sections in reading order.

    ``arrived``, ``elsewhere`` and ``not_checked`` have item and rows.
    """
    def section(number: int, title: str, frame: DataFrame, severity=None) -> DataFrame:
        kind = F.lit(severity).cast("string") if severity is None or isinstance(severity, str) else severity
        return frame.select(F.lit(number).alias("section_no"), F.lit(title).alias("section"), kind.alias("severity"),
                            F.col("item"), F.col("rows").cast("bigint").alias("rows"))

    named = found.select(F.concat_ws(".", "finding_id", "table_name", "column_name").alias("item"), "rows", "severity")
    outcome = verdict.select(F.concat(F.lit("verdict: "), F.col("verdict")).alias("item"),
                             F.col("acknowledged").alias("rows"))
    return (section(1, "what arrived", arrived).unionByName(section(2, "where else it went", elsewhere))
            .unionByName(section(3, "not checked", not_checked))
            .unionByName(section(4, "findings", named, F.col("severity")))
            .unionByName(section(5, "verdict", outcome)))
