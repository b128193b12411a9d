"""Several snapshots of one dataset: union what is complementary, refuse what conflicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carryover.operators.digest import table_digest
from carryover.operators.skew import one_per_key


def part_fingerprints(parts: Sequence[Mapping[str, DataFrame]], *, scales: Mapping[str, Mapping[str, int]] | None = None,
                      large: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(part, table_name, shape, rows, total, parity) per table of each part."""
    scales, large = scales or {}, large or {}
    out = None
    for i, part in enumerate(parts):
        for name in sorted(part):
            shape = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in part[name].schema)
            row = table_digest(part[name], scales=scales.get(name), large=large.get(name, ())).select(
                F.lit(i).alias("part"), F.lit(name).alias("table_name"), F.lit(shape).alias("shape"),
                "rows", "total", "parity")
            out = row if out is None else out.unionByName(row)
    return out


def overlaps(fingerprints: DataFrame) -> DataFrame:
    """(table_name, owner, parts, state): unique, duplicate (identical copies) or conflict."""
    content = F.concat_ws("|", "shape", "rows", "total", "parity")
    return fingerprints.groupBy(F.lower("table_name").alias("_t")).agg(
        F.min_by("table_name", "part").alias("table_name"), F.min("part").alias("owner"),
        F.count(F.lit(1)).alias("parts"), F.count_distinct(content).alias("_contents")).select(
        "table_name", "owner", "parts",
        F.when(F.col("_contents") > 1, "conflict").when(F.col("parts") > 1, "duplicate").otherwise("unique").alias("state"))


def snapshot_union_checked(parts: Sequence[Mapping[str, DataFrame]], **rendering) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables by name from their owning part, overlap report); a conflicting overlap raises.

    The report has one row per table, so reading it on the driver is bounded by the catalogue.
    """
    report = overlaps(part_fingerprints(parts, **rendering))
    rows = report.collect()
    conflicts = sorted(r.table_name for r in rows if r.state == "conflict")
    if conflicts:
        raise ValueError("snapshots disagree about: " + ", ".join(conflicts))
    return {r.table_name: parts[r.owner][r.table_name] for r in rows}, report


def latest_wins(parts: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """The last occurrence of each key over parts in the order given (one row per key and part)."""
    stacked = None
    for i, part in enumerate(parts):
        numbered = part.withColumn("_part", F.lit(i))
        stacked = numbered if stacked is None else stacked.unionByName(numbered)
    rest = [c for c in parts[0].columns if c not in key]
    return one_per_key(stacked, list(key), F.col("_part"), [*rest, "_part"]).withColumnRenamed("_part", "from_part")
