"""Findings, verdicts and reports: family K."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.functions import charset as C
from carryover.operators import findings as K
from carryover.operators import merge as M
from carryover.operators import prechecks as P
from carryover.spec import ColumnInfo
from workload.checks import NUMBERS, TIMES
from workload.charset import sql_double, sql_marker
from workload.merging import MERGED, merged
from workload.registry import query
from workload.roles import frames

FINDINGS = f"""
    found AS (SELECT * FROM (
      SELECT 'numeric capacity' AS finding_id, 'blocker' AS severity, 'lineitem' AS table_name, 'line' AS column_name,
             (SELECT count(*) FROM lineitem WHERE l_linenumber * 30 > 127) AS rows, NULL AS accept
      UNION ALL SELECT 'precision lost', 'blocker', 'events', 'at_second', (SELECT count(*) FROM events WHERE ts <> date_trunc('second', ts)), 'temporal-loss'
      UNION ALL SELECT 'precision lost', 'blocker', 'events', 'midnight', 0, 'temporal-loss'
      UNION ALL SELECT 'mojibake', 'blocker', 'documents', 'body', (SELECT count(*) FILTER ({sql_double('body')}) - count(*) FILTER (state = 'twice' AND body <> original)
            FROM {{st_text}}), 'charset-repair'
      UNION ALL SELECT 'mojibake', 'blocker', 'documents', 'body', (SELECT count(*) FILTER (state = 'twice' AND body <> original)
            + count(*) FILTER ({sql_marker('body')} AND NOT {sql_double('body')}) FROM {{st_text}}), 'keep-unrepairable-text'
      UNION ALL SELECT 'duplicate name', 'advisory', 'part', 'p_name', (SELECT count(*) - count(DISTINCT p_name) FROM part), NULL
      UNION ALL SELECT 'orphan reference', 'blocker', 'orders', 'o_custkey', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)), NULL
      UNION ALL SELECT 'rows', 'info', 'orders', NULL, (SELECT count(*) FROM orders), NULL)
    WHERE rows > 0 UNION ALL SELECT 'could not run', 'blocker', 'embeddings', NULL, NULL, NULL)"""


def found(spark, sf):
    lines, events, text, part, orders, customer = frames(spark, sf, "lineitem", "events", "st_text", "part", "orders", "customer")
    numbers = P.precheck(lines, NUMBERS, "l_orderkey")
    times = P.precheck(events, TIMES, "event_id", fraction_digits={"stamp": 6})
    census = C.charset_census(text, ["body"], "documents")
    kept = census.where("accept = 'keep-unrepairable-text'").agg(F.sum("rows").alias("rows"))
    duplicates = P.unique_conflicts(part, "p_name", ColumnInfo("varchar")).agg(F.sum("extras").alias("rows"))
    orphans = P.fk_violations(orders, customer, [("o_custkey", "c_custkey")], ["o_orderkey"]).agg(F.count(F.lit(1)).alias("rows"))
    return K.findings([
        K.finding(numbers.where("column_name = 'line'"), "numeric capacity", K.BLOCKER, "lineitem", "line"),
        *[K.finding(times.where(F.col("column_name") == c), "precision lost", K.BLOCKER, "events", c, "temporal-loss")
          for c in ("at_second", "midnight")],
        K.finding(census.where("lane = 'repairable'"), "mojibake", K.BLOCKER, "documents", "body", "charset-repair"),
        K.finding(kept, "mojibake", K.BLOCKER, "documents", "body", "keep-unrepairable-text"),
        K.finding(duplicates, "duplicate name", K.ADVISORY, "part", "p_name"),
        K.finding(orphans, "orphan reference", K.BLOCKER, "orders", "o_custkey"),
        K.finding(orders.agg(F.count(F.lit(1)).alias("rows")), "rows", K.INFO, "orders"),
        K.unchecked(spark, "could not run", "embeddings")])


@query("preflight_findings", f"WITH {FINDINGS} SELECT * FROM found")
def _(spark, sf):
    return found(spark, sf)


def _verdict(extra: str) -> str:
    return f"""
    WITH {FINDINGS}, b AS (SELECT * FROM found WHERE severity = 'blocker' {extra}),
    c AS (SELECT count(*) FILTER (accept IS NULL) AS hard, count(*) FILTER (accept IN ('charset-repair', 'keep-unrepairable-text')) AS outstanding,
        count(*) FILTER (accept = 'temporal-loss') AS acknowledged FROM b)
    SELECT CASE WHEN hard > 0 THEN 'no-go' WHEN outstanding > 0 THEN 'go-with-acknowledgements' ELSE 'go' END AS verdict,
           CASE WHEN hard > 0 THEN 2 WHEN outstanding > 0 THEN 1 ELSE 0 END AS exit_code, * FROM c"""


SIGNABLE = "AND accept IS NOT NULL"


@query("preflight_verdict", f"{_verdict('')} UNION ALL SELECT * FROM ({_verdict(SIGNABLE)})")
def _(spark, sf):
    f = found(spark, sf)
    return K.preflight_verdict(f, ["temporal-loss"]).unionByName(
        K.preflight_verdict(f.where("severity <> 'blocker' OR accept IS NOT NULL"), ["temporal-loss"]))


@query("import_report", f"""
    WITH {MERGED}, {FINDINGS}, v AS ({_verdict('').replace('WITH ' + FINDINGS + ',', 'WITH ')})
    SELECT 1 AS section_no, 'what arrived' AS section, NULL AS severity, 'orders: live rows' AS item, count(*) AS rows FROM live
    UNION ALL SELECT 2, 'where else it went', NULL, 'orders: beaten by the seed or excluded', count(*) FILTER (seeded OR excluded) FROM judged
    UNION ALL SELECT 3, 'not checked', NULL, 'embeddings', NULL
    UNION ALL SELECT 4, 'findings', severity, finding_id || '.' || table_name || coalesce('.' || column_name, ''), rows FROM found
    UNION ALL SELECT 5, 'verdict', NULL, 'verdict: ' || verdict, acknowledged FROM v""")
def _(spark, sf):
    _, _, live, _, judged = merged(spark, sf)
    f = found(spark, sf)
    arrived = live.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("orders: live rows").alias("item"), "rows")
    elsewhere = M.merge_overridden(judged).select(F.lit("orders: beaten by the seed or excluded").alias("item"),
                                                  F.col("overridden").alias("rows"))
    silent = f.where("rows IS NULL").select(F.col("table_name").alias("item"), "rows")
    return K.import_report(arrived, elsewhere, silent, f, K.preflight_verdict(f, ["temporal-loss"]))


