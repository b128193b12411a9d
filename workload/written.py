"""Queries that run an operator to its end: write, read back, resume, refuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.operators import archive as A
from carryover.operators import merge as M
from carryover.operators import parity as P
from carryover.operators import ranking as R
from carryover.operators.merge import project_mapped
from carryover.session import checkpoint_dir, materialise
from carryover.sources import audit_log, snapshots, windows
from carryover.spec import TableClass
from workload import ranking as W
from workload.merging import written_merge
from workload.parity import DAMAGED, damaged
from workload.registry import query
from workload.digests import given
from workload.roles import frame, frames
from workload.specs import ORDERS_COPY, ORDERS_MERGE, SCALES


def folder(spark, name: str) -> str:
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("snapshot_union_rows", """
    SELECT 'nation' AS table_name, count(*) AS rows, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation
    UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders UNION ALL SELECT 'part', count(*), CAST(sum(p_partkey) AS BIGINT) FROM part""")
def _(spark, sf):
    t = given(spark, sf, ["nation", "orders", "part"])
    tables, _ = snapshots.snapshot_union_checked(
        [{"nation": t["nation"], "orders": t["orders"]}, {"nation": t["nation"].repartition(3), "part": t["part"]}], scales=SCALES)
    out = None
    for name, key in (("nation", "n_nationkey"), ("orders", "o_orderkey"), ("part", "p_partkey")):
        row = tables[name].agg(F.count(F.lit(1)).alias("rows"), F.sum(key).alias("keys")).select(F.lit(name).alias("table_name"), "rows", "keys")
        out = row if out is None else out.unionByName(row)
    return out


@query("copy_id_intact_written", "SELECT * FROM {tgt_orders}", text=["total", "placed_on"])
def _(spark, sf):
    return materialise(project_mapped(frame(spark, sf, "orders"), ORDERS_COPY), "copied")


@query("copy_windows_resumed", """
    SELECT o_orderkey, o_custkey, (o_orderkey - (SELECT min(o_orderkey) FROM orders)) // 1000 AS "window" FROM orders""")
def _(spark, sf):
    src = frame(spark, sf, "orders").select("o_orderkey", "o_custkey")
    path, ledger = folder(spark, "windows"), windows.WindowLedger(spark, folder(spark, "ledger"), "orders")
    first = windows.copy_windows(src, "o_orderkey", path, "orders", ledger, size=1000, limit=3)
    rest = windows.copy_windows(src, "o_orderkey", path, "orders", ledger, size=1000)
    again = windows.copy_windows(src, "o_orderkey", path, "orders", ledger, size=1000)
    assert first <= 3 and again == 0 and first + rest == ledger.confirmed().count()
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", F.col("window").cast("bigint").alias("window"))


@query("audit_log_last_lines", """
    WITH tail AS (SELECT line_no, value FROM {log_lines} ORDER BY line_no DESC LIMIT 20),
    parsed AS (SELECT line_no, value::JSON AS j FROM tail WHERE NOT starts_with(value, 'broken'))
    SELECT line_no, CAST(j->>'$.transaction.messages[0].details.ruleId' AS VARCHAR) AS rule_id,
           'Matched (value redacted)' AS match, split_part(j->>'$.transaction.request.uri', '?', 1) AS uri,
           j->>'$.transaction.messages[0].message' AS message FROM parsed
    UNION ALL SELECT line_no, '?', 'plain', split_part(j->>'$.transaction.request.uri', '?', 1), 'second' FROM parsed""")
def _(spark, sf):
    return audit_log.triage(audit_log.last_lines(frame(spark, sf, "log_lines"), "line_no", 20))


@query("preserve_table_written", """
    SELECT w.home, w.t AS table_name, s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier, (VALUES ('archive', 'supplier'), ('live', 'supplier')) w(home, t)""")
def _(spark, sf):
    df = frame(spark, sf, "supplier")
    paths = {home: folder(spark, f"kept-{home}") for home in A.homes_of(TableClass.ARCHIVE)}
    out = None
    for home in A.preserve_table(df, TableClass.ARCHIVE, paths):
        row = spark.read.parquet(paths[home]).select(F.lit(home).alias("home"), F.lit("supplier").alias("table_name"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("spot_check_joins_also", """
    WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
    chosen AS (SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY sha256(c_custkey || ':seed-2'), c_custkey LIMIT 10)
      UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    SELECT c_custkey AS parent, 'orders' AS child_table, coalesce(o.n, 0) AS source_rows, coalesce(b.n, 0) AS target_rows,
           CASE WHEN coalesce(o.n, 0) = coalesce(b.n, 0) THEN 'pass' ELSE 'fail' END AS state
    FROM chosen LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN b ON b.o_custkey = c_custkey""")
def _(spark, sf):
    c, o = frames(spark, sf, "customer", "orders")
    wrong = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return P.spot_check_joins(c, "c_custkey", {"orders": (o, o.where("o_orderstatus <> 'P'"), "o_custkey")}, seed="seed-2", n=10, also=wrong)


@query("release_gate_closed", """
    SELECT CAST(2 AS BIGINT) AS homes, CAST((SELECT count(*) > 0 FROM customer WHERE c_acctbal < 0) AS BIGINT) AS homes_not_verified,
           CAST(0 AS BIGINT) AS mapping_violations, (SELECT count(*) = 0 FROM customer WHERE c_acctbal < 0) AS may_release""")
def _(spark, sf):
    originals = given(spark, sf, ["nation", "customer"])
    homes = P.preserved_parity(originals, {"archive": {"nation": originals["nation"], "customer": originals["customer"].where("c_acctbal >= 0")}}, scales=SCALES)
    n = W.names(spark, sf)
    return P.release_gate(homes, R.mapping_recheck(n, R.allocate_names(n, W.PREFIX), W.PREFIX))


@query("merge_parity_missing", f"""
    WITH {DAMAGED} SELECT m.old_id FROM idmap m JOIN {{st_orders}} s ON s.order_no = m.old_id
    WHERE NOT coalesce(s.total < 20000, false) AND m.new_id NOT IN (SELECT order_no FROM {{seed_orders}}) AND m.new_id NOT IN (SELECT order_no FROM hurt)""")
def _(spark, sf):
    src, seed, live, idmap = written_merge(spark, sf)
    filled = materialise(M.archived_backfill(live, seed, src, ORDERS_MERGE, ["order_no"]), "filled")
    return P.appended_missing(src, damaged(filled), seed, idmap, ORDERS_MERGE)
