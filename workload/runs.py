"""Whole runs of a migration over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.operators import parity as P
from carryover.plans.lifecycle import Migration
from carryover.plans.preflight import Expectations
from carryover.spec import ColumnInfo, TableClass, TableSpec
from workload.charset import sql_double, sql_marker
from workload.registry import query
from workload.roles import frame, frames, role, written_once
from workload.specs import LINES_COPY, ORDERS_COPY
from workload.written import folder

# --- customers and orders that refer to each other, both renumbered
role("ring_customers", """
    SELECT c_custkey AS id, c_name AS code, last_order AS ref FROM {customer}
    LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last_order FROM {orders} GROUP BY o_custkey) l ON o_custkey = c_custkey""")
role("ring_orders", """
    SELECT o_orderkey AS id, concat('order ', CAST(o_orderkey AS STRING)) AS code, CASE WHEN o_orderpriority = '5-LOW' THEN o_custkey + 100000000 ELSE o_custkey END AS ref
    FROM {orders}""")
role("ring_customers_seed", """
    SELECT c_custkey * 3 + 7 AS id, c_name AS code, CAST(NULL AS BIGINT) AS ref FROM {customer} WHERE c_mktsegment = 'BUILDING'""")
role("ring_orders_seed", """
    SELECT o_orderkey * 2 + 1 AS id, concat('order ', CAST(o_orderkey AS STRING)) AS code, CAST(NULL AS BIGINT) AS ref FROM {orders} WHERE o_orderstatus = 'F'""")


def _ring(name: str, parent: str) -> TableSpec:
    return TableSpec(name, TableClass.MERGE, columns={"id": ColumnInfo("bigint", nullable=False), "code": ColumnInfo("varchar", length=40), "ref": ColumnInfo("bigint")},
                     key=("id",), merge_keys=("code",), surrogate_pk="id", fk_remap={"ref": parent})


def _sql_map(table: str) -> str:
    return f"""{table}_map AS (SELECT s.id AS old_id, coalesce(d.id, (SELECT max(id) FROM {{{table}_seed}}) + row_number() OVER (PARTITION BY d.id IS NULL ORDER BY s.id)) AS new_id,
        d.id IS NOT NULL AS seeded, s.code, s.ref FROM {{{table}}} s LEFT JOIN {{{table}_seed}} d USING (code))"""


def _sql_live(table: str, parent: str) -> str:
    return f"""SELECT '{table}' AS table_name, id, code, ref FROM {{{table}_seed}}
        UNION ALL SELECT '{table}', m.new_id, m.code, p.new_id FROM {table}_map m LEFT JOIN {parent}_map p ON p.old_id = m.ref WHERE NOT m.seeded"""


@query("circular_merge", f"""
    WITH {_sql_map('ring_customers')}, {_sql_map('ring_orders')}
    {_sql_live('ring_customers', 'ring_orders')} UNION ALL {_sql_live('ring_orders', 'ring_customers')}""")
def _(spark, sf):
    names = ("ring_customers", "ring_orders")
    # each step reads the staged tables again: the one that joins is written first, as a staging area would hold it
    staging = {n: written_once(spark, sf, n) if n == "ring_customers" else frame(spark, sf, n) for n in names}
    run = Migration(spark, staging, {n: frame(spark, sf, f"{n}_seed") for n in names},
                    [_ring(*names), _ring(*names[::-1])], folder(spark, "ring"))
    run.apply()
    wrong = run.verify().where("rows > 0").select("table_name", F.lit(-1).cast("bigint").alias("id"), F.col("item").alias("code"), F.col("rows").alias("ref"))
    out = wrong  # no row: everything arrived
    for n in names:
        out = out.unionByName(run._read("live", n).select(F.lit(n).alias("table_name"), "id", "code", "ref"))
    return out


LINES = TableSpec("lineitem", columns={"l_orderkey": ColumnInfo("bigint"), "l_partkey": ColumnInfo("bigint", nullable=False), "l_linenumber": ColumnInfo("int"),
                                       "l_suppkey": ColumnInfo("bigint", primitive=True), "l_returnflag": ColumnInfo("char", length=1)},
                  key=("l_orderkey", "l_linenumber"), fk_remap={"l_partkey": "part", "l_suppkey": "supplier", "l_orderkey": "orders"},
                  dropped={"l_quantity": lambda: F.col("l_quantity") > 45})
PARTS = TableSpec("part", columns={"p_partkey": ColumnInfo("bigint"), "p_name": ColumnInfo("varchar", length=9), "p_size": ColumnInfo("tinyint"),
                                   "p_retailprice": ColumnInfo("decimal", precision=6, scale=2)},
                  key=("p_partkey",), value_exprs={"p_retailprice": lambda: F.col("p_retailprice").cast("decimal(12,2)")})
SUPPLIERS = TableSpec("supplier", columns={"s_suppkey": ColumnInfo("bigint"), "s_name": ColumnInfo("varchar", length=90)}, key=("s_suppkey",))
TEXTS = TableSpec("documents", columns={"doc_id": ColumnInfo("bigint"), "body": ColumnInfo("text")}, key=("doc_id",), charset_scan=("body",))
NAMES = TableSpec("nation", columns={"name": ColumnInfo("varchar", length=25, collation="ci")}, key=("name",), renames={"name": "n_name"})


CENSUS = f"""WITH c AS (SELECT count(*) FILTER ({sql_double('body')}) AS n, count(*) FILTER (state = 'twice' AND body <> original) AS multi,
        count(*) FILTER ({sql_marker('body')} AND NOT {sql_double('body')}) AS bad FROM {{st_text}})
    SELECT 'repairable' AS lane, n - multi AS rows FROM c UNION ALL SELECT 'multi', multi FROM c UNION ALL SELECT 'bad', bad FROM c"""


@query("preflight_run", """
    WITH l AS (SELECT l_partkey, l_suppkey, l_orderkey, l_quantity FROM lineitem),
    part_ AS (SELECT * FROM part WHERE p_size > 10), supplier_ AS (SELECT * FROM supplier WHERE s_acctbal > 0),
    orders_ AS (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT'),
    n AS (SELECT lower(CASE WHEN n_nationkey < 10 THEN 'Somewhere' WHEN n_nationkey < 14 THEN 'SOMEWHERE ELSE ' ELSE n_name END) AS name FROM nation),
    f AS (
      SELECT 'value-width' AS finding_id, 'blocker' AS severity, 'part' AS table_name, 'p_name' AS column_name, (SELECT count(*) FROM part_ WHERE length(p_name) > 9) AS rows, NULL AS accept
      UNION ALL SELECT 'value-capacity', 'blocker', 'part', 'p_size', (SELECT count(*) FROM part_ WHERE p_size > 127), NULL
      UNION ALL SELECT 'value-capacity', 'blocker', 'part', 'p_retailprice', (SELECT count(*) FROM part_ WHERE p_retailprice >= 10000), NULL
      UNION ALL SELECT 'value-without-home', 'advisory', 'lineitem', 'l_quantity', (SELECT count(*) FROM l WHERE l_quantity > 45), NULL
      UNION ALL SELECT 'reference-without-parent', 'blocker', 'lineitem', 'l_partkey', (SELECT count(*) FROM l WHERE l_partkey NOT IN (SELECT p_partkey FROM part_)), 'keep-raw-references'
      UNION ALL SELECT 'reference-becomes-zero', 'advisory', 'lineitem', 'l_suppkey', (SELECT count(*) FROM l WHERE l_suppkey <> 3 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier_)), NULL
      UNION ALL SELECT 'sentinel-is-a-key', 'blocker', 'supplier', 's_suppkey', (SELECT count(*) FROM supplier_ WHERE s_suppkey = 3), NULL
      UNION ALL SELECT 'reference-without-parent', 'advisory', 'lineitem', 'l_orderkey', (SELECT count(*) FROM l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders_)), NULL
      UNION ALL SELECT 'key-repeats', 'blocker', 'nation', 'name', (SELECT count(*) - count(DISTINCT rtrim(name)) FROM n), NULL
      UNION ALL SELECT 'required-rows-missing', 'blocker', 'orders', NULL, 1, 'missing-required-rows'
      UNION ALL SELECT 'ambiguous-file-name', 'blocker', 'documents', 'path',
        (SELECT count(*) FROM (SELECT source FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY source HAVING count(*) > 1)), 'ambiguous-file-names'
      UNION ALL SELECT 'charset-repairable', 'blocker', 'documents', 'body', (SELECT rows FROM ({CENSUS}) WHERE lane = 'repairable'), 'charset-repair'
      UNION ALL SELECT 'charset-' || lane, 'blocker', 'documents', 'body', rows, 'keep-unrepairable-text' FROM ({CENSUS}) WHERE lane <> 'repairable'
      UNION ALL SELECT 'unknown-column', 'advisory', t, c, r, NULL FROM (SELECT 'part' AS t, unnest(['p_brand', 'p_type']) AS c, (SELECT count(*) FROM part_) AS r
        UNION ALL SELECT 'supplier', unnest(['s_nationkey', 's_acctbal']), (SELECT count(*) FROM supplier_)
        UNION ALL SELECT 'lineitem', unnest(['l_extendedprice', 'l_discount', 'l_tax', 'l_linestatus', 'l_shipdate']), (SELECT count(*) FROM l)
        UNION ALL SELECT 'nation', unnest(['n_nationkey', 'n_regionkey']), (SELECT count(*) FROM n)
        UNION ALL SELECT 'documents', unnest(['path', 'state', 'lang']), (SELECT count(*) FROM documents))
      UNION ALL SELECT 'unknown-table', 'blocker', 'region', NULL, (SELECT count(*) FROM region), 'leave-unknown-tables'
      UNION ALL SELECT 'schema-type-change', 'blocker', 'part', 'p_size', (SELECT count(*) FROM part_), 'schema-differs'
      UNION ALL SELECT 'target-not-pristine', 'blocker', 'customer', NULL, (SELECT count(*) - 1 FROM customer), 'target-not-pristine')
    SELECT * FROM f WHERE rows > 0""".replace("{CENSUS}", CENSUS))
def _(spark, sf):
    part, supplier, orders, texts, nation = frames(spark, sf, "part", "supplier", "orders", "st_text", "nation")
    name = F.when(F.col("n_nationkey") < 10, "Somewhere").when(F.col("n_nationkey") < 14, "SOMEWHERE ELSE ").otherwise(F.col("n_name"))
    staging = {"lineitem": frame(spark, sf, "lineitem"), "part": part.where("p_size > 10"), "supplier": supplier.where("s_acctbal > 0"),
               "orders": orders.where("o_orderpriority <> '1-URGENT'"), "region": frame(spark, sf, "region"), "nation": nation.withColumn("n_name", name),
               "documents": texts.select("doc_id", "body", F.concat_ws("/", "lang", "source").alias("path"), "state", "lang")}
    expect = Expectations(required={"orders": lambda: F.col("o_orderpriority") == "1-URGENT", "part": lambda: F.col("p_size") > 11},
                          sentinels={("lineitem", "l_suppkey"): 3}, paths={"documents": "path"},
                          schema=spark.createDataFrame([("part", "p_size", "string"), ("part", "p_name", "string")], "table_name string, column_name string, data_type string"),
                          pristine=spark.createDataFrame([("customer", "copy", 1, False, 0)], "table_name string, class string, expected bigint, tolerated boolean, startup_rows int"))
    run = Migration(spark, staging, {"customer": frame(spark, sf, "customer")}, [LINES, PARTS, SUPPLIERS, ORDERS_COPY, TEXTS, NAMES], folder(spark, "preflight"), expect=expect)
    return run.preflight()[0]


@query("copy_value_parity_states", """
    SELECT 'lineitem' AS table_name, '(row)' AS column_name, 'not checked: no primary key' AS state, count(*) AS rows FROM lineitem
    UNION ALL SELECT 'orders', '(row)', 'not checked: rewritten on purpose (renumbering)', count(*) FROM orders""")
def _(spark, sf):
    lines, orders = frames(spark, sf, "lineitem", "orders")
    copied, stored = frames(spark, sf, "tgt_lineitem", "bad_orders")
    return P.copy_value_parity(lines, copied, LINES_COPY).unionByName(P.copy_value_parity(orders, stored, ORDERS_COPY, rewritten="renumbering"))
