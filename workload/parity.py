"""Value parity: family H from H4 on, K5 and K6."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.operators import merge as M
from carryover.operators import parity as P
from carryover.operators import ranking as R
from carryover.session import materialise
from workload import ranking as W
from workload.digests import given
from workload.merging import IDMAP, MERGED, SEED_TOTAL, merged, written_merge
from workload.registry import query
from workload.roles import frame, frames
from workload.specs import LARGE, LINES_COPY, ORDERS_COPY, ORDERS_MERGE, SCALES

PAIRED = """
    e AS (SELECT * FROM {tgt_orders}), p AS (SELECT e.orderno, d.orderno IS NOT NULL AS found,
        d.custno IS DISTINCT FROM CASE WHEN e.priority = '1-URGENT' AND e.total > 490000 THEN e.custno + 1 ELSE e.custno END AS b_custno,
        d.status IS DISTINCT FROM e.status AS b_status, d.total IS DISTINCT FROM e.total AS b_total,
        d.placed_on IS DISTINCT FROM e.placed_on AS b_placed_on, d.priority IS DISTINCT FROM e.priority AS b_priority
      FROM e LEFT JOIN {bad_orders} d USING (orderno))"""


def override():
    total = F.col("o_totalprice").cast("decimal(12,2)")
    return {"custno": ((F.col("o_orderpriority") == "1-URGENT") & (total > 490000), F.col("o_custkey") + 1)}


@query("copy_value_parity", f"""
    WITH {PAIRED} SELECT 'orders' AS table_name, column_name, CASE WHEN rows = 0 THEN 'pass' ELSE 'fail' END AS state, rows FROM (
      SELECT 'orderno' AS column_name, CAST(0 AS BIGINT) AS rows UNION ALL SELECT 'custno', count(*) FILTER (found AND b_custno) FROM p
      UNION ALL SELECT 'status', count(*) FILTER (found AND b_status) FROM p UNION ALL SELECT 'total', count(*) FILTER (found AND b_total) FROM p
      UNION ALL SELECT 'placed_on', count(*) FILTER (found AND b_placed_on) FROM p
      UNION ALL SELECT 'priority', count(*) FILTER (found AND b_priority) FROM p
      UNION ALL SELECT '(row)', count(*) FILTER (found AND (b_custno OR b_status OR b_total OR b_placed_on OR b_priority)) FROM p
      UNION ALL SELECT '(missing)', count(*) FILTER (NOT found) FROM p)""")
def _(spark, sf):
    src, tgt = frames(spark, sf, "orders", "bad_orders")
    return P.copy_value_parity(src, tgt, ORDERS_COPY, override())


@query("mismatch_keys", f"""
    WITH {PAIRED} SELECT orderno FROM p WHERE NOT found OR b_custno OR b_status OR b_total OR b_placed_on OR b_priority
    ORDER BY orderno LIMIT 50""")
def _(spark, sf):
    src, tgt = frames(spark, sf, "orders", "bad_orders")
    return P.mismatch_keys(src, tgt, ORDERS_COPY, override())


@query("multiset_parity", """
    SELECT 'lineitem' AS table_name, CASE WHEN (SELECT count(*) FROM (SELECT * FROM {tgt_lineitem} EXCEPT ALL SELECT * FROM {bad_lineitem})) = 0
        THEN 'verified' ELSE 'content differs' END AS status, count(*) AS expected_rows, count(*) AS actual_rows FROM lineitem
    UNION ALL SELECT 'lineitem', 'verified', count(*), count(*) FROM lineitem""")
def _(spark, sf):
    src, good, bad = frames(spark, sf, "lineitem", "tgt_lineitem", "bad_lineitem")
    return P.multiset_parity(src, bad, LINES_COPY).unionByName(P.multiset_parity(src, good, LINES_COPY))


SIDES = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_shipdate"


@query("multiset_offenders", f"""
    SELECT {SIDES}, 'source only' AS side, count(*) AS copies FROM (SELECT * FROM {{tgt_lineitem}} EXCEPT ALL SELECT * FROM {{bad_lineitem}}) GROUP BY ALL
    UNION ALL SELECT {SIDES}, 'target only', count(*) FROM (SELECT * FROM {{bad_lineitem}} EXCEPT ALL SELECT * FROM {{tgt_lineitem}}) GROUP BY ALL""", text=["l_quantity", "l_extendedprice"], micros=["l_shipdate"])
def _(spark, sf):
    src, bad = frames(spark, sf, "lineitem", "bad_lineitem")
    return P.multiset_offenders(src, bad, LINES_COPY)


@query("row_parity", f"""
    WITH {MERGED}, late AS (SELECT count(*) AS n FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'O')
    SELECT 'orders' AS table_name, 'copy' AS "class", (SELECT count(*) FROM orders) - n AS source_rows, (SELECT count(*) FROM orders) AS target_rows,
           (SELECT count(*) FROM orders) AS expected_rows, 'pass' AS state FROM late
    UNION ALL SELECT 'orders', 'copy', (SELECT count(*) FROM orders) - n, (SELECT count(*) FROM orders), (SELECT count(*) FROM orders) - n + 7, 'fail' FROM late
    UNION ALL SELECT 'orders', 'merge', (SELECT count(*) FROM {{st_orders}}), (SELECT count(*) FROM live), (SELECT count(*) FROM live), 'pass'
    UNION ALL SELECT 'orders', 'merge', (SELECT count(*) FROM {{st_orders}}), (SELECT count(*) FROM {{seed_orders}}),
        (SELECT count(*) FROM {{seed_orders}}) + (SELECT count(*) FROM added), 'fail'""")
def _(spark, sf):
    orders = frame(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    late = (F.col("o_totalprice") > 400000) & (F.col("o_orderstatus") == "O")
    before = orders.where(~late)
    src, seed, live, _, _ = merged(spark, sf)
    return (P.copy_row_parity(before, orders, "orders", ["o_orderkey"], admin=late)
            .unionByName(P.copy_row_parity(before, orders, "orders", ["o_orderkey"], recorded=7, limit=100))
            .unionByName(P.merge_row_parity(src, live, ORDERS_MERGE)).unionByName(P.merge_row_parity(src, seed, ORDERS_MERGE)))


FILLED = IDMAP + f""",
    best AS (SELECT cust_no, priority, legacy_status FROM (SELECT *, row_number() OVER (PARTITION BY cust_no, priority
        ORDER BY legacy_status IS NULL, legacy_status) AS n FROM {{st_orders}} WHERE NOT (total < 20000)) WHERE n = 1),
    filled AS (SELECT l.order_no, l.cust_no, l.priority, l.total, l.placed_at, p.order_no IS NOT NULL AS seed,
        CASE WHEN p.order_no IS NOT NULL THEN b.legacy_status ELSE l.{SEED_TOTAL} END AS archived
      FROM live l LEFT JOIN {{seed_orders}} p USING (order_no)
      LEFT JOIN best b ON b.cust_no = l.cust_no AND b.priority IS NOT DISTINCT FROM l.priority)"""


def damaged(live):
    """A live table with three kinds of damage."""
    gone = (F.col("total") > 499000) & (F.col("priority") == "2-HIGH")
    kept = live.where(~F.coalesce(gone, F.lit(False)))
    return (kept.withColumn("total", F.when((F.col("total") > 480000) & (F.col("priority") == "1-URGENT"), F.col("total") + 1)
                            .otherwise(F.col("total")).cast("decimal(12,2)"))
            .withColumn(SEED_TOTAL, F.when(F.col("priority") == "3-MEDIUM", F.lit("Z")).otherwise(F.col(SEED_TOTAL))))


DAMAGED = FILLED + """,
    hurt AS (SELECT order_no, cust_no, priority, seed, placed_at,
        CASE WHEN total > 480000 AND priority = '1-URGENT' THEN total + 1 ELSE total END AS total, total AS was,
        CASE WHEN priority = '3-MEDIUM' THEN 'Z' ELSE archived END AS archived, archived AS before
      FROM filled WHERE NOT coalesce(total > 499000 AND priority = '2-HIGH', false))"""


@query("merge_parity", f"""
    WITH {DAMAGED} SELECT claim, rows FROM (
      SELECT 'seed unchanged' AS claim, (SELECT count(*) FROM {{seed_orders}}) - count(*) FILTER (seed AND total = was) AS rows FROM hurt
      UNION ALL SELECT 'appended as written', count(*) FROM hurt h JOIN idmap m ON m.new_id = h.order_no JOIN {{st_orders}} s ON s.order_no = m.old_id
        WHERE NOT h.seed AND NOT (s.total < 20000) AND (h.total <> s.total OR h.archived IS DISTINCT FROM s.legacy_status)
      UNION ALL SELECT 'losers archived', count(*) FROM hurt h WHERE seed
        AND EXISTS (SELECT 1 FROM {{st_orders}} s WHERE s.cust_no = h.cust_no AND s.priority IS NOT DISTINCT FROM h.priority AND NOT (s.total < 20000))
        AND NOT EXISTS (SELECT 1 FROM {{st_orders}} s WHERE s.cust_no = h.cust_no AND s.priority IS NOT DISTINCT FROM h.priority
          AND NOT (s.total < 20000) AND s.legacy_status IS NOT DISTINCT FROM h.archived))""")
def _(spark, sf):
    src, seed, live, idmap = written_merge(spark, sf)
    filled = materialise(M.archived_backfill(live, seed, src, ORDERS_MERGE, ["order_no"]), "filled")
    return P.merge_parity(src, damaged(filled), seed, idmap, ORDERS_MERGE)


@query("preserved_parity", f"""
    SELECT h.home, t.t AS table_name, CASE WHEN h.home = 'archive' THEN 'verified' WHEN t.t IN ('labels', 'customer', 'orders') THEN 'failed'
        ELSE 'verified' END AS status,
      CASE WHEN h.home = 'archive' THEN NULL WHEN t.t = 'labels' THEN 'table missing' WHEN t.t = 'customer' THEN 'rows'
           WHEN t.t = 'orders' THEN 'content' END AS why
    FROM (VALUES ('archive'), ('live')) h(home), (VALUES ('labels'), ('customer'), ('orders'), ('nation')) t(t)
    WHERE (SELECT count(*) FROM customer WHERE c_acctbal < 0) > 0""")
def _(spark, sf):
    originals = given(spark, sf, ["labels", "customer", "orders", "nation"])
    hit = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000)
    live = {"customer": originals["customer"].where("c_acctbal >= 0"), "nation": originals["nation"],
            "orders": originals["orders"].withColumn("o_custkey", F.when(hit, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))}
    return P.preserved_parity(originals, {"archive": {k: v.repartition(3) for k, v in originals.items()}, "live": live},
                              large=LARGE, scales=SCALES)


@query("archived_column_parity", f"""
    WITH {FILLED}, src AS (SELECT * FROM {{st_orders}} WHERE NOT (total < 20000)),
    g AS (SELECT cust_no, priority, count(legacy_status) AS n FROM src GROUP BY 1, 2),
    x AS (SELECT CAST(sum(CASE WHEN n > 0 AND EXISTS (SELECT 1 FROM {{seed_orders}} d WHERE d.cust_no = g.cust_no
        AND d.priority IS NOT DISTINCT FROM g.priority) THEN n - 1 ELSE 0 END) AS BIGINT) AS surplus FROM g),
    c AS (SELECT (SELECT count(legacy_status) FROM src) AS source_values, surplus AS twin_surplus, (SELECT count(archived) FROM filled) AS live_values FROM x)
    SELECT '{SEED_TOTAL}' AS column_name, *, CASE WHEN source_values - twin_surplus = live_values THEN 'pass' ELSE 'fail' END AS state FROM c""")
def _(spark, sf):
    src, seed, live, _, _ = merged(spark, sf)
    filled = M.archived_backfill(live, seed, src, ORDERS_MERGE, ["order_no"])
    return P.archived_column_parity(src, filled, seed, ORDERS_MERGE)


@query("group_totals_parity", """
    WITH s AS (SELECT CAST(year(placed_on) AS INTEGER) AS year, count(*) AS n, sum(total) AS t FROM {tgt_orders} GROUP BY 1),
    d AS (SELECT CAST(year(placed_on) AS INTEGER) AS year, count(*) AS n, coalesce(sum(total), 0) AS t FROM {bad_orders} GROUP BY 1)
    SELECT year, s.n AS source_rows, CAST(CAST(s.t AS DECIMAL(24,2)) AS VARCHAR) AS source_total, d.n AS target_rows,
           CAST(CAST(d.t AS DECIMAL(24,2)) AS VARCHAR) AS target_total,
           CASE WHEN s.n IS NOT DISTINCT FROM d.n AND s.t IS NOT DISTINCT FROM d.t THEN 'pass' ELSE 'fail' END AS state
    FROM s FULL JOIN d USING (year)""")
def _(spark, sf):
    src, tgt = frames(spark, sf, "tgt_orders", "bad_orders")
    return P.group_totals_parity(src, tgt, F.year("placed_on"), F.col("total"))


@query("spot_check_joins", """
    WITH chosen AS (SELECT c_custkey FROM customer ORDER BY sha256(c_custkey || ':seed-1'), c_custkey LIMIT 40),
    o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
    e AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
    SELECT c_custkey AS parent, 'orders' AS child_table, coalesce(o.n, 0) AS source_rows, coalesce(b.n, 0) AS target_rows,
           CASE WHEN coalesce(o.n, 0) = coalesce(b.n, 0) THEN 'pass' ELSE 'fail' END AS state
    FROM chosen LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN b ON b.o_custkey = c_custkey
    UNION ALL SELECT c_custkey, 'events', coalesce(e.n, 0), coalesce(e.n, 0), 'pass' FROM chosen LEFT JOIN e ON user_id = c_custkey""")
def _(spark, sf):
    c, o, e = frames(spark, sf, "customer", "orders", "events")
    return P.spot_check_joins(c, "c_custkey", {"orders": (o, o.where("o_orderstatus <> 'P'"), "o_custkey"),
                                               "events": (e, e, "user_id")}, seed="seed-1", n=40)


@query("raw_field_parity", """
    WITH b AS (SELECT doc_id, CASE WHEN source = 'src1' THEN replace(text, 'the', 'THE') WHEN source = 'src2' THEN text || ' ' ELSE text END AS text,
        CASE WHEN source = 'src3' THEN upper(lang) ELSE lang END AS lang FROM documents WHERE source <> 'src4'),
    j AS (SELECT d.doc_id, d.text AS s, b.text AS d, d.lang AS sl, b.lang AS dl, b.doc_id IS NULL AS lost FROM documents d LEFT JOIN b USING (doc_id))
    SELECT 'text' AS column_name, count(*) FILTER (NOT lost AND s = d) AS same, count(*) FILTER (NOT lost AND s <> d AND d = replace(s, 'the', 'THE')) AS replaced,
      count(*) FILTER (NOT lost AND s <> d AND d <> replace(s, 'the', 'THE')) AS different, count(*) FILTER (lost) AS missing FROM j
    UNION ALL SELECT 'lang', count(*) FILTER (NOT lost AND sl = dl), 0, count(*) FILTER (NOT lost AND sl <> dl), count(*) FILTER (lost) FROM j""")
def _(spark, sf):
    src = frame(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    text = (F.when(F.col("source") == "src1", F.replace("text", F.lit("the"), F.lit("THE")))
            .when(F.col("source") == "src2", F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    tgt = src.where("source <> 'src4'").select(
        "doc_id", text.alias("text"), F.when(F.col("source") == "src3", F.upper("lang")).otherwise(F.col("lang")).alias("lang"))
    return P.raw_field_parity(src, tgt, "doc_id", ["text", "lang"], {"text": ("the", "THE")})


@query("release_gate", """
    SELECT CAST(2 AS BIGINT) AS homes, CAST(0 AS BIGINT) AS homes_not_verified, CAST(0 AS BIGINT) AS mapping_violations, true AS may_release
    WHERE (SELECT count(*) FROM customer) >= 0""")
def _(spark, sf):
    originals = given(spark, sf, ["nation", "customer"])
    homes = P.preserved_parity(originals, {"archive": {k: v.repartition(2) for k, v in originals.items()}}, scales=SCALES)
    n = W.names(spark, sf)
    return P.release_gate(homes, R.mapping_recheck(n, R.allocate_names(n, W.PREFIX), W.PREFIX))

