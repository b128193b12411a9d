"""Pre-checks: family D."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.operators import prechecks as P
from carryover.sources.catalog import catalog_profile
from carryover.spec import ColumnInfo, TableSpec
from workload.digests import given
from workload.registry import query
from workload.roles import frame, frames

WIDE = TableSpec("documents", columns={
    "doc_id": ColumnInfo("int"), "text": ColumnInfo("text", length=3000), "lang": ColumnInfo("char", length=2),
    "source": ColumnInfo("varchar", length=4), "title": ColumnInfo("varchar", length=40)},
    value_exprs={"title": lambda: F.substring_index("text", ".", 1)})
WIDE_SOURCE = {"lang": ColumnInfo("char", length=2)}


@query("width_overflow", """
    SELECT 'documents' AS table_name, c AS column_name, 'width' AS check_name, count(*) FILTER (bad) AS rows,
           min(doc_id) FILTER (bad) AS first_id
    FROM (SELECT doc_id, 'text' AS c, strlen(text) > 3000 AS bad FROM documents
      UNION ALL SELECT doc_id, 'source', length(source) > 4 FROM documents
      UNION ALL SELECT doc_id, 'title', length(split_part(text, '.', 1)) > 40 FROM documents) GROUP BY c""")
def _(spark, sf):
    found = P.precheck(frame(spark, sf, "documents"), WIDE, "doc_id", source=WIDE_SOURCE)
    return found.where("check_name = 'width'")


TEXT_NUMBER = """CASE WHEN event_type = 'view' THEN '' WHEN event_type = 'click' THEN CAST(user_id AS STRING)
    WHEN event_type = 'error' AND user_id > 10 THEN ' -1.5e3 ' WHEN event_type = 'error' THEN '.5.1' WHEN user_id > 20 THEN '12a'
    ELSE props END"""


@query("non_numeric_text", f"""
    SELECT 'events' AS table_name, 'amount' AS column_name, 'not_a_number' AS check_name, count(*) FILTER (bad) AS rows,
           min(event_id) FILTER (bad) AS first_id
    FROM (SELECT event_id, trim(t) <> '' AND TRY_CAST(trim(t) AS DOUBLE) IS NULL AS bad
          FROM (SELECT event_id, {TEXT_NUMBER} AS t FROM events))""")
def _(spark, sf):
    df = frame(spark, sf, "events").select("event_id", F.expr(TEXT_NUMBER).alias("amount"))
    spec = TableSpec("events", columns={"amount": ColumnInfo("double")})
    found = P.precheck(df, spec, "event_id", source={"amount": ColumnInfo("varchar", length=50)})
    return found.where("check_name = 'not_a_number'")


NUMBERS = TableSpec("lineitem", columns={
    "price": ColumnInfo("decimal", precision=6, scale=1), "line": ColumnInfo("tinyint"), "part": ColumnInfo("smallint"),
    "quantity": ColumnInfo("int"), "tax": ColumnInfo("float")},
    value_exprs={"price": lambda: F.col("l_extendedprice").cast("decimal(12,2)"), "line": lambda: F.col("l_linenumber") * 30,
                 "part": lambda: F.col("l_partkey") * 100, "quantity": lambda: F.col("l_quantity").cast("decimal(12,2)") / 4,
                 "tax": lambda: F.col("l_tax").cast("decimal(12,2)")})


@query("numeric_capacity", """
    WITH v AS (SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, l_linenumber * 30 AS line,
        l_partkey * 100 AS part, CAST(l_quantity AS BIGINT) AS quantity, CAST(l_tax AS DECIMAL(12,2)) AS tax FROM lineitem),
    b AS (SELECT l_orderkey, 'price' AS c, price > 99999.9 OR CAST(price * 100 AS BIGINT) % 10 <> 0 AS bad FROM v
      UNION ALL SELECT l_orderkey, 'line', line > 127 FROM v UNION ALL SELECT l_orderkey, 'part', part > 32767 FROM v
      UNION ALL SELECT l_orderkey, 'quantity', quantity % 4 <> 0 FROM v
      UNION ALL SELECT l_orderkey, 'tax', CAST(CAST(CAST(tax AS FLOAT) AS DOUBLE) AS DECIMAL(38,10)) <> tax FROM v)
    SELECT 'lineitem' AS table_name, c AS column_name, 'capacity' AS check_name, count(*) FILTER (bad) AS rows,
           min(l_orderkey) FILTER (bad) AS first_id FROM b GROUP BY c""")
def _(spark, sf):
    return P.precheck(frame(spark, sf, "lineitem"), NUMBERS, "l_orderkey")


TIMES = TableSpec("events", columns={"at_second": ColumnInfo("datetime"), "on_day": ColumnInfo("date"),
                                     "stamp": ColumnInfo("timestamp"), "midnight": ColumnInfo("date")},
                  value_exprs={"at_second": lambda: F.col("ts"), "on_day": lambda: F.col("ts"),
                               "stamp": lambda: F.when(F.col("event_type") == "view", F.col("ts") + F.expr("INTERVAL '20' YEAR"))
                               .otherwise(F.col("ts")), "midnight": lambda: F.date_trunc("DAY", "ts")})


@query("temporal_capacity", """
    WITH b AS (SELECT event_id, 'at_second' AS c, ts <> date_trunc('second', ts) AS bad FROM events
      UNION ALL SELECT event_id, 'on_day', ts <> date_trunc('day', ts) FROM events
      UNION ALL SELECT event_id, 'midnight', false FROM events
      UNION ALL SELECT event_id, 'stamp', event_type = 'view' FROM events)
    SELECT 'events' AS table_name, c AS column_name, 'temporal' AS check_name, count(*) FILTER (bad) AS rows,
           min(event_id) FILTER (bad) AS first_id FROM b GROUP BY c""")
def _(spark, sf):
    return P.precheck(frame(spark, sf, "events"), TIMES, "event_id",
                      fraction_digits={"stamp": 6})


@query("fk_violations", """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '2-HIGH' OR o_totalprice < 300000)
    GROUP BY 1, 2""")
def _(spark, sf):
    child, parent = frames(spark, sf, "lineitem", "orders")
    parent = parent.where("o_orderpriority <> '2-HIGH' OR o_totalprice < 300000")
    lost = P.fk_violations(child, parent, [("l_orderkey", "o_orderkey")], ["l_partkey", "l_suppkey"])
    return lost.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("fk_unmapped", """
    SELECT o_custkey AS old_id, count(*) AS rows, will_hold FROM orders, (VALUES ('NULL'), ('raw id'), ('zero (0)')) v(will_hold)
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY 1, 3""")
def _(spark, sf):
    child, parents = frames(spark, sf, "orders", "customer")
    idmap = parents.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("old_id"),
                                                               (F.col("c_custkey") + 1000).alias("new_id"))
    # a column that may be NULL, one that may not, and one that may but whose readers cannot hold a NULL
    out = P.fk_unmapped(child, idmap, "o_custkey", True, ["o_orderkey"])
    for info in (ColumnInfo("bigint", nullable=False), ColumnInfo("bigint", primitive=True)):
        out = out.unionByName(P.fk_unmapped(child, idmap, "o_custkey", info, ["o_orderkey"]))
    return out


@query("unique_conflicts", """
    SELECT lower(rtrim(name, ' ')) AS folded, count(*) AS rows, count(*) - 1 AS extras
    FROM (SELECT CASE WHEN p_size > 25 THEN upper(p_name) || '  ' ELSE p_name END AS name FROM part) GROUP BY 1 HAVING count(*) > 1""")
def _(spark, sf):
    df = frame(spark, sf, "part").select(F.when(F.col("p_size") > 25, F.concat(F.upper("p_name"), F.lit("  ")))
                                         .otherwise(F.col("p_name")).alias("name"))
    return P.unique_conflicts(df, "name", ColumnInfo("varchar", collation="ci"))


@query("sentinel_reference", """
    WITH c AS (SELECT id, CASE WHEN kind = 'click' THEN -1 WHEN kind = 'signup' THEN person * 20 ELSE person END AS ref FROM {st_decisions})
    SELECT CAST((SELECT count(*) FROM customer WHERE c_custkey = -1) AS BIGINT) AS sentinel_is_real,
           count(*) FILTER (ref IS NULL) AS null_references, count(*) FILTER (ref = -1) AS unassigned,
           count(*) FILTER (ref <> -1 AND ref NOT IN (SELECT c_custkey FROM customer)) AS invalid FROM c""")
def _(spark, sf):
    child, parent = frames(spark, sf, "st_decisions", "customer")
    ref = F.when(F.col("kind") == "click", -1).when(F.col("kind") == "signup", F.col("person") * 20).otherwise(F.col("person"))
    return P.sentinel_reference(child.select("id", ref.alias("ref")), "ref", parent, "c_custkey", -1, ["id"])


@query("unknown_tables_columns", """
    SELECT * FROM (SELECT 'events' AS table_name, v.c AS column_name, (SELECT count(*) FROM events) AS rows, 'unknown column' AS kind,
        v.u AS unsafe_name, v.l AS too_long, false AS reserved_name
      FROM (VALUES ('bad-name', true, false), ('a_very_long_column_name_that_leaves_no_room_for_the_prefix', false, true), ('props', false, false)) v(c, u, l)
      UNION ALL SELECT 'labels__idmap', c, (SELECT count(*) FROM labels), 'unknown table', false, false, true
      FROM (VALUES ('doc_id'), ('quality'), ('toxic')) w(c))""")
def _(spark, sf):
    t = given(spark, sf, ["events", "labels", "region"])
    events = t["events"].select("*", F.lit(1).alias("bad-name"),
                                F.lit(1).alias("a_very_long_column_name_that_leaves_no_room_for_the_prefix"))
    profile = catalog_profile({"events": events, "labels__idmap": t["labels"], "empty": t["region"].where("r_regionkey < 0")})
    mapped = spark.sql("""SELECT 'Events' AS table_name, explode(array('event_id', 'TS', 'user_id', 'event_type', 'value')) AS column_name""")
    return P.unknown_objects(profile, mapped, reserved=["__idmap", "__preseed"])


DROPPED = TableSpec("orders", dropped={
    "o_orderpriority": lambda: F.col("o_orderpriority") != "5-LOW", "o_orderstatus": lambda: F.col("o_orderstatus") == "P",
    "o_totalprice": lambda: F.col("o_totalprice") > 400000})


@query("dropped_value_scan", """
    SELECT 'o_orderpriority' AS column_name, count(*) FILTER (o_orderpriority <> '5-LOW') AS rows FROM orders
    UNION ALL SELECT 'o_orderstatus', count(*) FILTER (o_orderstatus = 'P') FROM orders
    UNION ALL SELECT 'o_totalprice', count(*) FILTER (o_totalprice > 400000) FROM orders""")
def _(spark, sf):
    return P.dropped_value_scan(frame(spark, sf, "orders"), DROPPED)


@query("removed_prefix_keys", """
    SELECT name, count(*) AS rows FROM {st_settings} WHERE starts_with(name, 'fax_1') OR name = 'docRoot' GROUP BY 1""")
def _(spark, sf):
    df = frame(spark, sf, "st_settings").where(P.like_prefix(F.col("name"), ["fax_1"], ["docRoot"]))
    return df.groupBy("name").agg(F.count(F.lit(1)).alias("rows"))


@query("required_presence", """
    SELECT count(*) AS rows, count(*) FILTER (s_acctbal > 9000) AS enabled_rows,
           CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) FILTER (s_acctbal > 9000) = 0 THEN 'none enabled' ELSE 'present' END AS state
    FROM supplier""")
def _(spark, sf):
    return P.required_presence(frame(spark, sf, "supplier"), F.col("s_acctbal") > 9000)


@query("ambiguous_basename", r"""
    SELECT regexp_extract(report_path, '[^/\\]*$') AS name, count(DISTINCT replace(report_path, '\', '/')) AS paths
    FROM {st_reports} GROUP BY 1 HAVING count(DISTINCT replace(report_path, '\', '/')) > 1""")
def _(spark, sf):
    return P.ambiguous_basename(frame(spark, sf, "st_reports"), "report_path")


