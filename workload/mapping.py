"""Sources, mapping and sinks: family A."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.operators.counting import count_frame
from carryover.operators.merge import project_mapped, seed_replace
from carryover.operators.parity import copy_row_parity
from carryover.sources import audit_log, catalog, export, policy, snapshots, windows
from carryover.spec import effective_spec
from workload.registry import query
from workload.roles import BASE, frame, frames
from workload.digests import COLUMNS, given, sql_lanes
from workload.specs import ORDERS_COPY, SCALES

# Columns of the given tables that COLUMNS leaves out.
PROFILED = {**{t: [c.split(":")[0] for c in cols.split()] for t, cols in COLUMNS.items()},
            "embeddings": ["vec_id", "embedding", "label"]}

SQL_TYPE = """CASE {t} WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
  WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE {t} END"""


def sql_profile(source: str, table: str, columns: list[str], first: int = 1) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, {i} AS ordinal, '{c}' AS column_name,
        {SQL_TYPE.format(t=f"typeof(any_value({c}))")} AS data_type, count(*) AS rows, count(*) - count({c}) AS nulls
        FROM {source}""" for i, c in enumerate(columns, first))


@query("catalog_profile", " UNION ALL ".join(sql_profile(t, t, PROFILED[t]) for t in BASE))
def _(spark, sf):
    return catalog.catalog_profile(given(spark, sf, BASE)).drop("nullable")


@query("schema_diff", """
    SELECT 'customer' AS table_name, 'c_acctbal' AS column_name, 'missing column' AS change, 'double' AS expected_type,
           NULL AS actual_type, CAST(NULL AS BIGINT) AS rows
    UNION ALL SELECT 'nation', 'n_regionkey', 'lossless widening', 'bigint', 'int', count(*) FROM nation
    UNION ALL SELECT 'nation', 'n_nationkey', 'type change', 'string', 'int', count(*) FROM nation
    UNION ALL SELECT 'orders', 'o_extra', 'unexpected column', NULL, 'string', count(*) FROM orders
    UNION ALL SELECT 'part', x, 'missing table', y, NULL, NULL
      FROM (VALUES ('p_partkey', 'bigint'), ('p_name', 'string'), ('p_brand', 'string'), ('p_type', 'string'),
                   ('p_size', 'int'), ('p_retailprice', 'double')) v(x, y)""")
def _(spark, sf):
    want = given(spark, sf, ["customer", "nation", "orders", "part"])
    have = dict(want)
    want["nation"] = want["nation"].select(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("bigint"))
    have["customer"] = have["customer"].drop("c_acctbal")
    have["orders"] = have["orders"].withColumn("o_extra", F.lit("x"))
    del have["part"]
    return catalog.schema_diff(catalog.catalog_profile(want), catalog.catalog_profile(have))


@query("effective_mapping", """
    SELECT o_orderkey AS orderno, o_custkey AS custno,
           CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'U' END AS status,
           CAST(o_totalprice AS DECIMAL(12,2)) AS total, o_orderpriority AS priority, 'placed_on: skipped' AS notes
    FROM orders""", text=["total"])
def _(spark, sf):
    # a snapshot of an older patch level: another spelling, one column absent
    snapshot = frame(spark, sf, "orders").drop("o_orderdate").withColumnRenamed("o_totalprice", "O_TotalPrice")
    spec, notes = effective_spec(ORDERS_COPY, snapshot.columns, ["orders"])
    said = "; ".join(f"{c}: {n}" for c, n in notes)
    return project_mapped(snapshot, spec).withColumn("notes", F.lit(said))


@query("project_mapped", "SELECT * FROM {tgt_orders}", text=["total", "placed_on"])
def _(spark, sf):
    return project_mapped(frame(spark, sf, "orders"), ORDERS_COPY)


@query("snapshot_union_checked", """
    SELECT v.table_name, v.owner, CAST(v.parts AS BIGINT) AS parts, v.state,
           CASE v.table_name WHEN 'nation' THEN (SELECT count(*) FROM nation) WHEN 'orders' THEN (SELECT count(*) FROM orders)
             WHEN 'part' THEN (SELECT count(*) FROM part) ELSE (SELECT count(*) FROM customer) END AS rows
    FROM (VALUES ('nation', 0, 2, 'duplicate'), ('orders', 0, 1, 'unique'), ('part', 1, 1, 'unique'),
                 ('customer', 0, 2, 'conflict')) v(table_name, owner, parts, state)""")
def _(spark, sf):
    t = given(spark, sf, ["nation", "orders", "part", "customer"])
    first = {"nation": t["nation"], "orders": t["orders"], "customer": t["customer"]}
    second = {"nation": t["nation"].repartition(3), "part": t["part"],
              "customer": t["customer"].withColumn("c_name", F.upper("c_name"))}
    prints = snapshots.part_fingerprints([first, second], scales=SCALES)
    sizes = prints.groupBy("table_name").agg(F.max("rows").alias("rows"))
    return snapshots.overlaps(prints).join(sizes, "table_name")


@query("latest_wins_by_path", """
    WITH parts AS (
      SELECT url AS path, length(html) AS size, 0 AS part FROM pages
      UNION ALL SELECT url, length(html) + 1, 1 FROM pages WHERE url LIKE 'https:%'
      UNION ALL SELECT concat(url, '.new'), length(html), 2 FROM pages WHERE url LIKE '%/en/%'
      UNION ALL SELECT url, 0, 2 FROM pages WHERE url LIKE '%.html')
    SELECT path, max(CAST(size AS INTEGER)) AS size, part AS from_part
    FROM parts p WHERE part = (SELECT max(part) FROM parts q WHERE q.path = p.path) GROUP BY path, part""")
def _(spark, sf):
    p = frame(spark, sf, "pages").select(F.col("url").alias("path"), F.char_length("html").alias("size"))
    p = p.groupBy("path").agg(F.max("size").alias("size"))
    increments = [p, p.where("path LIKE 'https:%'").withColumn("size", F.col("size") + 1),
                  p.where("path LIKE '%/en/%'").withColumn("path", F.concat("path", F.lit(".new"))).unionByName(
                      p.where("path LIKE '%.html'").withColumn("size", F.lit(0)))]
    return snapshots.latest_wins(increments, ["path"])


@query("copy_id_intact", """
    SELECT 'orders' AS table_name, 'copy' AS class, n AS source_rows, n AS target_rows, n AS expected_rows, 'pass' AS state
    FROM (SELECT count(*) AS n FROM orders)""")
def _(spark, sf):
    src = frame(spark, sf, "orders")
    copied = project_mapped(src, ORDERS_COPY)
    return copy_row_parity(src.select(F.col("o_orderkey").alias("orderno")), copied, "orders", ["orderno"])


@query("copy_range_window", """
    WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders)
    SELECT (o_orderkey - lo) // 1000 AS "window", lo - 1 + (o_orderkey - lo) // 1000 * 1000 AS low_exclusive,
           least(lo - 1 + ((o_orderkey - lo) // 1000 + 1) * 1000, hi) AS high_inclusive, count(*) AS rows
    FROM orders, b GROUP BY ALL""")
def _(spark, sf):
    return windows.window_plan(frame(spark, sf, "orders"), "o_orderkey", size=1000)


@query("archive_csv_export", """
    SELECT '"' || page_id || '",' || CASE WHEN url LIKE 'http:%' THEN '' WHEN url LIKE '%#top' THEN '""'
             ELSE '"' || replace(url, '"', '""') || '"' END
           || ',"' || upper(hex(encode(html))) || '"' AS line
    FROM pages""")
def _(spark, sf):
    archive = frame(spark, sf, "pages").select(
        "page_id",
        F.when(F.col("url").like("http:%"), F.lit(None)).when(F.col("url").like("%#top"), "").otherwise(F.col("url")).alias("url"),
        F.col("html").cast("binary").alias("html"))
    return export.csv_lines(archive)


@query("pristine_check", """
    SELECT table_name, class, rows, expected, CASE WHEN tolerated THEN 'tolerated' WHEN class = 'merge' AND rows < expected THEN 'too few'
        WHEN class <> 'merge' AND rows <> expected THEN 'not pristine' ELSE 'pristine' END AS state
    FROM (SELECT 'region' AS table_name, 'copy' AS class, count(*) AS rows, CAST(5 AS BIGINT) AS expected, false AS tolerated FROM region
      UNION ALL SELECT 'nation', 'copy', count(*) - 1, 24, false FROM nation UNION ALL SELECT 'supplier', 'merge', count(*), 10, false FROM supplier
      UNION ALL SELECT 'part', 'merge', count(*), 100000000, false FROM part UNION ALL SELECT 'orders', 'copy', count(*) - 1, 0, false FROM orders
      UNION ALL SELECT 'events', 'copy', count(*), 0, true FROM events)""")
def _(spark, sf):
    counts = None
    for t in ("region", "nation", "supplier", "part", "orders", "events"):
        row = count_frame(frame(spark, sf, t)).select(F.lit(t).alias("table_name"), "rows")
        counts = row if counts is None else counts.unionByName(row)
    expected = spark.sql("""SELECT * FROM VALUES ('region', 'copy', 5L, false, 0), ('nation', 'copy', 24L, false, 1),
        ('supplier', 'merge', 10L, false, 0), ('part', 'merge', 100000000L, false, 0), ('orders', 'copy', 0L, false, 3),
        ('events', 'copy', 0L, true, 0) AS t(table_name, class, expected, tolerated, startup_rows)""")
    return catalog.pristine_check(counts, expected)


@query("seed_replace", """
    SELECT o_orderkey, o_custkey FROM orders o
    WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_orderkey AND c.c_mktsegment = 'BUILDING')""")
def _(spark, sf):
    target, seeds = frames(spark, sf, "orders", "customer")
    seeds = seeds.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_orderkey"))
    return seed_replace(target.select("o_orderkey", "o_custkey"), seeds, ["o_orderkey"])


@query("column_policy_view", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def _(spark, sf):
    return policy.column_policy_view(frame(spark, sf, "customer"), "customer",
                                     hidden={"Customer": ["C_NAME", "c_acctbal"]}, restricted=["events"])


@query("grant_audit", """
    SELECT table_name, column_name, problem FROM (VALUES
      ('customer', 'c_acctbal', 'hidden column'), ('customer', 'c_nationkey', 'not granted'),
      ('events', NULL, 'restricted table'), ('nation', 'n_name', 'only some columns'),
      ('nation', 'n_nationkey', 'not granted'), ('nation', 'n_regionkey', 'not granted'),
      ('part', NULL, 'whole table with hidden columns'), ('ghost', NULL, 'grant on absent table'),
      ('customer', 'c_ghost', 'grant on absent column'), ('labels', 'toxic', 'not in the policy'))
      v(table_name, column_name, problem)
    WHERE EXISTS (SELECT 1 FROM customer)""")
def _(spark, sf):
    names = ["customer", "nation", "part", "events", "orders", "labels"]
    existing = catalog.catalog_profile(given(spark, sf, names)).where("rows > 0").select("table_name", "column_name")
    ruled = existing.where("table_name <> 'labels'")
    rules = ruled.withColumn("rule", F.when(F.col("table_name") == "events", "restricted")
                             .when(F.col("column_name").isin("c_name", "c_acctbal", "p_retailprice"), "hidden")
                             .otherwise("open"))
    grants = spark.sql("""SELECT * FROM VALUES ('Customer', 'c_custkey'), ('customer', 'C_MKTSEGMENT'), ('customer', 'c_acctbal'),
        ('customer', 'c_ghost'), ('events', NULL), ('nation', 'n_name'), ('part', NULL), ('orders', NULL), ('ghost', NULL),
        ('labels', 'toxic') AS t(table_name, column_name)""")
    return policy.grant_audit(rules, grants, existing)


@query("audit_log_triage", """
    WITH ok AS (SELECT line_no, value FROM {log_lines} WHERE NOT starts_with(value, 'broken')),
    parsed AS (SELECT line_no, value::JSON AS j FROM ok)
    SELECT line_no, CAST(j->>'$.transaction.messages[0].details.ruleId' AS VARCHAR) AS rule_id,
           'Matched (value redacted)' AS match,
           split_part(j->>'$.transaction.request.uri', '?', 1) AS uri,
           j->>'$.transaction.messages[0].message' AS message FROM parsed
    UNION ALL
    SELECT line_no, '?', 'plain',
           split_part(j->>'$.transaction.request.uri', '?', 1), 'second' FROM parsed""")
def _(spark, sf):
    return audit_log.triage(frame(spark, sf, "log_lines"))

