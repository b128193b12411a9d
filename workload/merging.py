"""Copy, merge and id maps: families E and G."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.functions.text import fold
from carryover.operators import archive as A
from carryover.operators import merge as M
from carryover.session import materialise
from carryover.spec import TableSpec, ColumnInfo, with_archived
from workload.registry import query
from workload.roles import frame, frames
from workload.specs import ORDERS_MERGE

# the merge, spelled for the check: decisions, appended rows with fresh ids, the live table
MERGED = """
    judged AS (SELECT s.*, EXISTS (SELECT 1 FROM {seed_orders} d WHERE d.cust_no = s.cust_no
        AND d.priority IS NOT DISTINCT FROM s.priority) AS seeded, s.total < 20000 AS excluded FROM {st_orders} s),
    added AS (SELECT (SELECT max(order_no) FROM {seed_orders}) + row_number() OVER (ORDER BY order_no) AS new_no, *
        FROM judged WHERE NOT seeded AND NOT excluded),
    live AS (SELECT order_no, cust_no, priority, total, placed_at, import_archived_legacy_status FROM {seed_orders}
        UNION ALL SELECT new_no, cust_no, priority, total, placed_at, legacy_status FROM added)"""
IDMAP = MERGED + """,
    s AS (SELECT order_no, cust_no, priority, row_number() OVER (PARTITION BY cust_no, priority ORDER BY order_no) AS n FROM {st_orders}),
    d AS (SELECT order_no, cust_no, priority, row_number() OVER (PARTITION BY cust_no, priority ORDER BY order_no) AS n FROM live),
    idmap AS (SELECT s.order_no AS old_id, coalesce(d.order_no, f.order_no) AS new_id FROM s
      LEFT JOIN d ON d.cust_no = s.cust_no AND d.priority IS NOT DISTINCT FROM s.priority AND d.n = s.n
      LEFT JOIN d f ON f.cust_no = s.cust_no AND f.priority IS NOT DISTINCT FROM s.priority AND f.n = 1
      WHERE coalesce(d.order_no, f.order_no) IS NOT NULL)"""
SEED_TOTAL = "import_archived_legacy_status"


def merged(spark, sf):
    src, seed = frames(spark, sf, "st_orders", "seed_orders")
    live, added, judged = M.merge_seed_wins(src, seed, ORDERS_MERGE)
    return src, seed, live, added, judged


def written_merge(spark, sf):
    """(source, seed, live, id map) with the merge written down first, as a run does it."""
    src, seed, live, _, _ = merged(spark, sf)
    live = materialise(live, "merged")
    return src, seed, live, M.idmap_twins(src, live, ORDERS_MERGE)


def idmap(spark, sf):
    return written_merge(spark, sf)[3]


@query("merge_seed_wins", f"WITH {MERGED} SELECT * FROM live", text=["total"], micros=["placed_at"])
def _(spark, sf):
    return merged(spark, sf)[2]


@query("merge_overridden", f"""
    WITH {MERGED} SELECT count(*) FILTER (seeded AND NOT excluded) AS beaten, count(*) FILTER (excluded) AS excluded,
        count(*) FILTER (seeded OR excluded) AS overridden, count(*) FILTER (NOT seeded AND NOT excluded) AS appended FROM judged""")
def _(spark, sf):
    return M.merge_overridden(merged(spark, sf)[4])


@query("surrogate_assign", f"WITH {MERGED} SELECT order_no AS old_id, new_no AS new_id FROM added")
def _(spark, sf):
    return merged(spark, sf)[3].select(F.col("_old_id").alias("old_id"), F.col("order_no").alias("new_id"))


@query("idmap_twins", f"WITH {IDMAP} SELECT * FROM idmap")
def _(spark, sf):
    return idmap(spark, sf)


@query("fk_remap", f"""
    WITH {IDMAP} SELECT l_orderkey AS old_ref, l_linenumber, l_partkey, l_suppkey, m.new_id AS nullable_ref,
        coalesce(m.new_id, l_orderkey) AS strict_ref FROM lineitem LEFT JOIN idmap m ON m.old_id = l_orderkey""")
def _(spark, sf):
    lines = frame(spark, sf, "lineitem").select(F.col("l_orderkey").alias("old_ref"), "l_linenumber", "l_partkey", "l_suppkey",
                                                F.col("l_orderkey").alias("nullable_ref"))
    out = M.fk_remap(lines, idmap(spark, sf), "nullable_ref", True, ["l_partkey", "l_suppkey"])
    return out.withColumn("strict_ref", F.coalesce("nullable_ref", "old_ref"))


@query("idmap_changed", f"WITH {IDMAP} SELECT * FROM idmap WHERE old_id <> new_id")
def _(spark, sf):
    return M.idmap_changed(idmap(spark, sf))


@query("preseed_split", f"""
    WITH {MERGED} SELECT order_no, 'seed' AS origin FROM {{seed_orders}} UNION ALL SELECT new_no, 'appended' FROM added""")
def _(spark, sf):
    _, seed, live, _, _ = merged(spark, sf)
    return M.preseed_split(live.select("order_no"), seed, ["order_no"])


@query("archived_backfill", f"""
    WITH {MERGED},
    best AS (SELECT cust_no, priority, legacy_status FROM (SELECT *, row_number() OVER (PARTITION BY cust_no, priority
        ORDER BY legacy_status IS NULL, legacy_status) AS n FROM {{st_orders}} WHERE NOT (total < 20000)) WHERE n = 1)
    SELECT l.order_no, CASE WHEN p.order_no IS NOT NULL THEN b.legacy_status ELSE l.{SEED_TOTAL} END AS {SEED_TOTAL}
    FROM live l LEFT JOIN {{seed_orders}} p USING (order_no)
    LEFT JOIN best b ON b.cust_no = l.cust_no AND b.priority IS NOT DISTINCT FROM l.priority""")
def _(spark, sf):
    src, seed, live, _, _ = merged(spark, sf)
    return M.archived_backfill(live, seed, src, ORDERS_MERGE, ["order_no"]).select("order_no", SEED_TOTAL)


@query("insert_if_absent", """
    WITH w AS (SELECT s_suppkey, s_name AS name FROM supplier UNION ALL
               SELECT 1000000 + n_nationkey, CASE WHEN n_regionkey < 2 THEN 'SUPPLIER#00000000' || n_regionkey || '  ' ELSE n_name END FROM nation),
    lost AS (SELECT * FROM w WHERE lower(rtrim(name, ' ')) NOT IN (SELECT lower(rtrim(s_name, ' ')) FROM supplier))
    SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY s_suppkey) AS id, name FROM lost""")
def _(spark, sf):
    suppliers, nations = frames(spark, sf, "supplier", "nation")
    have = suppliers.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    wanted = have.select(F.col("id").alias("seed_order"), "name").unionByName(nations.select(
        (F.lit(1000000).cast("bigint") + F.col("n_nationkey")).alias("seed_order"),
        F.when(F.col("n_regionkey") < 2, F.concat(F.lit("SUPPLIER#00000000"), F.col("n_regionkey"), F.lit("  ")))
        .otherwise(F.col("n_name")).alias("name")))
    return M.insert_if_absent(have, wanted, "name", "id", "seed_order", fold).select("id", "name")


@query("default_link", """
    SELECT c_custkey AS entity, (SELECT min(s_suppkey) FROM supplier WHERE s_acctbal > 5000) AS parent
    FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def _(spark, sf):
    c, o, s = frames(spark, sf, "customer", "orders", "supplier")
    links = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("entity"))
    return M.default_link(c.select(F.col("c_custkey").alias("entity")), links, s.withColumnRenamed("s_suppkey", "parent"),
                          "entity", "parent", F.col("s_acctbal") > 5000)


@query("synthesise_membership", """
    WITH outside AS (SELECT c_custkey AS entity FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)),
    activity AS (SELECT DISTINCT o_custkey AS entity, CAST(year(o_orderdate) AS BIGINT) AS parent FROM orders),
    parents AS (SELECT entity, CAST(1 AS BIGINT) AS parent FROM outside UNION SELECT a.* FROM activity a JOIN outside USING (entity)),
    roles AS (SELECT n_nationkey AS role_id, n_name AS role_name,
        (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS grants FROM nation),
    held AS (SELECT o_custkey AS entity, CAST(o_orderkey % 25 AS INTEGER) AS role_id FROM orders WHERE o_orderpriority = '5-LOW'),
    best AS (SELECT entity, role_id FROM (SELECT entity, r.role_id, row_number() OVER (PARTITION BY entity
        ORDER BY role_name = 'NATION_3' DESC, grants DESC, r.role_id) AS n FROM held JOIN roles r USING (role_id)) WHERE n = 1),
    least AS (SELECT role_id FROM roles ORDER BY grants, role_id LIMIT 1)
    SELECT p.entity, p.parent, coalesce(b.role_id, (SELECT role_id FROM least)) AS role_id,
           CASE WHEN b.role_id IS NULL THEN 'least privileged' ELSE 'own role' END AS source
    FROM parents p LEFT JOIN best b USING (entity)""")
def _(spark, sf):
    c, o, n, s = frames(spark, sf, "customer", "orders", "nation", "supplier")
    grants = s.groupBy(F.col("s_nationkey").alias("role_id")).agg(F.count(F.lit(1)).alias("grants"))
    roles = (n.select(F.col("n_nationkey").alias("role_id"), F.col("n_name").alias("role_name")).join(grants, "role_id", "left")
             .withColumn("grants", F.coalesce("grants", F.lit(0))))
    entity = F.col("o_custkey").alias("entity")
    return M.synthesise_membership(
        c.select(F.col("c_custkey").alias("entity")), o.where("o_totalprice > 300000").select(entity),
        o.select(entity, F.year("o_orderdate").cast("bigint").alias("parent")), roles, entity="entity", parent="parent",
        fixed_parent=1, preferred="NATION_3",
        held=o.where("o_orderpriority = '5-LOW'").select(entity, (F.col("o_orderkey") % 25).cast("int").alias("role_id")))


@query("conditional_activate", """
    SELECT id, CASE WHEN optout IS NULL AND a AND b AND coalesce(kind, '') <> 'signup' THEN 1 ELSE optout END AS optout,
      CASE WHEN optout IS NOT NULL THEN 'kept' WHEN NOT (a AND b) THEN 'owner not live' WHEN kind = 'signup' THEN 'reserved'
           ELSE 'activated' END AS outcome
    FROM (SELECT *, coalesce(person IN (SELECT c_custkey FROM customer WHERE c_acctbal > 1000), false) AS a,
                 coalesce(person IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000), false) AS b FROM {st_decisions})""")
def _(spark, sf):
    d, c, o = frames(spark, sf, "st_decisions", "customer", "orders")
    out = M.conditional_activate(
        d, c.where("c_acctbal > 1000").select(F.col("c_custkey").alias("person")),
        o.where("o_totalprice > 250000").select(F.col("o_custkey").alias("person")), "person", "optout",
        F.col("kind") == "signup", ["id"])
    return out.select("id", "optout", "outcome")


@query("spelling_canonicalise", """
    SELECT o_orderkey, coalesce(c.name, spelled) AS grp, coalesce(c.name <> spelled, false) AS drifted
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN lower(c_mktsegment) WHEN o_orderstatus = 'O' THEN c_mktsegment || ' '
            WHEN o_totalprice > 300000 THEN ' ' || c_mktsegment ELSE c_mktsegment END AS spelled
          FROM orders JOIN customer ON o_custkey = c_custkey) o
    LEFT JOIN (SELECT DISTINCT c_mktsegment AS name FROM customer) c ON lower(c.name) = lower(rtrim(spelled, ' '))""")
def _(spark, sf):
    o, c = frames(spark, sf, "orders", "customer")
    segment = F.col("c_mktsegment")
    spelled = (F.when(F.col("o_orderstatus") == "F", F.lower(segment)).when(F.col("o_orderstatus") == "O", F.concat(segment, F.lit(" ")))
               .when(F.col("o_totalprice") > 300000, F.concat(F.lit(" "), segment)).otherwise(segment))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", spelled.alias("grp"))
    return M.spelling_canonicalise(rows, c.select("c_mktsegment"), "grp", "c_mktsegment", fold, ["o_orderkey"])


@query("prune_with_archive", """
    WITH doomed AS (SELECT * FROM {st_settings} WHERE starts_with(name, 'fax_') OR name = 'docRoot'),
    before AS (SELECT id, name FROM {st_settings} WHERE starts_with(name, 'fax_1'))
    SELECT 'live' AS place, id, name FROM {st_settings} WHERE NOT (starts_with(name, 'fax_') OR name = 'docRoot')
    UNION ALL SELECT 'archive', id, name FROM before
    UNION ALL SELECT 'archive', id, name FROM doomed WHERE id NOT IN (SELECT id FROM before)""")
def _(spark, sf):
    live = frame(spark, sf, "st_settings").select("id", "name")
    kept, archive = M.prune_with_archive(live, live.where(F.col("name").startswith("fax_1")),
                                         F.col("name").startswith("fax_") | (F.col("name") == "docRoot"), ["id"])
    return kept.select(F.lit("live").alias("place"), "*").unionByName(archive.select(F.lit("archive").alias("place"), "*"))


@query("unambiguous_restore", """
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_returnflag END AS flag,
        CASE WHEN l_returnflag = 'A' OR l_linestatus = 'O' THEN NULL ELSE l_linestatus END AS status FROM lineitem),
    single AS (SELECT s_nationkey, any_value(s_name) AS name, any_value(s_acctbal) AS bal FROM supplier GROUP BY 1 HAVING count(*) = 1),
    c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal > 3000 THEN NULL ELSE c_name END AS name,
          CASE WHEN c_acctbal > 5000 THEN NULL ELSE c_acctbal END AS bal FROM customer)
    SELECT c_custkey, CASE WHEN c.name IS NULL AND c.bal IS NULL AND s.name IS NOT NULL THEN s.name ELSE c.name END AS name,
           CAST(CASE WHEN c.name IS NULL AND c.bal IS NULL AND s.name IS NOT NULL THEN s.bal ELSE c.bal END AS DECIMAL(12,2)) AS bal,
           c.name IS NULL AND c.bal IS NULL AND s.name IS NOT NULL AS restored
    FROM c LEFT JOIN single s ON s.s_nationkey = c.c_nationkey""", text=["bal"])
def _(spark, sf):
    c, s = frames(spark, sf, "customer", "supplier")
    rows = c.select("c_custkey", F.col("c_nationkey").alias("nation"), F.when(F.col("c_acctbal") <= 3000, F.col("c_name")).alias("name"),
                    F.when(F.col("c_acctbal") <= 5000, F.col("c_acctbal").cast("decimal(12,2)")).alias("bal"))
    live = s.select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"),
                    F.col("s_acctbal").cast("decimal(12,2)").alias("bal"))
    return M.unambiguous_restore(rows, live, "nation", ["name", "bal"], ["c_custkey"]).drop("nation")


@query("missing_from_seed", "SELECT c_custkey, c_name, CAST(NULL AS INTEGER) AS c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer")
def _(spark, sf):
    c = frame(spark, sf, "customer")
    return M.adopt_columns(c.select("c_custkey", "c_name"), c.drop("c_mktsegment"))


ARCHIVED = TableSpec("orders", columns={"o_orderkey": ColumnInfo("bigint"), "o_custkey": ColumnInfo("bigint")}, chunk_by="o_orderkey",
                     dropped={"o_orderpriority": lambda: F.col("o_orderpriority") != "5-LOW",
                              "o_orderstatus": lambda: F.col("o_orderstatus") == "P"})


@query("preserve_table", """
    SELECT v.t AS table_name, v.c AS "class", n.rows, w.home, NOT (v.c IS NULL AND n.rows = 0) AS copied
    FROM (VALUES ('region', 'reference'), ('nation', 'drop'), ('supplier', 'archive'), ('customer', 'merge'), ('orders', 'copy'),
                 ('labels', NULL), ('none', NULL)) v(t, c)
    JOIN (SELECT 'region' AS t, count(*) AS rows FROM region UNION ALL SELECT 'nation', count(*) FROM nation
      UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'customer', count(*) FROM customer
      UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'none', 0) n USING (t)
    JOIN (VALUES ('archive', 'archive'), ('archive', 'live'), ('drop', 'archive'), ('drop', 'live'), ('reference', 'archive'),
                 ('merge', 'archive'), ('?', 'archive'), ('?', 'live')) w(c, home) ON w.c = coalesce(v.c, '?')""")
def _(spark, sf):
    tables = None
    for name, cls in (("region", "reference"), ("nation", "drop"), ("supplier", "archive"), ("customer", "merge"),
                      ("orders", "copy"), ("labels", None), ("none", None)):
        df = frame(spark, sf, "labels").where("doc_id < 0") if name == "none" else frame(spark, sf, name)
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"),
                                                             F.lit(cls).cast("string").alias("class"), "rows")
        tables = row if tables is None else tables.unionByName(row)
    return A.preserve_plan(tables)


@query("dropped_shadow", """
    SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderpriority <> '5-LOW' OR o_orderstatus = 'P'""")
def _(spark, sf):
    return A.dropped_shadow(frame(spark, sf, "orders"), ARCHIVED)


@query("unknown_shadow", """
    SELECT order_no, placed_at, legacy_status FROM (SELECT order_no, CASE WHEN legacy_status = 'O' THEN placed_at END AS placed_at, legacy_status
      FROM {st_orders}) WHERE placed_at IS NOT NULL OR legacy_status IS NOT NULL""", micros=["placed_at"])
def _(spark, sf):
    spec = TableSpec("orders", columns={"order_no": ColumnInfo("bigint"), "cust_no": ColumnInfo("bigint"),
                                        "priority": ColumnInfo("varchar"), "total": ColumnInfo("decimal", precision=12, scale=2)},
                     chunk_by="order_no")
    src = frame(spark, sf, "st_orders").withColumn("placed_at", F.when(F.col("legacy_status") == "O", F.col("placed_at")))
    return A.unknown_shadow(src, spec)


@query("archived_column_plan", """
    SELECT o_orderkey, o_custkey, o_orderdate AS import_archived_o_orderdate, o_orderpriority AS import_archived_o_orderpriority,
           o_orderstatus AS import_archived_o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)) AS import_archived_o_totalprice FROM orders""", text=["import_archived_o_totalprice"], micros=["import_archived_o_orderdate"])
def _(spark, sf):
    src = frame(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(12,2)"))
    return M.project_mapped(src, with_archived(ARCHIVED, src))
