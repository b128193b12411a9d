"""Set similarity and access matrices: family I."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.operators import access as A
from workload.registry import ORACLES, query
from workload.roles import frame, frames, written_once

IS_GROUP = "NOT regexp_matches({0}, '(?i)^(-?[0-9]+|_all|_queue\\..*)$')"
PAIRS = f"""
    mine AS (SELECT DISTINCT lower(rtrim(grp, ' ')) AS g, lower(rtrim(object, ' ')) AS o, trim(privilege) AS p FROM {{staged_matrix}}
        WHERE {IS_GROUP.format('grp')}),
    theirs AS (SELECT DISTINCT lower(rtrim(grp, ' ')) AS g, lower(rtrim(object, ' ')) AS o, trim(privilege) AS p FROM {{seed_matrix}}),
    size_m AS (SELECT g, count(*) AS n FROM mine GROUP BY 1), size_t AS (SELECT g, count(*) AS n FROM theirs GROUP BY 1),
    scored AS (SELECT m.g AS custom, t.g AS template, count(*) AS shared, any_value(a.n) + any_value(b.n) - count(*) AS u
        FROM mine m JOIN theirs t USING (o, p) JOIN size_m a ON a.g = m.g JOIN size_t b ON b.g = t.g GROUP BY 1, 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY custom ORDER BY shared / u DESC, template) AS n FROM scored)"""
FLOOR = 0.05


def matrix(spark, sf, name):
    """An access matrix, written down because a query reads it several times.

    Both matrices come from different grants by best, least and different values, so the join of
    the large tables runs once and what is read again are its different rows.
    """
    written_once(spark, sf, "grants_all", ("seg", "reg", "object", "ptype", "flag", "qty"))
    return written_once(spark, sf, name)


def matrices(spark, sf):
    staged, seed = (matrix(spark, sf, n) for n in ("staged_matrix", "seed_matrix"))
    return staged.where(A.is_group(F.col("grp"))), seed


@query("jaccard_template", f"""
    WITH {PAIRS} SELECT s.g AS custom, CASE WHEN s.g = 'building 0' THEN 'machinery' WHEN shared / u >= CASE WHEN template = 'furniture' THEN 0.5
        ELSE {FLOOR} END THEN template END AS template, coalesce(shared, 0) AS shared, coalesce(u, 0) AS "union"
    FROM size_m s LEFT JOIN best b ON b.custom = s.g AND b.n = 1""")
def templates(spark, sf):
    custom, stock = matrices(spark, sf)
    return A.jaccard_template(custom, stock, FLOOR, guarded=["FURNITURE"], override={"building 0": "MACHINERY"})


@query("jaccard_template_pruned", ORACLES["jaccard_template"])
def _(spark, sf):
    custom, stock = matrices(spark, sf)
    best, _ = A.closest_templates(custom, stock)
    return A.jaccard_template(custom, stock, FLOOR, guarded=["FURNITURE"], override={"building 0": "MACHINERY"}, best=best)


@query("era_objects", """
    SELECT DISTINCT object FROM {seed_matrix} WHERE lower(object) NOT IN (SELECT lower(object) FROM {staged_matrix})
        AND lower(object) NOT IN (SELECT lower('ERA.' || p_brand) FROM part WHERE p_brand LIKE 'Brand#1%')""")
def eras(spark, sf):
    staged, seed = (matrix(spark, sf, n) for n in ("staged_matrix", "seed_matrix"))
    part = frame(spark, sf, "part")
    catalogue = part.where("p_brand LIKE 'Brand#1%'").select(F.concat(F.lit("ERA."), F.col("p_brand")).alias("object"))
    return A.era_objects(seed, catalogue, staged)


CUSTOM = f"""
    named AS (SELECT grp, CASE WHEN NOT ({IS_GROUP.format('grp')}) THEN 'not a group'
        WHEN lower(grp) IN (SELECT lower(grp) FROM {{staged_matrix}} WHERE {IS_GROUP.format('grp')})
         AND lower(grp) NOT IN (SELECT lower(grp) FROM {{stock_groups}}) THEN 'custom' END AS state FROM {{target_groups}})"""


def target_groups(spark, sf):
    return matrix(spark, sf, "staged_matrix").select("grp").union(matrix(spark, sf, "seed_matrix").select("grp")).distinct()


@query("custom_groups", f"WITH {CUSTOM} SELECT * FROM named WHERE state IS NOT NULL")
def customs(spark, sf):
    staged, stock = matrix(spark, sf, "staged_matrix"), frame(spark, sf, "stock_groups")
    return A.custom_groups(target_groups(spark, sf), staged, stock)


BACKFILL = f"""{PAIRS}, chosen AS (SELECT s.g AS custom, CASE WHEN s.g = 'building 0' THEN 'machinery'
        WHEN shared / u >= CASE WHEN template = 'furniture' THEN 0.5 ELSE {FLOOR} END THEN template END AS template
        FROM size_m s LEFT JOIN best b ON b.custom = s.g AND b.n = 1),
    era AS (SELECT DISTINCT object FROM {{seed_matrix}} WHERE lower(object) NOT IN (SELECT lower(object) FROM {{staged_matrix}})
        AND lower(object) NOT IN (SELECT lower('ERA.' || p_brand) FROM part WHERE p_brand LIKE 'Brand#1%')),
    added AS (SELECT custom AS grp, d.object, min(d.privilege) AS privilege FROM chosen JOIN {{seed_matrix}} d ON lower(d.grp) = template
        WHERE d.object IN (SELECT object FROM era) AND NOT EXISTS (SELECT 1 FROM {{staged_matrix}} s WHERE lower(s.grp) = custom AND lower(s.object) = lower(d.object))
        GROUP BY 1, 2)"""


@query("grant_backfill", f"WITH {BACKFILL} SELECT * FROM added")
def backfill(spark, sf):
    staged, seed = (matrix(spark, sf, n) for n in ("staged_matrix", "seed_matrix"))
    return A.grant_backfill(staged, templates(spark, sf), seed, eras(spark, sf))


@query("matrix_diff", f"""
    WITH {CUSTOM}, s AS (SELECT grp, object, min(privilege) AS privilege, bool_or(object LIKE 'Brand#9.%') AS excl FROM {{staged_matrix}} GROUP BY 1, 2),
    d AS (SELECT grp, object, min(privilege) AS privilege FROM {{seed_matrix}} GROUP BY 1, 2),
    t AS (SELECT grp, object FROM s UNION SELECT grp, object FROM d UNION SELECT grp, 'new.object' FROM named WHERE state = 'custom'),
    g AS (SELECT grp FROM {{staged_matrix}} GROUP BY 1), stock AS (SELECT 'MACHINERY 1' AS grp UNION SELECT 'FURNITURE 1'),
    cells AS (SELECT grp, object, s.privilege AS sp, d.privilege AS dp, t.object IS NOT NULL AS in_t, coalesce(excl, false) AS excl,
        grp IN (SELECT grp FROM g) AS in_src, grp IN (SELECT grp FROM {{target_groups}}) AS in_tgt, grp IN (SELECT grp FROM stock) AS is_stock,
        grp IN (SELECT grp FROM named WHERE state = 'custom') AS is_custom
      FROM s FULL JOIN d USING (grp, object) FULL JOIN t USING (grp, object))
    SELECT grp, object, 'overridden' AS change FROM cells WHERE sp <> dp UNION ALL SELECT grp, object, 'excluded' FROM cells WHERE excl
    UNION ALL SELECT grp, object, 'restored' FROM cells WHERE dp IS NOT NULL AND sp IS NULL AND in_src
    UNION ALL SELECT grp, object, 'appended-role' FROM cells WHERE dp IS NOT NULL AND sp IS NULL AND NOT in_src AND in_tgt
    UNION ALL SELECT grp, object, 'backfilled' FROM cells WHERE in_t AND sp IS NULL AND is_custom
    UNION ALL SELECT grp, object, 'stock-append' FROM cells WHERE sp IS NOT NULL AND dp IS NULL AND is_stock AND NOT excl""")
def _(spark, sf):
    staged, seed = (matrix(spark, sf, n) for n in ("staged_matrix", "seed_matrix"))
    groups = target_groups(spark, sf)
    custom = customs(spark, sf).where("state = 'custom'").select("grp")
    target = staged.unionByName(seed).unionByName(custom.select("grp", F.lit("new.object").alias("object"), F.lit("x").alias("privilege")))
    stock = spark.sql("SELECT explode(array('MACHINERY 1', 'FURNITURE 1')) AS grp")
    return A.matrix_diff(staged, seed, target, source_groups=staged, target_groups=groups, stock=stock,
                         excluded=F.col("object").like("Brand#9.%"), custom=custom)


@query("matrix_integrity", """
    WITH members AS (SELECT o_custkey AS member, CASE WHEN o_orderstatus = 'F' THEN lower(c_mktsegment) WHEN o_totalprice > 400000 THEN 'ghost, group'
            ELSE c_mktsegment END AS grp, CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END AS active FROM orders JOIN customer ON o_custkey = c_custkey),
    groups AS (SELECT DISTINCT grp FROM members UNION SELECT 'empty'), grants AS (SELECT DISTINCT grp FROM {seed_matrix}),
    active AS (SELECT * FROM members WHERE active = 1)
    SELECT 'guaranteed group missing' AS check_name, 'blocker' AS severity, CAST(1 AS BIGINT) AS rows
    UNION ALL SELECT 'active member without a grant', 'blocker', (SELECT count(DISTINCT member) FROM active WHERE member NOT IN
        (SELECT member FROM active WHERE grp IN (SELECT grp FROM grants)))
    UNION ALL SELECT 'active member not linked', 'blocker', (SELECT count(DISTINCT member) FROM active WHERE member NOT IN
        (SELECT c_custkey FROM customer WHERE c_nationkey < 20))
    UNION ALL SELECT 'grants below the seed floor', 'blocker', greatest(1000000 - (SELECT count(*) FROM {seed_matrix}), 0)
    UNION ALL SELECT 'member group spelled differently', 'blocker', (SELECT count(*) FROM active a JOIN grants g ON lower(a.grp) = lower(g.grp) WHERE a.grp <> g.grp)
    UNION ALL SELECT 'group granting nothing', 'advisory', (SELECT count(*) FROM groups WHERE grp NOT IN (SELECT grp FROM grants))
    UNION ALL SELECT 'comma in a group name', 'advisory', (SELECT count(*) FROM groups WHERE grp LIKE '%,%')""")
def _(spark, sf):
    orders, customers = frames(spark, sf, "orders", "customer")
    grants = matrix(spark, sf, "seed_matrix")
    grp = (F.when(F.col("o_orderstatus") == "F", F.lower("c_mktsegment")).when(F.col("o_totalprice") > 400000, "ghost, group")
           .otherwise(F.col("c_mktsegment")))
    members = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("member"), grp.alias("grp"), F.when(F.col("o_orderpriority") == "5-LOW", 0).otherwise(1).alias("active"))
    groups = members.select("grp").distinct().unionByName(spark.sql("SELECT 'empty' AS grp"))
    return A.matrix_integrity(groups, grants, members, customers.where("c_nationkey < 20").select(F.col("c_custkey").alias("member")),
                              guaranteed=["BUILDING", "Nobody"], floor=1000000)
