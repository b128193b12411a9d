"""Ranking, dedup and allocation: family F."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.operators import ranking as R
from workload.registry import query
from workload.roles import frame, frames

DECISION = dict(pk="id", key=["person", "kind"], deleted="deleted", optout="optout", explicit="explicit", edited="edited")
LIVE = """
    k AS (SELECT *, deleted IS NOT DISTINCT FROM 0 AND optout IS NOT NULL AS live,
        deleted IS NULL OR optout IS NULL OR explicit IS NULL AS nf FROM {st_decisions}),
    r AS (SELECT *, row_number() OVER (PARTITION BY live, person, kind ORDER BY optout DESC, coalesce(explicit, 0) DESC,
        edited IS NULL, edited DESC, id DESC) AS rn FROM k),
    helper AS (SELECT id, person, kind, live, nf, live AND person IS NOT NULL AND kind IS NOT NULL AND rn > 1 AS surplus,
        explicit, optout, deleted FROM r),
    stored AS (SELECT id, person, kind, CASE WHEN NOT live OR surplus THEN 1 ELSE 0 END AS deleted, coalesce(optout, 1) AS optout,
        coalesce(explicit, 0) AS explicit, explicit AS prior_explicit, optout AS prior_optout, deleted AS prior_deleted,
        CASE WHEN nf AND surplus THEN 'null_flag,duplicate_retired' WHEN nf THEN 'null_flag' WHEN surplus THEN 'duplicate_retired' END AS reason
        FROM helper)"""


@query("one_live_per_key", f"WITH {LIVE} SELECT * FROM stored")
def _(spark, sf):
    return R.one_live_per_key(frame(spark, sf, "st_decisions"), **DECISION)


@query("live_key_coverage", f"""
    WITH {LIVE}, s AS (SELECT s.id, s.deleted AS sd, s.optout AS so, h.deleted AS hd, h.reason
        FROM {{st_decisions}} s JOIN stored h USING (id) WHERE s.kind IS DISTINCT FROM 'signup')
    SELECT (SELECT count(*) FROM {{st_decisions}} WHERE kind = 'signup') AS missing, CAST(0 AS BIGINT) AS extra,
      count(*) FILTER (hd = 1 AND sd = 0 AND so IS NOT NULL) AS duplicate,
      (SELECT count(*) FROM {{st_decisions}} WHERE deleted = 0 AND optout IS NULL) AS undecided,
      count(*) FILTER (reason IS NOT NULL) AS changed,
      (SELECT count(*) FROM {{st_decisions}} WHERE deleted IS NULL) AS null_deleted,
      (SELECT count(*) FROM {{st_decisions}} WHERE deleted <> 0) AS legacy_deleted, CAST(0 AS BIGINT) AS duplicate_live_keys
    FROM s""")
def _(spark, sf):
    src = frame(spark, sf, "st_decisions")
    helper = R.one_live_per_key(src, **DECISION).where("kind IS NULL OR kind <> 'signup'")
    return R.live_key_coverage(src, helper, pk="id", key=["person", "kind"], deleted="deleted", optout="optout")


RANKED = """SELECT *, row_number() OVER (PARTITION BY filename ORDER BY created IS NULL, created, id) AS rn FROM {st_files}"""


@query("disambiguate_duplicates", f"""
    WITH r AS (SELECT *, '-' || coalesce(CAST(year(created) AS VARCHAR), 'x') || '-' || id AS tag FROM ({RANKED}))
    SELECT id, CASE WHEN rn > 1 THEN substr(filename, 1, greatest(0, 14 - length(tag))) || tag ELSE filename END AS filename,
           CASE WHEN rn > 1 THEN filename END AS original FROM r""")
def _(spark, sf):
    live, originals, _ = R.disambiguate(frame(spark, sf, "st_files"), "filename", pk="id", order="created",
                                        year=F.year("created"), width=14)
    return live.join(originals.select("id", F.col("original_value").alias("original")), "id", "left").select(
        "id", "filename", "original")


PREFIX = "import"
NAMES = """
    names AS (SELECT 'disks' AS source_table, id AS row_id, name AS original_name, lower(rtrim(name, ' ')) AS folded,
        coalesce(CAST(made AS VARCHAR), 'x') AS year_tag FROM {st_disks}
      UNION ALL SELECT 'claims', id, name, lower(rtrim(name, ' ')), 'x' FROM {st_claims}),
    sized AS (SELECT n.*, count(*) OVER (PARTITION BY folded) AS group_size FROM names n),
    tries AS (SELECT s.*, t.nonce, 'import-' || source_table || '-' || year_tag || '-' || row_id || '-' || t.nonce AS candidate
        FROM sized s, (SELECT unnest(range(0, 20)) AS nonce) t WHERE group_size > 1),
    free AS (SELECT * FROM tries WHERE lower(candidate) NOT IN (SELECT folded FROM names WHERE folded IS NOT NULL)),
    mapping AS (SELECT source_table, row_id, original_name, candidate AS new_name, group_size, year_tag, nonce, 'collision' AS reason
        FROM free f WHERE nonce = (SELECT min(nonce) FROM free g WHERE g.source_table = f.source_table AND g.row_id = f.row_id)
      UNION ALL SELECT source_table, row_id, original_name, original_name, group_size, year_tag, 0, 'unchanged' FROM sized WHERE group_size = 1)"""


def names(spark, sf):
    disks, claims = frames(spark, sf, "st_disks", "st_claims")
    return R.namespace({"disks": (disks, "id", "name", F.col("made")), "claims": (claims, "id", "name", None)})


@query("allocate_unique_names", f"WITH {NAMES} SELECT * FROM mapping")
def _(spark, sf):
    return R.allocate_names(names(spark, sf), PREFIX)


@query("mapping_recheck", f"""
    WITH {NAMES} SELECT claim, rows FROM (
      SELECT 'missing_or_changed' AS claim, count(*) FILTER (source_table = 'claims') + count(*) FILTER (source_table = 'disks' AND reason = 'unchanged'
          AND original_name LIKE 'red%') AS rows FROM mapping
      UNION ALL SELECT 'extra', count(*) FROM {{st_claims}}
      UNION ALL SELECT 'policy', count(*) FILTER (source_table = 'disks' AND reason = 'unchanged' AND original_name LIKE 'red%')
          + count(*) FILTER (source_table = 'claims') FROM mapping
      UNION ALL SELECT 'collision', 0 UNION ALL SELECT 'not_unique', 0)""")
def _(spark, sf):
    n = names(spark, sf)
    mapping = R.allocate_names(n, PREFIX)
    moved = F.col("source_table") == "claims"
    tampered = (mapping.withColumn("row_id", F.when(moved, F.col("row_id") + 5000000).otherwise(F.col("row_id")))
                .withColumn("new_name", F.when(moved, F.concat("new_name", F.lit("~"))).otherwise(F.col("new_name")))
                .withColumn("original_name", F.when((F.col("reason") == "unchanged") & ~moved & F.col("original_name").like("red%"),
                                                    F.upper("original_name")).otherwise(F.col("original_name"))))
    return R.mapping_recheck(n, tampered, PREFIX)


def _retained(latest: bool) -> str:
    older = "older" if latest else "several-rows"
    return f"""
    WITH {NAMES}, f AS (SELECT DISTINCT name FROM {{disk_files}}),
    b AS (SELECT n.*, f.name IS NOT NULL AS there FROM names n LEFT JOIN f ON f.name = n.original_name),
    g AS (SELECT original_name, count(DISTINCT source_table) AS tables, count(*) AS refs, max(row_id) AS latest, min(source_table) AS t,
        min(folded) AS folded FROM b WHERE there GROUP BY 1),
    u AS (SELECT * FROM g WHERE tables = 1 AND (refs = 1 OR {str(latest).lower()})),
    v AS (SELECT t, folded, count(*) AS rivals FROM u GROUP BY 1, 2)
    SELECT b.source_table, b.row_id, b.original_name, CASE WHEN NOT there THEN 'no-file'
      WHEN g.tables > 1 THEN 'several-tables'
      WHEN g.refs > 1 AND ({str(not latest).lower()} OR b.row_id <> g.latest) THEN '{older}'
      WHEN v.rivals > 1 THEN 'name-clash' ELSE 'retained' END AS status
    FROM b LEFT JOIN g USING (original_name) LEFT JOIN v ON v.t = g.t AND v.folded = g.folded"""


@query("retained_generations", _retained(True))
def _(spark, sf):
    return R.retained_generations(names(spark, sf), frame(spark, sf, "disk_files"), latest=True)


@query("retained_generations_strict", _retained(False))
def _(spark, sf):
    return R.retained_generations(names(spark, sf), frame(spark, sf, "disk_files"), latest=False)


CLASSIFIED = """
    hits AS (SELECT l.*, s.code AS seed_code, s.label AS seed_label FROM {live_codes} l JOIN {seed_codes} s USING (id)),
    alive AS (SELECT lower(rtrim(code, ' ')) AS c FROM {live_codes} WHERE id NOT IN (SELECT id FROM {seed_codes})
        UNION SELECT lower(rtrim(code, ' ')) FROM {seed_codes}),
    lost AS (SELECT id FROM hits WHERE code <> seed_code AND lower(rtrim(code, ' ')) NOT IN (SELECT c FROM alive)),
    homes AS (SELECT id, (SELECT max(id) FROM (SELECT id FROM {live_codes} UNION ALL SELECT id FROM {seed_codes}))
        + row_number() OVER (ORDER BY id) AS new_key FROM lost),
    plan AS (SELECT id, code, seed_code, CASE WHEN code = seed_code THEN 'same' WHEN new_key IS NOT NULL THEN 'rehome' ELSE 'replace' END AS action,
        new_key FROM hits LEFT JOIN homes USING (id))"""


@query("seed_collision_classify", f"WITH {CLASSIFIED} SELECT * FROM plan")
def _(spark, sf):
    live, seed = frames(spark, sf, "live_codes", "seed_codes")
    return R.classify_seed_collisions(live, seed, "id", "code")


@query("seed_collision_apply", f"""
    WITH {CLASSIFIED}, held AS (SELECT p.id FROM plan p JOIN {{live_codes}} l USING (id) JOIN {{code_backup}} b USING (id)
        WHERE l.code IS DISTINCT FROM b.code OR l.label IS DISTINCT FROM b.label)
    SELECT 'live' AS place, id, code, label FROM {{live_codes}} WHERE id NOT IN (SELECT id FROM plan)
    UNION ALL SELECT 'live', p.new_key, l.code, l.label FROM plan p JOIN {{live_codes}} l USING (id)
      WHERE action = 'rehome' AND p.id NOT IN (SELECT id FROM held)
    UNION ALL SELECT 'live', id, code, label FROM {{seed_codes}}
    UNION ALL SELECT 'held', id, NULL, NULL FROM held""")
def _(spark, sf):
    live, seed, backup = frames(spark, sf, "live_codes", "seed_codes", "code_backup")
    plan = R.classify_seed_collisions(live, seed, "id", "code")
    after, held = R.apply_seed_collisions(live, seed, plan, backup, "id")
    return after.select(F.lit("live").alias("place"), "*").unionByName(
        held.select(F.lit("held").alias("place"), "id"), allowMissingColumns=True)


@query("single_claim_owner", """
    WITH rec AS (SELECT p_partkey AS id, CASE WHEN p_brand = 'Brand#1' THEN 'TEXT' WHEN p_brand = 'Brand#2' THEN NULL ELSE '' END AS module FROM part),
    claims AS (SELECT l_partkey AS id, o_custkey AS owner, 'ORDER' AS module FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_quantity > 49 UNION ALL
      SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT), user_id, 'TEXT' FROM events WHERE event_type = 'signup'),
    agreed AS (SELECT id, count(DISTINCT (owner, module)) AS n, min(owner) AS owner, min(module) AS module FROM claims
        WHERE id > 0 AND owner > 0 GROUP BY id)
    SELECT r.id, CASE WHEN n = 1 AND (r.module IS NULL OR r.module = '' OR r.module = a.module) THEN a.owner END AS owner,
      CASE WHEN n = 1 AND (r.module IS NULL OR r.module = '' OR r.module = a.module) THEN a.module END AS owner_module,
      CASE WHEN n IS NULL THEN 'no claim' WHEN n > 1 THEN 'conflicting claims'
           WHEN NOT (r.module IS NULL OR r.module = '' OR r.module = a.module) THEN 'module disagrees' ELSE 'assigned' END AS state
    FROM rec r LEFT JOIN agreed a ON a.id = r.id""")
def _(spark, sf):
    part, lines, orders, events = frames(spark, sf, "part", "lineitem", "orders", "events")
    module = F.when(F.col("p_brand") == "Brand#1", "TEXT").when(F.col("p_brand") == "Brand#2", F.lit(None)).otherwise("")
    records = part.select(F.col("p_partkey").alias("id"), module.alias("module"))
    direct = (lines.where("l_quantity > 49").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
              .select(F.col("l_partkey").alias("id"), F.col("o_custkey").alias("owner"), F.lit("ORDER").alias("module")))
    text = R.url_claims(events.where("event_type = 'signup'"), "props", "user_id", r"\"k\": ([0-9]+)(?=[}])", "TEXT", "id")
    return R.single_claim_owner(records, direct.unionByName(text), pk="id", module="module")
