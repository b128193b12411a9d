"""Column transforms: family B."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.functions import transforms as T
from carryover.operators.counting import beside
from carryover.spec import ColumnInfo, TableSpec
from workload.registry import query
from workload.roles import frame

DATE_TEXT = """CASE WHEN o_orderstatus = 'P' THEN '0000-00-00' WHEN o_orderpriority = '5-LOW' THEN '0000-00-00 00:00:00'
    ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END"""


@query("zero_date_null", f"""
    SELECT o_orderkey, TRY_CAST(nullif(nullif({DATE_TEXT}, '0000-00-00'), '0000-00-00 00:00:00') AS DATE) AS placed_on FROM orders""", text=["placed_on"])
def _(spark, sf):
    text = frame(spark, sf, "orders").select("o_orderkey", F.expr(DATE_TEXT).alias("t"))
    return text.select("o_orderkey", T.zero_date_null(F.col("t")).try_cast("date").alias("placed_on"))


PRIORITY = ColumnInfo("enum", nullable=True, values=("1-URGENT", "2-HIGH"), default="9-OTHER")
STATUS = ColumnInfo("enum", nullable=False, values=("O", "F"))
SEGMENT = ColumnInfo("enum", nullable=True, values=("BUILDING", "MACHINERY"))


@query("enum_fold", """
    SELECT order_no, CASE WHEN priority IS NULL THEN NULL WHEN priority IN ('1-URGENT', '2-HIGH') THEN priority ELSE '9-OTHER' END AS priority,
           CASE WHEN legacy_status IN ('O', 'F') THEN legacy_status ELSE 'O' END AS status,
           CASE WHEN priority IN ('BUILDING', 'MACHINERY') THEN priority END AS segment FROM {st_orders}""")
def _(spark, sf):
    return frame(spark, sf, "st_orders").select(
        "order_no", T.enum_fold(F.col("priority"), PRIORITY).alias("priority"),
        T.enum_fold(F.col("legacy_status"), STATUS).alias("status"), T.enum_fold(F.col("priority"), SEGMENT).alias("segment"))


@query("not_null_fallback", """
    SELECT id, coalesce(person, 0) AS person, coalesce(kind, '') AS kind, coalesce(optout, 0) AS optout,
           coalesce(edited, TIMESTAMP '0001-01-01 00:00:00') AS edited,
           coalesce(CAST(edited AS DATE), DATE '0001-01-01') AS edited_on FROM {st_decisions}""", text=["edited_on"], micros=["edited"])
def _(spark, sf):
    def strict(kind):
        return ColumnInfo(kind, nullable=False)

    return frame(spark, sf, "st_decisions").select(
        "id", T.not_null_fallback(F.col("person"), strict("bigint")).alias("person"),
        T.not_null_fallback(F.col("kind"), strict("varchar")).alias("kind"),
        T.not_null_fallback(F.col("optout"), strict("int")).alias("optout"),
        T.not_null_fallback(F.col("edited"), strict("datetime")).alias("edited"),
        T.not_null_fallback(F.to_date("edited"), strict("date")).alias("edited_on"))


SUPPLIED = TableSpec("decisions", columns={"id": ColumnInfo("bigint", nullable=False), "kind": ColumnInfo("varchar"),
                                           "locked": ColumnInfo("int", nullable=False), "note": ColumnInfo("text", nullable=False)})


@query("primitive_supplied", "SELECT id, kind, 0 AS locked, '' AS note FROM {st_decisions}")
def _(spark, sf):
    from carryover.operators.merge import project_mapped
    from carryover.spec import effective_spec

    src = frame(spark, sf, "st_decisions")
    spec, _ = effective_spec(SUPPLIED, src.columns)
    return project_mapped(src, spec).select("id", "kind", F.col("locked").cast("int"), "note")


COERCED = TableSpec("decisions", columns={
    "person": ColumnInfo("bigint", nullable=False), "kind": ColumnInfo("enum", values=("click", "signup"), default="click"),
    "optout": ColumnInfo("int", nullable=False), "deleted": ColumnInfo("int", nullable=False)})


@query("coercion_counts", """
    SELECT 'person' AS column_name, 'not_null_fallback' AS rule, count(*) FILTER (person IS NULL) AS rows FROM {st_decisions}
    UNION ALL SELECT 'kind', 'enum_fallback', count(*) FILTER (kind NOT IN ('click', 'signup')) FROM {st_decisions}
    UNION ALL SELECT 'optout', 'not_null_fallback', count(*) FILTER (optout IS NULL) FROM {st_decisions}
    UNION ALL SELECT 'deleted', 'not_null_fallback', count(*) FILTER (deleted IS NULL) FROM {st_decisions}""")
def _(spark, sf):
    return T.coercion_counts(frame(spark, sf, "st_decisions"), COERCED)


CODES = {"click": "CLK", "signup": "SGN", "Purchase": "PUR"}


@query("code_map_exact", """
    SELECT coalesce(kind, '<NULL>') AS code,
           coalesce(CASE kind WHEN 'click' THEN 'CLK' WHEN 'signup' THEN 'SGN' WHEN 'Purchase' THEN 'PUR' ELSE kind END, '<NULL>') AS canonical,
           CASE WHEN kind IN ('click', 'signup', 'Purchase') THEN 'rewritten' WHEN kind IN ('VIEW', 'CLK') THEN 'known'
                ELSE 'unknown' END AS state, count(*) AS rows FROM {st_decisions} GROUP BY kind""")
def _(spark, sf):
    return T.code_map_report(frame(spark, sf, "st_decisions"), "kind", CODES, ["VIEW", "CLK"])


@query("literal_marker_rewrite", """
    SELECT page_id, contains(html, '<article>') AS had_marker, md5(replace(html, '<article>', '<section>')) AS body,
           contains(replace(html, '<article>', '<section>'), '<article>') AS remains FROM pages""")
def _(spark, sf):
    html = T.marker_rewrite(F.col("html"), "<article>", "<section>")
    return frame(spark, sf, "pages").select(
        "page_id", F.contains("html", F.lit("<article>")).alias("had_marker"), F.md5(html).alias("body"),
        F.contains(html, F.lit("<article>")).alias("remains"))


@query("basename_rewrite", """
    SELECT id, '/srv/documents/' || regexp_extract(report_path, '[^/\\\\]*$') AS once,
           '/srv/documents/' || regexp_extract(report_path, '[^/\\\\]*$') AS twice FROM {st_reports}""")
def _(spark, sf):
    once = T.basename_rewrite(F.col("report_path"), "/srv/documents")
    return frame(spark, sf, "st_reports").select("id", once.alias("once"),
                                                 T.basename_rewrite(once, "/srv/documents").alias("twice"))


@query("path_context_rewrite", """
    WITH p AS (SELECT page_id, url, '/var/lib/Docs/' || replace(url, ':', '') ||
             CASE WHEN url LIKE '%/en/%' THEN '/../../../../../../etc' WHEN url LIKE '%/fr/%' THEN '/x/../y/' ELSE '' END AS path,
             replace(url, ':', '') AS clean FROM pages),
    t AS (SELECT page_id, path, url, substr(clean, strpos(clean, '/') + 1) AS tail FROM p)
    SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN NULL
        WHEN url LIKE '%/fr/%' THEN '/srv/new/' || trim(regexp_replace(tail || '/y/', '/+', '/', 'g'), '/') || '/'
        ELSE '/srv/new/' || trim(regexp_replace(tail, '/+', '/', 'g'), '/') ||
             CASE WHEN tail LIKE '%/' THEN '/' ELSE '' END END AS new_path FROM t""")
def _(spark, sf):
    path = F.concat(F.lit("/var/lib/Docs/"), F.replace("url", F.lit(":"), F.lit("")),
                    F.when(F.col("url").like("%/en/%"), "/../../../../../../etc")
                    .when(F.col("url").like("%/fr/%"), "/x/../y/").otherwise(""))
    return frame(spark, sf, "pages").select("page_id", T.context_rewrite(path, "Docs", "/srv/new").alias("new_path"))


@query("key_disposition", """
    SELECT id, name, CASE
      WHEN setting = 'yes' AND name = 'docRoot' THEN 'new-default' WHEN setting = 'yes' AND name = 'smtpPassword' THEN 'skipped'
      WHEN name = 'docRoot' THEN 'translate' WHEN name = 'smtpPassword' THEN 'carry-secret'
      WHEN name LIKE 'label.%' THEN 'carry' WHEN starts_with(name, 'fax_1') THEN 'refused' WHEN starts_with(name, 'fax_') THEN 'dropped'
      ELSE 'unknown' END AS disposition FROM {st_settings}""")
def _(spark, sf):
    d = T.key_disposition(F.col("name"), F.col("setting"),
                          defaults={"docRoot": "yes", "smtpPassword": "yes", "label.1": "yes"}, new_defaults={"docRoot": "no"},
                          exact={"docRoot": "translate", "smtpPassword": "carry-secret"},
                          prefixes=[("label.", "carry"), ("fax_1", "refused"), ("fax_", "dropped")], always_carried=["label."])
    return frame(spark, sf, "st_settings").select("id", "name", d.alias("disposition"))


@query("template_token_rename", """
    SELECT d.doc_id AS id, CASE lang WHEN 'en' THEN 'renamed' WHEN 'fr' THEN 'renamed' ELSE 'needs-review' END AS state,
           md5(CASE lang WHEN 'en' THEN replace(body, '${old.sign}', '${new.sign}') WHEN 'fr' THEN replace(body, '${old.by}', '${new.by}')
               ELSE body END) AS body,
           CAST(CASE WHEN lang IN ('en', 'fr') THEN 1 ELSE 0 END AS BIGINT) AS renamed,
           CAST(CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS BIGINT) AS unmapped
    FROM {st_templates} t JOIN documents d ON d.doc_id = t.id""")
def _(spark, sf):
    r = T.token_rename(F.col("body"), {"old.sign": "new.sign", "old.by": "new.by"}, ("DATE",))
    return frame(spark, sf, "st_templates").select("id", r.alias("r")).select(
        "id", "r.state", F.md5("r.value").alias("body"), "r.renamed", "r.unmapped")


@query("expiry_and_name_rules", """
    SELECT count(*) FILTER (deleted = 1 AND (edited IS NULL OR edited < TIMESTAMP '2024-01-10 00:00:00')) AS expired,
           (SELECT count(*) FROM part WHERE NOT regexp_full_match(replace(p_name, ' ', CASE WHEN p_size > 25 THEN '' ELSE ' ' END),
              '[a-zA-Z0-9]{1,30}')) AS bad_names,
           count(*) FILTER (person IS NOT NULL AND person <> 1) AS not_default FROM {st_decisions}""")
def _(spark, sf):
    d = frame(spark, sf, "st_decisions")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    counts = d.agg(F.count_if(T.expired(F.col("deleted"), F.col("edited"), now)).alias("expired"),
                   F.count_if(F.col("person") != 1).alias("not_default"))
    name = F.replace("p_name", F.lit(" "), F.when(F.col("p_size") > 25, "").otherwise(" "))
    names = frame(spark, sf, "part").agg(F.count_if(T.bad_name(name)).alias("bad_names"))
    return beside(counts, names)


NAMES = ["The", "und", "la", "los", "nowhere_table"]


@query("whole_word_refs", """
    SELECT doc_id, array_to_string(list_sort(list_intersect(['la', 'los', 'nowhere_table', 'the', 'und'],
             regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*'))), ',') AS refs FROM documents""")
def _(spark, sf):
    return frame(spark, sf, "documents").select("doc_id", F.array_join(T.whole_word_refs(F.col("text"), NAMES), ",").alias("refs"))
