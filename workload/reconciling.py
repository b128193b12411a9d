"""References, attachments and files: family J."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.operators import reconcile as R
from carryover.session import materialise
from workload.digests import given
from workload.registry import query
from workload.roles import BASE, frame, frames

SERVED = r"regexp_extract({0}, '[^/\\]*$')"
GAPS = rf"""
    files AS (SELECT file_name, max(size) AS size FROM {{attachment_files}} GROUP BY 1),
    used AS (SELECT {SERVED.format('filename')} AS n FROM {{st_attachments}} UNION SELECT file_name FROM files),
    gaps AS (SELECT a.id, a.filename, CASE
        WHEN starts_with(filename, '/') OR list_contains(string_split(filename, '/'), '..') THEN 'escapes the directory'
        WHEN contains(filename, '/') OR contains(filename, '\') THEN 'names a subdirectory' WHEN starts_with(filename, '.') THEN 'leading dot'
        WHEN trim(filename) = '' THEN 'blank'
        WHEN f.file_name IS NULL AND 'notice-' || a.id || '.pdf' IN (SELECT n FROM used) THEN 'placeholder name taken'
        WHEN f.file_name IS NULL THEN 'missing' WHEN f.size IS NULL THEN 'directory' WHEN f.size = 0 THEN 'empty' END AS problem
      FROM {{st_attachments}} a LEFT JOIN files f ON f.file_name = a.filename)"""


def gaps(spark, sf):
    rows, files = frames(spark, sf, "st_attachments", "attachment_files")
    return R.attachment_gaps(rows, files, pk="id", name="filename", prefix="notice-")


@query("attachment_gaps", f"WITH {GAPS} SELECT * FROM gaps WHERE problem IS NOT NULL")
def _(spark, sf):
    return gaps(spark, sf)


@query("orphan_files", """
    WITH o AS (SELECT DISTINCT file_name FROM {attachment_files} WHERE file_name NOT IN (SELECT filename FROM {st_attachments}))
    SELECT (SELECT count(*) FROM o) AS total, file_name FROM (SELECT file_name FROM o ORDER BY file_name LIMIT 50)""")
def _(spark, sf):
    rows, files = frames(spark, sf, "st_attachments", "attachment_files")
    return R.orphan_report(R.orphan_files(files, rows, "filename"))


REFS = r"""
    static AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?(-->|$)', '', 'g'), '(?is)(<script[^>]*>).*?</script>', '\1</script>', 'g') AS h
        FROM {st_pages}),
    raw AS (SELECT page_id, unnest(list_distinct(list_concat(regexp_extract_all(h, '"\$\{asset_path\}([^"]*)"', 1),
        regexp_extract_all(h, 'url\(\s*\$\{asset_path\}([^\s()]*)', 1)))) AS v FROM static),
    cut AS (SELECT page_id, split_part(replace(v, '&amp;', '&'), '#', 1) AS v FROM raw),
    refs AS (SELECT DISTINCT page_id, url_decode(replace(split_part(v, '&', 1), '+', ' ')) AS ref FROM cut WHERE v <> '')"""


def refs(spark, sf):
    return R.html_asset_refs(frame(spark, sf, "st_pages"), "page_id", "html", "${asset_path}")


@query("html_asset_refs", f"""
    WITH {REFS} SELECT page_id, ref, CASE WHEN list_contains(string_split(ref, '/'), '..') OR starts_with(ref, '/') THEN 'escaping'
        WHEN contains(ref, '/') THEN 'subdirectory' WHEN ref NOT IN (SELECT lang FROM documents UNION SELECT 'The' UNION SELECT 'bg.png') THEN 'missing'
        ELSE 'routable' END AS state FROM refs WHERE ref <> ''""")
def _(spark, sf):
    assets = frame(spark, sf, "documents").select(F.col("lang").alias("asset")).unionByName(
        spark.sql("SELECT explode(array('The', 'bg.png')) AS asset"))
    return R.asset_state(materialise(refs(spark, sf), "references"), assets)


@query("cross_source_claims", rf"""
    SELECT id, {SERVED.format('report_path')} AS served FROM {{st_reports}} WHERE {SERVED.format('report_path')} IN
      (SELECT DISTINCT {SERVED.format('url')} FROM pages WHERE url LIKE '%.net%' AND {SERVED.format('url')} <> '')""")
def _(spark, sf):
    reports, pages = frames(spark, sf, "st_reports", "pages")
    found = R.cross_source_claims(reports, pages.where("url LIKE '%.net%'"), report="report_path", document="url", scatter=["id"])
    return found.select("id", F.col("_served").alias("served"))


@query("placeholder_rewrite", f"""
    WITH {GAPS} SELECT a.id, CASE WHEN g.problem = 'missing' THEN 'notice-' || a.id || '.pdf' ELSE a.filename END AS filename,
      CASE WHEN g.problem = 'missing' THEN 'application/pdf' ELSE a.kind END AS kind, CASE WHEN g.problem = 'missing' THEN 1 ELSE a.pages END AS pages,
      coalesce(g.problem = 'missing', false) AS replaced FROM {{st_attachments}} a JOIN gaps g USING (id)""")
def _(spark, sf):
    rows = frame(spark, sf, "st_attachments")
    values = {"filename": R.placeholder_name(F.col("id"), "notice-"), "kind": F.lit("application/pdf"), "pages": F.lit(1).cast("bigint")}
    return R.placeholder_rewrite(rows, gaps(spark, sf).where("problem = 'missing'"), "id", values)


@query("inventory_summary", """
    SELECT 'rows of orders' AS item, count(*) AS amount FROM orders UNION ALL SELECT 'rows of customer', count(*) FROM customer
    UNION ALL SELECT 'tables', 14 UNION ALL SELECT 'bytes of files', CAST(sum(size) AS BIGINT) FROM {attachment_files}""")
def _(spark, sf):
    return R.inventory_summary(given(spark, sf, BASE), ["orders", "customer"], frame(spark, sf, "attachment_files"))
