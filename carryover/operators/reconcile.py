"""Do rows and files agree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.functions.text import basename, decoded_references
from carryover.operators.counting import beside
from carryover.operators.skew import lookup


def name_problem(name: Column) -> Column:
    """Why a stored name cannot be a flat file name, NULL when it can."""
    climbs = F.array_contains(F.split(name, "/"), "..")
    return (F.when(name.startswith("/") | F.contains(name, F.lit("\u0000")) | climbs, "escapes the directory")
            .when(F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\")), "names a subdirectory")
            .when(name.startswith("."), "leading dot").when(F.trim(name) == "", "blank"))


def placeholder_name(pk: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), pk.cast("string"), F.lit(".pdf"))


def attachment_gaps(rows: DataFrame, inventory: DataFrame, *, pk: str, name: str, prefix: str) -> DataFrame:
    """(pk, name, problem) for rows whose file is missing, empty, a directory or badly named.

    ``inventory`` has file_name and size (NULL for a directory). ``missing`` rows may be
    given a notice; a row whose notice name is already in use may not.
    """
    files = inventory.groupBy("file_name").agg(F.max(F.struct(F.lit(1).alias("one"), F.col("size"))).alias("_file"))
    found = lookup(rows.select(pk, name), files, [(name, "file_name")], scatter=[pk])
    # names in use that could be mistaken for a notice: served names of rows, and files
    served = basename(F.col(name))
    in_use = (rows.where(served.startswith(prefix)).select(served.alias("_used"))
              .unionByName(inventory.where(F.col("file_name").startswith(prefix)).select(F.col("file_name").alias("_used")))
              .distinct())
    marked = (found.withColumn("_notice", placeholder_name(F.col(pk), prefix))
              .join(in_use, F.col("_notice") == F.col("_used"), "left"))
    problem = F.coalesce(
        name_problem(F.col(name)),
        F.when(F.col("_file").isNull(), F.when(F.col("_used").isNotNull(), "placeholder name taken").otherwise("missing"))
        .when(F.col("_file.size").isNull(), "directory").when(F.col("_file.size") == 0, "empty"))
    return marked.select(pk, name, problem.alias("problem")).where(F.col("problem").isNotNull())


def orphan_files(inventory: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Files no row references."""
    return inventory.select("file_name").distinct().join(
        rows.select(F.col(name).alias("file_name")).distinct(), "file_name", "left_anti")


def orphan_report(orphans: DataFrame, limit: int = 50) -> DataFrame:
    """The exact total next to the first names: the total is not capped."""
    total = orphans.agg(F.count(F.lit(1)).alias("total"))
    first = orphans.orderBy("file_name").limit(limit).agg(F.sort_array(F.collect_list("file_name")).alias("_first"))
    return beside(total, first).select("total", F.explode_outer("_first").alias("file_name"))


def static_html(html: Column) -> Column:
    """The text without comments and script bodies; an opening script tag stays."""
    no_comments = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")
    opening = r"""<script\b(?:[^'">]++|"[^"]*+"|'[^']*+')*+>"""
    return F.regexp_replace(no_comments, f"(?is)({opening}).*?(</script\\s*>|\\z)", "$1$2")


def reference_name(raw: Column) -> Column:
    """The file a reference names: its address without fragment and parameters, form-decoded."""
    return F.try_url_decode(F.regexp_extract(raw, "^[^#&]*", 0))


def html_asset_refs(pages: DataFrame, pk: str, html: str, token: str) -> DataFrame:
    """Distinct (pk, ref): values that follow ``token`` in static HTML.

    A quoted value ends at its quote (spaces allowed), a bare one at white space, a
    quote, a tag end, or the bracket of a CSS ``url(...)`` around it.
    """
    literal = "\\Q" + token + "\\E"
    pattern = (f"\"{literal}([^\"]*)\"|'{literal}([^']*)'|(?i:\\burl\\s*\\(\\s*){literal}([^\\s\"'()<>]*)"
               f"|(?<![\"']){literal}([^\\s\"'<>]*)|[\"']{literal}([^\\s\"'<>]*)")
    # the same alternatives, once to find each occurrence and once per group to take its value
    hits = F.regexp_extract_all(static_html(F.col(html)), F.lit(pattern), F.lit(0))
    one = F.col("_hit")
    value = F.coalesce(*[F.nullif(F.regexp_extract(one, f"^(?:{pattern})$", g), F.lit("")) for g in range(1, 6)])
    found = pages.select(pk, F.explode(F.array_distinct(hits)).alias("_hit")).select(pk, value.alias("_raw"))
    raw = F.col("_raw")
    # an ampersand, bare or as its own entity, ends the name; other references are decoded once per distinct value
    other = F.regexp_like(raw, F.lit("&(?!amp;)[#a-zA-Z]"))
    plain = F.replace(raw, F.lit("&amp;"), F.lit("&"))
    named = found.where(raw.isNotNull()).distinct().select(pk, F.when(other, decoded_references(raw)).otherwise(plain).alias("_value"))
    decoded = named.select(pk, F.coalesce(reference_name(F.col("_value")), F.regexp_extract("_value", "^[^#&]*", 0)).alias("ref"))
    return decoded.where(F.col("ref") != "").distinct()


def asset_state(refs: DataFrame, assets: DataFrame, ref: str = "ref") -> DataFrame:
    """Add ``state``: escaping, subdirectory, missing or routable. ``assets`` has ``asset``."""
    known = assets.select("asset").distinct().withColumn("_there", F.lit(True))
    keys = [c for c in refs.columns if c != ref]
    joined = lookup(refs, known, [(ref, "asset")], scatter=keys)
    climbs = F.array_contains(F.split(F.col(ref), "/"), "..") | F.col(ref).startswith("/")
    state = (F.when(climbs, "escaping").when(F.contains(ref, F.lit("/")) | F.contains(ref, F.lit("\\")), "subdirectory")
             .when(F.col("_there").isNull(), "missing").otherwise("routable"))
    return joined.withColumn("state", state).drop("_there")


def cross_source_claims(reports: DataFrame, documents: DataFrame, *, report: str, document: str,
                        scatter: Sequence[str]) -> DataFrame:
    """Reports whose served name a document already claims: the file there is the document's."""
    claimed = documents.select(basename(F.col(document)).alias("_name")).where(F.col("_name") != "").distinct()
    return lookup(reports.withColumn("_served", basename(F.col(report))), claimed, [("_served", "_name")],
                  scatter=scatter, how="left_semi")


def placeholder_rewrite(rows: DataFrame, missing: DataFrame, pk: str, values: Mapping[str, Column]) -> DataFrame:
    """Replacement fields for exactly the rows in ``missing``; adds ``replaced``."""
    marks = missing.select(pk).distinct().withColumn("_gone", F.lit(True))
    joined = rows.join(marks, pk, "left")
    gone = F.coalesce("_gone", F.lit(False))
    return joined.select(*[F.when(gone, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
                           for c in rows.columns], gone.alias("replaced"))


def inventory_summary(tables: Mapping[str, DataFrame], anchors: Sequence[str], inventory: DataFrame | None = None
                      ) -> DataFrame:
    """(item, amount): rows of each anchor table, how many tables there are, and the files' size."""
    out = None
    for name in anchors:
        row = tables[name].agg(F.count(F.lit(1)).alias("amount")).select(F.lit(f"rows of {name}").alias("item"), "amount")
        out = row if out is None else out.unionByName(row)
    first = tables[anchors[0]]
    out = out.unionByName(first.agg(F.lit(len(tables)).cast("bigint").alias("amount"))
                          .select(F.lit("tables").alias("item"), "amount"))
    if inventory is not None:
        out = out.unionByName(inventory.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("amount"))
                              .select(F.lit("bytes of files").alias("item"), "amount"))
    return out
