"""Charset repair: family C. The roles build the damage with replacements; the checks know the original."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.functions import charset as C
from workload.registry import query
from workload.roles import frame

SPECIALS, CONTROLS = C.CP1252_CHARS, C.C1_CHARS
FOREIGN = r"[^\x00-\x7F\x{A0}-\x{FF}\x{81}\x{8D}\x{8F}\x{90}\x{9D}" + SPECIALS + "]"
UTF8 = (r"(?s)(?:[\x00-\x7F]|[\x{C2}-\x{DF}][\x{80}-\x{BF}]|\x{E0}[\x{A0}-\x{BF}][\x{80}-\x{BF}]"
        r"|[\x{E1}-\x{EC}\x{EE}\x{EF}][\x{80}-\x{BF}]{2}|\x{ED}[\x{80}-\x{9F}][\x{80}-\x{BF}]"
        r"|\x{F0}[\x{90}-\x{BF}][\x{80}-\x{BF}]{2}|[\x{F1}-\x{F3}][\x{80}-\x{BF}]{3}|\x{F4}[\x{80}-\x{8F}][\x{80}-\x{BF}]{2})*")
MARKER = r"(?i)(?:[\x{C3}\x{C2}][\x{80}-\x{BF}]|\x{E2}(?:\x{20AC}|\x{201E}\x{A2}))"


def sql_double(c: str) -> str:
    """The definition over code points: single-byte text whose bytes follow the UTF-8 grammar."""
    return (f"(strlen({c}) <> length({c}) AND NOT regexp_matches({c}, '{FOREIGN}') "
            f"AND regexp_full_match(translate({c}, '{SPECIALS}', '{CONTROLS}'), '{UTF8}'))")


def sql_marker(c: str) -> str:
    return f"regexp_matches({c}, '{MARKER}')"


@query("mojibake_detect", f"SELECT doc_id, {sql_double('body')} AS double_encoded FROM {{st_text}}")
def _(spark, sf):
    return frame(spark, sf, "st_text").select("doc_id", C.is_double_encoded(F.col("body")).alias("double_encoded"))


@query("mojibake_repair", """
    SELECT s.doc_id, md5(CASE s.state WHEN 'once' THEN s.original WHEN 'twice' THEN t.once ELSE s.body END) AS repaired
    FROM {st_text} s JOIN {text_once} t USING (doc_id)""")
def _(spark, sf):
    return frame(spark, sf, "st_text").select("doc_id", F.md5(C.repair(F.col("body"))).alias("repaired"))


@query("mojibake_fixed_point", f"""
    SELECT doc_id, md5(CASE WHEN state = 'once' AND NOT {sql_marker('original')} THEN original ELSE body END) AS stored,
           state = 'once' AND body <> original AS changed FROM {{st_text}}""")
def _(spark, sf):
    stored = C.validated_repair(F.col("body"))
    return frame(spark, sf, "st_text").select("doc_id", F.md5(stored).alias("stored"),
                                              (stored != F.col("body")).alias("changed"))


@query("mojibake_census", f"""
    WITH lanes AS (SELECT count(*) FILTER ({sql_double('body')}) AS n,
        count(*) FILTER (state = 'twice' AND body <> original) AS multi,
        count(*) FILTER ({sql_marker('body')} AND NOT {sql_double('body')}) AS bad FROM {{st_text}})
    SELECT 'documents' AS table_name, 'body' AS column_name, lane, accept, rows FROM (
      SELECT 'repairable' AS lane, 'charset-repair' AS accept, n - multi AS rows FROM lanes
      UNION ALL SELECT 'multi', 'keep-unrepairable-text', multi FROM lanes
      UNION ALL SELECT 'partial', 'keep-unrepairable-text', 0 FROM lanes
      UNION ALL SELECT 'bad', 'keep-unrepairable-text', bad FROM lanes)""")
def _(spark, sf):
    return C.charset_census(frame(spark, sf, "st_text"), ["body"], "documents")


RESIDUAL = r"\x{E2}[\x{80}-\x{9F}]"


@query("exact_span_repair", f"""
    SELECT doc_id, md5(CASE WHEN state = 'once' THEN original
        WHEN state = 'clean' AND NOT regexp_matches(replaced, '{RESIDUAL}') AND NOT {sql_marker('replaced')} THEN replaced
        ELSE body END) AS stored FROM {{st_spans}}""")
def _(spark, sf):
    return frame(spark, sf, "st_spans").select("doc_id", F.md5(C.exact_span_repair(F.col("body"))).alias("stored"))


@query("exact_span_counts", f"""
    WITH s AS (SELECT state, lang, body, original, replaced,
        state = 'clean' AND (contains(body, 'â\u0080\u0093') OR contains(body, 'â\u0089¤')) AS span,
        CASE WHEN state = 'once' THEN false WHEN state = 'twice' THEN body <> original WHEN state = 'mixed' THEN true
             ELSE regexp_matches(replaced, '{RESIDUAL}') OR {sql_marker('replaced')} END AS doubt FROM {{st_spans}})
    SELECT lane, rows FROM (
      SELECT 'repaired' AS lane, count(*) FILTER ((span OR (state = 'once' AND body <> original)) AND NOT doubt) AS rows FROM s
      UNION ALL SELECT 'doubt', count(*) FILTER (doubt) FROM s
      UNION ALL SELECT 'iso8859-1-en-dash', count(*) FILTER (contains(body, 'â\u0080\u0093') AND NOT doubt) FROM s
      UNION ALL SELECT 'iso8859-1-less-or-equal', count(*) FILTER (contains(body, 'â\u0089¤') AND NOT doubt) FROM s)""")
def _(spark, sf):
    return C.exact_span_counts(frame(spark, sf, "st_spans"), "body")
