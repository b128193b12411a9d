"""Content digests: H1 to H3, K3."""

from __future__ import annotations

from pyspark.sql import functions as F

from carryover.operators import digest as D
from carryover.operators.findings import transfer_verdict
from workload.registry import query
from workload.roles import BASE, frame, frames
from workload.specs import LARGE, SCALES

# Columns of the given tables and how the check renders each kind.
COLUMNS = {
    "region": "r_regionkey:i r_name:s", "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d "
                "l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:i ts:t user_id:i event_type:s value:d props:s",
    "documents": "doc_id:i text:l lang:s source:s n_chars:i", "pages": "page_id:i url:s html:l",
    "benchmark": "item_id:i text:l", "labels": "doc_id:i quality:i toxic:i",
    "conversations": "conv_id:i turn:i role:s text:l",
}


def sql_piece(column: str, kind: str) -> str:
    text = {"i": f"CAST({column} AS VARCHAR)", "s": column, "l": column,
            "d": f"CAST(CAST({column} AS DECIMAL(38,2)) AS VARCHAR)",
            "t": f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"}[kind]
    body = f"sha256({text})" if kind == "l" else text
    return f"CASE WHEN {column} IS NULL THEN '~' ELSE length({text}) || ':' || {body} END"


def sql_lanes(source: str, columns: str, group: str = "") -> str:
    """Digest lanes of ``source`` in the check's SQL; ``columns`` as in COLUMNS."""
    pieces = " || chr(31) || ".join(sql_piece(*c.split(":")) for c in columns.split())
    keys = f"{group}, " if group else ""
    return f"""SELECT {keys}count(*) AS rows, CAST(coalesce(sum(('0x' || substr(h, 1, 16))::UBIGINT), 0) AS VARCHAR) AS total,
      CASE WHEN bit_xor(('0x' || substr(h, 17, 16))::UBIGINT) >= 9223372036854775808
           THEN CAST(bit_xor(('0x' || substr(h, 17, 16))::UBIGINT)::HUGEINT - 18446744073709551616 AS BIGINT)
           ELSE CAST(coalesce(bit_xor(('0x' || substr(h, 17, 16))::UBIGINT), 0) AS BIGINT) END AS parity,
      count(*) FILTER (WHERE h IS NULL) AS unhashed
      FROM (SELECT {keys}sha256({pieces}) AS h FROM {source}) hashed {"GROUP BY " + group if group else ""}"""


DIGESTED = list(COLUMNS)


def _document_sql(changed: dict[str, str] | None = None) -> str:
    parts = [f"SELECT '{t}' AS table_name, * FROM ({sql_lanes((changed or {}).get(t, t), COLUMNS[t])})" for t in DIGESTED]
    return " UNION ALL ".join(parts)


def given(spark, sf, names=DIGESTED):
    return {t: frame(spark, sf, t) for t in names}


@query("table_digest", sql_lanes("lineitem", COLUMNS["lineitem"]))
def _(spark, sf):
    return D.table_digest(frame(spark, sf, "lineitem"), scales=SCALES["lineitem"])


@query("grouped_digest", sql_lanes("lineitem", COLUMNS["lineitem"], "l_returnflag"))
def _(spark, sf):
    df = frame(spark, sf, "lineitem")
    return D.grouped_digest(df, ["l_returnflag"], df.columns, scales=SCALES["lineitem"])


@query("digest_document", f"""
    SELECT table_name, CASE WHEN table_name = 'embeddings' THEN 3 ELSE n END AS columns, rows, total, parity, unhashed,
           table_name = 'embeddings' AS refused
    FROM (SELECT d.*, s.n FROM ({_document_sql()}) d JOIN (VALUES
      {", ".join(f"('{t}', {len(c.split())})" for t, c in COLUMNS.items())}) s(t, n) ON s.t = d.table_name
      UNION ALL SELECT 'embeddings', NULL, NULL, NULL, NULL, 3)""")
def _(spark, sf):
    document = D.digest_document(given(spark, sf, BASE), large=LARGE, scales=SCALES)
    return document.select("table_name", F.size("columns").alias("columns"), "rows", "total", "parity", "unhashed",
                           F.col("error").isNotNull().alias("refused"))


CORRUPT = {
    "orders": "(SELECT * REPLACE (CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 400000 "
              "THEN o_custkey + 1 ELSE o_custkey END AS o_custkey) FROM orders)",
    "customer": "(SELECT * FROM customer WHERE c_acctbal >= 0)",
}


def arrived(spark, sf):
    """The table set as it arrived: one changed value, lost rows, a lost column, a lost table, a stranger."""
    tables = given(spark, sf)
    o = tables["orders"]
    hit = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000)
    tables["orders"] = o.withColumn("o_custkey", F.when(hit, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    tables["customer"] = tables["customer"].where("c_acctbal >= 0")
    tables["supplier"] = tables["supplier"].drop("s_acctbal")
    tables["part"] = tables["part"].withColumn("p_name", F.col("p_name").cast("binary"))
    del tables["nation"]
    tables["stranger"] = tables["region"]
    tables["labels"] = tables["labels"].withColumn("quality", F.array("quality"))
    return tables


@query("digest_compare", f"""
    SELECT e.table_name AS table_name,
      CASE WHEN e.table_name = 'labels' THEN 'unverified'
           WHEN e.table_name IN ('nation', 'supplier', 'part') THEN 'failed'
           WHEN e.rows <> a.rows OR e.total <> a.total OR e.parity <> a.parity THEN 'failed' ELSE 'verified' END AS status,
      CASE e.table_name WHEN 'labels' THEN 'not measured here' WHEN 'nation' THEN 'table missing'
           WHEN 'supplier' THEN 'column missing' WHEN 'part' THEN 'column hashes differently'
           ELSE CASE WHEN e.rows <> a.rows THEN 'rows' WHEN e.total <> a.total OR e.parity <> a.parity THEN 'content' END
           END AS why
    FROM ({_document_sql()}) e JOIN ({_document_sql(CORRUPT)}) a USING (table_name)
    UNION ALL SELECT 'stranger', 'unverified', 'not in the expected document'""")
def compare_sets(spark, sf):
    expected = D.digest_document(given(spark, sf), large=LARGE, scales=SCALES)
    actual = D.digest_document(arrived(spark, sf), large=LARGE, scales={**SCALES, "stranger": {}})
    return D.digest_compare(expected, actual)


@query("transfer_verdict", f"""
    WITH c AS (SELECT e.table_name, e.rows <> a.rows OR e.total <> a.total OR e.parity <> a.parity AS differs
      FROM ({_document_sql()}) e JOIN ({_document_sql(CORRUPT)}) a USING (table_name))
    SELECT count(*) FILTER (WHERE NOT differs AND table_name NOT IN ('labels', 'nation', 'supplier', 'part')) AS verified,
           count(*) FILTER (WHERE (differs OR table_name IN ('nation', 'supplier', 'part')) AND table_name <> 'labels') AS failed,
           CAST(2 AS BIGINT) AS unverified, 'no-content-digests' AS needs, 'stop' AS verdict FROM c""")
def _(spark, sf):
    return transfer_verdict(compare_sets(spark, sf), accepted=["content-transfer"])
