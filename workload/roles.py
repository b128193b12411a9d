"""The given tables in the roles of a migration: staging, seed, target, children, files.

Each role is one SELECT that Spark and the checking database both run, so a query
and its check start from the same rows. Nothing here calls an operator. Roles
change values by attribute (a status, a priority, a language) and always cover
the whole table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from carryover.session import materialise

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations")

ROLES: dict[str, str] = {}


def role(name: str, sql: str) -> None:
    ROLES[name] = sql


def _needs(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql)) if n in BASE or n in ROLES]


def _named(sql: str, names: dict[str, str]) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: names.get(m.group(1), m.group(0)), sql)


# analysed plans of the query at hand by application, data folder and name (plans only, no data)
_PLANS: dict[tuple[str, str, str], DataFrame] = {}


# roles that the bench wrote down as tables before its clock starts
_STAGED: dict[tuple[str, str, str], DataFrame] = {}


# roles that the query at hand wrote down itself
_WRITTEN: set[tuple[str, str, str]] = set()


def forget() -> None:
    _PLANS.clear()
    _WRITTEN.clear()


def frame(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A base table or a role as a lazy DataFrame."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"), name)
    if key in _STAGED:
        return _STAGED[key]
    if key not in _PLANS:
        _PLANS[key] = _frame(spark, *key[1:])
    return _PLANS[key]


def _frame(spark: SparkSession, path: str, name: str) -> DataFrame:
    if name in BASE:
        return spark.read.parquet(f"{path}/{name}.parquet")
    views = {}
    for n in _needs(ROLES[name]):
        views[n] = f"role_{hashlib.sha256(path.encode()).hexdigest()[:8]}_{n}"
        frame(spark, path, n).createOrReplaceTempView(views[n])
    return spark.sql(_named(ROLES[name], views))


def written_once(spark: SparkSession, sf: str, name: str, distinct: Sequence[str] = ()) -> DataFrame:
    """A role that the query at hand reads several times, written down by its first reader: later roles read what was written.

    With ``distinct`` only the different values of these columns are kept, for readers that neither need more nor count rows.
    """
    key = (spark.sparkContext.applicationId, sf.rstrip("/"), name)
    if key not in _STAGED and key not in _WRITTEN:
        rows = frame(spark, sf, name)
        _PLANS[key] = materialise(rows.select(*distinct).distinct() if distinct else rows, name)
        _WRITTEN.add(key)
    return frame(spark, sf, name)


def write_down(spark: SparkSession, sf: str, *names: str) -> None:
    """Turn roles into written tables for the rest of the run, as a staging area would hold them."""
    for name in names:
        _STAGED[(spark.sparkContext.applicationId, sf.rstrip("/"), name)] = materialise(frame(spark, sf, name), name)


def frames(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [frame(spark, sf, n) for n in names]


def with_roles(sql: str) -> str:
    """Check SQL with its ``{role}`` references resolved to common table expressions."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in BASE or name in ordered:
            return
        for n in _needs(ROLES[name]):
            visit(n)
        ordered.append(name)

    for n in _needs(sql):
        visit(n)
    known = {n: n for n in (*BASE, *ROLES)}
    plain = lambda s: _named(s, known)
    parts = [f"{n} AS ({plain(ROLES[n])})" for n in ordered]
    body = plain(sql)
    if not parts:
        return body
    if body.lstrip().upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body.lstrip()[5:]
    return "WITH " + ", ".join(parts) + " " + body


# --- orders as a merge table: surrogate id, natural key with NULLs and twins, an archived column
role("st_orders", """
    SELECT o_orderkey AS order_no, o_custkey AS cust_no, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority,
           CAST(o_totalprice AS DECIMAL(12,2)) AS total, o_orderdate AS placed_at,
           nullif(o_orderstatus, 'P') AS legacy_status
    FROM {orders}""")
role("seed_orders", """
    SELECT o_orderkey * 2 + 1 AS order_no, o_custkey AS cust_no,
           nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority,
           CAST(CAST(o_totalprice AS DECIMAL(12,2)) + 1 AS DECIMAL(12,2)) AS total, o_orderdate AS placed_at,
           CAST(NULL AS STRING) AS import_archived_legacy_status
    FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice > 250000""")

# --- orders copied id-intact under another shape
role("tgt_orders", """
    SELECT o_orderkey AS orderno, o_custkey AS custno,
           CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'U' END AS status,
           CAST(o_totalprice AS DECIMAL(12,2)) AS total, CAST(o_orderdate AS DATE) AS placed_on,
           o_orderpriority AS priority
    FROM {orders}""")
role("bad_orders", """
    SELECT orderno,
           CASE WHEN priority = '1-URGENT' AND total > 480000 THEN custno + 1 ELSE custno END AS custno,
           CASE WHEN priority = '2-HIGH' AND total > 490000 THEN lower(status) ELSE status END AS status,
           CASE WHEN priority = '3-MEDIUM' AND total > 450000 THEN CAST(total + 0.01 AS DECIMAL(12,2))
                WHEN priority = '5-LOW' AND total > 490000 THEN NULL ELSE total END AS total,
           placed_on,
           CASE WHEN priority = '2-HIGH' AND total < 20000 THEN concat(priority, ' ') ELSE priority END AS priority
    FROM {tgt_orders} WHERE placed_on > DATE '1995-01-03'""")

# --- keyless table
role("tgt_lineitem", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS DECIMAL(8,2)) AS l_quantity,
           CAST(l_extendedprice AS DECIMAL(12,2)) AS l_extendedprice, l_returnflag, l_shipdate FROM {lineitem}""")
role("bad_lineitem", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
           CASE WHEN l_quantity = 50 AND l_returnflag = 'A' AND l_extendedprice > 90000
                THEN CAST(l_extendedprice + 0.01 AS DECIMAL(12,2)) ELSE l_extendedprice END AS l_extendedprice,
           l_returnflag, l_shipdate FROM {tgt_lineitem}""")

# --- decisions by person and type, with the NULLs a legacy table has
role("st_decisions", """
    SELECT event_id AS id, CASE WHEN value > 40 THEN NULL ELSE user_id END AS person,
           CASE event_type WHEN 'view' THEN 'click' WHEN 'error' THEN NULL ELSE event_type END AS kind,
           CASE WHEN value < 5 THEN 1 WHEN value < 30 THEN 0 ELSE NULL END AS optout,
           CASE WHEN props LIKE '%1}' THEN 1 WHEN props LIKE '%3}' THEN NULL ELSE 0 END AS explicit,
           CASE WHEN props LIKE '%7}' THEN NULL ELSE ts END AS edited,
           CASE WHEN props LIKE '%8}' THEN 1 WHEN props LIKE '%9}' THEN NULL ELSE 0 END AS deleted
    FROM {events}""")

# --- parts whose names repeat, with a date that may be missing
role("st_files", """
    SELECT p_partkey AS id, p_name AS filename,
           CASE WHEN p_brand IN ('Brand#3', 'Brand#7') THEN NULL ELSE f.first_ship END AS created
    FROM {part} LEFT JOIN (SELECT l_partkey, min(l_shipdate) AS first_ship FROM {lineitem} GROUP BY l_partkey) f
      ON l_partkey = p_partkey""")
role("st_disks", """
    SELECT p_partkey AS id, concat(p_name, ' ', p_type, ' ', CAST(p_size AS STRING)) AS name,
           CASE WHEN p_brand = 'Brand#3' THEN NULL ELSE 1992 + p_size END AS made
    FROM {part}""")
role("st_claims", """
    SELECT s_suppkey AS id,
           CASE WHEN s_nationkey < 5 THEN concat('import-disks-2001-', CAST(s_suppkey AS STRING), '-0')
                WHEN s_nationkey < 10 THEN upper(concat('import-disks-1997-', CAST(s_suppkey * 3 AS STRING), '-0'))
                WHEN s_nationkey < 15 THEN 'Small Ring PROMO 7' ELSE s_name END AS name
    FROM {supplier}""")
role("disk_files", """
    SELECT DISTINCT concat(p_name, ' ', p_type, ' ', CAST(p_size AS STRING)) AS name
    FROM {part} WHERE p_retailprice > 910
    UNION SELECT s_name FROM {supplier} WHERE s_acctbal > 0
    UNION SELECT 'Small Ring PROMO 7'""")

# --- a reference table whose ids collide with a seed
role("live_codes", """
    SELECT p_partkey AS id, concat(p_brand, ' ', CAST(p_size AS STRING)) AS code, p_name AS label FROM {part}""")
role("seed_codes", """
    SELECT p_partkey AS id,
           CASE WHEN p_type = 'PROMO' THEN concat(p_brand, ' ', CAST(p_size AS STRING))
                ELSE upper(concat(p_brand, ' ', CAST(p_size + 7 AS STRING))) END AS code, p_type AS label
    FROM {part} WHERE p_retailprice < 950 OR p_size > 40""")
role("code_backup", """
    SELECT id, code, CASE WHEN code LIKE 'Brand#2 %' THEN 'older label' ELSE label END AS label FROM {live_codes}""")

# --- settings
role("st_settings", """
    SELECT event_id AS id,
           CASE event_type WHEN 'view' THEN concat('label.', CAST(user_id AS STRING))
                WHEN 'click' THEN concat('fax_', CAST(user_id AS STRING))
                WHEN 'signup' THEN 'docRoot' WHEN 'purchase' THEN 'smtpPassword'
                ELSE concat('mod', CAST(user_id AS STRING)) END AS name,
           CASE WHEN value < 10 THEN 'yes' ELSE props END AS setting
    FROM {events}""")

# --- free text with markers, tokens and names
role("st_templates", """
    SELECT doc_id AS id,
           CASE WHEN lang = 'en' THEN concat('Signed $' || '{old.sign} on $' || '{DATE}: ', text)
                WHEN lang = 'fr' THEN concat(text, ' $' || '{old.by} $' || '{new.sign}')
                WHEN lang = 'de' THEN concat('$' || '{nowhere.known} ', text)
                ELSE concat(text, ' $' || '{old.sign') END AS body
    FROM {documents}""")

# --- access matrices: priorities hold (part type, brand) grants through orders
role("grants_all", """
    SELECT o_orderpriority AS raw_grp, o_orderstatus AS st, c_mktsegment AS seg, n_regionkey AS reg,
           p_brand AS object, p_type AS ptype, l_returnflag AS flag, l_quantity AS qty
    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
      JOIN {nation} ON c_nationkey = n_nationkey JOIN {part} ON l_partkey = p_partkey""")
role("staged_matrix", """
    SELECT concat(seg, ' ', CAST(reg AS STRING)) AS grp, concat(object, '.', ptype) AS object, max(flag) AS privilege
    FROM {grants_all} WHERE qty > 20 GROUP BY 1, 2
    UNION ALL SELECT DISTINCT '_all', object, 'R' FROM {grants_all} WHERE qty > 45
    UNION ALL SELECT DISTINCT CAST(reg AS STRING), object, 'R' FROM {grants_all} WHERE qty > 45""")
role("seed_matrix", """
    SELECT upper(seg) AS grp, concat(object, '.', ptype) AS object, max(flag) AS privilege
    FROM {grants_all} WHERE qty > 47 GROUP BY 1, 2
    UNION ALL SELECT concat(seg, ' 1'), concat(object, '.', ptype), min(flag) FROM {grants_all} WHERE qty > 40 GROUP BY 1, 2
    UNION ALL SELECT DISTINCT upper(seg), concat('era.', object), 'x' FROM {grants_all} WHERE qty > 49""")
role("target_groups", """
    SELECT DISTINCT grp FROM {staged_matrix} UNION SELECT DISTINCT grp FROM {seed_matrix}""")
role("stock_groups", "SELECT DISTINCT upper(c_mktsegment) AS grp FROM {customer}")

# --- documents, encoded by source: as stored, encoded once, twice, or mixed
# The accented letters of the given texts.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"


def _misread(char: str) -> str:
    """What a character looks like after its UTF-8 bytes were read as Windows-1252."""
    return "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252")
                   for b in char.encode("utf-8"))


def _encode(expr: str, alphabet: list[str], base: int) -> str:
    """SQL that misreads every character of ``alphabet``, by way of private-use placeholders."""
    marks = [chr(base + i) for i in range(len(alphabet))]
    expr = f"translate({expr}, '{''.join(alphabet)}', '{''.join(marks)}')"
    for char, mark in zip(alphabet, marks):
        expr = f"replace({expr}, '{mark}', '{_misread(char)}')"
    return expr


ONCE = list(LETTERS)
TWICE = sorted({c for letter in ONCE for c in _misread(letter)})
SOURCES = {"once": [f"src{i}" for i in range(0, 5)], "twice": [f"src{i}" for i in range(5, 9)],
           "mixed": [f"src{i}" for i in range(9, 12)]}
_in = {state: ", ".join(f"'{s}'" for s in sources) for state, sources in SOURCES.items()}
role("text_once", f"""
    SELECT doc_id, lang, source, text AS original, {_encode("text", ONCE, 0xE000)} AS once,
           CASE WHEN source IN ({_in['once']}) THEN 'once' WHEN source IN ({_in['twice']}) THEN 'twice'
                WHEN source IN ({_in['mixed']}) THEN 'mixed' ELSE 'clean' END AS state
    FROM {{documents}}""")
role("st_text", f"""
    SELECT doc_id, lang, source, state, original,
           CASE state WHEN 'once' THEN once WHEN 'twice' THEN {_encode("once", TWICE, 0xE100)}
                WHEN 'mixed' THEN concat(once, ' é Ã©') ELSE original END AS body
    FROM {{text_once}}""")
role("st_spans", """
    SELECT doc_id, lang, state, original,
           CASE WHEN state = 'clean' AND lang = 'en' THEN replace(original, ' the ', ' â\u0080\u0093 ')
                WHEN state = 'clean' AND lang = 'fr' THEN replace(replace(original, ' le ', ' â\u0089¤ '), ' la ', ' â\u0080\u0093 ')
                WHEN state = 'clean' AND lang = 'de' THEN replace(replace(original, ' der ', ' â\u0080\u0093 '), ' und ', ' â\u0085 ')
                ELSE body END AS body,
           CASE WHEN state = 'clean' AND lang = 'en' THEN replace(original, ' the ', ' – ')
                WHEN state = 'clean' AND lang = 'fr' THEN replace(replace(original, ' le ', ' ≤ '), ' la ', ' – ')
                WHEN state = 'clean' AND lang = 'de' THEN replace(replace(original, ' der ', ' – '), ' und ', ' â\u0085 ')
                ELSE body END AS replaced
    FROM {st_text}""")

# --- attachments and files
role("st_attachments", """
    SELECT doc_id AS id,
           CASE WHEN n_chars < 200 AND lang = 'en' THEN concat('/abs/', source, '.pdf')
                WHEN lang = 'es' AND n_chars < 900 THEN concat(source, '/', CAST(doc_id AS STRING), '.pdf')
                WHEN lang = 'de' AND n_chars < 900 THEN concat('.', source)
                WHEN lang = 'fr' AND n_chars < 300 THEN '  '
                ELSE concat(source, '-', CAST(doc_id AS STRING), '.pdf') END AS filename,
           lang AS kind, n_chars AS pages
    FROM {documents}""")
role("attachment_files", """
    SELECT concat(d.source, '-', CAST(d.doc_id AS STRING), '.pdf') AS file_name,
           CASE WHEN l.toxic = 1 THEN CAST(0 AS BIGINT) WHEN d.lang = 'es' AND l.quality = 0 THEN NULL
                ELSE d.n_chars END AS size
    FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
    UNION ALL
    SELECT concat('notice-', CAST(doc_id AS STRING), '.pdf'), n_chars FROM {documents} WHERE source = 'src3'
    UNION ALL
    SELECT concat('page-', CAST(page_id AS STRING), '.html'), CAST(length(html) AS BIGINT) FROM {pages}""")
role("st_pages", r"""
    SELECT page_id, url,
           replace(replace(replace(replace(html, 'href="/', 'href="$' || '{asset_path}'),
             'track(', 'load("$' || '{asset_path}script.png");track('), '<!-- ad', '<!-- <img src="$' || '{asset_path}comment.png"> ad'),
             'p{margin:0}', 'p{background:url( $' || '{asset_path}bg.png )}') AS html
    FROM {pages}""")
role("st_reports", r"""
    SELECT page_id AS id,
           CASE WHEN url LIKE 'https:%' THEN replace(url, '/', chr(92)) ELSE url END AS report_path
    FROM {pages}""")
role("log_lines", """
    SELECT event_id AS line_no,
           CASE WHEN event_type = 'signup' AND value < 5 THEN concat('broken ', props)
           ELSE concat('{"transaction":{"request":{"uri":"', coalesce(u.url, ''), '"},"messages":[{"message":"', event_type,
             '","details":{"ruleId":"', CAST(user_id AS STRING), '","match":"Matched (Value: ', CAST(event_id AS STRING),
             ' secret"}},{"message":"second","details":{"match":"plain"}}]}}') END AS value
    FROM {events} LEFT JOIN (SELECT page_id, url FROM {pages}) u ON u.page_id = user_id""")
