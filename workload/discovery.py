"""What a run has to find out for itself: keys, differing ranges, rules by table, the end of a live log."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from carryover.operators.ranges import difference_ranges
from carryover.operators.rules import disposition_by_tables, prefix_join
from carryover.sources import audit_log, keys
from carryover.sources.catalog import catalog_profile
from carryover.spec import ColumnInfo, TableSpec
from carryover.streaming.tail import last_lines_of, last_lines_stream
from workload.digests import given
from workload.mapping import PROFILED, sql_profile
from workload.parity import PAIRED, override
from workload.registry import ORACLES, query
from workload.roles import BASE, frame, frames, role
from workload.specs import ORDERS_COPY
from workload.written import folder


def _sets(longest: int):
    """(table, columns, bit mask) of every set of up to ``longest`` columns."""
    for table in BASE:
        columns = PROFILED[table]
        for size in range(1, min(longest, len(columns)) + 1):
            for chosen in combinations(range(len(columns)), size):
                yield table, [columns[i] for i in chosen], sum(1 << i for i in chosen)


def sql_keys(longest: int) -> str:
    each = " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, {mask} AS mask, {cols!r} AS key_columns, (SELECT count(*) FROM {t}) AS rows,
        (SELECT count(*) FROM (SELECT DISTINCT {', '.join(cols)} FROM {t} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)})) AS n"""
        for t, cols, mask in _sets(longest))
    return f"""
    held AS (SELECT * FROM ({each}) WHERE n = rows AND rows > 0),
    found AS (SELECT * FROM held h WHERE NOT EXISTS (SELECT 1 FROM held k WHERE k.table_name = h.table_name AND k.mask <> h.mask AND k.mask & h.mask = k.mask)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY len(key_columns), list_transform(range(12), lambda i: (mask >> i) & 1 = 0)) AS place FROM found)"""


@query("key_candidates", f"""
    WITH {sql_keys(4)} SELECT table_name, array_to_string(key_columns, ',') AS key_columns, CAST(len(key_columns) AS INTEGER) AS n_columns, rows, place = 1 AS preferred FROM ranked""")
def _(spark, sf):
    return keys.key_candidates(spark, given(spark, sf, BASE), longest=4).withColumn("key_columns", F.array_join("key_columns", ","))


def sql_preferred_keys() -> str:
    """The preferred key of each table, however many columns it takes: of up to two columns, else of all sets of columns, each a grouping set."""
    each = " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, {columns!r} AS columns, list_filter({columns!r}, lambda c, i: (g >> ({len(columns)} - i)) & 1 = 0) AS key_columns,
        (SELECT count(*) FROM {t}) AS rows, count(*) AS n
        FROM (SELECT grouping({', '.join(columns)}) AS g FROM {t} WHERE '{t}' IN (SELECT name FROM others) GROUP BY CUBE ({', '.join(columns)})) GROUP BY g
        HAVING {' AND '.join(f"((g >> {len(columns) - i}) & 1 = 1 OR (SELECT count(*) = count({c}) FROM {t}))" for i, c in enumerate(columns, 1))}"""
        for t, columns in ((t, PROFILED[t]) for t in BASE))
    return f"""
    {sql_keys(2)},
    others AS MATERIALIZED (SELECT unnest({list(BASE)!r}) AS name EXCEPT SELECT table_name FROM found),
    larger AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY len(key_columns), list_transform(columns, lambda c: NOT list_contains(key_columns, c))) AS place
      FROM ({each}) WHERE n = rows AND len(key_columns) > 0),
    preferred AS (SELECT table_name, key_columns FROM ranked WHERE place = 1 UNION ALL SELECT table_name, key_columns FROM larger WHERE place = 1)"""


@query("catalog_keys", f"""
    WITH {sql_preferred_keys()}, profile AS ({' UNION ALL '.join(sql_profile(t, t, PROFILED[t]) for t in BASE)})
    SELECT p.*, true AS nullable, CAST(nullif(list_position(key_columns, column_name), 0) AS INTEGER) AS key_position
    FROM profile p LEFT JOIN preferred r ON r.table_name = p.table_name""")
def _(spark, sf):
    tables = given(spark, sf, BASE)
    return keys.with_key_positions(catalog_profile(tables), keys.key_candidates(spark, tables, onward=True))


# --- a copy with rows that changed, went missing and came in addition
role("more_orders", """
    SELECT * FROM {bad_orders}
    UNION ALL SELECT orderno + 10000000, custno, status, total, placed_on, priority FROM {tgt_orders} WHERE total > 470000""")


@query("difference_ranges", f"""
    WITH {PAIRED} SELECT orderno, CASE WHEN found THEN 'differs' ELSE 'missing' END AS state
    FROM p WHERE NOT found OR b_custno OR b_status OR b_total OR b_placed_on OR b_priority
    UNION ALL SELECT orderno + 10000000, 'surplus' FROM {{tgt_orders}} WHERE total > 470000""")
def _(spark, sf):
    src, tgt = frames(spark, sf, "orders", "more_orders")
    return difference_ranges(src, tgt, ORDERS_COPY, override(), small_rows=200, level_bits=6)[0]


TURNS = TableSpec("conversations", columns={"conv_id": ColumnInfo("bigint"), "turn": ColumnInfo("int"), "role": ColumnInfo("varchar", length=20),
                                            "text": ColumnInfo("text")}, key=("conv_id", "turn"))


@query("difference_ranges_hashed", """
    SELECT conv_id, turn, CASE WHEN length(text) % 5 = 0 THEN 'missing' ELSE 'differs' END AS state FROM conversations WHERE length(text) % 5 < 2
    UNION ALL SELECT -conv_id - 1, turn, 'surplus' FROM conversations WHERE length(text) % 5 = 0""")
def _(spark, sf):
    turns = frame(spark, sf, "conversations")
    left = F.char_length("text") % 5
    copy = turns.select(F.when(left == 0, -F.col("conv_id") - 1).otherwise(F.col("conv_id")).alias("conv_id"), "turn", "role",
                        F.when(left == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return difference_ranges(turns, copy, TURNS, small_rows=20, level_bits=4)[0]


# --- prefix rules as tables
role("prefix_rules", """
    SELECT DISTINCT concat(head, substring(CAST(c_custkey AS STRING), 1, 1 + c_nationkey % 3)) AS prefix,
           concat('to ', head, CAST(c_nationkey % 3 AS STRING)) AS disposition, c_nationkey % 3 * 100 + length(head) AS rule_no
    FROM (SELECT c_custkey, c_nationkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'label.' WHEN 'MACHINERY' THEN 'fax_' WHEN 'AUTOMOBILE' THEN 'mod'
            ELSE substring('docRoot', 1, 3) END AS head FROM {customer}) h
    UNION ALL SELECT 'smtp', 'secret', 7 UNION ALL SELECT CAST(NULL AS STRING), 'never', 1""")


def _matched(order: str) -> str:
    return f"""WITH rules AS (SELECT prefix, min({{rule}}) AS r FROM {{{{prefix_rules}}}} WHERE prefix IS NOT NULL GROUP BY prefix),
    hit AS (SELECT id, r, row_number() OVER (PARTITION BY id ORDER BY {order}) AS n FROM {{{{st_settings}}}} JOIN rules ON starts_with(name, prefix))
    SELECT s.id, s.name, r.disposition AS disposition FROM {{{{st_settings}}}} s LEFT JOIN (SELECT * FROM hit WHERE n = 1) h USING (id)"""


@query("prefix_join", _matched("length(prefix) DESC").format(rule="{'disposition': disposition}"))
def _(spark, sf):
    settings, rules = frames(spark, sf, "st_settings", "prefix_rules")
    return prefix_join(settings.select("id", "name"), "name", rules, ["disposition"])


@query("prefix_join_first", _matched("r.rule_no, length(prefix) DESC").format(rule="{'rule_no': rule_no, 'disposition': disposition}"))
def _(spark, sf):
    settings, rules = frames(spark, sf, "st_settings", "prefix_rules")
    return prefix_join(settings.select("id", "name"), "name", rules, ["disposition"], order="rule_no")


@query("key_disposition_tables", ORACLES["key_disposition"])
def _(spark, sf):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    return disposition_by_tables(
        frame(spark, sf, "st_settings"), "name", "setting",
        defaults=table([("docRoot", "yes"), ("smtpPassword", "yes"), ("label.1", "yes")], "name string, value string"),
        new_defaults=table([("docRoot", "no")], "name string, value string"),
        exact=table([("docRoot", "translate"), ("smtpPassword", "carry-secret")], "name string, disposition string"),
        prefixes=table([("label.", "carry", 1), ("fax_1", "refused", 2), ("fax_", "dropped", 3)], "prefix string, disposition string, rule_no int"),
        always_carried=table([("label.",)], "prefix string")).select("id", "name", "disposition")


@query("audit_log_live_tail", ORACLES["audit_log_last_lines"])
def _(spark, sf):
    log, out, checkpoint = (folder(spark, name) for name in ("log", "tail", "tail-checkpoint"))
    lines = frame(spark, sf, "log_lines").repartition(4, "line_no").sortWithinPartitions("line_no")
    run = lambda: last_lines_stream(
        spark.readStream.schema("line_no bigint, value string").option("maxFilesPerTrigger", 2).parquet(log), out, checkpoint, position="line_no", n=20)
    # the log grows between two runs; the second one goes on from the first one's checkpoint
    for half in (lines.where("line_no % 2 = 0"), lines.where("line_no % 2 = 1")):
        half.write.mode("append").parquet(log)
        run().awaitTermination()
    last = last_lines_of(spark, out, 20)
    return audit_log.triage(last.select(F.col("position").alias("line_no"), F.col("line").alias("value")))
