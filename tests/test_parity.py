"""Every parity operator must notice a planted difference."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from carryover.operators import digest as D
from carryover.operators import merge as M
from carryover.operators import parity as P
from carryover.spec import ColumnInfo, TableClass, TableSpec, written_columns

SPEC = TableSpec("t", columns={"id": ColumnInfo("bigint"), "name": ColumnInfo("varchar", length=20), "at": ColumnInfo("datetime")},
                 renames={"name": "n", "at": "a"}, key=("id",))
ROWS = [(1, "Santé", "2020-01-01 10:00:00"), (2, None, None), (3, "x", "2021-02-03 00:00:00")]


@pytest.fixture()
def src(spark):
    return spark.createDataFrame(ROWS, "id bigint, n string, s string").select("id", "n", F.col("s").cast("timestamp_ntz").alias("a"))


def state(df):
    return {r.column_name: r.rows for r in df.collect()}


def test_faithful_copy_passes(src):
    assert set(state(P.copy_value_parity(src, src.select(*written_columns(SPEC)), SPEC)).values()) == {0}


@pytest.mark.parametrize("column, change", [
    ("name", "if(id = 1, 'Sante', name)"), ("name", "if(id = 3, 'x ', name)"), ("name", "if(id = 2, '', name)"),
    ("name", "if(id = 3, 'X', name)"), ("at", "if(id = 3, NULL, at)")])
def test_one_changed_value_is_found(src, column, change):
    bad = src.select(*written_columns(SPEC)).withColumn(column, F.expr(change))
    got = state(P.copy_value_parity(src, bad, SPEC))
    assert got[column] == 1 and got["(row)"] == 1 and got["(missing)"] == 0
    assert P.mismatch_keys(src, bad, SPEC).count() == 1


def test_missing_row_is_found(src):
    assert state(P.copy_value_parity(src, src.select(*written_columns(SPEC)).where("id <> 2"), SPEC))["(missing)"] == 1


def test_table_without_key_is_not_passed(src):
    row = P.copy_value_parity(src, src.select(*written_columns(SPEC)), replace(SPEC, key=())).first()
    assert row.state.startswith("not checked")


def test_multiset_sees_value_and_multiplicity(src):
    spec = replace(SPEC, key=())
    good = src.select(*written_columns(spec))
    assert P.multiset_parity(src, good.repartition(5), spec).first().status == "verified"
    assert P.multiset_parity(src, good.withColumn("name", F.upper("name")), spec).first().status == "content differs"
    assert P.multiset_parity(src, good.union(good.where("id = 1")), spec).first().status == "rows differ"
    assert P.multiset_offenders(src, good.union(good.where("id = 1")), spec).first().side == "target only"


def test_swapped_values_change_the_digest(spark):
    a = spark.createDataFrame([("1", "23"), ("~", None)], "x string, y string")
    for rows in ([("12", "3"), ("~", None)], [("1", "23"), (None, "~")], [("1", "23"), ("~", "~")]):
        b = spark.createDataFrame(rows, "x string, y string")
        assert D.table_digest(a).first() != D.table_digest(b).first()


def test_digest_refuses_what_it_cannot_render(spark):
    with pytest.raises(D.Unrenderable):
        D.table_digest(spark.createDataFrame([(1.5,)], "d double"))
    with pytest.raises(D.Unrenderable):
        D.table_digest(spark.createDataFrame([([1],)], "d array<int>"))


def test_unrendered_value_is_unhashed_not_agreed(spark):
    df = spark.createDataFrame([(1e300,), (2.0,), (None,)], "d double")
    row = D.table_digest(df, scales={"d": 2}).first()
    assert (row.rows, row.unhashed) == (3, 1)


def test_empty_table_digest(spark):
    assert tuple(D.table_digest(spark.createDataFrame([], "a int")).first()) == (0, "0", 0, 0)


def test_sum_lane_equals_plain_arithmetic(spark):
    import hashlib
    hashes = [hashlib.sha256(f"{len(str(i))}:{i}".encode()).hexdigest() for i in range(500)]
    row = D.table_digest(spark.range(500)).first()
    assert int(row.total) == sum(int(h[:16], 16) for h in hashes)
    parity = 0
    for h in hashes:
        parity ^= int(h[16:32], 16)
    assert row.parity % 2**64 == parity


MERGE = TableSpec("m", TableClass.MERGE, columns={"id": ColumnInfo("bigint"), "k": ColumnInfo("varchar", collation="ci"), "v": ColumnInfo("int")},
                  key=("id",), merge_keys=("k",), surrogate_pk="id", archived={"import_archived_w": "w"})


@pytest.fixture()
def merge(spark):
    src = spark.createDataFrame([(1, "A", 1, None), (2, "a ", 2, "z"), (3, "B", 3, "y"), (4, "B", 4, None), (5, None, 5, "n")],
                                "id bigint, k string, v int, w string")
    seed = spark.createDataFrame([(10, "a", 0, None)], "id bigint, k string, v int, import_archived_w string")
    live, _, _ = M.merge_seed_wins(src, seed, MERGE)
    live = M.archived_backfill(live, seed, src, MERGE, ["id"])
    return src, seed, live, M.idmap_twins(src, live, MERGE)


def claims(src, seed, live, idmap):
    return {r.claim: r.rows for r in P.merge_parity(src, live, seed, idmap, MERGE).collect()}


def test_merge_is_proven(merge):
    src, seed, live, idmap = merge
    assert {(r.id, r.k, r.v, r.import_archived_w) for r in live.collect()} == {
        (10, "a", 0, "z"), (11, "B", 3, "y"), (12, "B", 4, None), (13, None, 5, "n")}
    assert {r.old_id: r.new_id for r in idmap.collect()} == {1: 10, 2: 10, 3: 11, 4: 12, 5: 13}
    assert set(claims(src, seed, live, idmap).values()) == {0}
    row = P.archived_column_parity(src, live, seed, MERGE).first()
    assert (row.source_values, row.twin_surplus, row.live_values, row.state) == (3, 0, 3, "pass")


@pytest.mark.parametrize("claim, change", [
    ("seed unchanged", lambda d: d.withColumn("v", F.when(F.col("id") == 10, 9).otherwise(F.col("v")))),
    ("seed unchanged", lambda d: d.where("id <> 10")),
    ("appended as written", lambda d: d.withColumn("v", F.when(F.col("id") == 12, 9).otherwise(F.col("v")))),
    ("losers archived", lambda d: d.withColumn("import_archived_w", F.when(F.col("id") == 10, "q").otherwise(F.col("import_archived_w"))))])
def test_merge_damage_is_found(merge, claim, change):
    src, seed, live, idmap = merge
    assert claims(src, seed, change(live), idmap)[claim] == 1


def test_one_sided_totals_are_not_compared(src):
    got = P.group_totals_parity(src, None, F.year("a"), F.col("id"))
    assert {r.state for r in got.collect()} == {"not compared"}
