from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from carryover.operators import ranking as R

FIELDS = "id int, person int, kind int, optout int, explicit int, edited timestamp_ntz, deleted int"
RULES = dict(pk="id", key=["person", "kind"], deleted="deleted", optout="optout", explicit="explicit", edited="edited")


def stored(spark, *rows):
    df = spark.createDataFrame(rows, "id int, person int, kind int, optout int, explicit int, e string, deleted int")
    df = df.withColumn("edited", F.col("e").cast("timestamp_ntz")).drop("e")
    return {r.id: (r.deleted, r.reason) for r in R.one_live_per_key(df, **RULES).collect()}


LIVE, GONE = (0, None), (1, "duplicate_retired")


@pytest.mark.parametrize("name, rows, wanted", [
    ("opt-out beats opt-in", [(1, 1, 1, 1, 0, "2001-01-01", 0), (2, 1, 1, 0, 1, "2020-01-01", 0)], {1: LIVE, 2: GONE}),
    ("explicit beats newer implied", [(1, 1, 1, 0, 1, "2001-01-01", 0), (2, 1, 1, 0, 0, "2020-01-01", 0)], {1: LIVE, 2: GONE}),
    ("latest edit", [(1, 1, 1, 0, 0, "2001-01-01", 0), (2, 1, 1, 0, 0, "2020-01-01", 0)], {1: GONE, 2: LIVE}),
    ("undated is oldest", [(2, 1, 1, 0, 0, None, 0), (1, 1, 1, 0, 0, "1990-01-01", 0)], {2: GONE, 1: LIVE}),
    ("higher id", [(1, 1, 1, 0, 0, None, 0), (2, 1, 1, 0, 0, None, 0)], {1: GONE, 2: LIVE}),
    ("deleted stays deleted and is not ranked", [(1, 1, 1, 0, 0, None, 0), (2, 1, 1, 1, 1, None, 1)], {1: LIVE, 2: (1, None)}),
    ("null deleted is not live", [(1, 1, 1, 0, 0, None, None)], {1: (1, "null_flag")}),
    ("undecided is retired", [(1, 1, 1, None, 0, None, 0), (2, 1, 1, 0, 0, None, 0)], {1: (1, "null_flag"), 2: LIVE}),
    ("both reasons", [(1, 1, 1, 0, None, None, 0), (2, 1, 1, 0, 1, None, 0)], {1: (1, "null_flag,duplicate_retired"), 2: LIVE}),
    ("no key part, no group", [(1, None, 1, 0, 0, None, 0), (2, None, 1, 0, 0, None, 0), (3, 1, None, 0, 0, None, 0)],
     {1: LIVE, 2: LIVE, 3: LIVE}),
    ("other type", [(1, 1, 1, 0, 0, None, 0), (2, 1, 2, 0, 0, None, 0)], {1: LIVE, 2: LIVE}),
])
def test_one_live(spark, name, rows, wanted):
    assert stored(spark, *rows) == wanted, name


def test_allocation_retries_past_taken_names(spark):
    a = spark.createDataFrame([(1, "Same"), (2, "same "), (3, "import-a-x-1-0"), (4, "IMPORT-A-X-1-1"), (5, "own"), (6, None)], "id int, n string")
    names = R.namespace({"a": (a, "id", "n", None)})
    mapping = R.allocate_names(names, "import")
    got = {r.row_id: (r.new_name, r.nonce, r.reason) for r in mapping.collect()}
    assert got[1] == ("import-a-x-1-2", 2, "collision") and got[2] == ("import-a-x-2-0", 0, "collision")
    assert got[5] == ("own", 0, "unchanged") and got[6] == (None, 0, "unchanged")
    assert {r.claim: r.rows for r in R.mapping_recheck(names, mapping, "import").collect()} == {
        "missing_or_changed": 0, "extra": 0, "policy": 0, "collision": 0, "not_unique": 0}


def test_allocation_takes_the_first_gap(spark):
    """As many numbers as there are may be taken: no round is used up for them, and no gap is passed over."""
    taken = [(i + 10, f"Import-A-x-1-{i}.PDF ") for i in range(3000) if i != 2071] + [(9001, "import-a-x-2-00.pdf"), (9002, "import-a-x-2-1.pdf"),
             (9003, "import-a-x-3-0"), (9004, "import-a-x-4-0.pdf"), (9005, "import-a-x-4-2.pdf"), (9006, "import-a-x-4-99999999999999999999.pdf"), (9007, None)]
    names = R.namespace({"a": (spark.createDataFrame([(i, "n") for i in range(1, 6)] + taken, "id int, n string"), "id", "n", None)})
    for hot in (None, 100):
        mapping = R.allocate_names(names, "import", ".pdf", hot_rows=hot)
        got = {r.row_id: (r.new_name, r.nonce) for r in mapping.where("reason = 'collision'").collect()}
        assert got == {1: ("import-a-x-1-2071.pdf", 2071), 2: ("import-a-x-2-0.pdf", 0), 3: ("import-a-x-3-0.pdf", 0), 4: ("import-a-x-4-1.pdf", 1), 5: ("import-a-x-5-0.pdf", 0)}
    assert mapping.count() == names.count()
    assert {r.claim: r.rows for r in R.mapping_recheck(names, mapping, "import", ".pdf").collect()} == {
        "missing_or_changed": 0, "extra": 0, "policy": 0, "collision": 0, "not_unique": 0}


def test_tag_that_does_not_fit_is_reported(spark):
    df = spark.createDataFrame([(1, "v", None), (123456, "v", None)], "id int, n string, d date")
    live, originals, oversized = R.disambiguate(df, "n", pk="id", order="d", year=None, width=6)
    assert [r.id for r in oversized.collect()] == [123456]
    assert {r.n for r in live.collect()} == {"v"}
    live, originals, oversized = R.disambiguate(df, "n", pk="id", order="d", year=F.year("d"), width=9)
    assert {r.n for r in live.collect()} == {"v", "-x-123456"} and originals.count() == 1 and oversized.count() == 0


def test_seed_collision(spark):
    live = spark.createDataFrame([(1, "Y19"), (2, "LOST"), (3, "y20"), (9, "keep")], "id int, code string")
    seed = spark.createDataFrame([(1, "Y19"), (2, "A01"), (3, "A02"), (4, "Y20"), (12, "A03")], "id int, code string")
    plan = {r.id: (r.action, r.new_key) for r in R.classify_seed_collisions(live, seed, "id", "code").collect()}
    assert plan == {1: ("same", None), 2: ("rehome", 13), 3: ("replace", None)}
    after, held = R.apply_seed_collisions(live, seed, R.classify_seed_collisions(live, seed, "id", "code"), live, "id")
    assert {(r.id, r.code) for r in after.collect()} == {(1, "Y19"), (2, "A01"), (3, "A02"), (4, "Y20"), (12, "A03"), (9, "keep"), (13, "LOST")}
    assert held.count() == 0


def test_seed_collision_guard_sees_microseconds(spark):
    live = spark.sql("SELECT 1 AS id, 'LOST' AS code, TIMESTAMP_NTZ '2020-01-01 00:00:00.123456' AS at")
    seed = spark.sql("SELECT 1 AS id, 'A01' AS code, TIMESTAMP_NTZ '2020-01-01' AS at")
    plan = R.classify_seed_collisions(live, seed, "id", "code")
    backup = live.withColumn("at", F.expr("TIMESTAMP_NTZ '2020-01-01 00:00:00.123457'"))
    assert R.apply_seed_collisions(live, seed, plan, backup, "id")[1].count() == 1
    assert R.apply_seed_collisions(live, seed, plan, live, "id")[1].count() == 0
