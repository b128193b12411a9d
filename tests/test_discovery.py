"""Keys, differing ranges, rule tables and the end of a live log against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from carryover import session
from carryover.operators import ranges as R
from carryover.operators.parity import mismatch_keys
from carryover.operators.rules import prefix_join
from carryover.sources import keys as K
from carryover.sources.catalog import catalog_profile
from carryover.spec import ColumnInfo, TableSpec
from carryover.streaming import tail
from tools import check
from workload import ORACLES, QUERIES
from workload.roles import BASE


def brute_keys(rows, names, longest):
    full = [i for i in range(len(names)) if all(r[i] is not None for r in rows)]
    found = []
    for size in range(1, longest + 1):
        for chosen in combinations(full, size):
            if not any(set(f) <= set(chosen) for f in found) and len({tuple(r[i] for i in chosen) for r in rows}) == len(rows):
                found.append(chosen)
    return {tuple(names[i] for i in f) for f in found} if rows else set()


@pytest.mark.parametrize("seed,first,slice_", [(1, 5_000, 1_000_000), (2, 7, 60), (3, 20, 40)])
def test_minimal_keys(spark, seed, first, slice_, monkeypatch):
    monkeypatch.setattr(K, "FIRST", first)
    monkeypatch.setattr(K, "SLICE", slice_)  # a table above it is sketched first
    draw = random.Random(seed)
    names = ["a", "b.c", "s", "s2", "n"]
    rows = list({(draw.randrange(12), draw.randrange(9), draw.choice("xyzé"), str(draw.randrange(40)), draw.choice([1, None]) if i % 50 == 0 else i % 7) for i in range(150)})
    df = spark.createDataFrame(rows, "a int, `b.c` bigint, s string, s2 string, n int").repartition(3)
    for longest in (1, 2, 4):
        n, got = K.minimal_keys(df, longest)
        assert n == len(rows) and set(got) == brute_keys(rows, names, longest)
    repeated = df.unionByName(df.limit(1))
    assert K.minimal_keys(repeated.select("a", "s"), 2)[1] == [] and K.minimal_keys(repeated)[1] == []


def test_few_sets_are_counted_over_all_rows(spark, monkeypatch):
    """Sets of three and four columns that almost are keys are looked up on the repeats of a pair."""
    counted = []
    count = K._Repeats.count
    monkeypatch.setattr(K._Repeats, "count", lambda self, sets, keep: counted.extend(sets) or count(self, sets, keep))
    draw = random.Random(4)
    names = list("abcdefgh")
    rows = [(i // 4, draw.randrange(2000), *(draw.randrange(n) for n in (900, 50, 40, 30, 11, 9))) for i in range(20_000)]
    n, got = K.minimal_keys(spark.createDataFrame(rows, names).repartition(3), 4)
    assert n == len(rows) and set(got) == brute_keys(rows, names, 4)
    assert len(got) > len(counted) and len(counted) < 15


def test_keys_of_odd_tables(spark):
    maps = spark.createDataFrame([(1, {"a": 1}, [1.0]), (2, {"a": 1}, [1.0])], "i int, m map<string,int>, v array<double>")
    tables = {"maps": maps, "none": maps.limit(0), "one": maps.limit(1), "null": spark.createDataFrame([(None,), (None,)], "x int"), "only": maps.select("m")}
    got = {(r.table_name, tuple(r.key_columns)): r.preferred for r in K.key_candidates(spark, tables).collect()}
    assert got == {("maps", ("i",)): True, ("one", ("i",)): True, ("one", ("v",)): False}


SPEC = TableSpec("t", columns={"k": ColumnInfo("bigint"), "v": ColumnInfo("varchar", length=9), "d": ColumnInfo("double")}, key=("k",))
SCHEMA = "k bigint, v string, d double"


def found(src, tgt, spec, **how):
    rows, ranges, levels = R.difference_ranges(src, tgt, spec, **how)
    return sorted(map(tuple, rows.collect()), key=repr), ranges, levels


@pytest.mark.parametrize("key", ["number", "text"])
def test_difference_ranges(spark, key, tmp_path):
    draw = random.Random(5)
    rows = [(k * 7 - 9000, f"v{k % 5}", float(k % 3)) for k in range(6000)]
    changed = {draw.randrange(2000, 2100) for _ in range(12)}
    copy = [(k, v, d + (i in changed)) for i, (k, v, d) in enumerate(rows) if i != 2050] + [(10 ** 12, "x", 0.0)]
    if key == "text":
        rows, copy = ([(f"Key{k}", v, d) for k, v, d in side] for side in (rows, copy))
        copy = [(k.upper() + "  ", v, d) for k, v, d in copy]  # equal under the target's comparison
        spec = TableSpec("t", columns={**SPEC.columns, "k": ColumnInfo("varchar", length=30, collation="ci")}, key=("k",))
        schema = SCHEMA.replace("k bigint", "k string")
    else:
        spec, schema = SPEC, SCHEMA
    src = spark.createDataFrame(rows, schema).repartitionByRange(8, "k")
    tgt = spark.createDataFrame(copy, schema)
    if key == "number":
        src.write.parquet(f"{tmp_path}/src")
        src = spark.read.parquet(f"{tmp_path}/src")
        got, ranges, levels = found(src, tgt, spec, small_rows=50, level_bits=5)
        want = [(rows[i][0], "differs") for i in changed - {2050}] + [(rows[2050][0], "missing"), (10 ** 12, "surplus")]
        assert got == sorted(want, key=repr)
        # after the first round only unequal ranges are read, and at last no more than they hold
        assert len(levels) > 3 and levels[0].source_rows == 6000 and levels[1].source_rows < 6001 and levels[-1].source_rows < 400
        assert ranges.agg(F.max("source_rows")).first()[0] <= 50 and all(a.shift > b.shift for a, b in zip(levels, levels[1:]))
        sides = R.sides(src, tgt, spec)
        unequal, shift, _ = R.unequal_ranges(*sides, small_rows=50, level_bits=5)
        plan = sides[0].within(unequal, shift)._jdf.queryExecution().toString()
        assert "GreaterThanOrEqual(k" in plan and len(sides[0].intervals) <= R.INTERVALS
    else:
        # a key in another spelling is paired, and is itself a difference
        got, _, _ = found(src, tgt, spec, small_rows=50, level_bits=5)
        assert {s for _, s in got} == {"differs", "missing", "surplus"} and len(got) == 6001
    assert sorted(r.k for r in mismatch_keys(src, tgt, spec, limit=10 ** 6).collect()) == sorted(k for k, s in got if s != "surplus")


def test_difference_ranges_of_odd_copies(spark):
    rows = [(1, "a", 0.0), (2, None, float("nan")), (3, "", None), (None, "n", 1.0)]
    src = spark.createDataFrame(rows, SCHEMA)
    same = spark.createDataFrame([(1, "a", -0.0), *rows[1:]], SCHEMA)
    assert found(src, same, SPEC)[0] == [] and found(src.limit(0), same.limit(0), SPEC)[0] == []
    assert found(src, same.limit(0), SPEC)[0] == [(1, "missing"), (2, "missing"), (3, "missing"), (None, "missing")]
    assert found(src.limit(0), same, SPEC)[0] == [(1, "surplus"), (2, "surplus"), (3, "surplus"), (None, "surplus")]
    # NULL against empty, a number stored as text, a column more
    other = spark.createDataFrame([(1, "a", "0", 9), (2, "", "NaN", 9), (3, "", None, 9), (None, "n", "1.0", 9)], "k bigint, v string, d string, _place int")
    assert found(src, other, SPEC)[0] == [(2, "differs")]
    twice = same.unionByName(same.where("k = 1").withColumn("v", F.lit("b")))
    assert found(src, twice, SPEC)[0] == [(1, "differs")]
    changed = {"v": (F.col("k") == 1, F.lit("z"))}
    assert found(src, same, SPEC, overrides=changed)[0] == [(1, "differs")]
    with pytest.raises(ValueError):
        R.sides(src, same, TableSpec("t", columns=SPEC.columns))


def test_prefix_join(spark):
    draw = random.Random(2)
    word = lambda most: "".join(draw.choice("aébA") for _ in range(draw.randint(0, most)))
    rules = list({(word(5), draw.randrange(30), word(3)) for _ in range(200)}) + [(None, 0, "never")]
    keys = [(i, word(8), "p") for i in range(500)] + [(900, None, "p"), (901, "", "p")]
    df = spark.createDataFrame(keys, "i int, k string, prefix string")
    table = spark.createDataFrame(rules, "prefix string, no int, what string")
    for order in (None, "no"):
        got = {r.i: r.what for r in prefix_join(df, "k", table, ["what"], order=order).collect()}
        want = {}
        for i, k, _ in keys:
            hits = [r for r in rules if k is not None and r[0] is not None and k.startswith(r[0])]
            if order:
                firsts = {p: min((n, w) for q, n, w in hits if q == p) for p in {h[0] for h in hits}}
                want[i] = min(((n, -len(p), w) for p, (n, w) in firsts.items()), default=(0, 0, None))[2]
            else:
                most = max((len(h[0]) for h in hits), default=0)
                want[i] = min((h[2] for h in hits if len(h[0]) == most), default=None)
        assert got == want
    assert {r.what for r in prefix_join(df, "k", table.limit(0), ["what"]).collect()} == {None}
    assert prefix_join(df.limit(0), "k", table, ["what"]).collect() == []


def test_plan_does_not_grow_with_the_rules(spark):
    df = spark.range(2000).select(F.concat(F.lit("key."), F.col("id").cast("string")).alias("k"))
    sizes = []
    for n in (10, 100_000):
        rules = spark.range(n).select(F.concat(F.lit("key."), F.col("id").cast("string")).alias("prefix"), F.col("id").alias("what"))
        found_ = prefix_join(df, "k", rules, ["what"])
        sizes.append(len(found_._jdf.queryExecution().analyzed().toString().splitlines()))
        hit = found_.where(F.col("k") == F.concat(F.lit("key."), F.col("what").cast("string"))).count()
        assert hit == min(n, 2000)
    assert sizes[0] == sizes[1]


def test_live_tail_restarts_in_the_middle(spark, tmp_path, monkeypatch):
    log, out, checkpoint = (str(tmp_path / name) for name in ("log", "out", "checkpoint"))
    lines = [(i * 37 % 1009, f"line {i}" if i % 9 else None) for i in range(1009)] + [(None, "nowhere"), (10 ** 9, "last")]
    for i in range(6):
        spark.createDataFrame(lines[i::6], "pos bigint, value string").coalesce(1).write.mode("append").parquet(log)

    def run():
        source = spark.readStream.schema("pos bigint, value string").option("maxFilesPerTrigger", 1).parquet(log)
        return tail.last_lines_stream(source, out, checkpoint, position="pos", n=30, slots=4)

    # the third batch fails after it wrote its rows; the next run repeats it from its checkpoint
    import pyspark.sql.readwriter as writer
    plain, seen = writer.DataFrameWriter.parquet, []

    def failing(self, path, *a, **b):
        plain(self, path, *a, **b)
        if path.endswith("batch=2") and not seen:
            seen.append(path)
            raise RuntimeError("lost in the middle")

    monkeypatch.setattr(writer.DataFrameWriter, "parquet", failing)
    with pytest.raises(Exception, match="lost in the middle"):
        run().awaitTermination()
    assert seen
    run().awaitTermination()
    want = sorted(((p, v or "") for p, v in lines if p is not None), reverse=True)[:30]
    assert sorted(map(tuple, tail.last_lines_of(spark, out, 30).collect()), reverse=True) == want
    # a heap never holds more than its n lines, and an idle run changes nothing
    assert spark.read.parquet(out).groupBy("batch", "slot").count().agg(F.max("count")).first()[0] <= 30
    run().awaitTermination()
    assert tail.last_lines_of(spark, out, 30).count() == 30
    with pytest.raises(ValueError):
        tail.last_lines_stream(spark.readStream.schema("pos bigint, value string").parquet(log), out, checkpoint, position="pos", n=0)


def test_large_tables_are_counted_once_and_dealt(spark, monkeypatch):
    """Rows as a whole are not counted when few sets are left; what is counted is dealt before it is counted."""
    monkeypatch.setattr(K, "FIRST", 200)
    monkeypatch.setattr(K, "SLICE", 1000)
    monkeypatch.setattr(K, "DEALT", 3000, raising=False)
    counted, plans = [], []
    count, written = K._Repeats.count, K.materialise
    monkeypatch.setattr(K._Repeats, "count", lambda self, sets, keep: counted.extend(sets) or count(self, sets, keep))
    monkeypatch.setattr(K, "materialise", lambda df, name: plans.append((name, df._jdf.queryExecution().sparkPlan().toString())) or written(df, name))
    draw = random.Random(6)
    names = list("abcdef")
    rows = [(i // 4, i % 4, *(draw.randrange(n) for n in (50, 40, 30, 11))) for i in range(9000)]
    df = spark.createDataFrame(rows, names).repartition(3)
    assert set(K.minimal_keys(df, 2)[1]) == brute_keys(rows, names, 2) == {("a", "b")}
    assert counted and all(len(s) <= 2 for s in counted)
    assert plans and all("REPARTITION_BY_NUM" in plan for name, plan in plans if name == "repeats")
    # a row that repeats as a whole, which slices may miss: found before many sets are counted, and by counting few
    repeated = df.unionByName(df.where("a = 77 AND b = 1"))
    for few in (0, 8):
        counted.clear()
        monkeypatch.setattr(K, "FEW", few, raising=False)
        assert K.minimal_keys(repeated, 4)[1] == [] and (few or ("_0", "_1", "_2", "_3", "_4", "_5") in counted)


def test_repeats_of_large_tables_stay_small(spark, monkeypatch, tmp_path):
    """Shuffles hold one set of a large table and go when they were read; repeating rows are not found by a shuffle of the table."""
    monkeypatch.setattr(K, "FIRST", 300)
    monkeypatch.setattr(K, "SLICE", 4000)
    monkeypatch.setattr(K, "DEALT", 8_000)
    monkeypatch.setattr(K, "ENTRIES", 16_000, raising=False)
    plans, written = [], K.materialise
    monkeypatch.setattr(K, "materialise", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString(), df._jdf.queryExecution().shuffleCleanupMode().toString())) or written(df, name))
    draw = random.Random(7)
    names = list("abcdefgh")
    rows = [(i // 4, draw.randrange(2000), *(draw.randrange(n) for n in (900, 50, 40, 30, 11)), f"text {draw.randrange(9)}") for i in range(16_000)]
    df = spark.createDataFrame(rows, names).repartition(3)
    want = brute_keys(rows, names, 4)
    for found in (1_000_000, 300):  # with few hashes to a scan the repeats of a set lie in several parts
        monkeypatch.setattr(K, "FOUND", found, raising=False)
        plans.clear()
        keys = {tuple(r.key_columns) for r in K.key_candidates(spark, {"t": df}).collect()}
        assert keys == want and any(len(k) > 3 for k in keys)
        assert {"repeats", "repeated"} <= {name for name, _, _ in plans}
        assert all("RemoveShuffleFiles" in mode for *_, mode in plans)
        # one set at a time: no row is multiplied before it is dealt
        assert not any("Generate" in plan for name, plan, _ in plans if name == "repeats")
        assert all("BroadcastHashJoin" in plan and "SortMergeJoin" not in plan for name, plan, _ in plans if name == "repeated")
    assert spark.conf.get(session.REMOVAL) == "false"
    # a table that is no larger than a slice or two is not cut
    assert set(K.minimal_keys(df.where("a < 1200"), 2)[1]) == brute_keys(rows[:4800], names, 2)


def test_preferred_key_of_any_length(spark):
    """Where no key has up to four columns the search goes on; a profile shows the key."""
    names = list("abcdef")
    rows = [tuple(i >> k & 1 for k in range(5)) + (0,) for i in range(32)]
    tables = {"long": spark.createDataFrame(rows, names), "twice": spark.createDataFrame(rows + rows[:1], names),
              "short": spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], names)}
    assert {r.table_name for r in K.key_candidates(spark, tables).collect()} == {"short"}
    keys = K.key_candidates(spark, tables, onward=True)
    assert {(r.table_name, tuple(r.key_columns)) for r in keys.collect()} == {("long", tuple("abcde")), ("short", ("a",))}
    placed = K.with_key_positions(catalog_profile(tables), keys).where("key_position IS NOT NULL").collect()
    assert {(r.table_name, r.column_name, r.key_position) for r in placed} == {("short", "a", 1), *(("long", c, i) for i, c in enumerate("abcde", 1))}


def test_catalog_keys_are_of_any_length(spark, tmp_path):
    """The query shows a key of three and one of six columns, and its SQL agrees."""
    def written(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    given = "/root/testdata/sf0.001"
    for name in BASE:
        schema = spark.read.parquet(f"{given}/{name}.parquet").schema
        if name == "conversations":  # no one or two of conv_id, turn and role tell rows apart, text is the same
            written(name, [(i % 2, i // 2 % 2, "ab"[i // 4], "same") for i in range(8)], schema)
        elif name == "part":
            written(name, [(i & 1, f"n{i >> 1 & 1}", f"b{i >> 2 & 1}", f"t{i >> 3 & 1}", i >> 4 & 1, float(i >> 5 & 1)) for i in range(64)], schema)
        else:
            spark.read.parquet(f"{given}/{name}.parquet").limit(60).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.table_name, r.column_name): r.key_position for r in QUERIES["catalog_keys"](spark, str(tmp_path)).collect()}
    assert [got["conversations", c] for c in ("conv_id", "turn", "role", "text")] == [1, 2, 3, None]
    assert sorted(v for (t, _), v in got.items() if t == "part") == [1, 2, 3, 4, 5, 6]
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    ok, why, _, _ = check.compare(spark, con, str(tmp_path), "catalog_keys", QUERIES["catalog_keys"], ORACLES["catalog_keys"])
    assert ok, why
