"""Hot keys: spread lookups and ranged ordinals against plain joins and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from carryover.operators import merge as M
from carryover.operators import ordinals as O
from carryover.operators import skew
from carryover.spec import ColumnInfo, TableClass, TableSpec


def skewed(spark, n=6000):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id") % 400)
    return spark.range(n).select((F.col("id") * 7 + 1).alias("pk"), key.cast("bigint").alias("k")).repartition(16)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lookup_left_matches_plain_join(spark):
    left = skewed(spark)
    right = spark.range(200).select(F.col("id").alias("kk"), (F.col("id") * 2).alias("v"))
    got = skew.lookup(left, right, [("k", "kk")], scatter=["pk"], hot_rows=300)
    assert rows(got) == rows(left.join(right, F.col("k") == F.col("kk"), "left").select("pk", "k", "v"))


def test_lookup_null_safe_semi_and_anti(spark):
    left = skewed(spark)
    right = spark.createDataFrame([(7,), (None,), (3,)], "kk bigint")
    for how in ("left_semi", "left_anti"):
        got = skew.lookup(left, right, [("k", "kk")], scatter=["pk"], how=how, null_safe=True, hot_rows=300)
        assert rows(got) == rows(left.join(right, F.col("k").eqNullSafe(F.col("kk")), how))


def test_hot_key_is_spread_over_slots(spark):
    hot = skew.hot_keys(skewed(spark), ["k"], 300).collect()
    assert len(hot) == 2 and max(r._spread for r in hot) == 7


def test_every_hot_key_is_spread(spark):
    many = spark.range(60_000).select((F.col("id") % 6000).alias("k"), "id")
    assert skew.hot_keys(many, ["k"], 5).count() == 6000


def test_ranges_follow_the_row_count(spark):
    df = spark.range(20_000).select((F.col("id") * F.col("id")).alias("pk")).repartition(7)
    cuts = O.cut_points(df, "pk", 4)
    ranged = O.with_range(df, "pk", cuts)
    assert (len(cuts.edges) - 1) * cuts.cells * cuts.pieces >= 4500 and ranged.select("_range").distinct().count() > 4096
    got = O.with_ordinal(df, "pk", rows_per_range=4)
    assert [r.ordinal for r in got.orderBy("pk").collect()] == list(range(1, 20_001))


def test_ranges_of_a_clustered_key_stay_even(spark, monkeypatch):
    """Nine of ten ids lie in a millionth of the span, in clumps; no range may hold much more than its share."""
    monkeypatch.setattr(O, "QUANTILES", 16)
    clump = (F.col("id") % 37) * 100_000 + F.col("id") / 37
    df = spark.range(60_000).select(F.when(F.col("id") % 10 < 9, clump.cast("bigint") + F.col("id") % 7).otherwise(F.col("id") * 10 ** 9).alias("raw"), "id")
    df = df.groupBy("raw").agg(F.min("id").alias("id")).withColumnRenamed("raw", "pk").repartition(7)
    total = df.count()
    cuts = O.cut_points(df, "pk", 100)
    sizes = [r["count"] for r in O.with_range(df, "pk", cuts).groupBy("_range").count().collect()]
    assert cuts.inner is not None and sum(sizes) == total and max(sizes) <= 2 * total / len(sizes) and max(sizes) <= 250
    ordered = O.with_range(df, "pk", cuts).groupBy("_range").agg(F.min("pk").alias("a"), F.max("pk").alias("b")).orderBy("_range").collect()
    assert all(x.b < y.a for x, y in zip(ordered, ordered[1:]))
    got = O.with_ordinal(df, "pk", rows_per_range=100)
    assert [r.ordinal for r in got.orderBy("pk").collect()] == list(range(1, total + 1))


def test_numbers_in_order(spark):
    df = skewed(spark)
    got = O.in_order(df, [F.col("k").asc_nulls_first(), F.col("pk").asc()], "at").orderBy("at").collect()
    key = lambda r: (-1 if r.k is None else r.k, r.pk)
    assert [key(r) for r in got] == sorted(map(key, df.collect())) and len({r["at"] for r in got}) == len(got)


def test_plain_lookup_matches_the_spread_one(spark):
    right = spark.range(200).select(F.col("id").alias("kk"), (F.col("id") * 2).alias("v"))
    plain, spread = (skew.lookup(skewed(spark), right, [("k", "kk")], scatter=["pk"], hot_rows=n) for n in (None, 300))
    assert rows(plain) == rows(spread)


def test_ordinal_is_dense_over_many_ranges(spark):
    got = O.with_ordinal(skewed(spark), "pk", rows_per_range=500)
    assert [r.ordinal for r in got.orderBy("pk").collect()] == list(range(1, 6001))


def test_ordinal_of_nothing_and_of_one(spark):
    assert O.with_ordinal(skewed(spark).where("pk < 0"), "pk").count() == 0
    assert [r.ordinal for r in O.with_ordinal(skewed(spark).where("pk = 1"), "pk").collect()] == [1]


def test_group_ordinal_with_hot_and_null_keys(spark):
    got = O.with_group_ordinal(skewed(spark), ["k"], "pk", hot_rows=200, rows_per_range=300)
    wanted = F.row_number().over(Window.partitionBy("k").orderBy("pk"))
    assert got.withColumn("w", wanted).where("w <> ordinal").count() == 0
    assert got.count() == 6000


SPEC = TableSpec("t", TableClass.MERGE, columns={"id": ColumnInfo("bigint"), "k": ColumnInfo("bigint"), "v": ColumnInfo("varchar")},
                 key=("id",), merge_keys=("k",), surrogate_pk="id")


def test_idmap_of_a_hot_twin_group(spark):
    """A third of all rows share one key the seed holds twice: the surplus falls back to the first."""
    src = skewed(spark).select(F.col("pk").alias("id"), "k", F.lit("s").alias("v"))
    seed = spark.createDataFrame([(100, 7, "a"), (101, 7, "b"), (102, None, "c")], "id bigint, k bigint, v string")
    live, added, judged = M.merge_seed_wins(src, seed, SPEC, hot_rows=300, rows_per_range=500)
    plain = src.join(seed.select(F.col("k").alias("kk")).distinct(), F.col("k").eqNullSafe(F.col("kk")), "left_anti")
    assert added.count() == plain.count()
    assert sorted(r.id for r in added.select("id").collect()) == list(range(103, 103 + plain.count()))
    idmap = {r.old_id: r.new_id for r in M.idmap_twins(src, live, SPEC, hot_rows=300).collect()}
    assert len(idmap) == 6000
    hot = [idmap[r.id] for r in src.where("k = 7").orderBy("id").collect()]
    assert hot[:2] == [100, 101] and set(hot[2:]) == {100}
    assert {idmap[r.id] for r in src.where("k IS NULL").collect()} == {102}
    assert sorted(idmap[r.id] for r in plain.collect()) == list(range(103, 103 + plain.count()))
