"""Access matrices: which template a custom group resembles, and what changed in the matrix.

A matrix is a frame (grp, object, privilege). Names compare folded, privileges as
stored apart from surrounding blanks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.functions.text import fold
from carryover.operators.ordinals import in_order, with_group_ordinal
from carryover.operators.skew import lookup, one_per_key
from carryover.session import materialise

# Group names that are not roles (digits, everybody, queues).
NON_GROUP = r"(?i)^(-?[0-9]+|_all|_queue\..*)$"


def is_group(name: Column) -> Column:
    return F.coalesce((name != "") & ~F.regexp_like(name, F.lit(NON_GROUP)), F.lit(False))


def pairs(matrix: DataFrame) -> DataFrame:
    """Distinct folded (grp, object, privilege) of a matrix: the set a group is compared by."""
    return matrix.select(fold(F.col("grp")).alias("grp"), fold(F.col("object")).alias("object"),
                         F.trim(F.coalesce("privilege", F.lit(""))).alias("privilege")).distinct()


def jaccard_scores(custom: DataFrame, stock: DataFrame) -> DataFrame:
    """(custom, template, shared, score) for pairs of groups that share anything.

    A pair meets once per (object, privilege) both hold, and the meetings are counted
    map-side: no list of groups is ever gathered and nothing but counts is shuffled.
    """
    c, s = pairs(custom), pairs(stock)
    c_size = c.groupBy("grp").agg(F.count(F.lit(1)).alias("_c"))
    s_size = s.groupBy("grp").agg(F.count(F.lit(1)).alias("_s"))
    shared = (c.select(F.col("grp").alias("custom"), "object", "privilege")
              .join(s.select(F.col("grp").alias("template"), "object", "privilege"), ["object", "privilege"])
              .groupBy("custom", "template").agg(F.count(F.lit(1)).alias("shared")))
    sized = (shared.join(c_size.withColumnRenamed("grp", "custom"), "custom")
             .join(s_size.withColumnRenamed("grp", "template"), "template"))
    union = F.col("_c") + F.col("_s") - F.col("shared")
    return sized.select("custom", "template", "shared", union.alias("union"),
                        (F.col("shared") / union).alias("score"))


def _closest(scores: DataFrame) -> DataFrame:
    """For each custom group the template with the highest score, ties by name."""
    return one_per_key(scores, ["custom"], F.struct((-F.col("score")).alias("a"), F.col("template").alias("b")),
                       ["template", "shared", "union", "score"], largest=False)


@dataclass
class Round:
    """One threshold of :func:`closest_templates`: groups that went in, pairs looked at, groups settled."""

    threshold: float
    groups: int
    candidates: int
    settled: int


def closest_templates(custom: DataFrame, stock: DataFrame, thresholds: Sequence[float] = (0.8, 0.5, 0.2)) -> tuple[DataFrame, list[Round]]:
    """(custom, template, shared, union, score) of the closest template, without meeting all pairs.

    At a threshold t, two sets whose Jaccard score reaches t share one of their rarest
    (object, privilege) pairs: of n pairs, the first n - ceil(t n) + 1 in the order rare to frequent.
    Only these prefixes meet, and a pair of groups stays a candidate if its sizes and the places
    of the first pair they share leave room for t. Candidates are counted in full, once. A group
    whose best score reaches t is settled, since no better one can be missing; the others go on to
    the next lower threshold. What shares little with every template is met in full at the end.
    """
    spark = custom.sparkSession
    c, s = pairs(custom), pairs(stock)
    both = c.select("object", "privilege").unionByName(s.select("object", "privilege"))
    ranked = in_order(both.groupBy("object", "privilege").agg(F.count(F.lit(1)).alias("_n")), [F.col("_n").asc(), F.col("object").asc(), F.col("privilege").asc()], "_item")

    def placed(side: DataFrame, name: str) -> DataFrame:
        items = with_group_ordinal(side.join(ranked.select("object", "privilege", "_item"), ["object", "privilege"]), ["grp"], "_item", "_at")
        size = side.groupBy("grp").agg(F.count(F.lit(1)).alias("_size"))
        return materialise(items.join(size, "grp").select(F.col("grp").alias(name), "_item", F.col("_at").alias(f"_{name}_at"), F.col("_size").alias(f"_{name}_size")), name)

    mine, theirs = placed(c, "custom"), placed(s, "template")
    mine_size, theirs_size = F.col("_custom_size"), F.col("_template_size")
    open_groups, best, rounds = materialise(mine.select("custom").distinct(), "open"), [], []
    prefix = lambda name, t: F.col(f"_{name}_at") <= F.col(f"_{name}_size") - F.ceil(F.col(f"_{name}_size") * t - 1e-9) + 1
    for t in sorted(thresholds, reverse=True):
        left = mine.join(open_groups, "custom", "left_semi")
        fits = (theirs_size >= mine_size * t - 1e-9) & (mine_size >= theirs_size * t - 1e-9)
        met = (left.where(prefix("custom", t)).join(theirs.where(prefix("template", t)), "_item").where(fits)
               .groupBy("custom", "template", "_custom_size", "_template_size").agg(F.min("_custom_at").alias("_c"), F.min("_template_at").alias("_s")))
        # the first pair both hold stands at the smallest place on either side; at most what comes after it is shared too
        room = F.least(mine_size - F.col("_c"), theirs_size - F.col("_s")) + 1
        candidates = materialise(met.where(room >= (mine_size + theirs_size) * (t / (1 + t)) - 1e-9), "candidates")
        shared = (candidates.join(left.select("custom", "_item"), "custom").join(theirs.select("template", "_item"), ["template", "_item"])
                  .groupBy("custom", "template", "_custom_size", "_template_size").agg(F.count(F.lit(1)).alias("shared")))
        union = mine_size + theirs_size - F.col("shared")
        scored = shared.select("custom", "template", "shared", union.alias("union"), (F.col("shared") / union).alias("score"))
        settled = materialise(_closest(scored.where(F.col("score") >= t)), "settled")
        rounds.append(Round(t, open_groups.count(), candidates.count(), settled.count()))
        best.append(settled)
        open_groups = materialise(open_groups.join(settled.select("custom"), "custom", "left_anti"), "open")
    rest = c.join(open_groups.withColumnRenamed("custom", "grp"), "grp", "left_semi")
    out = _closest(jaccard_scores(rest, stock)) if not open_groups.isEmpty() else spark.createDataFrame([], best[0].schema)
    for part in best:
        out = out.unionByName(part)
    return out, rounds


def jaccard_template(custom: DataFrame, stock: DataFrame, floor: float, *, guarded: Sequence[str] = (),
                     guarded_floor: float = 0.5, override: dict[str, str] | None = None, best: DataFrame | None = None) -> DataFrame:
    """For each custom group the closest stock group, ties by name, NULL below the floor.

    A guarded (administrative) template needs ``guarded_floor``. An operator's override wins.
    ``best`` is what :func:`closest_templates` found; without it all groups meet.
    """
    groups = pairs(custom).select(F.col("grp").alias("custom")).distinct()
    if best is None:
        best = _closest(jaccard_scores(custom, stock))
    joined = groups.join(best, "custom", "left")
    needed = F.when(F.col("template").isin(*[g.lower() for g in guarded]), F.lit(max(floor, guarded_floor))) \
        .otherwise(F.lit(floor)) if guarded else F.lit(floor)
    chosen = F.when(F.col("score") >= needed, F.col("template"))
    if override:
        table = F.create_map(*[F.lit(x) for a, b in override.items() for x in (a.lower(), b.lower())])
        chosen = F.coalesce(table[F.col("custom")], chosen)
    return joined.select("custom", chosen.alias("template"), F.coalesce("shared", F.lit(0).cast("bigint")).alias("shared"),
                         F.coalesce("union", F.lit(0).cast("bigint")).alias("union"))


def era_objects(seed: DataFrame, catalogue: DataFrame, staged: DataFrame) -> DataFrame:
    """Objects the seed grants that the source never knew, in its catalogue or in any grant."""
    known = (catalogue.select(fold(F.col("object")).alias("_o")).unionByName(
        staged.select(fold(F.col("object")).alias("_o"))).distinct())
    return (seed.select("object").distinct().withColumn("_o", fold(F.col("object")))
            .join(known, "_o", "left_anti").select("object"))


def custom_groups(target: DataFrame, staged: DataFrame, stock: DataFrame) -> DataFrame:
    """(grp, state): custom groups with imported grants, and names set aside because they are no groups."""
    granted = staged.where(is_group(F.col("grp"))).select(fold(F.col("grp")).alias("_f")).distinct().withColumn(
        "_granted", F.lit(True))
    known = stock.select(fold(F.col("grp")).alias("_f")).distinct().withColumn("_stock", F.lit(True))
    names = target.select("grp").distinct().withColumn("_f", fold(F.col("grp")))
    joined = names.join(granted, "_f", "left").join(known, "_f", "left")
    state = (F.when(~is_group(F.col("grp")), "not a group")
             .when(F.col("_granted") & F.col("_stock").isNull(), "custom"))
    return joined.select("grp", state.alias("state")).where(F.col("state").isNotNull())


def grant_backfill(live: DataFrame, templates: DataFrame, seed: DataFrame, era: DataFrame) -> DataFrame:
    """Era grants of each custom group's template that the group lacks: the rows to add."""
    offered = seed.withColumn("_f", fold(F.col("grp"))).join(era.select("object").distinct(), "object", "left_semi")
    wanted = templates.where(F.col("template").isNotNull()).select("custom", F.col("template").alias("_f"))
    new = wanted.join(offered, "_f").select(F.col("custom").alias("grp"), "object", "privilege")
    held = live.select(fold(F.col("grp")).alias("_g"), fold(F.col("object")).alias("_o")).distinct()
    return (new.withColumn("_g", fold(F.col("grp"))).withColumn("_o", fold(F.col("object")))
            .join(held, ["_g", "_o"], "left_anti").groupBy("grp", "object").agg(F.min("privilege").alias("privilege")))


def matrix_diff(source: DataFrame, seed: DataFrame, target: DataFrame, *, source_groups: DataFrame,
                target_groups: DataFrame, stock: DataFrame, excluded: Column, custom: DataFrame) -> DataFrame:
    """Itemised changes (grp, object, change) over one full join of the three matrices.

    overridden: the seed holds another privilege; excluded: the merge left the grant
    behind; restored: a seed grant on a group the source has but never gave it;
    appended-role: the same on a group the source lacks; backfilled: added to a custom
    group; stock-append: a source grant that widens a stock group.
    """
    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy("grp", "object").agg(F.min("privilege").alias(name))

    left_out = source.select("grp", "object", F.coalesce(excluded, F.lit(False)).alias("_x")).groupBy(
        "grp", "object").agg(F.max("_x").alias("_excluded"))
    cells = (side(source, "_s").join(side(seed, "_d"), ["grp", "object"], "full_outer")
             .join(side(target, "_t"), ["grp", "object"], "full_outer").join(left_out, ["grp", "object"], "left"))

    # one row per group with everything known about it, so the cells are looked up once
    known = None
    for names, label in ((source_groups, "_in_source"), (target_groups, "_in_target"), (stock, "_stock"),
                         (custom, "_custom")):
        row = names.select("grp", F.lit(label).alias("_label"))
        known = row if known is None else known.unionByName(row)
    marks = known.groupBy("grp").agg(*[F.max(F.when(F.col("_label") == m, True)).alias(m)
                                       for m in ("_in_source", "_in_target", "_stock", "_custom")])
    groups = source.select("grp").unionByName(seed.select("grp")).unionByName(target.select("grp"))
    cells = lookup(cells, marks, [("grp", "grp")], scatter=["object"], counted=groups)
    in_s, in_d, in_t = F.col("_s").isNotNull(), F.col("_d").isNotNull(), F.col("_t").isNotNull()
    changes = F.array_compact(F.array(
        F.when(in_s & in_d & ~F.col("_s").eqNullSafe(F.col("_d")), "overridden"),
        F.when(F.col("_excluded"), "excluded"),
        F.when(in_d & ~in_s & F.col("_in_source"), "restored"),
        F.when(in_d & ~in_s & F.col("_in_source").isNull() & F.col("_in_target"), "appended-role"),
        F.when(in_t & ~in_s & F.col("_custom"), "backfilled"),
        F.when(in_s & ~in_d & F.col("_stock") & ~F.coalesce("_excluded", F.lit(False)), "stock-append")))
    return cells.select("grp", "object", F.explode(changes).alias("change"))


def matrix_integrity(groups: DataFrame, grants: DataFrame, members: DataFrame, links: DataFrame, *,
                     guaranteed: Sequence[str], floor: int) -> DataFrame:
    """Invariants and advisories: (check_name, severity, rows), zero rows meaning it holds.

    ``members`` has member, grp and active; ``links`` has member.
    """
    names = groups.select(fold(F.col("grp")).alias("_f")).distinct()
    granting = grants.select(F.col("grp")).distinct()
    wanted = F.array(*[F.lit(g.lower()) for g in guaranteed])
    lost = names.agg(F.size(F.array_except(wanted, F.collect_set(F.when(F.array_contains(wanted, F.col("_f")),
                                                                        F.col("_f"))))).cast("bigint").alias("rows"))
    active = members.where(F.col("active") == 1)
    with_grant = lookup(active, granting, [("grp", "grp")], scatter=["member"], how="left_semi").select("member").distinct()
    people = active.select("member").distinct()
    spelled = granting.withColumn("_f", fold(F.col("grp"))).groupBy("_f").agg(F.min("grp").alias("_s"))
    drift = lookup(active.withColumn("_f", fold(F.col("grp"))), spelled, [("_f", "_f")], scatter=["member"])

    def counted(frame: DataFrame) -> DataFrame:
        return frame.agg(F.count(F.lit(1)).alias("rows"))

    checks = [("guaranteed group missing", "blocker", lost),
              ("active member without a grant", "blocker", counted(people.join(with_grant, "member", "left_anti"))),
              ("active member not linked", "blocker", counted(people.join(links.select("member").distinct(), "member",
                                                                          "left_anti"))),
              ("grants below the seed floor", "blocker",
               counted(grants).select(F.greatest(F.lit(floor) - F.col("rows"), F.lit(0)).cast("bigint").alias("rows"))),
              ("member group spelled differently", "blocker", counted(drift.where(F.col("_s") != F.col("grp")))),
              ("group granting nothing", "advisory",
               counted(groups.select("grp").distinct().join(granting, "grp", "left_anti"))),
              ("comma in a group name", "advisory",
               counted(groups.select("grp").distinct().where(F.contains("grp", F.lit(",")))))]
    out = None
    for name, severity, frame in checks:
        row = frame.select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), "rows")
        out = row if out is None else out.unionByName(row)
    return out
