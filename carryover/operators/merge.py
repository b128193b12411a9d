"""Seed-wins merges, id maps, remaps and what keeps the losers' values.

Rules that hold for every function here: keys are the values the write stores,
under the target's comparison and null-safe; a source twin on a key the target
does not hold is appended like any other row; nothing is overwritten or dropped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.functions.transforms import not_null_fallback
from carryover.operators.counting import beside
from carryover.operators.ordinals import cut_points, with_group_ordinal, with_ordinal
from carryover.operators.skew import lookup, one_per_key
from carryover.spec import REMAP_PREFIX, ColumnInfo, TableSpec, key_exprs, source_expr, written, written_columns


def with_idmaps(src: DataFrame, spec: TableSpec, idmaps: Mapping[str, DataFrame], scatter: Sequence[str],
                hot_rows: int | None = None) -> DataFrame:
    """Join each parent's id map; the written expressions read ``_remap_<column>``.

    Every parent needs a map: for a table whose ids do not change that is
    :func:`identity_map`. Without one, references would silently become NULL. A map that
    is None stands for a parent that has no ids yet.
    """
    out = src
    for column, parent in spec.fk_remap.items():
        source = spec.source_of(column)
        if parent not in idmaps:
            raise KeyError(f"{spec.name}.{column}: no id map for {parent}")
        if idmaps[parent] is None:
            out = out.withColumn(REMAP_PREFIX + column, F.lit(None).cast("bigint"))
            continue
        mapped = idmaps[parent].select("old_id", F.col("new_id").alias(REMAP_PREFIX + column))
        out = lookup(out, mapped, [(source, "old_id")], scatter=scatter, hot_rows=hot_rows,
                     counted=src.select(source))
    return out


def identity_map(parent: DataFrame, spec: TableSpec) -> DataFrame:
    """The id map of a table that keeps its ids: every stored key maps to itself."""
    key = spec.source_of(spec.key[0])
    return parent.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("old_id"), F.col(key).cast("bigint").alias("new_id")).distinct()


def project_mapped(src: DataFrame, spec: TableSpec, idmaps: Mapping[str, DataFrame] | None = None,
                   scatter: Sequence[str] | None = None) -> DataFrame:
    """Source rows as the target stores them."""
    if spec.fk_remap:
        src = with_idmaps(src, spec, idmaps or {}, scatter or [spec.source_of(k) for k in spec.key])
    return src.select(*written_columns(spec))


def fk_remap(child: DataFrame, idmap: DataFrame, column: str, info: ColumnInfo | bool, scatter: Sequence[str],
             hot_rows: int | None = None) -> DataFrame:
    """Replace a reference by the parent's new id.

    An unknown one becomes NULL, stays raw where NULL is not allowed, and becomes the type's zero
    where the column may be NULL but its readers cannot hold one. ``info`` is the target
    column, or only whether it may be NULL.
    """
    if isinstance(info, bool):
        info = ColumnInfo("bigint", nullable=info)
    mapped = lookup(child, idmap.select("old_id", F.col("new_id").alias("_new")), [(column, "old_id")],
                    scatter=scatter, hot_rows=hot_rows, counted=child.select(column))
    value = F.col("_new") if info.nullable else F.coalesce("_new", F.col(column))
    if info.primitive:
        value = not_null_fallback(value, info)
    return mapped.withColumn(column, value).drop("_new")


def idmap_changed(idmap: DataFrame) -> DataFrame:
    return idmap.where(F.col("old_id") != F.col("new_id"))


@dataclass
class Judged:
    """Source rows next to the key they store, with the merge's decision about each."""

    source: DataFrame
    rows: DataFrame          # source columns, _k0.., _seeded, _excluded
    keys: list[str]
    spec: TableSpec

    @property
    def overridden(self) -> DataFrame:
        return self.rows.where(F.col("_seeded") | F.col("_excluded"))

    @property
    def appended(self) -> DataFrame:
        return self.rows.where(~F.col("_seeded") & ~F.col("_excluded"))


def judge(src: DataFrame, seed: DataFrame, spec: TableSpec, hot_rows: int | None = None) -> Judged:
    """Mark each source row: does the target hold its key already, and is it excluded."""
    excluded = F.coalesce(spec.merge_exclude(), F.lit(False)) if spec.merge_exclude else F.lit(False)
    keyed = src.select("*", *key_exprs(spec, stored=False), excluded.alias("_excluded"))
    keys = [f"_k{i}" for i in range(len(spec.merge_keys))]
    held = seed.select(*key_exprs(spec, stored=True)).distinct().withColumn("_held", F.lit(True))
    scatter = [spec.source_of(spec.surrogate_pk)] if spec.surrogate_pk else [spec.source_of(k) for k in spec.key]
    rows = lookup(keyed, held, [(k, k) for k in keys], scatter=scatter, null_safe=True, hot_rows=hot_rows,
                  counted=keyed.select(*keys))
    rows = rows.withColumn("_seeded", F.coalesce("_held", F.lit(False))).drop("_held")
    return Judged(src, rows, keys, spec)


def appended_rows(judged: Judged, seed: DataFrame, *, floor: Column | int | None = None,
                  rows_per_range: int | None = None) -> DataFrame:
    """Rows the merge inserts, with fresh surrogate ids in source-id order above every seed id.

    ``floor`` raises the starting point (above the whole source history where some
    source rows stay in the archive).
    """
    spec = judged.spec
    pk = spec.surrogate_pk
    if pk is None:
        return judged.appended.select(*written_columns(spec))
    return _with_new_ids(judged, _stored(judged.appended, spec), pk, seed, floor, rows_per_range)


def numbered_rows(judged: Judged, seed: DataFrame) -> DataFrame:
    """The source rows that the merge inserts, each with the ``_new_id`` that :func:`appended_rows` gives it."""
    rows = judged.appended.select("*", F.col(judged.spec.source_of(judged.spec.surrogate_pk)).alias("_old_id"))
    return _with_new_ids(judged, rows, "_new_id", seed)


def stored_rows(numbered: DataFrame, spec: TableSpec) -> DataFrame:
    """The rows of :func:`numbered_rows` as the target stores them, with ``_old_id``."""
    return _stored(numbered, spec, F.col("_new_id").alias(spec.surrogate_pk))


def _stored(rows: DataFrame, spec: TableSpec, *more: Column) -> DataFrame:
    return rows.select(F.col(spec.source_of(spec.surrogate_pk)).alias("_old_id"),
                       *[c for c, n in zip(written_columns(spec), _names(spec)) if n != spec.surrogate_pk], *more)


def _with_new_ids(judged: Judged, rows: DataFrame, name: str, seed: DataFrame, floor: Column | int | None = None,
                  rows_per_range: int | None = None) -> DataFrame:
    spec = judged.spec
    pk = spec.surrogate_pk
    # the source's own ids split the appended rows evenly enough, and cost one column to read
    cuts = cut_points(judged.source, spec.source_of(pk), rows_per_range)
    numbered = with_ordinal(rows, "_old_id", "_ordinal", cuts=cuts)
    base = seed.agg(F.coalesce(F.max(pk), F.lit(0))).scalar()
    if floor is not None:
        base = F.greatest(base, F.lit(floor) if isinstance(floor, int) else floor)
    return numbered.withColumn(name, base + F.col("_ordinal")).drop("_ordinal")


def _names(spec: TableSpec) -> list[str]:
    return [*spec.carried, *[c for c in spec.supplied if c not in spec.columns]]


def merge_seed_wins(src: DataFrame, seed: DataFrame, spec: TableSpec, *, hot_rows: int | None = None,
                    rows_per_range: int | None = None) -> tuple[DataFrame, DataFrame, Judged]:
    """(live table, appended rows with ``_old_id``, decisions). The seed's rows are untouched."""
    judged = judge(src, seed, spec, hot_rows)
    added = appended_rows(judged, seed, rows_per_range=rows_per_range)
    live = seed.unionByName(added.drop("_old_id"), allowMissingColumns=True)
    return live, added, judged


def merge_overridden(judged: Judged) -> DataFrame:
    """How many source rows the seed beat, were excluded, or will be appended. Taken before the write."""
    return judged.rows.agg(
        F.count_if(F.col("_seeded") & ~F.col("_excluded")).alias("beaten"),
        F.count_if(F.col("_excluded")).alias("excluded"),
        F.count_if(F.col("_seeded") | F.col("_excluded")).alias("overridden"),
        F.count_if(~F.col("_seeded") & ~F.col("_excluded")).alias("appended"))


def overridden_counts(src: DataFrame, added: DataFrame, spec: TableSpec) -> DataFrame:
    """:func:`merge_overridden` from the rows that were inserted: what was neither inserted nor excluded, the seed beat."""
    excluded = F.coalesce(spec.merge_exclude(), F.lit(False)) if spec.merge_exclude else F.lit(False)
    appended = added.agg(F.count(F.lit(1)).alias("appended"))
    both = beside(src.agg(F.count(F.lit(1)).alias("_all"), F.count_if(excluded).alias("excluded")), appended)
    return both.select((F.col("_all") - F.col("appended") - F.col("excluded")).alias("beaten"), "excluded",
                       (F.col("_all") - F.col("appended")).alias("overridden"), "appended")


def merge_idmap(judged: Judged, ids: DataFrame, seed: DataFrame, live: DataFrame) -> DataFrame:
    """:func:`idmap_twins` of a merge whose inserted rows are known: ``ids`` has their old_id and new_id.

    A key that the seed does not hold has no other target rows than its inserted twins, in the order of the
    source ids, so only the twins of seed rows are paired. An excluded twin would shift that pairing.
    """
    spec = judged.spec
    if spec.merge_exclude:
        return idmap_twins(judged.source, live, spec)
    beaten = judged.rows.where("_seeded").drop("_seeded", "_excluded", *judged.keys)
    return idmap_twins(beaten, seed, spec).unionByName(ids.select(F.col("old_id").cast("bigint"), F.col("new_id").cast("bigint")))


def idmap_twins(src: DataFrame, target: DataFrame, spec: TableSpec, *, hot_rows: int | None = None) -> DataFrame:
    """(old_id, new_id): the n-th source twin of a key pairs with the n-th target twin.

    A surplus source twin takes the target's first row of that key. Groups of any size
    are numbered in ranges, and the fallback row is looked up with spread keys.
    """
    pk = spec.surrogate_pk
    keys = [f"_k{i}" for i in range(len(spec.merge_keys))]
    source = src.select(F.col(spec.source_of(pk)).cast("bigint").alias("old_id"), *key_exprs(spec, stored=False))
    held = target.select(F.col(pk).cast("bigint").alias("new_id"), *key_exprs(spec, stored=True))
    left = with_group_ordinal(source, keys, "old_id", "_n", hot_rows=hot_rows)
    right = with_group_ordinal(held, keys, "new_id", "_m", hot_rows=hot_rows)
    right = right.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], "new_id", "_m")
    paired_on = F.col("_n") == F.col("_m")
    for i, k in enumerate(keys):
        paired_on = paired_on & F.col(k).eqNullSafe(F.col(f"_t{i}"))
    paired = left.join(right, paired_on, "left").select("old_id", *keys, "new_id")
    first = held.groupBy(*keys).agg(F.min("new_id").alias("_first"))
    mapped = lookup(paired, first, [(k, k) for k in keys], scatter=["old_id"], null_safe=True, hot_rows=hot_rows,
                    counted=source.select(*keys))
    new = F.coalesce("new_id", "_first")
    return mapped.where(new.isNotNull()).select("old_id", new.alias("new_id"))


def preseed_split(live: DataFrame, preseed: DataFrame, key: Sequence[str]) -> DataFrame:
    """The live table with ``origin``: seed where the pre-merge snapshot holds the key, appended else."""
    marks = preseed.select(*key).withColumn("_seed", F.lit(True))
    return (live.join(marks, list(key), "left")
            .withColumn("origin", F.when(F.col("_seed"), "seed").otherwise("appended")).drop("_seed"))


def backfill_values(src: DataFrame, spec: TableSpec) -> DataFrame:
    """One source row per stored key: NULLs last, then the smallest archived value.

    Keys are ``_k0..``; a min over an ordering struct, so twins never meet in one task.
    """
    keys = [f"_k{i}" for i in range(len(spec.merge_keys))]
    keyed = src
    if spec.merge_exclude:
        keyed = keyed.where(~F.coalesce(spec.merge_exclude(), F.lit(False)))
    keyed = keyed.select(*key_exprs(spec, stored=False), *[F.col(s).alias(t) for t, s in spec.archived.items()])
    order = F.struct(*[part for t in sorted(spec.archived)
                       for part in (F.col(t).isNull().alias(f"{t}_n"), F.col(t).alias(t))])
    return one_per_key(keyed, keys, order, list(spec.archived), largest=False)


def archived_backfill(live: DataFrame, preseed: DataFrame, src: DataFrame, spec: TableSpec,
                      key: Sequence[str]) -> DataFrame:
    """Fill archived columns of seed rows that beat a source row, from one source twin per key.

    Appended rows keep what their own insert stored.
    """
    marked = preseed_split(live, preseed, key)
    keyed = marked.select("*", *key_exprs(spec, stored=True))
    keys = [f"_k{i}" for i in range(len(spec.merge_keys))]
    values = backfill_values(src, spec).select(
        *keys, *[F.col(t).alias(f"_b_{t}") for t in spec.archived], F.lit(True).alias("_twin"))
    joined = lookup(keyed, values, [(k, k) for k in keys], scatter=list(key), null_safe=True)
    takes = (F.col("origin") == "seed") & F.coalesce("_twin", F.lit(False))
    filled = [F.when(takes, F.col(f"_b_{t}")).otherwise(F.col(t)).alias(t) if t in spec.archived else F.col(t)
              for t in live.columns]
    return joined.select(*filled)


def insert_if_absent(present: DataFrame, wanted: DataFrame, name: str, pk: str, order: str,
                     fold_name) -> DataFrame:
    """Rows of ``wanted`` whose folded name is absent, with fresh ids in the order given."""
    have = present.select(fold_name(F.col(name)).alias("_f")).distinct()
    lost = wanted.withColumn("_f", fold_name(F.col(name))).join(have, "_f", "left_anti").drop("_f")
    numbered = with_ordinal(lost, order, "_ordinal", cuts=cut_points(wanted, order))
    base = present.agg(F.coalesce(F.max(pk), F.lit(0))).scalar()
    return numbered.withColumn(pk, base + F.col("_ordinal")).drop("_ordinal")


def default_link(entities: DataFrame, links: DataFrame, parents: DataFrame, entity: str, parent: str,
                 enabled: Column) -> DataFrame:
    """(entity, parent) for entities without a link: the first enabled parent, one row."""
    first = parents.where(enabled).agg(F.min(parent)).scalar()
    unlinked = entities.select(entity).join(links.select(entity).distinct(), entity, "left_anti")
    return unlinked.select(entity, first.alias(parent)).where(F.col(parent).isNotNull())


def synthesise_membership(entities: DataFrame, members: DataFrame, activity: DataFrame, roles: DataFrame, *,
                          entity: str, parent: str, fixed_parent: int, held: DataFrame,
                          preferred: str) -> DataFrame:
    """(entity, parent, role, source) for entities that belong nowhere.

    Parents are the fixed one and those the entity's own activity names. The role is
    the best it holds (preferred name, then most grants, then lowest id), or the
    least privileged of all. ``roles`` has role_id, role_name and grants; ``held`` has
    the entity and role_id.
    """
    outside = entities.select(entity).join(members.select(entity).distinct(), entity, "left_anti")
    named = activity.where(F.col(parent).isNotNull()).select(entity, parent).distinct()
    own = outside.join(named, entity)
    parents = (outside.select(entity, F.lit(fixed_parent).cast(dict(named.dtypes)[parent]).alias(parent))
               .unionByName(own.select(entity, parent)).distinct())
    ranked = lookup(held.select(entity, "role_id").distinct(), roles, [("role_id", "role_id")], scatter=[entity],
                    how="inner")
    best = one_per_key(ranked, [entity], F.struct((F.col("role_name") == preferred).alias("p"), F.col("grants"),
                                                  (-F.col("role_id")).alias("i")), ["role_id"])
    least = roles.agg(F.min_by("role_id", F.struct("grants", "role_id"))).scalar()
    chosen = parents.join(best, entity, "left").withColumn("_least", least)
    return chosen.select(entity, parent, F.coalesce("role_id", "_least").alias("role_id"),
                         F.when(F.col("role_id").isNull(), "least privileged").otherwise("own role").alias("source"))


def conditional_activate(rows: DataFrame, live_a: DataFrame, live_b: DataFrame, entity: str, flag: str,
                         reserved: Column, scatter: Sequence[str]) -> DataFrame:
    """Set the flag on NULL rows whose owner is live in both tables, except reserved ones.

    Adds ``outcome``: activated, reserved, owner not live, or kept.
    """
    def mark(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(entity).distinct().withColumn(name, F.lit(True))

    # both liveness tests as one right-hand row per owner, so the rows are looked up once
    owners = mark(live_a, "_a").join(mark(live_b, "_b"), entity)
    marked = lookup(rows, owners, [(entity, entity)], scatter=scatter, counted=rows.select(entity))
    alive = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    outcome = (F.when(F.col(flag).isNotNull(), "kept").when(~alive, "owner not live")
               .when(reserved, "reserved").otherwise("activated"))
    decided = marked.withColumn("outcome", outcome).drop("_a", "_b")
    return decided.withColumn(flag, F.when(F.col("outcome") == "activated", F.lit(1)).otherwise(F.col(flag)))


def spelling_canonicalise(rows: DataFrame, catalogue: DataFrame, column: str, name: str, fold_name,
                          scatter: Sequence[str]) -> DataFrame:
    """Rewrite names equal to the catalogue's under folding but not byte for byte; adds ``drifted``."""
    canonical = catalogue.groupBy(fold_name(F.col(name)).alias("_f")).agg(F.min(name).alias("_canonical"))
    joined = lookup(rows.withColumn("_fold", fold_name(F.col(column))), canonical, [("_fold", "_f")], scatter=scatter)
    drifted = F.coalesce(F.col("_canonical") != F.col(column), F.lit(False))
    return (joined.withColumn("drifted", drifted)
            .withColumn(column, F.coalesce("_canonical", F.col(column))).drop("_canonical", "_fold"))


def prune_with_archive(live: DataFrame, archive: DataFrame, doomed: Column, key: Sequence[str]
                       ) -> tuple[DataFrame, DataFrame]:
    """(kept live rows, archive with the pruned rows added once each)."""
    doomed = F.coalesce(doomed, F.lit(False))
    leaving = live.where(doomed).join(archive.select(*key), list(key), "left_anti")
    return live.where(~doomed), archive.unionByName(leaving, allowMissingColumns=True)


def unambiguous_restore(rows: DataFrame, live: DataFrame, key: str, columns: Sequence[str],
                        scatter: Sequence[str]) -> DataFrame:
    """Fill columns that are all missing from the live row of that key, where there is exactly one."""
    single = (live.groupBy(key).agg(F.count(F.lit(1)).alias("_n"),
                                    F.first(F.struct(*columns)).alias("_v"))
              .where(F.col("_n") == 1).select(F.col(key).alias("_lk"), "_v"))
    joined = lookup(rows, single, [(key, "_lk")], scatter=scatter)
    missing = F.lit(True)
    for c in columns:
        missing = missing & F.col(c).isNull()
    restored = missing & F.col("_v").isNotNull()
    return joined.select(*[F.when(restored, F.col(f"_v.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
                           for c in rows.columns], restored.alias("restored"))


def missing_from_seed(live: DataFrame, seed: DataFrame) -> DataFrame:
    """Seed columns the live table lacks, as (column_name, data_type): pure metadata."""
    have = {c.lower() for c in live.columns}
    lost = [(f.name, f.dataType.simpleString()) for f in seed.schema if f.name.lower() not in have]
    return live.sparkSession.createDataFrame(lost, "column_name string, data_type string")


def adopt_columns(live: DataFrame, seed: DataFrame) -> DataFrame:
    """Add the seed's missing columns to the live table with their declared types."""
    have = {c.lower() for c in live.columns}
    return live.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in seed.schema
                              if f.name.lower() not in have])


def seed_replace(target: DataFrame, seed_keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """The target without its declared seed rows, ready for the copy."""
    return target.join(seed_keys.select(*key).distinct(), list(key), "left_anti")
