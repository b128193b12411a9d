"""Choosing one row per key, making names unique and re-homing colliding rows.

Every choice has a total order that ends in the primary key. Winners are found
with map-side aggregates and joined back on the primary key, so the size of a
group never decides the size of a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.functions.text import fold
from carryover.operators.counting import beside
from carryover.operators.ordinals import cut_points, with_group_ordinal, with_ordinal
from carryover.operators.skew import lookup
from carryover.session import checkpoint_dir

NULL_FLAG = "null_flag"
DUPLICATE_RETIRED = "duplicate_retired"


def one_live_per_key(df: DataFrame, *, pk: str, key: Sequence[str], deleted: str, optout: str, explicit: str,
                     edited: str) -> DataFrame:
    """One live record per key; the others are retired, never dropped.

    Among live, decided rows the deciding record is an opt-out before an opt-in, an
    explicit record before an implied one, then the latest edit (undated is oldest),
    then the higher id. A live row without a recorded decision is retired and stored
    as an opt-out; a NULL ``deleted`` is not live; rows missing a key part are not
    grouped. ``reason`` says why the stored row differs, and the prior flags stay.
    """
    live = F.col(deleted).eqNullSafe(F.lit(0)) & F.col(optout).isNotNull()
    grouped = live
    for k in key:
        grouped = grouped & F.col(k).isNotNull()
    order = F.struct(F.col(optout).cast("int").alias("a"), F.coalesce(F.col(explicit).cast("int"), F.lit(0)).alias("b"),
                     F.col(edited).isNotNull().alias("c"), F.col(edited).alias("d"), F.col(pk).alias("e"))
    winners = (df.where(grouped).groupBy(*key).agg(F.max_by(pk, order).alias(pk))
               .select(pk, F.lit(True).alias("_wins")))
    ranked = df.join(winners, pk, "left")
    surplus = grouped & F.col("_wins").isNull()
    null_flag = F.col(optout).isNull() | F.col(explicit).isNull() | F.col(deleted).isNull()
    reason = F.concat_ws(",", F.when(null_flag, NULL_FLAG), F.when(surplus, DUPLICATE_RETIRED))
    return ranked.select(
        F.col(pk), *key,
        F.when(~live | surplus, 1).otherwise(0).alias("deleted"),
        F.coalesce(F.col(optout).cast("int"), F.lit(1)).alias("optout"),
        F.coalesce(F.col(explicit).cast("int"), F.lit(0)).alias("explicit"),
        F.col(explicit).cast("int").alias("prior_explicit"), F.col(optout).cast("int").alias("prior_optout"),
        F.col(deleted).cast("int").alias("prior_deleted"),
        F.nullif(reason, F.lit("")).alias("reason"))


def live_key_coverage(source: DataFrame, helper: DataFrame, *, pk: str, key: Sequence[str], deleted: str,
                      optout: str) -> DataFrame:
    """One row: coverage of the helper, keys with more than one live row, and what changed."""
    both = (source.select(pk, F.col(deleted).alias("_sd"), F.col(optout).alias("_so"), F.lit(True).alias("_s"))
            .join(helper.select(pk, F.col("deleted").alias("_hd"), "reason", F.lit(True).alias("_h")), pk, "full_outer"))
    was_live = F.col("_sd").eqNullSafe(F.lit(0))
    counts = both.agg(
        F.count_if(F.col("_h").isNull()).alias("missing"), F.count_if(F.col("_s").isNull()).alias("extra"),
        F.count_if((F.col("_hd") == 1) & was_live & F.col("_so").isNotNull()).alias("duplicate"),
        F.count_if(F.col("_so").isNull() & was_live & F.col("_s")).alias("undecided"),
        F.count_if(F.col("reason").isNotNull()).alias("changed"),
        F.count_if(F.col("_sd").isNull() & F.col("_s")).alias("null_deleted"),
        F.count_if(F.coalesce(F.col("_sd") != 0, F.lit(False))).alias("legacy_deleted"))
    complete = F.col("deleted") == 0
    for k in key:
        complete = complete & F.col(k).isNotNull()
    repeated = (helper.where(complete).groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
                .agg(F.count_if(F.col("_n") > 1).alias("duplicate_live_keys")))
    return beside(counts, repeated)


def dedup_tag(pk: str, year: Column | None) -> Column:
    """``-<year or x>-<id>``, or ``-dup-<id>`` where the table has no date. Ends in the full id."""
    middle = F.lit("dup") if year is None else F.coalesce(year.cast("string"), F.lit("x"))
    return F.concat(F.lit("-"), middle, F.lit("-"), F.col(pk).cast("string"))


def disambiguate(df: DataFrame, column: str, *, pk: str, order: str, year: Column | None, width: int
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with unique values, originals of the changed rows, rows whose tag does not fit).

    The earliest row (NULL dates last, then id) keeps the value; every other row gets a
    tag, its prefix cut so that the whole tag fits. Refuse the run if the third frame
    has rows.
    """
    rank = F.struct(F.col(order).isNull().alias("n"), F.col(order).alias("d"), F.col(pk).alias("i"))
    keepers = (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min_by(pk, rank).alias(pk))
               .select(pk, F.lit(True).alias("_keeps")))
    marked = df.join(keepers, pk, "left").withColumn("_tag", dedup_tag(pk, year))
    changes = F.col(column).isNotNull() & F.col("_keeps").isNull()
    room = F.greatest(F.lit(0), F.lit(width) - F.char_length("_tag"))
    tagged = F.concat(F.substring(F.col(column), F.lit(1), room), F.col("_tag"))
    live = marked.withColumn(column, F.when(changes & (F.char_length("_tag") <= width), tagged)
                             .otherwise(F.col(column))).drop("_keeps", "_tag")
    originals = marked.where(changes).select(pk, F.lit(column).alias("column_name"),
                                             F.col(column).alias("original_value"))
    oversized = marked.where(changes & (F.char_length("_tag") > width)).select(pk)
    return live, originals, oversized


def namespace(tables: Mapping[str, tuple[DataFrame, str, str, Column | None]]) -> DataFrame:
    """(source_table, row_id, original_name, folded, year_tag) over tables sharing one name space."""
    out = None
    for table, (df, pk, name, year) in sorted(tables.items()):
        tag = F.lit("x") if year is None else F.coalesce(year.cast("string"), F.lit("x"))
        part = df.select(F.lit(table).alias("source_table"), F.col(pk).cast("bigint").alias("row_id"),
                         F.col(name).alias("original_name"), fold(F.col(name)).alias("folded"), tag.alias("year_tag"))
        out = part if out is None else out.unionByName(part)
    return out


def generated_name(prefix: str, suffix: str) -> Column:
    """Bounded name with the table, the full row id and the retry number."""
    return F.concat(F.lit(prefix + "-"), F.col("source_table"), F.lit("-"), F.col("year_tag"), F.lit("-"),
                    F.col("row_id").cast("string"), F.lit("-"), F.col("nonce").cast("string"), F.lit(suffix))


def free_numbers(names: DataFrame, prefix: str, suffix: str = "", *, hot_rows: int | None = None) -> DataFrame:
    """(_stem, _free): the smallest number that no original name has behind its stem, for every stem some name has.

    The numbers of a stem are put in order; those that stand where they belong, 0 first, are the
    run without a gap that starts at 0, so how many they are is the first free number.
    """
    head, tail = F.lower(F.lit(prefix + "-")), F.lower(F.rtrim(F.lit(suffix)))
    folded = F.col("folded")
    looks = names.where(folded.startswith(head) & folded.endswith(tail)).select(
        F.substring(folded, F.lit(1), F.char_length(folded) - F.char_length(tail)).alias("_name")).distinct()
    # a generated number has no leading zero; one of more digits lies behind more names than there are
    numbered = r"^(.*-)(0|[1-9][0-9]{0,17})$"
    taken = looks.where(F.regexp_like("_name", F.lit(numbered))).select(
        F.regexp_extract("_name", numbered, 1).alias("_stem"), F.regexp_extract("_name", numbered, 2).cast("bigint").alias("_number"))
    placed = with_group_ordinal(taken, ["_stem"], "_number", "_place", hot_rows=hot_rows)
    return placed.groupBy("_stem").agg(F.count_if(F.col("_number") == F.col("_place") - 1).alias("_free"))


def allocate_names(names: DataFrame, prefix: str, suffix: str = "", *, hot_rows: int | None = None) -> DataFrame:
    """Names for every row: unchanged where unique, generated where several rows share one.

    ``names`` comes from :func:`namespace`. A generated name carries the smallest number with
    which it equals no original (under the target's comparison). Output: source_table, row_id,
    original_name, new_name, group_size, year_tag, nonce, reason.
    """
    sizes = names.where(F.col("folded").isNotNull()).groupBy("folded").agg(F.count(F.lit(1)).alias("group_size"))
    rows = ["source_table", "row_id"]
    sized = lookup(names, sizes, [("folded", "folded")], scatter=rows, hot_rows=hot_rows, counted=names.select("folded"))
    shared = F.coalesce(F.col("group_size"), F.lit(1)) > 1
    stem = F.lower(F.concat(F.lit(prefix + "-"), F.col("source_table"), F.lit("-"), F.col("year_tag"), F.lit("-"), F.col("row_id").cast("string"), F.lit("-")))
    free = free_numbers(names, prefix, suffix, hot_rows=hot_rows)
    numbered = lookup(sized.withColumn("_own", F.when(shared, stem)), free, [("_own", "_stem")], scatter=rows)
    numbered = numbered.withColumn("nonce", F.coalesce("_free", F.lit(0).cast("bigint")))
    return numbered.select(
        *rows, "original_name", F.when(shared, generated_name(prefix, suffix)).otherwise(F.col("original_name")).alias("new_name"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), "year_tag", "nonce",
        F.when(shared, "collision").otherwise("unchanged").alias("reason"))


def mapping_recheck(names: DataFrame, mapping: DataFrame, prefix: str, suffix: str = "",
                    hot_rows: int | None = None) -> DataFrame:
    """Re-derive the allocation from the source and compare: (claim, rows) per claim."""
    sizes = names.where(F.col("folded").isNotNull()).groupBy("folded").agg(F.count(F.lit(1)).alias("_size"))
    fresh = lookup(names, sizes, [("folded", "folded")], scatter=["source_table", "row_id"], hot_rows=hot_rows,
                   counted=names.select("folded"))
    fresh = fresh.select("source_table", "row_id", F.col("original_name").alias("_original"), F.col("year_tag").alias("_year"),
                         F.coalesce("_size", F.lit(1)).alias("_size"), F.lit(True).alias("_s"))
    both = fresh.join(mapping.withColumn("_m", F.lit(True)), ["source_table", "row_id"], "full_outer")
    follows = F.col("new_name").eqNullSafe(F.when(F.col("group_size") > 1, generated_name(prefix, suffix))
                                           .otherwise(F.col("original_name")))
    reason = F.col("reason") == F.when(F.col("group_size") > 1, "collision").otherwise("unchanged")
    counted = both.agg(
        F.count_if(F.col("_s") & (F.col("_m").isNull() | ~F.col("original_name").eqNullSafe(F.col("_original"))
                                  | (F.col("group_size") != F.col("_size")) | (F.col("year_tag") != F.col("_year")))
                   ).alias("missing_or_changed"),
        F.count_if(F.col("_s").isNull()).alias("extra"),
        F.count_if(F.col("_m") & ~(follows & reason)).alias("policy"))
    taken = names.select(F.col("folded").alias("_taken")).distinct()
    collides = (mapping.where(F.col("group_size") > 1)
                .join(taken, fold(F.col("new_name")) == F.col("_taken"), "left_semi")
                .agg(F.count(F.lit(1)).alias("collision")))
    repeats = (mapping.where(F.col("new_name").isNotNull()).groupBy(fold(F.col("new_name")).alias("_f"))
               .agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("not_unique")))
    row = beside(counted, collides, repeats)
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("claim"), F.col(c).alias("rows")) for c in row.columns])))


def retained_generations(names: DataFrame, inventory: DataFrame, *, latest: bool,
                         hot_rows: int | None = None) -> DataFrame:
    """Which generation rows can keep their surviving file: adds ``status`` to every row.

    ``names`` is a :func:`namespace` frame; ``inventory`` has ``name``. Names are
    compared byte by byte with files and under the target's comparison with each other.
    """
    present = inventory.select(F.col("name").alias("_file")).distinct().withColumn("_there", F.lit(True))
    backed = lookup(names, present, [("original_name", "_file")], scatter=["source_table", "row_id"], hot_rows=hot_rows,
                    counted=names.select("original_name"))
    alive = backed.where(F.col("_there"))
    per_name = alive.groupBy("original_name").agg(
        F.count_distinct("source_table").alias("_tables"), F.count(F.lit(1)).alias("_refs"),
        F.max("row_id").alias("_latest"), F.min("source_table").alias("_table"), F.min("folded").alias("_folded"))
    usable = per_name.where((F.col("_tables") == 1) & ((F.col("_refs") == 1) | F.lit(latest)))
    rivals = usable.groupBy("_table", "_folded").agg(F.count(F.lit(1)).alias("_rivals"))
    judged = (per_name.join(rivals, ["_table", "_folded"], "left")
              .select(F.col("original_name").alias("_name"), "_tables", "_refs", "_latest", "_rivals"))
    full = lookup(backed, judged, [("original_name", "_name")], scatter=["source_table", "row_id"], hot_rows=hot_rows,
                  counted=names.select("original_name"))
    older = "older" if latest else "several-rows"
    status = (F.when(F.col("_there").isNull(), "no-file")
              .when(F.col("_tables") > 1, "several-tables")
              .when((F.col("_refs") > 1) & ((F.col("row_id") != F.col("_latest")) | F.lit(not latest)), older)
              .when(F.col("_rivals") > 1, "name-clash").otherwise("retained"))
    return full.select("source_table", "row_id", "original_name", status.alias("status"))


def classify_seed_collisions(live: DataFrame, seed: DataFrame, key: str, code: str, *,
                             rows_per_range: int | None = None) -> DataFrame:
    """(key, code, seed_code, action, new_key) for live rows at keys the seed will write.

    ``same``: the code is the seed's own. ``replace``: the code survives elsewhere, in a
    row outside the collision range or among the seed's codes. ``rehome``: the code
    would be lost, so the row moves above every live and seed key, in key order.
    """
    wanted = seed.select(F.col(key).alias("_sk"), F.col(code).alias("seed_code"))
    at = live.join(wanted, F.col(key) == F.col("_sk"))
    diverging = at.where(~F.col(code).eqNullSafe(F.col("seed_code")))
    outside = live.join(seed.select(key), key, "left_anti")
    surviving = (outside.select(F.col(code)).unionByName(seed.select(code)).where(F.col(code).isNotNull())
                 .select(fold(F.col(code)).alias("_code")).distinct().withColumn("_lives", F.lit(True)))
    judged = lookup(diverging.withColumn("_fold", fold(F.col(code))), surviving, [("_fold", "_code")], scatter=[key])
    lost = judged.where(F.col("_lives").isNull()).select(key)
    top = live.select(key).unionByName(seed.select(key)).agg(F.max(key)).scalar()
    homes = (with_ordinal(lost, key, "_n", cuts=cut_points(live, key, rows_per_range))
             .select(F.col(key).alias("_lk"), (top + F.col("_n")).alias("new_key")))
    placed = at.join(homes, F.col(key) == F.col("_lk"), "left")
    action = (F.when(F.col(code).eqNullSafe(F.col("seed_code")), "same")
              .when(F.col("new_key").isNotNull(), "rehome").otherwise("replace"))
    return placed.select(key, code, "seed_code", action.alias("action"), "new_key")


def apply_seed_collisions(live: DataFrame, seed: DataFrame, plan: DataFrame, backup: DataFrame, key: str
                          ) -> tuple[DataFrame, DataFrame]:
    """(table after the seed, rows held back because their backup is not identical).

    A colliding row moves or goes only where the backup holds exactly the same bytes.
    """
    columns = live.columns
    saved = backup.select(F.col(key).alias("_bk"), *[F.col(c).alias(f"_s_{c}") for c in columns])
    placed = live.join(plan.select(F.col(key).alias("_pk"), "action", "new_key"), F.col(key) == F.col("_pk"), "left")
    checked = placed.join(saved, F.col(key) == F.col("_bk"), "left")
    safe = F.col("_bk").isNotNull()
    for c in columns:
        safe = safe & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    untouched = checked.where(F.col("action").isNull()).select(*columns)
    moved = checked.where((F.col("action") == "rehome") & safe).select(
        *[F.col("new_key").cast(dict(live.dtypes)[key]).alias(key) if c == key else F.col(c) for c in columns])
    held = checked.where(F.col("action").isNotNull() & ~safe).select(key)
    return untouched.unionByName(moved).unionByName(seed.select(*columns)), held


def single_claim_owner(records: DataFrame, claims: DataFrame, *, pk: str, module: str) -> DataFrame:
    """Owner of an unassigned record if every claim names one (owner, module) that agrees with it.

    ``claims`` has the record id, owner and module. Minimum and maximum of the pair
    decide whether there is one, so a record with very many claims costs no more.
    """
    pair = F.struct("owner", "module")
    agreed = (claims.where((F.col(pk) > 0) & (F.col("owner") > 0)).groupBy(pk)
              .agg(F.min(pair).alias("_lo"), F.max(pair).alias("_hi")))
    joined = records.join(agreed, pk, "left")
    single = F.col("_lo").isNotNull() & (F.col("_lo") == F.col("_hi"))
    fits = F.col(module).isNull() | (F.col(module) == "") | (F.col(module) == F.col("_lo.module"))
    owner = F.when(single & fits, F.col("_lo.owner"))
    state = (F.when(F.col("_lo").isNull(), "no claim").when(~single, "conflicting claims")
             .when(~fits, "module disagrees").otherwise("assigned"))
    return joined.select(pk, owner.alias("owner"), F.when(single & fits, F.col("_lo.module")).alias("owner_module"),
                         state.alias("state"))


def url_claims(df: DataFrame, text: str, owner: str, pattern: str, module: str, pk: str) -> DataFrame:
    """Claims made by record ids inside text: every match of ``pattern`` group 1."""
    ids = F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))
    return (df.select(ids.alias("_id"), F.col(owner).cast("bigint").alias("owner"))
            .select(F.col("_id").try_cast("bigint").alias(pk), "owner", F.lit(module).alias("module"))
            .where(F.col(pk).isNotNull()))


