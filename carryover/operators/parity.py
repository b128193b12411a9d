"""Did every value arrive, not just every row.

Checks pair rows the way the write paired them (on the target's comparison) and
compare values byte by byte and null-safe. Counts come out of one aggregate per
comparison; the keys behind a count are available from the same predicate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.operators.counting import beside, capped_keys, labelled_counts
from carryover.operators.digest import digest_compare, digest_document, table_digest
from carryover.operators.skew import lookup
from carryover.spec import ColumnInfo, TableClass, TableSpec, compared, key_exprs, written


def unpairable_reason(spec: TableSpec) -> str | None:
    """Why rows of a table cannot be paired one to one, None when they can."""
    if not spec.key:
        return "no primary key"
    lost = [k for k in spec.key if k not in spec.columns]
    return f"key column not copied: {lost[0]}" if lost else None


def same_value(stored: Column, expected: Column, info: ColumnInfo | None) -> Column:
    """Byte-exact and null-safe, except that a NOT NULL timestamp accepts any value for a NULL source."""
    same = stored.eqNullSafe(expected)
    if info is not None and info.type == "timestamp" and not info.nullable:
        return expected.isNull() | same
    return same


def expected_value(spec: TableSpec, column: str, overrides: Mapping[str, tuple[Column, Column]] | None = None) -> Column:
    """The written value, after a documented change where there is one."""
    value = written(spec, column)
    if overrides and column in overrides:
        condition, replacement = overrides[column]
        value = F.when(condition, replacement).otherwise(value)
    return value


def paired(src: DataFrame, tgt: DataFrame, spec: TableSpec, overrides: Mapping[str, tuple[Column, Column]] | None = None
           ) -> DataFrame:
    """Source rows with the written value ``e_<column>`` next to the stored ``d_<column>``.

    ``overrides`` are documented changes made after the copy: column -> (condition,
    replacement), over source columns.
    """
    expected = [expected_value(spec, c, overrides).alias(f"e_{c}") for c in spec.carried]
    left = src.select(*expected)
    right = tgt.select(*[F.col(c).alias(f"d_{c}") for c in spec.carried], F.lit(True).alias("_found"))
    pair = None
    for k in spec.key:
        info = spec.columns[k]
        test = compared(F.col(f"d_{k}"), info).eqNullSafe(compared(F.col(f"e_{k}"), info))
        pair = test if pair is None else pair & test
    return left.join(right, pair, "left")


def mismatch(spec: TableSpec, column: str) -> Column:
    return ~same_value(F.col(f"d_{column}"), F.col(f"e_{column}"), spec.columns.get(column))


def any_mismatch(spec: TableSpec, columns: Sequence[str]) -> Column:
    test = F.lit(False)
    for c in columns:
        test = test | mismatch(spec, c)
    return test


def copy_value_parity(src: DataFrame, tgt: DataFrame, spec: TableSpec,
                      overrides: Mapping[str, tuple[Column, Column]] | None = None, *, rewritten: str | None = None) -> DataFrame:
    """(table_name, column_name, state, rows) from one join and one aggregate.

    One line per column, ``(row)`` for rows with any difference and ``(missing)`` for
    source rows without a twin. A table that cannot be paired, or that was ``rewritten`` on
    purpose after the copy (by what is the text given), is reported as not checked with the
    rows that stand unchecked, never as passed.
    """
    reason = f"rewritten on purpose ({rewritten})" if rewritten else unpairable_reason(spec)
    if reason:
        return labelled_counts(src, ["table_name", "column_name", "state"],
                               [((spec.name, "(row)", f"not checked: {reason}"), F.lit(True))])
    found = F.col("_found").isNotNull()
    names = spec.carried
    # each comparison is made once; the row-level count reuses the columns' flags
    flags = paired(src, tgt, spec, overrides).select(
        found.alias("_found"), *[(found & mismatch(spec, c)).alias(f"_m{i}") for i, c in enumerate(names)])
    differs = F.lit(False)
    for i in range(len(names)):
        differs = differs | F.col(f"_m{i}")
    checks = [((spec.name, c), F.col(f"_m{i}")) for i, c in enumerate(names)]
    checks += [((spec.name, "(row)"), differs), ((spec.name, "(missing)"), ~F.col("_found"))]
    counts = labelled_counts(flags, ["table_name", "column_name"], checks)
    return counts.select("table_name", "column_name",
                         F.when(F.col("rows") == 0, "pass").otherwise("fail").alias("state"), "rows")


def mismatch_keys(src: DataFrame, tgt: DataFrame, spec: TableSpec,
                  overrides: Mapping[str, tuple[Column, Column]] | None = None, limit: int = 50) -> DataFrame:
    """Keys of rows that differ or are missing: the predicate of the count, capped for the private report."""
    pairs = paired(src, tgt, spec, overrides)
    bad = pairs.where(F.col("_found").isNull() | any_mismatch(spec, spec.carried))
    return capped_keys(bad.select(*[F.col(f"e_{k}").alias(k) for k in spec.key]), list(spec.key), limit)


def normalised(spec: TableSpec, side: str) -> list[Column]:
    """Columns for the multiset check: numbers in the target's type, times at microseconds."""
    out = []
    for name, info in spec.columns.items():
        value = written(spec, name) if side == "source" else F.col(name)
        if info.type in ("date", "datetime", "timestamp"):
            value = value.cast("timestamp_ntz")
        else:
            value = value.cast(info.spark_type())
        out.append(value.alias(name))
    return out


def multiset_parity(src: DataFrame, tgt: DataFrame, spec: TableSpec, *, scales: Mapping[str, int] | None = None,
                    large: Sequence[str] = ()) -> DataFrame:
    """Keyless tables: the digest of what should be stored against the digest of what is."""
    lanes = ["rows", "total", "parity", "unhashed"]
    e = table_digest(src.select(*normalised(spec, "source")), scales=scales, large=large)
    a = table_digest(tgt.select(*normalised(spec, "target")), scales=scales, large=large)
    e = e.select(*[F.col(c).alias(f"expected_{c}") for c in lanes])
    a = a.select(*[F.col(c).alias(f"actual_{c}") for c in lanes])
    unhashed = (F.col("expected_unhashed") > 0) | (F.col("actual_unhashed") > 0)
    content = (F.col("expected_total") != F.col("actual_total")) | (F.col("expected_parity") != F.col("actual_parity"))
    status = (F.when(unhashed, "unverified").when(F.col("expected_rows") != F.col("actual_rows"), "rows differ")
              .when(content, "content differs").otherwise("verified"))
    return beside(e, a).select(F.lit(spec.name).alias("table_name"), status.alias("status"),
                                    "expected_rows", "actual_rows")


def multiset_offenders(src: DataFrame, tgt: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows on one side only, with how many copies are too many there.

    Counted with signs in one aggregate instead of two set differences: one shuffle, and
    identical rows combine before it.
    """
    columns = list(spec.columns)
    e = src.select(*normalised(spec, "source"), F.lit(1).alias("_w"))
    a = tgt.select(*normalised(spec, "target"), F.lit(-1).alias("_w"))
    balance = e.unionByName(a).groupBy(*columns).agg(F.sum("_w").alias("_w")).where(F.col("_w") != 0)
    return balance.select(*columns, F.when(F.col("_w") > 0, "source only").otherwise("target only").alias("side"),
                          F.abs("_w").alias("copies"))


def copy_row_parity(src: DataFrame, tgt: DataFrame, name: str, key: Sequence[str], *, admin: Column | None = None,
                    recorded: int | None = None, limit: int | None = None) -> DataFrame:
    """Counts of a copied table, equal after the exact tolerated differences.

    Tolerated: the rows ``admin`` describes on the target, and the recorded appended
    rows, which must equal the target rows without a source twin and stay within
    ``limit``.
    """
    n = src.agg(F.count(F.lit(1)).alias("source_rows"))
    own = F.lit(False) if admin is None else admin
    m = tgt.agg(F.count(F.lit(1)).alias("target_rows"), F.count_if(F.coalesce(own, F.lit(False))).alias("admin_rows"))
    out = beside(n, m)
    if recorded is None:
        out = out.withColumn("twinless", F.lit(0).cast("bigint"))
    else:
        twinless = tgt.where(~F.coalesce(own, F.lit(False))).join(src.select(*key), list(key), "left_anti")
        out = beside(out, twinless.agg(F.count(F.lit(1)).alias("twinless")))
    ledger = F.lit(recorded or 0)
    expected = F.col("source_rows") + F.col("admin_rows") + ledger
    bad = F.col("target_rows") != expected
    if recorded is not None:
        bad = bad | (F.col("twinless") != ledger)
        if limit is not None:
            bad = bad | (F.col("twinless") > limit)
    return out.select(F.lit(name).alias("table_name"), F.lit("copy").alias("class"), "source_rows", "target_rows",
                      expected.cast("bigint").alias("expected_rows"), F.when(bad, "fail").otherwise("pass").alias("state"))


def merge_row_parity(src: DataFrame, tgt: DataFrame, spec: TableSpec, pruned: Column | None = None,
                     hot_rows: int | None = None) -> DataFrame:
    """Source rows of a merged table without a target twin, declared prunes and exclusions aside."""
    rows = src
    for test in (spec.merge_exclude() if spec.merge_exclude else None, pruned):
        if test is not None:
            rows = rows.where(~F.coalesce(test, F.lit(False)))
    scatter = [spec.source_of(spec.surrogate_pk)] if spec.surrogate_pk else [spec.source_of(k) for k in spec.key]
    keyed = rows.select(*scatter, *key_exprs(spec, stored=False))
    held = tgt.select(*key_exprs(spec, stored=True)).distinct()
    keys = [f"_k{i}" for i in range(len(spec.merge_keys))]
    lost = lookup(keyed, held, [(k, k) for k in keys], scatter=scatter, how="left_anti", null_safe=True,
                  hot_rows=hot_rows, counted=keyed.select(*keys))
    sizes = beside(src.agg(F.count(F.lit(1)).alias("source_rows")), tgt.agg(F.count(F.lit(1)).alias("target_rows")),
                   lost.agg(F.count(F.lit(1)).alias("_lost")))
    return sizes.select(F.lit(spec.name).alias("table_name"), F.lit("merge").alias("class"), "source_rows", "target_rows",
                        (F.col("target_rows") + F.col("_lost")).alias("expected_rows"),
                        F.when(F.col("_lost") > 0, "fail").otherwise("pass").alias("state"))


def seed_changes(live: DataFrame, preseed: DataFrame, key: Sequence[str], columns: Sequence[str],
                 removed: Column | None = None) -> DataFrame:
    """Seed rows that are gone or changed since the snapshot; ``removed`` names declared removals."""
    before = preseed.select(*[F.col(c).alias(f"p_{c}") for c in dict.fromkeys([*key, *columns])],
                            (F.coalesce(removed, F.lit(False)) if removed is not None else F.lit(False)).alias("_removed"))
    after = live.select(*[F.col(c).alias(f"d_{c}") for c in dict.fromkeys([*key, *columns])], F.lit(True).alias("_found"))
    pair = None
    for k in key:
        test = F.col(f"d_{k}").eqNullSafe(F.col(f"p_{k}"))
        pair = test if pair is None else pair & test
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(f"d_{c}").eqNullSafe(F.col(f"p_{c}"))
    both = before.join(after, pair, "left")
    return both.where((F.col("_found").isNull() | changed) & ~F.col("_removed")).select(
        *[F.col(f"p_{k}").alias(k) for k in key])


def placed_rows(src: DataFrame, live: DataFrame, preseed: DataFrame, idmap: DataFrame | None, spec: TableSpec) -> DataFrame:
    """Rows a merge had to append, as written (``e_``), next to what is stored (``d_``, ``_found``).

    Rows that the id map leads to a seed row are none of them. A table without a
    surrogate keeps its key; there the rows are those whose key the seed did not hold.
    """
    pk = spec.surrogate_pk
    columns = [c for c in spec.carried if c != pk]
    rows = src
    if spec.merge_exclude:
        rows = rows.where(~F.coalesce(spec.merge_exclude(), F.lit(False)))
    if pk is None:
        held = preseed.select(*key_exprs(spec, stored=True)).distinct()
        names = [f"_k{i}" for i in range(len(spec.merge_keys))]
        rows = lookup(rows.select("*", *key_exprs(spec, stored=False)), held, [(k, k) for k in names],
                      scatter=[spec.source_of(k) for k in spec.key], how="left_anti", null_safe=True)
        joined = paired(rows, live, spec)
        return joined.withColumn("_old", F.col(f"e_{spec.key[0]}"))
    expected = rows.select(F.col(spec.source_of(pk)).alias("_old"), *[written(spec, c).alias(f"e_{c}") for c in columns])
    led = expected.join(idmap.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new")), "_old", "left")
    # surplus twins of a seed row leave here, so no target id is left with more than one row
    added = led.join(preseed.select(F.col(pk).alias("_new")), "_new", "left_anti")
    stored = live.select(F.col(pk).alias("_new"), *[F.col(c).alias(f"d_{c}") for c in columns], F.lit(True).alias("_found"))
    return added.join(stored, "_new", "left")


def appended_mismatches(src: DataFrame, live: DataFrame, preseed: DataFrame, idmap: DataFrame | None, spec: TableSpec
                        ) -> DataFrame:
    """Appended rows whose live row does not hold the value the merge wrote, paired through the id map.

    The surrogate itself is not compared: the merge did not carry it. Rows that are not
    there at all are :func:`appended_missing`.
    """
    columns = [c for c in spec.carried if c != spec.surrogate_pk]
    return (placed_rows(src, live, preseed, idmap, spec).where(F.col("_found").isNotNull() & any_mismatch(spec, columns))
            .select(F.col("_old").alias("old_id")))


def appended_missing(src: DataFrame, live: DataFrame, preseed: DataFrame, idmap: DataFrame | None, spec: TableSpec) -> DataFrame:
    """Rows the merge had to append that the live table does not hold."""
    return placed_rows(src, live, preseed, idmap, spec).where(F.col("_found").isNull()).select(F.col("_old").alias("old_id"))


def backfill_mismatches(src: DataFrame, live: DataFrame, preseed: DataFrame, spec: TableSpec,
                        key: Sequence[str]) -> DataFrame:
    """Seed rows with a source twin whose archived columns agree with no twin of that key.

    The distinct archived values of a key stand for its twins, so a key with very many
    twins is reduced before the join.
    """
    keys = [f"_k{i}" for i in range(len(spec.merge_keys))]
    rows = src
    if spec.merge_exclude:
        rows = rows.where(~F.coalesce(spec.merge_exclude(), F.lit(False)))
    twins = rows.select(*key_exprs(spec, stored=False), *[F.col(s).alias(f"s_{t}") for t, s in spec.archived.items()])
    values = [f"s_{t}" for t in spec.archived]
    seeds = (live.join(preseed.select(*key), list(key), "left_semi")
             .select(*key, *key_exprs(spec, stored=True), *[F.col(t).alias(f"s_{t}") for t in spec.archived]))
    has_twin = twins.select(*keys).distinct()
    holds = twins.distinct().withColumn("_ok", F.lit(True))
    beaten = lookup(seeds, has_twin, [(k, k) for k in keys], scatter=list(key), how="left_semi", null_safe=True)
    agreed = lookup(beaten, holds, [(k, k) for k in [*keys, *values]], scatter=list(key), null_safe=True)
    return agreed.where(F.col("_ok").isNull()).select(*key)


def merge_parity(src: DataFrame, live: DataFrame, preseed: DataFrame, idmap: DataFrame, spec: TableSpec, *,
                 removed: Column | None = None, missing: bool = False) -> DataFrame:
    """The three claims of a merge: (claim, rows). Zero everywhere means proven.

    With ``missing`` the count of :func:`appended_missing` is a fourth, from the same pass.
    """
    pk = [spec.surrogate_pk] if spec.surrogate_pk else list(spec.key)
    plain = [c for c in preseed.columns if c not in spec.archived]
    counted = lambda frame, claim: frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(claim).alias("claim"), "rows")
    out = counted(seed_changes(live, preseed, pk, plain, removed), "seed unchanged")
    differs = F.col("_found").isNotNull() & any_mismatch(spec, [c for c in spec.carried if c != spec.surrogate_pk])
    claims = {"appended as written": differs, **({"appended and there": F.col("_found").isNull()} if missing else {})}
    placed = placed_rows(src, live, preseed, idmap, spec).agg(*[F.count_if(test).alias(f"_{i}") for i, test in enumerate(claims.values())])
    entries = [F.struct(F.lit(claim).alias("claim"), F.col(f"_{i}").alias("rows")) for i, claim in enumerate(claims)]
    out = out.unionByName(placed.select(F.inline(F.array(*entries))))
    if not spec.archived:  # losers without archived columns have nothing to lose
        return out.unionByName(preseed.limit(0).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("losers archived").alias("claim"), "rows"))
    return out.unionByName(counted(backfill_mismatches(src, live, preseed, spec, pk), "losers archived"))


def preserved_parity(originals: Mapping[str, DataFrame], homes: Mapping[str, Mapping[str, DataFrame]], *,
                     large: Mapping[str, Sequence[str]] | None = None,
                     scales: Mapping[str, Mapping[str, int]] | None = None) -> DataFrame:
    """Archive homes exist and hold the same rows, content and shape: (home, table_name, status, why)."""
    expected = digest_document(originals, large=large, scales=scales)
    out = None
    for home, tables in sorted(homes.items()):
        compared_home = digest_compare(expected, digest_document(tables, large=large, scales=scales))
        row = compared_home.select(F.lit(home).alias("home"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def archived_column_parity(src: DataFrame, live: DataFrame, preseed: DataFrame | None, spec: TableSpec,
                           excluded: Column | None = None) -> DataFrame:
    """(column_name, source_values, twin_surplus, live_values, state) per archived column.

    Surplus: on a key the seed holds, one live column can keep the value of one source
    row only, so values beyond one per key stay in the archive.
    """
    rows = src
    for test in (spec.merge_exclude() if spec.merge_exclude else None, excluded):
        if test is not None:
            rows = rows.where(~F.coalesce(test, F.lit(False)))
    keys = [f"_k{i}" for i in range(len(spec.merge_keys))]
    stored = live.agg(*[F.count(t).alias(t) for t in spec.archived])
    if spec.cls is TableClass.MERGE and preseed is not None:
        keyed = rows.select(*key_exprs(spec, stored=False), *[F.col(s).alias(t) for t, s in spec.archived.items()])
        # per key: how many values of each column; a hot key combines map-side
        groups = keyed.groupBy(*keys).agg(*[F.count(t).alias(t) for t in spec.archived])
        held = preseed.select(*key_exprs(spec, stored=True)).distinct().select(
            *[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.lit(True).alias("_seeded"))
        on = None
        for i, k in enumerate(keys):
            test = F.col(k).eqNullSafe(F.col(f"_h{i}"))
            on = test if on is None else on & test
        marked = groups.join(held, on, "left")
        surplus = [F.sum(F.when(F.col("_seeded") & (F.col(t) > 0), F.col(t) - 1).otherwise(0)).alias(f"x_{t}")
                   for t in spec.archived]
        counted = marked.agg(*[F.sum(t).alias(f"n_{t}") for t in spec.archived], *surplus)
    else:
        counted = rows.agg(*[F.count(s).alias(f"n_{t}") for t, s in spec.archived.items()],
                           *[F.lit(0).cast("bigint").alias(f"x_{t}") for t in spec.archived])
    joined = beside(counted, stored)
    entries = [F.struct(F.lit(t).alias("column_name"), F.col(f"n_{t}").alias("source_values"),
                        F.col(f"x_{t}").alias("twin_surplus"), F.col(t).alias("live_values"),
                        F.when(F.col(f"n_{t}") - F.col(f"x_{t}") == F.col(t), "pass").otherwise("fail").alias("state"))
               for t in spec.archived]
    return joined.select(F.inline(F.array(*entries)))


def group_totals_parity(src: DataFrame | None, tgt: DataFrame | None, year: Column, amount: Column) -> DataFrame:
    """Count and exact total per year on both sides; one absent side is a failure that says so."""
    present = src if src is not None else tgt

    def totals(frame: DataFrame | None, side: str) -> DataFrame:
        if frame is None:
            frame = present.limit(0)
        return frame.groupBy(F.coalesce(year, F.lit(0)).alias("year")).agg(
            F.count(F.lit(1)).alias(f"{side}_rows"), F.coalesce(
                F.sum(amount.cast("decimal(14,2)")), F.lit(0)).cast("decimal(24,2)").cast("string").alias(f"{side}_total"))

    joined = totals(src, "source").join(totals(tgt, "target"), "year", "full_outer")
    same = F.col("source_rows").eqNullSafe(F.col("target_rows")) & F.col("source_total").eqNullSafe(F.col("target_total"))
    state = (F.lit("not compared") if src is None or tgt is None
             else F.when(same, "pass").otherwise("fail"))
    return joined.select("year", "source_rows", "source_total", "target_rows", "target_total", state.alias("state"))


def spot_sample(df: DataFrame, pk: str, seed: str, n: int) -> DataFrame:
    """``n`` keys chosen by hash with a seed taken from the input digest: a sample anybody can repeat."""
    return (df.select(pk).withColumn("_h", F.sha2(F.concat(F.col(pk).cast("string"), F.lit(":" + seed)), 256))
            .orderBy("_h", pk).limit(n).select(pk))


def spot_check_joins(parents: DataFrame, pk: str, children: Mapping[str, tuple[DataFrame, DataFrame, str]], *,
                     seed: str, n: int, also: DataFrame | None = None) -> DataFrame:
    """Child counts of sampled parents on both sides: (parent, child_table, source_rows, target_rows, state)."""
    chosen = spot_sample(parents, pk, seed, n)
    if also is not None:
        chosen = chosen.unionByName(also.select(pk)).distinct()
    out = None
    for name, (src, tgt, fk) in sorted(children.items()):
        def counted(frame: DataFrame, label: str) -> DataFrame:
            hits = frame.select(F.col(fk).alias(pk)).join(F.broadcast(chosen), pk, "left_semi") if also is None else \
                frame.select(F.col(fk).alias(pk)).join(chosen, pk, "left_semi")
            return hits.groupBy(pk).agg(F.count(F.lit(1)).alias(label))

        row = (chosen.join(counted(src, "source_rows"), pk, "left").join(counted(tgt, "target_rows"), pk, "left")
               .select(F.col(pk).alias("parent"), F.lit(name).alias("child_table"),
                       F.coalesce("source_rows", F.lit(0).cast("bigint")).alias("source_rows"),
                       F.coalesce("target_rows", F.lit(0).cast("bigint")).alias("target_rows")))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("state", F.when(F.col("source_rows") == F.col("target_rows"), "pass").otherwise("fail"))


def raw_field_parity(src: DataFrame, tgt: DataFrame, key: str, columns: Sequence[str],
                     permitted: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Named columns against the raw source byte by byte, or after one permitted replacement.

    (column_name, same, replaced, different, missing)
    """
    permitted = permitted or {}
    left = src.select(F.col(key).alias("_k"), *[F.col(c).alias(f"s_{c}") for c in columns])
    right = tgt.select(F.col(key).alias("_j"), *[F.col(c).alias(f"d_{c}") for c in columns])
    both = left.join(right, F.col("_k") == F.col("_j"), "left")
    lost = F.col("_j").isNull()
    aggregates, entries = [F.count_if(lost).alias("_lost")], []
    for c in columns:
        raw, stored = F.col(f"s_{c}"), F.col(f"d_{c}")
        same = stored.eqNullSafe(raw)
        swapped = F.lit(False)
        if c in permitted:
            old, new = permitted[c]
            swapped = ~same & stored.eqNullSafe(F.replace(raw, F.lit(old), F.lit(new)))
        aggregates += [F.count_if(~lost & same).alias(f"a_{c}"), F.count_if(~lost & swapped).alias(f"b_{c}"),
                       F.count_if(~lost & ~same & ~swapped).alias(f"c_{c}")]
        entries.append(F.struct(F.lit(c).alias("column_name"), F.col(f"a_{c}").alias("same"),
                                F.col(f"b_{c}").alias("replaced"), F.col(f"c_{c}").alias("different"),
                                F.col("_lost").alias("missing")))
    return both.agg(*aggregates).select(F.inline(F.array(*entries)))


def release_gate(parity: DataFrame, recheck: DataFrame) -> DataFrame:
    """May staging be dropped: every archive home verified and every mapping claim at zero."""
    homes = parity.agg(F.count_if(F.col("status") != "verified").alias("homes_not_verified"),
                       F.count(F.lit(1)).alias("homes"))
    claims = recheck.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("mapping_violations"))
    row = beside(homes, claims)
    return row.select("homes", "homes_not_verified", "mapping_violations",
                      ((F.col("homes") > 0) & (F.col("homes_not_verified") == 0)
                       & (F.col("mapping_violations") == 0)).alias("may_release"))
