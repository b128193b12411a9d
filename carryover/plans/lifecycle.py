"""Assess, copy, verify, report: the run of a migration as four actions.

Planning is lazy. Control reaches the executors in ``preflight`` (checks only),
``apply`` (writes parquet), ``verify`` (re-reads what was written) and ``report``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover.operators import findings as K
from carryover.operators import merge as M
from carryover.operators import parity as P
from carryover.operators.archive import dropped_shadow, homes_of, preserve_table, unknown_columns, unknown_shadow
from carryover.plans.circles import circles
from carryover.plans.preflight import Expectations, Preflight
from carryover.session import materialise, tune
from carryover.spec import REMAP_PREFIX, TableClass, TableSpec, effective_spec, written


class Refused(RuntimeError):
    """The gate is closed: the verdict names what stands in the way."""


@dataclass
class Migration:
    spark: SparkSession
    staging: Mapping[str, DataFrame]
    seed: Mapping[str, DataFrame]
    specs: Sequence[TableSpec]
    out: str
    accepted: Sequence[str] = ()
    expect: Expectations = field(default_factory=Expectations)
    rewritten: Mapping[str, str] = field(default_factory=dict)   # table -> what changes it on purpose after the copy
    notes: list[tuple[str, str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        tune(self.spark)
        self._specs: dict[str, TableSpec] = {}
        self._found: DataFrame | None = None
        for spec in self.specs:
            if spec.name not in self.staging:
                self.notes.append((spec.name, "", "table absent from the snapshot"))
                continue
            reduced, said = effective_spec(spec, self.staging[spec.name].columns, self.staging)
            self._specs[spec.name] = reduced
            self.notes += [(spec.name, column, what) for column, what in said]

    def _path(self, role: str, table: str) -> str:
        return f"{self.out.rstrip('/')}/{role}/{table}"

    def _read(self, role: str, table: str) -> DataFrame:
        return self.spark.read.parquet(self._path(role, table))

    def _renumbered(self, table: str) -> bool:
        spec = self._specs.get(table)
        return spec is not None and spec.cls is TableClass.MERGE and spec.surrogate_pk is not None

    def _maps(self, spec: TableSpec, without: frozenset[str] = frozenset()) -> dict[str, DataFrame | None]:
        """The id map of every parent: what its merge wrote, or the identity of a table that keeps its ids.

        Parents in ``without`` have no ids yet and no map.
        """
        maps = {}
        for parent in spec.fk_remap.values():
            if parent in without:
                maps[parent] = None
            elif self._renumbered(parent):
                maps[parent] = self._read("idmap", parent)
            elif parent in self._specs:
                maps[parent] = M.identity_map(self.staging[parent], self._specs[parent])
        return maps

    def _sources(self, spec: TableSpec, without: frozenset[str] = frozenset()) -> DataFrame:
        """The staged rows next to the new ids of what they refer to."""
        src = self.staging[spec.name]
        if not spec.fk_remap:
            return src
        return M.with_idmaps(src, spec, self._maps(spec, without), [spec.source_of(k) for k in spec.key])

    def groups(self) -> list[list[TableSpec]]:
        """Renumbered parents before their children; tables that renumber each other in a circle come together.

        The declared order breaks ties.
        """
        parents = {s.name: {p for p in s.fk_remap.values() if self._renumbered(p) and p != s.name} for s in self._specs.values()}
        return [[self._specs[name] for name in group] for group in circles(parents)]

    def ordered(self) -> list[TableSpec]:
        return [spec for group in self.groups() for spec in group]

    def _circle(self, group: Sequence[TableSpec]) -> frozenset[str]:
        """The renumbered tables of a group that refer to each other or to themselves."""
        names = {s.name for s in group}
        circle = frozenset(s.name for s in group if self._renumbered(s.name) and set(s.fk_remap.values()) & names)
        for spec in group:
            held = [k for k in spec.merge_keys if spec.fk_remap.get(k) in circle]
            if spec.name in circle and held:
                raise Refused(f"{spec.name}: merge key {held[0]} refers to a table whose ids depend on it in turn")
        return circle

    def preflight(self) -> tuple[DataFrame, DataFrame]:
        """(findings, verdict) over every staged table; reads only, and each table once.

        Values the target cannot hold, keys that repeat, references without a parent,
        text in a wrong charset, values without a home, and what ``expect`` names, each with the
        sign-off that settles it where there is one. The findings are written down the first
        time, so that the gate and the report speak of the same ones.
        """
        if self._found is None:
            self._found = materialise(Preflight(self.spark, self.staging, self.seed, self._specs, self.expect).findings(), "findings")
        return self._found, K.preflight_verdict(self._found, self.accepted)

    def apply(self) -> None:
        """Write every table, its id map and its pre-merge snapshot. Refuses a closed gate."""
        verdict = self.preflight()[1].first()
        if verdict.exit_code:
            raise Refused(verdict.verdict)
        for group in self.groups():
            circle = self._circle(group)
            for spec in group:
                if spec.cls is TableClass.MERGE:
                    # the snapshot is written first and read back: every later step sees the same seed
                    self.seed[spec.name].write.mode("overwrite").parquet(self._path("preseed", spec.name))
                if spec.name in circle:
                    self._number(spec, circle)
            for spec in group:
                src = self.staging[spec.name]
                preserve_table(src, spec.cls, {home: self._path(f"kept/{home}", spec.name) for home in homes_of(spec.cls)})
                if spec.dropped:
                    dropped_shadow(src, spec).write.mode("overwrite").parquet(self._path("dropped", spec.name))
                if unknown_columns(spec, src):
                    unknown_shadow(src, spec).write.mode("overwrite").parquet(self._path("unknown", spec.name))
                if spec.cls is TableClass.MERGE:
                    self._merge(spec, spec.name in circle)
                elif spec.cls is TableClass.COPY:
                    self._sources(spec).select(*M.written_columns(spec)).write.mode("overwrite").parquet(self._path("live", spec.name))

    def _write(self, df: DataFrame, role: str, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(role, table))
        return self._read(role, table)

    def _number(self, spec: TableSpec, circle: frozenset[str]) -> None:
        """The ids and the id map of a table in a circle: they do not depend on the references, so a pass without them gives both."""
        seed = self._read("preseed", spec.name)
        judged = M.judge(self._sources(spec, circle), seed, spec)
        rows = M.numbered_rows(judged, seed).drop("_old_id", "_seeded", "_excluded", *[REMAP_PREFIX + c for c in spec.fk_remap])
        rows = self._write(rows, "numbered", spec.name)
        ids = rows.select(F.col(spec.source_of(spec.surrogate_pk)).alias("old_id"), F.col("_new_id").alias("new_id"))
        # target rows as far as twins look at them: the key and the id
        keys = [F.col(k).alias(n) for k, n in zip(judged.keys, spec.merge_keys)]
        live = seed.select(*spec.merge_keys, spec.surrogate_pk).unionByName(rows.select(*keys, F.col("_new_id").alias(spec.surrogate_pk)))
        self._write(M.merge_idmap(judged, ids, seed, live), "idmap", spec.name)

    def _merge(self, spec: TableSpec, numbered: bool) -> None:
        seed = self._read("preseed", spec.name)
        if numbered:
            rows = M.with_idmaps(self._read("numbered", spec.name), spec, self._maps(spec), [spec.source_of(k) for k in spec.key])
            added = M.stored_rows(rows, spec)
        else:
            judged = M.judge(self._sources(spec), seed, spec)
            added = M.appended_rows(judged, seed)
        # the inserted rows are written once: the live table, the id map and the counts read them
        added = self._write(added, "appended", spec.name)
        live = seed.unionByName(added.drop("_old_id"), allowMissingColumns=True)
        self._write(M.overridden_counts(self.staging[spec.name], added, spec), "overridden", spec.name)
        if spec.archived:
            key = [spec.surrogate_pk] if spec.surrogate_pk else list(spec.key)
            live = M.archived_backfill(live, seed, self._sources(spec), spec, key)
        live = self._write(live, "live", spec.name)
        if spec.surrogate_pk and not numbered:
            ids = added.select(F.col("_old_id").alias("old_id"), F.col(spec.surrogate_pk).alias("new_id"))
            self._write(M.merge_idmap(judged, ids, seed, live), "idmap", spec.name)

    def verify(self) -> DataFrame:
        """(table_name, item, rows): values that did not arrive, by table and claim."""
        out = None
        for spec in self._specs.values():
            if spec.cls not in (TableClass.COPY, TableClass.MERGE):
                kept = {home: {spec.name: self._read(f"kept/{home}", spec.name)} for home in homes_of(spec.cls)}
                rows = self._preserved(spec, kept)
            else:
                rows = self._arrived(spec)
            if rows is not None:
                out = rows if out is None else out.unionByName(rows)
        return out

    def _preserved(self, spec: TableSpec, kept: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame | None:
        if not kept:
            return None
        return P.preserved_parity({spec.name: self.staging[spec.name]}, kept).select(
            "table_name", F.concat(F.col("home"), F.lit(" home")).alias("item"),
            F.when(F.col("status") == "verified", 0).otherwise(1).cast("bigint").alias("rows"))

    def _arrived(self, spec: TableSpec) -> DataFrame:
        src, live = self._sources(spec), self._read("live", spec.name)
        counted = lambda df, item: df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(spec.name).alias("table_name"), F.lit(item).alias("item"), "rows")
        if spec.cls is TableClass.MERGE:
            preseed = self._read("preseed", spec.name)
            idmap = self._read("idmap", spec.name) if spec.surrogate_pk else None
            rows = P.merge_parity(src, live, preseed, idmap, spec, missing=True).select(F.lit(spec.name).alias("table_name"), F.col("claim").alias("item"), "rows")
            # keys that hold no reference are read without the id maps
            bare = src if {*spec.fk_remap, *spec.value_exprs} & set(spec.merge_keys) else self.staging[spec.name]
            rows = rows.unionByName(self._counted_rows(P.merge_row_parity(bare, live, spec)))
            if spec.archived:
                rows = rows.unionByName(self._archived_values(P.archived_column_parity(src, live, preseed, spec), spec))
            return rows
        if spec.name in self.rewritten:
            # named, with no count: not a pass
            state = P.copy_value_parity(src, live, spec, rewritten=self.rewritten[spec.name])
            return state.select("table_name", F.col("state").alias("item"), F.lit(None).cast("bigint").alias("rows"))
        if P.unpairable_reason(spec):
            rows = P.multiset_parity(src, live, spec).select(
                "table_name", F.lit("content").alias("item"), F.when(F.col("status") == "verified", 0).otherwise(1)
                .cast("bigint").alias("rows"))
        else:
            rows = P.copy_value_parity(src, live, spec).select("table_name", F.col("column_name").alias("item"), "rows")
            extra = live.select(*[F.col(k).alias(f"l_{k}") for k in spec.key]).join(
                src.select(*[written(spec, k).alias(f"s_{k}") for k in spec.key]),
                reduce(and_, [F.col(f"l_{k}").eqNullSafe(F.col(f"s_{k}")) for k in spec.key]), "left_anti")
            rows = rows.unionByName(counted(extra, "(surplus)"))
            for column, parent in spec.fk_remap.items():
                if parent in self._specs and len(self._specs[parent].key) == 1:
                    # against the raw source: a reference that has a parent must not be stored as NULL
                    own = self._specs[parent]
                    known = self.staging[parent].select(F.col(own.source_of(own.key[0])).alias("_p")).distinct()
                    raw = self.staging[spec.name]
                    held = raw.join(known, F.col(spec.source_of(column)) == F.col("_p"), "left_semi").select(
                        *[written(spec, k).alias(f"s_{k}") for k in spec.key if k not in spec.fk_remap])
                    if held.columns:
                        empty = live.where(F.col(column).isNull()).join(
                            held, reduce(and_, [F.col(c[2:]).eqNullSafe(F.col(c)) for c in held.columns]), "left_semi")
                        rows = rows.unionByName(counted(empty, f"{column}: lost references"))
        rows = rows.unionByName(self._counted_rows(P.copy_row_parity(src, live, spec.name, list(spec.key))))
        if spec.archived:
            rows = rows.unionByName(self._archived_values(P.archived_column_parity(src, live, None, spec), spec))
        return rows

    def _counted_rows(self, parity: DataFrame) -> DataFrame:
        return parity.select("table_name", F.lit("(row count)").alias("item"), F.when(F.col("state") == "pass", 0)
                             .otherwise(F.greatest(F.abs(F.col("target_rows") - F.col("expected_rows")), F.lit(1))).cast("bigint").alias("rows"))

    def _archived_values(self, parity: DataFrame, spec: TableSpec) -> DataFrame:
        lost = F.abs(F.col("source_values") - F.col("twin_surplus") - F.col("live_values"))
        return parity.select(F.lit(spec.name).alias("table_name"), F.concat(F.col("column_name"), F.lit(": archived values")).alias("item"), lost.cast("bigint").alias("rows"))

    def gate(self, recheck: DataFrame | None = None) -> DataFrame:
        """May staging be dropped: the homes that are the only copy of their rows are read again and digested.

        ``recheck`` has the claims (claim, rows) of mappings that the run depends on.
        """
        only = {s.name: self.staging[s.name] for s in self._specs.values() if s.cls not in (TableClass.COPY, TableClass.MERGE) and homes_of(s.cls)}
        homes: dict[str, dict[str, DataFrame]] = {}
        for name in only:
            for home in homes_of(self._specs[name].cls):
                homes.setdefault(home, {})[name] = self._read(f"kept/{home}", name)
        parity = None
        for home, tables in sorted(homes.items()):
            part = P.preserved_parity({t: only[t] for t in tables}, {home: tables})
            parity = part if parity is None else parity.unionByName(part)
        if parity is None:
            parity = self.spark.createDataFrame([], "home string, table_name string, status string, why string")
        claims = recheck if recheck is not None else self.spark.createDataFrame([], "claim string, rows bigint")
        return P.release_gate(parity, claims)

    def report(self, verified: DataFrame) -> DataFrame:
        """The long report: what arrived, where else it went, what was not checked, findings, verdict."""
        found, verdict = self.preflight()
        arrived = elsewhere = None
        for spec in self._specs.values():
            if spec.cls not in (TableClass.COPY, TableClass.MERGE):
                for home in homes_of(spec.cls):
                    row = self._read(f"kept/{home}", spec.name).agg(F.count(F.lit(1)).alias("rows")).select(
                        F.lit(f"{spec.name}: {home} rows").alias("item"), "rows")
                    elsewhere = row if elsewhere is None else elsewhere.unionByName(row)
                continue
            row = self._read("live", spec.name).agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(f"{spec.name}: live rows").alias("item"), "rows")
            arrived = row if arrived is None else arrived.unionByName(row)
            if spec.cls is TableClass.MERGE:
                row = self._read("overridden", spec.name).select(
                    F.lit(f"{spec.name}: beaten by the seed or excluded").alias("item"), F.col("overridden").alias("rows"))
                elsewhere = row if elsewhere is None else elsewhere.unionByName(row)
        unchecked = verified.where("rows IS NULL").select(F.concat_ws(": ", "table_name", "item").alias("item"), "rows")
        wrong = verified.where(F.col("rows") > 0).select(
            F.lit("not as written").alias("finding_id"), F.lit(K.BLOCKER).alias("severity"), "table_name",
            F.col("item").alias("column_name"), "rows", F.lit(None).cast("string").alias("accept"))
        skipped = self.spark.createDataFrame([(f"{t}.{c}: {w}", None) for t, c, w in self.notes], "item string, rows bigint")
        empty = skipped.where(F.lit(False))
        return K.import_report(arrived, elsewhere if elsewhere is not None else empty, skipped.unionByName(unchecked),
                               found.unionByName(wrong), verdict)
