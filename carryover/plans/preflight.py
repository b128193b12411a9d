"""All checks of a run from one scan per table.

Checks differ in what they need: a predicate per row, the repeats of a key, references
against another table's keys, the paths behind a file name. All of them can be read off
tallies, (kind, value, rows): a row gives one entry for each predicate it fails, for its key, its
references and its path, and equal entries are counted before they are shuffled. So a table is
scanned once, whatever is checked on it, and a reference meets the tallied keys of its
parent, not the parent. The findings are a handful of joins over the tallies of all tables, however
many tables there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover.functions.charset import census_lanes
from carryover.operators import findings as K
from carryover.operators.prechecks import unknown_objects, unmapped_becomes, value_checks
from carryover.session import scratch
from carryover.sources.catalog import pristine_check, schema_diff
from carryover.spec import Factory, TableClass, TableSpec, compared, known_columns

# Tables tallied by one job; more tables are appended job by job.
TABLES_AT_ONCE = 40
_TALLY = "table_name string, kind string, value string, rows bigint"
_SEED = "seed of "


@dataclass
class Expectations:
    """What a run should find beyond its mapping; everything is optional."""

    required: Mapping[str, Factory] = field(default_factory=dict)                  # table -> "this row is enabled"
    sentinels: Mapping[tuple[str, str], int] = field(default_factory=dict)         # (table, reference) -> stands for "none"
    paths: Mapping[str, str] = field(default_factory=dict)                         # table -> column whose file names tell rows apart
    schema: DataFrame | None = None                                                # table_name, column_name, data_type the mapping was made for
    pristine: DataFrame | None = None                                              # of the seed: see catalog.pristine_check


@dataclass
class Check:
    """A finding in waiting: which tally it reads and what it becomes."""

    table: str
    kind: str
    finding: str
    severity: str
    column: str | None = None
    accept: str | None = None
    parent: str | None = None


@dataclass
class Entry:
    kind: str
    value: Column | None
    when: Column


def _text(value: Column, kind: str) -> Column:
    """A key as text, spelled alike in the parent and in what refers to it."""
    return F.coalesce(value.try_cast(kind).cast("string"), value.cast("string"))


class Preflight:
    def __init__(self, spark: SparkSession, staging: Mapping[str, DataFrame], seed: Mapping[str, DataFrame],
                 specs: Mapping[str, TableSpec], expect: Expectations):
        self.spark, self.staging, self.seed, self.specs, self.expect = spark, staging, seed, specs, expect
        self.checks: list[Check] = []
        self.entries: dict[str, list[Entry]] = {name: [] for name in staging}
        self.frames: dict[str, DataFrame] = dict(staging)
        self._keyed: set[str] = set()
        for spec in specs.values():
            self._of(spec)

    def _add(self, check: Check, value: Column | None, when: Column) -> None:
        self.checks.append(check)
        self.entries[check.table].append(Entry(check.kind, value, F.coalesce(when, F.lit(False))))

    def _key_kind(self, parent: str) -> str:
        own = self.specs[parent]
        return own.columns[own.key[0]].spark_type() if own.key[0] in own.columns else "string"

    def _key(self, table: str) -> None:
        """Tally the keys of a table that is referred to or whose key must not repeat."""
        if table not in self._keyed:
            self._keyed.add(table)
            raw = F.col(self.specs[table].source_of(self.specs[table].key[0]))
            self.entries[table].append(Entry("key", _text(raw, self._key_kind(table)), raw.isNotNull()))

    def _of(self, spec: TableSpec) -> None:
        df, name = self.staging[spec.name], spec.name
        for column, check, test in value_checks(df, spec):
            self._add(Check(name, f"{check} {column}", f"value-{check}", K.BLOCKER, column), None, test)
        if len(spec.key) == 1 and spec.cls is TableClass.COPY and spec.key[0] in spec.columns:
            column, info = spec.key[0], spec.columns[spec.key[0]]
            if info.collation == "ci":
                raw = F.col(spec.source_of(column))
                self._add(Check(name, "folded key", "key-repeats", K.BLOCKER, column), compared(raw, info).cast("string"), raw.isNotNull())
            else:
                self._key(name)
                self.checks.append(Check(name, "key", "key-repeats", K.BLOCKER, column))
        for column, parent in spec.fk_remap.items():
            if parent in self.specs and len(self.specs[parent].key) == 1:
                self._reference(spec, column, parent)
        scanned = [spec.source_of(c) for c in spec.charset_scan if c not in spec.repaired]
        if scanned:
            # a column that the mapping repairs was signed off with the mapping
            self.frames[name], lanes = census_lanes(df, scanned)
            for column, lane, accept, test in lanes:
                self._add(Check(name, f"charset {lane} {column}", f"charset-{lane}", K.BLOCKER, column, accept), None, test)
        for column, test in spec.dropped.items():
            self._add(Check(name, f"dropped {column}", "value-without-home", K.ADVISORY, column), None, test())
        if name in self.expect.required:
            self._add(Check(name, "enabled", "required-rows-missing", K.BLOCKER, None, "missing-required-rows"), None, self.expect.required[name]())
        if name in self.expect.paths:
            path = F.replace(F.col(self.expect.paths[name]), F.lit("\\"), F.lit("/"))
            self._add(Check(name, "path", "ambiguous-file-name", K.BLOCKER, self.expect.paths[name], "ambiguous-file-names"), path, path != "")

    def _reference(self, spec: TableSpec, column: str, parent: str) -> None:
        self._key(parent)
        info, raw = spec.columns[column], F.col(spec.source_of(column))
        used = raw.isNotNull()
        sentinel = self.expect.sentinels.get((spec.name, column))
        if sentinel is not None:
            used = used & (raw != sentinel)
            # a stand-in that is somebody's key would be taken for that row
            key = F.col(self.specs[parent].source_of(self.specs[parent].key[0]))
            self._add(Check(parent, f"sentinel of {spec.name}.{column}", "sentinel-is-a-key", K.BLOCKER, self.specs[parent].key[0]), None, key == sentinel)
        # a reference that may be NULL becomes NULL or its type's zero, which is said; any other stays raw, which needs a sign-off
        becomes = unmapped_becomes(info)
        finding = "reference-becomes-zero" if becomes.startswith("zero") else "reference-without-parent"
        accept = None if info.nullable else "keep-raw-references"
        self._add(Check(spec.name, f"reference {column}", finding, K.ADVISORY if info.nullable else K.BLOCKER, column, accept, parent),
                  _text(raw, self._key_kind(parent)), used)

    def tally(self, table: str) -> DataFrame:
        """(table_name, kind, value, rows) of one table."""
        rows = [Entry("rows", None, F.lit(True)), *self.entries[table]]
        found = F.array(*[F.when(e.when, F.struct(F.lit(e.kind).alias("kind"), (F.lit(None) if e.value is None else e.value).cast("string").alias("value")))
                          for e in rows])
        each = self.frames[table].select(F.inline(F.filter(found, lambda e: e.isNotNull())))
        return each.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(table).alias("table_name"), "kind", "value", "rows")

    def tallies(self) -> DataFrame:
        """The tallies of all tables, written down: one scan per table."""
        parts = [self.tally(t) for t in self.staging]
        if self.expect.pristine is not None:
            parts += [df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(_SEED + t).alias("table_name"), F.lit("rows").alias("kind"), F.lit(None).cast("string").alias("value"), "rows") for t, df in self.seed.items()]
        path = scratch(self.spark, "tallies")
        self.spark.createDataFrame([], _TALLY).write.parquet(path)
        for i in range(0, len(parts), TABLES_AT_ONCE):
            some = parts[i]
            for part in parts[i + 1:i + TABLES_AT_ONCE]:
                some = some.unionByName(part)
            some.write.mode("append").parquet(path)
        return self.spark.read.schema(_TALLY).parquet(path)

    def _as_frame(self, checks: Sequence[Check]) -> DataFrame:
        return self.spark.createDataFrame(
            [(c.table, c.kind, c.finding, c.severity, c.column, c.accept, c.parent) for c in checks],
            "table_name string, kind string, finding_id string, severity string, column_name string, accept string, parent string")

    def findings(self) -> DataFrame:
        """Every check that found something: (finding_id, severity, table_name, column_name, rows, accept)."""
        # a row per check of the mapping, however large the tables are
        tallies, checks = self.tallies(), F.broadcast(self._as_frame(self.checks))
        at = ["table_name", "kind"]
        listed = F.col("finding_id")
        found = tallies.join(checks, at)
        # keys and references are judged below, all other entries are rows that fail a check
        simple = found.where(~listed.isin("key-repeats", "ambiguous-file-name", "required-rows-missing") & F.col("parent").isNull())
        repeats = found.where((listed == "key-repeats") & (F.col("rows") > 1)).withColumn("rows", F.col("rows") - 1)
        keys = tallies.where("kind = 'key'").select(F.col("table_name").alias("parent"), "value")
        lost = found.where(F.col("parent").isNotNull()).join(keys, ["parent", "value"], "left_anti").select(found.columns)
        out = [f.groupBy(*at).agg(F.sum("rows").alias("rows")).join(checks, at) for f in (simple, repeats, lost)]
        names = found.where(listed == "ambiguous-file-name").groupBy(*at, F.substring_index("value", "/", -1).alias("name")).agg(F.count(F.lit(1)).alias("paths"))
        out.append(names.where("paths > 1").groupBy(*at).agg(F.count(F.lit(1)).alias("rows")).join(checks, at))
        missing = checks.where(listed == "required-rows-missing").join(tallies.select(*at).distinct(), at, "left_anti")
        out.append(missing.withColumn("rows", F.lit(1).cast("bigint")))
        return K.findings([*[f.select(*K.FINDING) for f in out], *self._of_metadata(tallies.where("kind = 'rows'").select("table_name", "rows"))])

    def _of_metadata(self, rows: DataFrame) -> list[DataFrame]:
        """Unknown objects, differences of the schema and a target that is not as it was set up."""
        shape = [(t, f.name, f.dataType.simpleString()) for t, df in self.staging.items() for f in df.schema]
        profile = self.spark.createDataFrame(shape, "table_name string, column_name string, data_type string").join(rows, "table_name", "left").na.fill(0, ["rows"])
        mapped = [(t, c) for t, spec in self.specs.items() for c in {*known_columns(spec), *(s.lower() for s in spec.archived.values())}]
        unknown = unknown_objects(profile, self.spark.createDataFrame(mapped, "table_name string, column_name string"))
        whole = F.col("kind") == "unknown table"
        unsafe = F.col("unsafe_name") | F.col("too_long")
        text = lambda v: F.lit(v).cast("string")
        out = [unknown.select(
            F.when(whole, "unknown-table").when(unsafe, "unknown-column-unsafe-name").otherwise("unknown-column").alias("finding_id"),
            F.when(whole | unsafe, K.BLOCKER).otherwise(K.ADVISORY).alias("severity"), "table_name",
            F.when(~whole, F.col("column_name")).alias("column_name"), "rows", F.when(whole, "leave-unknown-tables").alias("accept")).distinct()]
        if self.expect.schema is not None:
            change = schema_diff(self.expect.schema, profile)
            widened = F.col("change") == "lossless widening"
            out.append(change.where("change <> 'unexpected column'").select(
                F.concat(F.lit("schema-"), F.replace("change", F.lit(" "), F.lit("-"))).alias("finding_id"),
                F.when(widened, K.INFO).otherwise(K.BLOCKER).alias("severity"), "table_name", "column_name",
                F.greatest(F.coalesce("rows", F.lit(0)), F.lit(1)).alias("rows"), F.when(~widened, "schema-differs").alias("accept")))
        if self.expect.pristine is not None:
            counts = rows.where(F.col("table_name").startswith(_SEED)).withColumn("table_name", F.substring("table_name", len(_SEED) + 1, 1000))
            judged = pristine_check(counts, self.expect.pristine).where("state NOT IN ('pristine', 'tolerated')")
            out.append(judged.select(text("target-not-pristine").alias("finding_id"), text(K.BLOCKER).alias("severity"), "table_name", text(None).alias("column_name"),
                                     F.abs(F.col("rows") - F.col("expected")).alias("rows"), text("target-not-pristine").alias("accept")))
        return out
