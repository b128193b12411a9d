"""What a user declares about a table: its mapping, its keys and its target columns.

A :class:`TableSpec` is driver-side metadata. ``written`` is the single
definition of the value that ends up in a target column; the copy, the merge and
every check call it, so a check cannot drift away from the write it checks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.functions import transforms as T
from carryover.functions.charset import validated_repair
from carryover.functions.text import fold

ARCHIVED_PREFIX = "import_archived_"
REMAP_PREFIX = "_remap_"

Factory = Callable[[], Column]


class TableClass(str, Enum):
    COPY = "copy"
    MERGE = "merge"
    ARCHIVE = "archive"
    DROP = "drop"
    REFERENCE = "reference"


@dataclass(frozen=True)
class ColumnInfo:
    """A target column. ``type`` is a family name, not a Spark type string."""

    type: str
    nullable: bool = True
    length: int | None = None          # characters for char/varchar, bytes for text and blob
    precision: int | None = None
    scale: int = 0
    default: object = None
    values: tuple[str, ...] = ()       # enum members
    collation: str = "binary"          # "binary" or "ci" (case and pad insensitive)
    primitive: bool = False            # may be NULL, but its readers cannot: a NULL is stored as the type's zero

    def spark_type(self) -> str:
        if self.type == "decimal":
            return f"decimal({self.precision},{self.scale})"
        return T.SPARK_TYPES[self.type]


@dataclass(frozen=True)
class TableSpec:
    name: str
    cls: TableClass = TableClass.COPY
    columns: Mapping[str, ColumnInfo] = field(default_factory=dict)
    renames: Mapping[str, str] = field(default_factory=dict)        # target -> source
    value_exprs: Mapping[str, Factory] = field(default_factory=dict)
    fk_remap: Mapping[str, str] = field(default_factory=dict)       # target column -> parent table
    key: tuple[str, ...] = ()                                       # primary key of the target
    merge_keys: tuple[str, ...] = ()
    surrogate_pk: str | None = None
    merge_exclude: Factory | None = None                            # over source columns
    archived: Mapping[str, str] = field(default_factory=dict)       # target -> source
    dropped: Mapping[str, Factory] = field(default_factory=dict)    # source -> "holds a non-default value"
    supplied: Mapping[str, object] = field(default_factory=dict)    # absent target column -> literal
    charset_scan: tuple[str, ...] = ()
    repaired: frozenset[str] = frozenset()
    chunk_by: str | None = None
    archive_twins: bool = True

    def source_of(self, column: str) -> str:
        if column in self.archived:
            return self.archived[column]
        return self.renames.get(column, column)

    @property
    def carried(self) -> list[str]:
        """Target columns the write fills, archived ones last."""
        return [*self.columns, *self.archived]


def source_expr(spec: TableSpec, column: str) -> Column:
    """The source value of a target column before the target's own rules apply."""
    if column in spec.value_exprs:
        return spec.value_exprs[column]()
    raw = F.col(spec.source_of(column))
    if column in spec.repaired:
        raw = validated_repair(raw)
    if column in spec.fk_remap:
        mapped = F.col(REMAP_PREFIX + column)
        return mapped if spec.columns[column].nullable else F.coalesce(mapped, raw)
    return raw


def written(spec: TableSpec, column: str) -> Column:
    """The value stored in ``column``: one definition for writers and checkers."""
    value = source_expr(spec, column)
    if column in spec.archived:
        return value
    info = spec.columns[column]
    return T.sanitize(value, info).cast(info.spark_type())


def written_columns(spec: TableSpec) -> list[Column]:
    named = [written(spec, c).alias(c) for c in spec.carried]
    return named + [F.lit(v).cast(spec.columns[c].spark_type() if c in spec.columns else T.literal_type(v)).alias(c)
                    for c, v in spec.supplied.items() if c not in spec.columns]


def compared(value: Column, info: ColumnInfo | None) -> Column:
    """A key value under the target's comparison: folded for a ci collation, else as stored."""
    if info is not None and info.collation == "ci":
        return fold(value)
    return value


def key_exprs(spec: TableSpec, stored: bool, keys: Sequence[str] | None = None) -> list[Column]:
    """Key columns ``_k0 ...``; ``stored`` picks the target side, else the written source value."""
    out = []
    for i, name in enumerate(keys or spec.merge_keys):
        value = F.col(name) if stored else written(spec, name)
        out.append(compared(value, spec.columns.get(name)).alias(f"_k{i}"))
    return out


def effective_spec(spec: TableSpec, source_columns: Iterable[str], tables: Iterable[str] | None = None
                   ) -> tuple[TableSpec, list[tuple[str, str]]]:
    """Reduce a spec to the columns a snapshot really has, and say what was left out.

    Names match regardless of case and keep the snapshot's spelling. A remap whose
    parent table is absent is dropped and reported, never silently applied.
    """
    real = {c.lower(): c for c in source_columns}
    notes: list[tuple[str, str]] = []
    columns, renames, archived, dropped = {}, {}, {}, {}
    for target, info in spec.columns.items():
        source = spec.renames.get(target, target)
        if target in spec.value_exprs:
            columns[target] = info
            continue
        found = real.get(source.lower())
        if found is None:
            notes.append((target, "skipped"))
            continue
        columns[target] = info
        if found != target:
            renames[target] = found
    for target, source in spec.archived.items():
        found = real.get(source.lower())
        if found is None:
            notes.append((target, "skipped"))
        else:
            archived[target] = found
    for source, predicate in spec.dropped.items():
        found = real.get(source.lower())
        if found is None:
            notes.append((source, "nothing to capture"))
        else:
            dropped[found] = predicate
    have = None if tables is None else {t.lower() for t in tables}
    remap = {}
    for column, parent in spec.fk_remap.items():
        if column not in columns:
            continue
        if have is not None and parent.lower() not in have:
            notes.append((column, "remap dropped"))
        else:
            remap[column] = parent
    missing_keys = [k for k in spec.merge_keys if k not in columns]
    notes.extend((k, "merge key missing") for k in missing_keys)
    supplied = dict(spec.supplied)
    for target, info in spec.columns.items():
        if target not in columns and not info.nullable:
            supplied[target] = info.default if info.default is not None else T.type_zero(info)
            notes.append((target, "default supplied"))
    return replace(spec, columns=columns, renames=renames, archived=archived, dropped=dropped,
                   fk_remap=remap, supplied=supplied), notes


def resolve_table(name: str, present: Iterable[str]) -> str | None:
    """Exact name first, else the only table that differs by case alone."""
    present = list(present)
    if name in present:
        return name
    folded = [t for t in present if t.lower() == name.lower()]
    return folded[0] if len(folded) == 1 else None


def known_columns(spec: TableSpec) -> set[str]:
    names = {spec.renames.get(c, c).lower() for c in spec.columns if c not in spec.value_exprs}
    names |= {c.lower() for c in spec.columns}
    return names | {c.lower() for c in spec.dropped}


def unknown_columns(spec: TableSpec, source: DataFrame) -> list[str]:
    known = known_columns(spec)
    return [c for c in source.columns if c.lower() not in known]


def with_archived(spec: TableSpec, source: DataFrame) -> TableSpec:
    """Give every column without a home an ``import_archived_`` column on the live table."""
    if not spec.archive_twins:
        return spec
    spelling = {c.lower(): c for c in source.columns}
    homeless = sorted({c.lower() for c in spec.dropped} | {c.lower() for c in unknown_columns(spec, source)})
    plan = {ARCHIVED_PREFIX + spelling[c]: spelling[c] for c in homeless if c in spelling}
    return replace(spec, archived={**spec.archived, **plan})
