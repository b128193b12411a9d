"""Where two copies of a table differ, found without joining what agrees.

Both copies are digested per range of the key, 1024 ranges at first. Ranges whose digests
agree are done with; the others are cut into 1024 parts each and digested again, and so on
until a range is small. Only the rows of those last ranges are paired and compared. What
disagrees is kept in written tables, so nothing about single ranges reaches the driver but
the few dozen intervals that later scans are narrowed to.

The place of a row is its key where that is one whole number, so that the intervals become
pushed filters of the scan, and a hash of the key otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.functions.transforms import INTEGERS
from carryover.operators.parity import any_mismatch, expected_value, paired, unpairable_reason
from carryover.session import materialise
from carryover.spec import TableSpec, compared

# Bits of the key that one level resolves, and the rows at which a range is small.
LEVEL_BITS = 10
SMALL_ROWS = 5_000
# Intervals a scan is narrowed to.
INTERVALS = 64
# Widths of the addends a 64-bit sum is kept in; neither overflows below 2**31 rows a range.
_HALF = 32


@dataclass
class Level:
    """One round: the width of its ranges as a power of two, and the rows on either side that it read."""

    shift: int
    source_rows: int
    target_rows: int
    unequal: int


@dataclass
class Side:
    """A copy with the place of each row (_range_place) and two hashes of what it holds (_range_a, _range_b)."""

    rows: DataFrame
    place: str | None                      # the column scans can be narrowed by
    whole: bool = True
    intervals: list[tuple[int, int]] = field(default_factory=list)

    def within(self, unequal: DataFrame | None, shift: int) -> DataFrame:
        out = self.rows
        if self.place and self.intervals:
            near = reduce(or_, [F.col(self.place).between(low, high) for low, high in self.intervals])
            out = out.where(near | F.col(self.place).isNull())
        if unequal is not None:
            out = out.join(unequal.select(F.col("range").alias("_range")), F.shiftright("_range_place", shift) == F.col("_range"), "left_semi")
        return out


def _whole_key(spec: TableSpec) -> bool:
    return len(spec.key) == 1 and spec.columns[spec.key[0]].type in INTEGERS


def _hashes(columns: list[str], kinds: Mapping[str, str], stored: Mapping[str, str]) -> list[Column]:
    """Two 64-bit hashes of a row. Values of unlike types are hashed as text, which no two different values share."""
    values = [F.col(c) if kinds[c] == stored[c] else F.col(c).cast("string") for c in columns]
    absent = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return [F.xxhash64(absent, *values).alias("_range_a"), F.xxhash64(F.lit(1), absent, *values).alias("_range_b")]


def sides(src: DataFrame, tgt: DataFrame, spec: TableSpec, overrides: Mapping[str, tuple[Column, Column]] | None = None) -> tuple[Side, Side]:
    """The two copies, each keeping its own columns, with place and hashes."""
    reason = unpairable_reason(spec)
    if reason:
        raise ValueError(f"{spec.name} has no ranges: {reason}")
    expected = src.select("*", *[expected_value(spec, c, overrides).alias(f"_e_{c}") for c in spec.carried])
    kinds = {c: dict(expected.dtypes)[f"_e_{c}"] for c in spec.carried}
    tgt = tgt.select(*spec.carried)
    stored = dict(tgt.dtypes)

    def placed(df: DataFrame, prefix: str, own: Mapping[str, str], other: Mapping[str, str]) -> DataFrame:
        keys = [compared(F.col(f"{prefix}{k}"), spec.columns[k]) for k in spec.key]
        if _whole_key(spec):
            place = F.coalesce(keys[0].cast("bigint"), F.lit(0).cast("bigint"))
        else:
            place = F.xxhash64(F.concat(*[F.when(k.isNull(), "1").otherwise("0") for k in keys]), *keys)
        named = df.select("*", place.alias("_range_place"), *[F.col(f"{prefix}{c}").alias(f"_v_{c}") for c in spec.carried])
        hashes = _hashes([f"_v_{c}" for c in spec.carried], {f"_v_{c}": own[c] for c in spec.carried}, {f"_v_{c}": other[c] for c in spec.carried})
        return named.select(*df.columns, "_range_place", *hashes)

    left = placed(expected, "_e_", kinds, stored).drop(*[f"_e_{c}" for c in spec.carried])
    right = placed(tgt, "", stored, kinds)
    narrow = {"bigint", "int", "smallint", "tinyint"}
    key, raw = spec.key[0], spec.source_of(spec.key[0])
    plain = _whole_key(spec) and key not in spec.value_exprs and key not in spec.fk_remap and not (overrides and key in overrides)
    return (Side(left, raw if plain and dict(src.dtypes).get(raw) in narrow else None),
            Side(right, key if _whole_key(spec) and stored[key] in narrow else None))


def _digests(rows: DataFrame, shift: int, name: str) -> DataFrame:
    low = F.col("_range_b").bitwiseAND((1 << _HALF) - 1)
    return rows.groupBy(F.shiftright("_range_place", shift).alias("range")).agg(
        F.count(F.lit(1)).alias(f"{name}_rows"), F.bit_xor("_range_a").alias(f"_{name}_xor"),
        F.sum(F.shiftright("_range_b", _HALF)).alias(f"_{name}_high"), F.sum(low).alias(f"_{name}_low"))


def _compared(source: DataFrame, target: DataFrame, shift: int) -> DataFrame:
    """Every range of either side with its rows and whether the two digests agree."""
    both = _digests(source, shift, "source").join(_digests(target, shift, "target"), "range", "full_outer")
    same = reduce(and_, [F.col(f"{a}source{b}").eqNullSafe(F.col(f"{a}target{b}")) for a, b in (("", "_rows"), ("_", "_xor"), ("_", "_high"), ("_", "_low"))])
    zero = F.lit(0).cast("bigint")
    return both.select("range", F.coalesce("source_rows", zero).alias("source_rows"), F.coalesce("target_rows", zero).alias("target_rows"), same.alias("same"))


def _intervals(unequal: DataFrame, shift: int, before: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """At most INTERVALS intervals of places that cover the unequal ranges; too many ranges keep what was known before."""
    most = 1 << LEVEL_BITS
    found = sorted(r.range for r in unequal.select("range").limit(most + 2).collect())
    if len(found) > most + 1:
        return before
    edges = [(r << shift, ((r + 1) << shift) - 1) for r in found]
    gaps = sorted(range(1, len(edges)), key=lambda i: edges[i - 1][1] - edges[i][0])  # the widest first
    cuts = [0, *sorted(gaps[:INTERVALS - 1]), len(edges)]
    return [(edges[a][0], edges[b - 1][1]) for a, b in zip(cuts, cuts[1:]) if b > a]


def unequal_ranges(source: Side, target: Side, *, small_rows: int = SMALL_ROWS, level_bits: int = LEVEL_BITS) -> tuple[DataFrame, int, list[Level]]:
    """(ranges, shift, levels): the small ranges (range, source_rows, target_rows) whose digests differ.

    A range holds the places ``range << shift`` to ``((range + 1) << shift) - 1``.
    """
    if source.place or target.place:
        ends = [r for side in (source, target) for r in side.rows.agg(F.min("_range_place"), F.max("_range_place")).first() if r is not None]
        bits = (max(ends) - min(ends)).bit_length() if ends else 0
    else:
        bits = 64
    shift, unequal, levels = max(0, bits - level_bits), None, []
    above = shift
    while True:
        checked = materialise(_compared(source.within(unequal, above), target.within(unequal, above), shift), "ranges")
        read = checked.agg(F.coalesce(F.sum("source_rows"), F.lit(0)).alias("s"), F.coalesce(F.sum("target_rows"), F.lit(0)).alias("t"),
                           F.count_if(~F.col("same")).alias("n"),
                           F.coalesce(F.max(F.when(~F.col("same"), F.greatest("source_rows", "target_rows"))), F.lit(0)).alias("most")).first()
        levels.append(Level(shift, read.s, read.t, read.n))
        unequal, above = checked.where("NOT same").drop("same"), shift
        for side in (source, target):
            side.intervals = _intervals(unequal, shift, side.intervals)
        if shift == 0 or read.most <= small_rows:
            return unequal, shift, levels
        shift = max(0, shift - level_bits)


def difference_ranges(src: DataFrame, tgt: DataFrame, spec: TableSpec, overrides: Mapping[str, tuple[Column, Column]] | None = None, *,
                      small_rows: int = SMALL_ROWS, level_bits: int = LEVEL_BITS) -> tuple[DataFrame, DataFrame, list[Level]]:
    """(rows, ranges, levels): every row that differs, is missing or is surplus, by descending into unequal ranges.

    ``rows`` has the key and ``state``: ``differs`` and ``missing`` are the rows of
    ``mismatch_keys`` without its cap, ``surplus`` the target rows that no source row stands for.
    The digest jobs run at once.
    """
    source, target = sides(src, tgt, spec, overrides)
    unequal, shift, levels = unequal_ranges(source, target, small_rows=small_rows, level_bits=level_bits)
    ranges = unequal.select(F.shiftleft("range", shift).alias("low"), (F.shiftleft("range", shift) + F.lit((1 << shift) - 1)).alias("high"),
                            "source_rows", "target_rows")
    if not levels[-1].unequal:  # equal copies
        left, right = src.limit(0), tgt.select(spec.carried).limit(0)
    else:
        left, right = source.within(unequal, shift).select(src.columns), target.within(unequal, shift).select(spec.carried)
    pairs = paired(left, right, spec, overrides)
    bad = pairs.where(F.col("_found").isNull() | any_mismatch(spec, spec.carried)).select(
        *[F.col(f"e_{k}").alias(k) for k in spec.key], F.when(F.col("_found").isNull(), "missing").otherwise("differs").alias("state"))
    wanted = left.select(*[compared(expected_value(spec, k, overrides), spec.columns[k]).alias(f"_w{i}") for i, k in enumerate(spec.key)])
    same = reduce(and_, [compared(F.col(k), spec.columns[k]).eqNullSafe(F.col(f"_w{i}")) for i, k in enumerate(spec.key)])
    surplus = right.join(wanted, same, "left_anti").select(*[F.col(k).cast(dict(bad.dtypes)[k]).alias(k) for k in spec.key], F.lit("surplus").alias("state"))
    return bad.unionByName(surplus), ranges, levels
