"""Primary keys of tables that declare none: minimal sets of columns in which no two rows agree.

Sets are tried level by level, the smallest first. A set goes to the next level only if it
is no key, and a larger set is only tried if every set it contains went there, so what is
found is minimal. The product of the columns' distinct estimates spares many sets, slices of the hash
range most of the others: a set that is no key usually shows a repeat there. Slices are cut once a table. What is
left is counted over all rows, in shuffles of two 64-bit hashes per row and set, which are dealt before they are
counted; a shuffle holds several sets of a small table or one set of a large one, and its files go when it was
read. Rows that repeat as a whole rule all sets out: slices show whether many do, and all rows are counted
for it before many sets would be. Two rows that agree in a set agree in each set it contains: where a set that
few rows repeat in lies within several of those left, it is counted for them, and they are looked up on its repeats.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from carryover.session import materialise, shuffles_removed

# Size of the distinct sketches (log2 of their slots), their relative standard deviation, and the
# deviations of room a set gets before its columns' sketches alone rule it out.
SLOTS, DEVIATION, ROOM = 12, 0.0163, 8
# Sets that one job tries, and entries of them that one shuffle holds, unless a single set has more.
COUNTED, ENTRIES = 256, 32_000_000
# Entries that a task counts at once: above that many they are dealt first, since hardly any of them meets another.
DEALT = 1_000_000
# More sets than this are only counted over all rows once no two rows are found to repeat as a whole.
FEW = 8
# Rows of the slices of the hash range that are counted first, where most sets show a repeat, and
# the values a slice should hold of the column that it is cut by.
FIRST, SLICE, VALUES = 5_000, 1_000_000, 16
# A set of up to SMALL columns of whose rows at most this share repeats may be counted for its repeats, although it is no key.
SMALL, THIN = 2, 0.1
# Repeating hashes that are broadcast at once to find their rows, and the scans that a set's may take; more are joined by a shuffle.
FOUND, SCANS = 1_000_000, 16
# Types whose values are kept as they are; of all others two 64-bit hashes are.
NARROW = (S.NumericType, S.BooleanType, S.DateType, S.TimestampType, S.TimestampNTZType)


def _hashable(kind: S.DataType) -> bool:
    if isinstance(kind, S.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, S.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return not isinstance(kind, (S.MapType, S.VariantType))


def _blocks(items: list, size: int) -> Iterable[list]:
    return (items[i:i + size] for i in range(0, len(items), size))


def _estimate(columns: tuple[str, ...]) -> Column:
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*columns), SLOTS))


def _narrow(df: DataFrame) -> DataFrame:
    """``df`` with two 64-bit hashes for each value that is not of a narrow type."""
    hashed = lambda c: F.struct(*[F.xxhash64(F.lit(side), c).alias(side) for side in "ab"])
    return df.select(*[F.col(f.name) if isinstance(f.dataType, NARROW) else hashed(f.name).alias(f.name) for f in df.schema])


def _hashes(df: DataFrame, columns: Iterable[str], *keep: str) -> DataFrame:
    """Every column hashed twice, each time in its own way; a set's hash is the exclusive or of its columns'."""
    return df.select(*keep, *[F.xxhash64(F.lit(f"{c}{side}"), c).alias(f"{side}{c}") for side in "ab" for c in columns])


def _entries(rows: DataFrame, sets: Mapping[int, Mapping[int, tuple[str, ...]]], *keep: str) -> DataFrame:
    """(s, a, b) of each row and each numbered set of its ``part``; without the column ``part`` all rows are in part 0."""
    part = lambda side, s: " ^ ".join(f"{side}{c}" for c in s)
    whole = "part" not in rows.columns
    if whole and len(sets[0]) == 1:
        (i, s), = sets[0].items()
        return rows.select(*keep, F.lit(i).alias("s"), F.expr(part("a", s)).alias("a"), F.expr(part("b", s)).alias("b"))
    each = {p: ", ".join(f"named_struct('s', {i}, 'a', {part('a', s)}, 'b', {part('b', s)})" for i, s in held.items()) for p, held in sets.items()}
    if whole:
        return rows.select(*keep, F.expr(f"inline(array({each[0]}))"))
    chosen = " ".join(f"WHEN {p} THEN array({held})" for p, held in each.items())
    return rows.where(F.col("part").isin(*sets)).select(*keep, F.expr(f"inline(CASE part {chosen} END)"))


def _repeats(entries: DataFrame, size: int = 0) -> DataFrame:
    """Rows by entry. About ``size`` entries that are mostly different are dealt by hash: counting them before that would only fill memory."""
    if size > DEALT:
        entries = entries.repartition(-(-size // DEALT), "a")
    return entries.groupBy("s", "a", "b").agg(F.count(F.lit(1)).alias("n"))


class _Repeats:
    """The rows that repeat in sets of columns: in slices of a table, and over all rows."""

    def __init__(self, df: DataFrame, rows: int, distinct: Mapping[str, float], longest: int):
        self.whole, self.rows, self.distinct = tuple(distinct), rows, distinct
        self.table = _narrow(df.select(*self.whole))
        # the most telling columns of sets that can be keys
        self.leads = [c for c in self.whole if prod([distinct[c], *sorted((distinct[o] for o in self.whole if o != c and distinct[o] <= distinct[c]), reverse=True)[:longest - 1]]) >= rows]
        self.unique: bool | None = None  # does no row repeat as a whole, as far as known
        self.slices: dict[int, tuple[DataFrame, dict[str, int]]] = {}
        self.thin: dict[tuple[str, ...], float] = {}
        self.sizes: dict[tuple[str, ...], int] = {}
        self.frames: dict[tuple[str, ...], list[tuple[DataFrame, int]]] = {}

    def _slice(self, target: int) -> tuple[DataFrame, dict[str, int]]:
        """Rows of a slice by each leading column, and the part that it is. A column of too few values cuts none."""
        if target not in self.slices:
            cuts = {c: min(self.rows // target, int(self.distinct[c]) // VALUES) for c in self.leads}
            cuts = {c: cut for c, cut in cuts.items() if cut > 1}
            inside = {c: f"pmod(xxhash64('{c}a', {c}), {cut}L) = 0" for c, cut in cuts.items()}
            few = {c: f"pmod(xxhash64('{c}a', {c}), {10 * cut}L) = 0" for c, cut in cuts.items()}
            frame = self.table
            if cuts:
                taken = ", ".join(f"named_struct('part', {i}, 'taken', {inside[c]}, 'few', {few[c]})" for i, c in enumerate(cuts))
                frame = materialise(frame.where(" OR ".join(inside.values())).select("*", F.expr(f"inline(array({taken}))")).where("taken").drop("taken"), "slices")
            self.slices[target] = frame, {c: i for i, c in enumerate(cuts)}
        return self.slices[target]

    def shares(self, sets: Iterable[tuple[str, ...]], target: int) -> dict[tuple[str, ...], float]:
        """The sets that repeat in a slice of about ``target`` rows, and the share of its rows that do."""
        out: dict[tuple[str, ...], float] = {}
        frame, parts = self._slice(target)
        # the rows of a slice share its most telling column's hash, so rows that agree are in one slice
        led = {s: parts.get(max(s, key=self.distinct.get)) for s in sets}
        for few in (True, False) if target > 10 * FIRST else (False,):  # of a large slice a tenth first
            left = [s for s, p in led.items() if p is not None and s not in out]
            if left:
                out |= self._shares(frame.where("few") if few else frame, left, led, target // 10 if few else target)
        self.thin |= {s: share for s, share in out.items() if len(s) <= SMALL and share <= THIN}
        return out

    def _shares(self, frame: DataFrame, sets: list[tuple[str, ...]], led: Mapping[tuple[str, ...], int], target: int) -> dict[tuple[str, ...], float]:
        out = {}
        for block in _blocks(sets, max(1, min(COUNTED, ENTRIES // target))):
            held: dict[int, dict[int, tuple[str, ...]]] = {}
            for i, s in enumerate(block):
                held.setdefault(led[s], {})[i] = s
            found = _repeats(_entries(_hashes(frame, self.whole, "part"), held), target * len(block))
            found = found.groupBy("s").agg(F.sum("n").alias("n"), F.sum(F.expr("if(n > 1, n, 0)")).alias("again"))
            out |= {block[r.s]: r.again / r.n for r in found.where("again > 0").collect()}  # at most one row per set
        return out

    def smallest(self, columns: tuple[str, ...]) -> tuple[str, ...] | None:
        """The counted set within ``columns`` that has the fewest repeats."""
        within = [s for s in self.frames if set(s) <= set(columns)]
        return min(within, key=self.sizes.get, default=None)

    def count(self, sets: list[tuple[str, ...]], keep: bool) -> set[tuple[str, ...]]:
        """Those of ``sets`` that repeat over all rows; with ``keep`` their repeats are kept for larger sets."""
        out, kept = set(), []
        for block in _blocks(sets, max(1, min(COUNTED, ENTRIES // self.rows))):
            entries = _entries(_hashes(self.table, self.whole), {0: dict(enumerate(block))})
            again = materialise(_repeats(entries, self.rows * len(block)).where("n > 1"), "repeats")
            sizes = {block[r.s]: (r.n, r.hashes) for r in again.groupBy("s").agg(F.sum("n").alias("n"), F.count("n").alias("hashes")).collect()}  # at most one row per set
            out |= set(sizes)
            kept += [(s, *sizes[s], again.where(F.col("s") == i)) for i, s in enumerate(block) if s in sizes and sizes[s][0] <= max(FIRST, THIN * self.rows)]
        if keep:
            self._keep(kept)
        return out

    def _keep(self, found: list[tuple[tuple[str, ...], int, int, DataFrame]]) -> None:
        """Write down the rows that repeat, or that share a hash with some that do, in the sets that were ``found`` (set, rows, different hashes, hashes), as many sets at once as hashes can be broadcast."""
        parts, jobs = [], []
        for s, n, different, hashes in found:
            scans = -(-different // FOUND)
            if 1 < scans <= SCANS:  # rows that agree are in one of the scans
                parts += [(s, n // scans, different // scans, hashes.where(f"pmod(a, {scans}L) = {i}")) for i in range(scans)]
            else:
                parts.append((s, n, different, hashes))
            self.sizes[s], self.frames[s] = n, []
        for part in sorted(parts, key=lambda x: x[2]):
            if not jobs or len(jobs[-1]) == COUNTED or sum(x[2] for x in jobs[-1]) + part[2] > FOUND:
                jobs.append([])
            jobs[-1].append(part)
        for job in jobs:
            again = None
            for *_, hashes in job:
                again = hashes.select("a") if again is None else again.unionByName(hashes.select("a"))
            if sum(x[2] for x in job) <= FOUND:
                again = F.broadcast(again)
            numbered = {i: x[0] for i, x in enumerate(job)}
            rows = self.table.select("*", *[F.xxhash64(F.lit(f"{c}{side}"), c).alias(f"{side}{c}") for side in "ab" for c in self.whole])
            held = _entries(rows, {0: numbered}, *self.whole).join(again, "a", "left_semi")
            frame = materialise(held.select(F.col("s").alias("part"), *self.whole), "repeated")
            for i, s in numbered.items():
                self.frames[s].append((frame, i))

    def within(self, sets: list[tuple[str, ...]]) -> set[tuple[str, ...]]:
        """Those of ``sets`` that repeat, looked up on the repeats of a set that each contains."""
        out, jobs = set(), {}
        for s in sets:
            held = self.frames[smallest := self.smallest(s)]
            for frame, part in held:
                jobs.setdefault(id(frame), (frame, []))[1].append((part, s, self.sizes[smallest] // len(held)))
        for frame, wanted in jobs.values():
            for block in _blocks(wanted, max(1, min(COUNTED, ENTRIES // max(n for *_, n in wanted)))):
                parts: dict[int, dict[int, tuple[str, ...]]] = {}
                for i, (part, s, _) in enumerate(block):
                    parts.setdefault(part, {})[i] = s
                entries = _entries(_hashes(frame, self.whole, "part"), parts)
                found = _repeats(entries, sum(n for *_, n in block)).where("n > 1").select("s").distinct().collect()  # at most one row per set
                out |= {block[r.s][1] for r in found}
        return out

    def cover(self, sets: list[tuple[str, ...]], least: int) -> list[tuple[str, ...]]:
        """Sets that few rows repeat in, each within ``least`` or more of those of ``sets`` that none before it lies in."""
        out, left = [], list(sets)
        while True:
            held = {t: sum(set(t) < set(s) for s in left) for t in self.thin if t not in self.frames}
            best = max(held, key=lambda t: (held[t], -self.thin[t]), default=None)
            if best is None or held[best] < least or best in out:
                return out
            out.append(best)
            left = [s for s in left if not set(best) < set(s)]


def _repeating(repeats: _Repeats, sets: list[tuple[str, ...]], more: bool) -> set[tuple[str, ...]]:
    """The sets in which two rows agree. Equal pairs of 64-bit hashes count as equal values. ``more``: larger sets may follow."""
    out: set[tuple[str, ...]] = set()
    left = sets

    def known() -> list[tuple[str, ...]]:
        held = [s for s in left if repeats.smallest(s)]
        out.update(repeats.within(held))
        return [s for s in left if s not in set(held)]

    if left and repeats.rows > FIRST:
        out.update(repeats.shares(left, FIRST))
        left = [s for s in left if s not in out]
    left = known()
    if left and repeats.rows > SLICE:
        out.update(repeats.shares(left, SLICE))
        left = [s for s in left if s not in out]
    if len(left) > FEW and repeats.unique is None:
        repeats.unique = not repeats.count([repeats.whole], False)
    if repeats.unique is False:
        return set(sets)
    covers = repeats.cover(left, 1 if more else 2)
    if covers:
        repeats.count(covers, True)
        repeats.thin = {s: share for s, share in repeats.thin.items() if s not in covers}
        left = known()
    return out | repeats.count(left, more)


def _rows_repeat(repeats: _Repeats) -> bool:
    """Do rows repeat as a whole: in a slice of a large table, anywhere in one that is no larger than a slice."""
    if repeats.rows <= SLICE:
        return bool(repeats.count([repeats.whole], False))
    return any(repeats.shares([repeats.whole], target) for target in (FIRST, SLICE))


def minimal_keys(df: DataFrame, longest: int = 4, onward: bool = False) -> tuple[int, list[tuple[str, ...]]]:
    """(rows, every minimal key of up to ``longest`` columns) of one table, in the columns' order.

    With ``onward`` a table that has no such key is searched for larger ones, up to the first
    size that has some. A column with NULLs is no part of a key, nor is one that cannot be
    compared (a map). A table without rows has no key to show.
    """
    columns = [f.name for f in df.schema if _hashable(f.dataType)]
    if not columns:
        return df.count(), []
    df = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)])
    names = df.columns
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"v{c}") for c in names],
                 *[_estimate((c,)).alias(f"d{c}") for c in names]).first()
    rows, full = row.n, [c for c in names if row[f"v{c}"] == row.n]
    if not rows or not full:
        return rows, []
    most = 1 + ROOM * DEVIATION
    distinct = {c: row[f"d{c}"] * most + 1 for c in full}
    repeats = _Repeats(df, rows, distinct, len(full) if onward else longest)
    keys: list[tuple[str, ...]] = []
    level = [(c,) for c in full]
    for size in range(1, len(full) + 1):
        if size > longest and (keys or not onward):
            break
        likely = [s for s in level if prod(distinct[c] for c in s) >= rows]
        more = size < len(full) and (size < longest or onward)
        repeating = _repeating(repeats, likely, more)
        found = [s for s in likely if s not in repeating]
        keys += found
        if found:
            repeats.unique = True
        elif repeats.unique is None and size == 1 and _rows_repeat(repeats):
            repeats.unique = False
        if repeats.unique is False:
            break  # rows that repeat as a whole leave no key at all
        left = set(level) - set(found)
        heads = sorted(left)
        level = [(*s, c) for s in heads for c in full if names.index(c) > names.index(s[-1])
                 and all(part in left for part in combinations((*s, c), size))]
    return rows, [tuple(columns[int(c[1:])] for c in key) for key in keys]


def key_candidates(spark: SparkSession, tables: Mapping[str, DataFrame], *, longest: int = 4, onward: bool = False) -> DataFrame:
    """(table_name, key_columns, n_columns, rows, preferred): the minimal keys of a set of tables.

    ``preferred`` marks one key a table, what a declared primary key would be: the fewest
    columns, and of those the ones that come first. With ``onward`` every table that has a key at all
    shows it, however many columns it takes. The counting jobs run at once; only
    column names and counts reach the driver.
    """
    out = []
    for name in sorted(tables):
        df = tables[name]
        with shuffles_removed(spark):
            rows, keys = minimal_keys(df, longest, onward)
        place = {c: i for i, c in enumerate(df.columns)}
        ranked = sorted(keys, key=lambda k: (len(k), [place[c] for c in k]))
        out += [(name, list(key), len(key), rows, i == 0) for i, key in enumerate(ranked)]
    return spark.createDataFrame(out, "table_name string, key_columns array<string>, n_columns int, rows bigint, preferred boolean")


def with_key_positions(profile: DataFrame, keys: DataFrame) -> DataFrame:
    """A catalogue profile with each column's 1-based place in the table's preferred key, NULL outside."""
    placed = keys.where("preferred").select("table_name", F.posexplode("key_columns").alias("_at", "column_name"))
    return (profile.join(placed, ["table_name", "column_name"], "left")
            .select(*profile.columns, (F.col("_at") + 1).alias("key_position")))
