"""Every refusal gathered before the first write.

Value checks of one table share one aggregate (one scan); each is measured on the
value the write would store, not on the raw column. Reference checks are anti
joins on keys.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.functions.transforms import NUMERIC, TEXTUAL, null_zero
from carryover.operators.counting import beside, labelled_counts
from carryover.operators.skew import lookup
from carryover.spec import ColumnInfo, TableSpec, compared, source_expr

# The numeric literal grammar a text value must follow to be stored as a number.
NUMERIC_LITERAL = r"^\s*[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][-+]?[0-9]+)?\s*$"
# Inclusive integer ranges.
INTEGER_RANGE = {"tinyint": (-128, 127), "smallint": (-32768, 32767), "mediumint": (-8388608, 8388607),
                 "int": (-2147483648, 2147483647), "bigint": (-9223372036854775808, 9223372036854775807),
                 "tinyint unsigned": (0, 255), "smallint unsigned": (0, 65535), "mediumint unsigned": (0, 16777215),
                 "int unsigned": (0, 4294967295), "bigint unsigned": (0, 18446744073709551615)}
FLOAT_MAX = 3.4028234663852886e38
# What a TIMESTAMP column can hold, in UTC.
TIMESTAMP_RANGE = ("1970-01-01 00:00:01", "2038-01-19 03:14:07.999999")


def too_wide(value: Column, info) -> Column:
    """Characters for char and varchar, bytes for text and blob."""
    if info.type in ("char", "varchar"):
        return F.char_length(value) > info.length
    return F.octet_length(value) > info.length


def proven_to_fit(source, target) -> bool:
    """Whether declared widths alone prove that no value can overflow."""
    if source is None or source.length is None or target.length is None:
        return False
    if source.type in ("char", "varchar") and target.type in ("char", "varchar"):
        return source.length <= target.length
    if source.type in ("char", "varchar") and target.type == "text":
        return source.length * 4 <= target.length
    return source.type == target.type and source.length <= target.length


def not_a_number(value: Column) -> Column:
    return (F.trim(value) != "") & ~F.regexp_like(value, F.lit(NUMERIC_LITERAL))


def _decimal_parts(value: Column) -> tuple[Column, Column, Column]:
    """(significant digits, digits behind the point, is negative) of a number's own decimal text.

    Digits carry no zeros at either end, so 1500 is ("15", -2). Nothing is rounded, whatever
    the number's size or scale.
    """
    text = F.lower(F.trim(value.cast("string")))
    fraction = F.regexp_extract(text, "^[-+]?[0-9]*[.]([0-9]*)", 1)
    every = F.concat(F.regexp_extract(text, "^[-+]?([0-9]*)", 1), fraction)
    exponent = F.coalesce(F.regexp_extract(text, "e([-+]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    kept = F.rtrim(every, F.lit("0"))
    digits = F.ltrim(kept, F.lit("0"))
    behind = F.char_length(fraction) - exponent - F.char_length(every) + F.char_length(kept)
    return digits, F.when(digits == "", 0).otherwise(behind), text.startswith("-") & (digits != "")


# Digits before and behind the point of the source types that are compared as they are.
EXACT_SOURCES = {"tinyint": (3, 0), "smallint": (5, 0), "int": (10, 0), "bigint": (19, 0)}


def _native_capacity(value: Column, info, dtype: str | None) -> Column | None:
    """The same answer by plain arithmetic where the source's own type leaves room for it."""
    found = re.fullmatch(r"decimal\((\d+),(\d+)\)", dtype or "")
    if found:
        before, behind = int(found[1]) - int(found[2]), int(found[2])
    elif dtype in EXACT_SOURCES:
        before, behind = EXACT_SOURCES[dtype]
    else:
        return None
    if info.type in INTEGER_RANGE and max(before, 20) + behind <= 38:
        low, high = (F.lit(Decimal(bound)) for bound in INTEGER_RANGE[info.type])
        lossy = (value < low) | (value > high)
        return lossy | (value != F.bround(value, 0)) if behind else lossy
    if info.type == "decimal" and max(before, info.precision - info.scale + 1) + behind <= 38:
        bound = Decimal(10 ** (info.precision - info.scale))
        lossy = (value >= F.lit(bound)) | (value <= F.lit(-bound))
        return lossy | (value != F.bround(value, info.scale)) if behind > info.scale else lossy
    if info.type in ("float", "double") and before + behind <= 15:  # every such number is one double
        number = value.cast("double")
        return (number.cast("float").cast("double") != number) if info.type == "float" else F.lit(False)
    return None


def out_of_capacity(value: Column, info, dtype: str | None = None) -> Column:
    """Outside the target's range or scale, or not exactly what a float or double would hold. Never raises.

    ``dtype`` is the Spark type of ``value``; without it the number's text is compared.
    """
    native = _native_capacity(value, info, dtype)
    if native is not None:
        return value.isNotNull() & native
    digits, behind, negative = _decimal_parts(value)
    ahead = F.char_length(digits) - behind
    lossy = ~F.regexp_like(F.trim(value.cast("string")), F.lit(NUMERIC_LITERAL))
    if info.type in INTEGER_RANGE:
        def beyond(limit: int) -> Column:
            bound = str(abs(limit))
            longer = ahead > len(bound)
            return longer | ((ahead == len(bound)) & (F.rpad(digits, len(bound), "0") > bound)) if limit else digits != ""

        low, high = INTEGER_RANGE[info.type]
        lossy = lossy | (behind > 0) | F.when(negative, beyond(low)).otherwise(beyond(high))
    elif info.type == "decimal":
        lossy = lossy | (behind > info.scale) | (ahead > info.precision - info.scale)
    else:
        number = value.try_cast("double")
        held = number.cast("float").cast("double") if info.type == "float" else number
        same = [a.eqNullSafe(b) for a, b in zip(_decimal_parts(held), (digits, behind, negative))]
        lossy = lossy | number.isNull() | ~(same[0] & same[1] & same[2])
        if info.type == "float":
            lossy = lossy | (F.abs(number) > FLOAT_MAX)
    return value.isNotNull() & lossy


def temporal_loss(value: Column, info, digits: int = 0) -> Column:
    """Fraction or time of day the narrower type would drop, or a moment TIMESTAMP cannot hold.

    ``digits`` is the target's number of fraction digits, 0 to 6.
    """
    if digits not in range(7):
        raise ValueError(f"{digits} fraction digits: a moment has 0 to 6")
    if info.type == "time":
        fraction = F.rtrim(F.regexp_extract(value.cast("string"), "[.]([0-9]*)", 1), F.lit("0"))
        return value.isNotNull() & (F.char_length(fraction) > digits)
    moment = value.cast("timestamp_ntz")
    if info.type == "date":
        return value.isNotNull() & (moment != F.date_trunc("DAY", moment).cast("timestamp_ntz"))
    lost = F.pmod(F.unix_micros(moment.cast("timestamp")), F.lit(10 ** (6 - digits))) != 0
    if info.type == "timestamp":
        low, high = (F.lit(t).cast("timestamp_ntz") for t in TIMESTAMP_RANGE)
        lost = lost | (moment < low) | (moment > high)
    return value.isNotNull() & lost


def value_checks(df: DataFrame, spec: TableSpec, source: Mapping[str, object] | None = None,
                 fraction_digits: Mapping[str, int] | None = None) -> list[tuple[str, str, Column]]:
    """(column, check, predicate) for every value the target cannot hold. A width proven by metadata has no check."""
    source, digits = source or {}, fraction_digits or {}
    read = [c for c, i in spec.columns.items() if i.type in NUMERIC and not (c in spec.fk_remap and f"_remap_{c}" not in df.columns)]
    types = dict(df.select(*[source_expr(spec, c).alias(c) for c in read]).dtypes) if read else {}
    checks: list[tuple[str, str, Column]] = []
    for name, info in spec.columns.items():
        if name in spec.fk_remap and f"_remap_{name}" not in df.columns:
            continue
        value = source_expr(spec, name)
        declared = source.get(name)
        if info.type in TEXTUAL | {"binary", "blob"} and info.length and not proven_to_fit(declared, info):
            checks.append((name, "width", too_wide(value, info)))
        if info.type in NUMERIC:
            if declared is not None and declared.type in TEXTUAL and name not in spec.value_exprs:
                checks.append((name, "not_a_number", not_a_number(value)))
            checks.append((name, "capacity", out_of_capacity(value, info, types[name])))
        if info.type in ("date", "datetime", "timestamp", "time"):
            checks.append((name, "temporal", temporal_loss(value, info, digits.get(name, 0))))
    return checks


def precheck(df: DataFrame, spec: TableSpec, key: str, *, source: Mapping[str, object] | None = None,
             fraction_digits: Mapping[str, int] | None = None) -> DataFrame:
    """Values the target cannot hold: (table_name, column_name, check_name, rows, first_id).

    One scan for the whole table. A width proven by metadata is not scanned. A column
    that reads through an id map is measured on the mapped value once its map is joined.
    """
    checks = value_checks(df, spec, source, fraction_digits)
    # each predicate is evaluated once, then counted and located from its flag
    flags = df.select(F.col(key).alias("_key"), *[F.coalesce(t, F.lit(False)).alias(f"_b{i}")
                                                  for i, (_, _, t) in enumerate(checks)])
    aggregates = [a for i in range(len(checks)) for a in (
        F.count_if(f"_b{i}").alias(f"_n{i}"), F.min(F.when(F.col(f"_b{i}"), F.col("_key"))).alias(f"_f{i}"))]
    rows = [F.struct(F.lit(spec.name).alias("table_name"), F.lit(c).alias("column_name"), F.lit(k).alias("check_name"),
                     F.col(f"_n{i}").alias("rows"), F.col(f"_f{i}").alias("first_id"))
            for i, (c, k, _) in enumerate(checks)]
    return flags.agg(*aggregates).select(F.inline(F.array(*rows)))


def fk_violations(child: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]], scatter: Sequence[str],
                  hot_rows: int | None = None) -> DataFrame:
    """Child rows whose complete reference has no parent. A NULL part means no reference."""
    complete = child.dropna(subset=[c for c, _ in on])
    parents = parent.select(*[p for _, p in on]).distinct()
    return lookup(complete, parents, on, scatter=scatter, how="left_anti", hot_rows=hot_rows,
                  counted=complete.select(*[c for c, _ in on]))


def unmapped_becomes(info) -> str:
    """What a row holds whose reference the parent's id map does not know, by the rules of the write."""
    if not info.nullable:
        return "raw id"
    zero = null_zero(info)
    return "NULL" if zero is None else f"zero ({zero})"


def fk_unmapped(child: DataFrame, idmap: DataFrame, column: str, info: ColumnInfo | bool, scatter: Sequence[str],
                hot_rows: int | None = None) -> DataFrame:
    """References the parent's id map does not know: how many, and what the row will hold.

    ``info`` is the target column, or only whether it may be NULL.
    """
    if isinstance(info, bool):
        info = ColumnInfo("bigint", nullable=info)
    lost = lookup(child.where(F.col(column).isNotNull()), idmap.select("old_id"), [(column, "old_id")],
                  scatter=scatter, how="left_anti", hot_rows=hot_rows)
    return (lost.groupBy(F.col(column).alias("old_id")).agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("will_hold", F.lit(unmapped_becomes(info))))


def unique_conflicts(df: DataFrame, column: str, info=None) -> DataFrame:
    """Values that stop being unique under the target's comparison: (key, rows, extras)."""
    key = compared(F.col(column), info)
    return (df.where(F.col(column).isNotNull()).groupBy(key.alias("folded"))
            .agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
            .withColumn("extras", F.col("rows") - 1))


def sentinel_reference(child: DataFrame, column: str, parent: DataFrame, parent_key: str, sentinel: int,
                       scatter: Sequence[str], hot_rows: int | None = None) -> DataFrame:
    """One row: sentinel used as a real key, NULL references, invalid ones, unassigned ones."""
    clash = parent.agg(F.count_if(F.col(parent_key) == sentinel).alias("sentinel_is_real"))
    simple = child.agg(F.count_if(F.col(column).isNull()).alias("null_references"),
                       F.count_if(F.col(column) == sentinel).alias("unassigned"))
    real = child.where(F.col(column) != sentinel)
    invalid = fk_violations(real, parent, [(column, parent_key)], scatter, hot_rows).agg(
        F.count(F.lit(1)).alias("invalid"))
    return beside(clash, simple, invalid)


def unknown_objects(profile: DataFrame, mapped: DataFrame, *, prefix: str = "import_archived_", limit: int = 64,
                    reserved: Sequence[str] = ()) -> DataFrame:
    """Columns of a profile the mapping does not know, with the problems their names cause.

    Only tables that hold rows are reported. ``profile`` has table_name, column_name and
    rows; ``mapped`` has table_name and column_name.
    """
    known = mapped.select(F.lower("table_name").alias("_t"), F.lower("column_name").alias("_c")).distinct()
    lost = (profile.where(F.col("rows") > 0)
            .join(known, (F.lower("table_name") == F.col("_t")) & (F.lower("column_name") == F.col("_c")), "left_anti"))
    tables = known.select(F.col("_t").alias("_known_table")).distinct()
    placed = lost.join(tables, F.lower("table_name") == F.col("_known_table"), "left")
    helper = F.lit(False)
    for suffix in reserved:
        helper = helper | F.lower("table_name").endswith(suffix)
    return placed.select(
        "table_name", "column_name", "rows",
        F.when(F.col("_known_table").isNull(), "unknown table").otherwise("unknown column").alias("kind"),
        (~F.regexp_like("column_name", F.lit("^[A-Za-z0-9_$]+$"))).alias("unsafe_name"),
        (F.char_length("column_name") + len(prefix) > limit).alias("too_long"),
        helper.alias("reserved_name"))


def like_prefix(name: Column, prefixes: Sequence[str], keys: Sequence[str] = ()) -> Column:
    """Name starts with one of ``prefixes`` (taken literally) or equals one of ``keys``."""
    test = F.lit(False)
    for p in prefixes:
        test = test | name.startswith(p)
    return test | name.isin(*keys) if keys else test


def dropped_value_scan(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows with a non-default value in a column that has no home: (column_name, rows)."""
    return labelled_counts(df, ["column_name"], [((c,), p()) for c, p in spec.dropped.items()])


def required_presence(df: DataFrame, enabled: Column) -> DataFrame:
    """One row: rows, enabled rows and what that means."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(enabled).alias("enabled_rows")).select(
        "rows", "enabled_rows",
        F.when(F.col("rows") == 0, "empty").when(F.col("enabled_rows") == 0, "none enabled")
        .otherwise("present").alias("state"))


def ambiguous_basename(df: DataFrame, column: str) -> DataFrame:
    """File names that rows reach through different full paths, compared byte by byte.

    Distinct paths are reduced first, so a path repeated on many rows is one row when
    the names are grouped.
    """
    path = F.replace(F.col(column), F.lit("\\"), F.lit("/"))
    paths = df.where(F.col(column).isNotNull() & (F.col(column) != "")).select(path.alias("_path")).distinct()
    return (paths.groupBy(F.substring_index("_path", "/", -1).alias("name"))
            .agg(F.count(F.lit(1)).alias("paths")).where(F.col("paths") > 1))
