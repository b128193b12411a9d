"""What value is stored: the per-column rules of a target, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column families and the Spark type that holds them.
SPARK_TYPES = {
    "tinyint": "tinyint", "smallint": "smallint", "mediumint": "int", "int": "int", "bigint": "bigint",
    "tinyint unsigned": "smallint", "smallint unsigned": "int", "mediumint unsigned": "int", "int unsigned": "bigint",
    "bigint unsigned": "decimal(20,0)", "float": "float", "double": "double", "bit": "boolean",
    "year": "int", "date": "date", "datetime": "timestamp_ntz", "timestamp": "timestamp",
    "char": "string", "varchar": "string", "text": "string", "enum": "string", "set": "string",
    "json": "string", "time": "string", "binary": "binary", "blob": "binary",
}
INTEGERS = {"tinyint", "smallint", "mediumint", "int", "bigint"}
NUMERIC = INTEGERS | {f"{t} unsigned" for t in INTEGERS} | {"decimal", "float", "double"}
TEMPORAL = {"date", "datetime", "timestamp"}
TEXTUAL = {"char", "varchar", "text", "enum", "set", "json"}

# Spellings of a zero date, and the sentinels that stand for one in
# columns that may not be NULL (Spark dates start at year 1).
ZERO_DATES = ("0000-00-00", "0000-00-00 00:00:00")
SENTINEL_DATE = "0001-01-01"
SENTINEL_DATETIME = "0001-01-01 00:00:00"


def literal_type(value: object) -> str:
    return {bool: "boolean", int: "bigint", float: "double"}.get(type(value), "string")


def zero_date_null(value: Column) -> Column:
    """Zero dates become NULL; everything else is untouched. Works on the text form."""
    return F.when(F.trim(value).isin(*ZERO_DATES), F.lit(None)).otherwise(value)


def type_zero(info) -> object | None:
    """The value a NULL falls to on a NOT NULL column, or None where only the user can say.

    ``timestamp`` has no such value (the reference server would store the moment
    of the insert) and ``enum`` has its own rule.
    """
    if info.type in ("timestamp", "enum"):
        return None
    if info.type == "bit":
        return False
    if info.type in NUMERIC or info.type == "year":
        return 0
    if info.type == "date":
        return SENTINEL_DATE
    if info.type == "datetime":
        return SENTINEL_DATETIME
    if info.type == "time":
        return "00:00:00"
    return ""


def enum_fallback(info) -> Column:
    """The column default, else NULL where allowed, else the first member."""
    if info.default is not None:
        return F.lit(info.default)
    return F.lit(None).cast("string") if info.nullable else F.lit(info.values[0])


def enum_fold(value: Column, info) -> Column:
    folded = F.when(value.isin(*info.values), value).otherwise(enum_fallback(info))
    return F.when(value.isNull(), F.lit(None).cast("string")).otherwise(folded) if info.nullable else folded


def null_zero(info) -> object | None:
    """What a NULL is stored as, None where it stays NULL or only the user can say."""
    return None if info.nullable and not info.primitive else type_zero(info)


def not_null_fallback(value: Column, info) -> Column:
    zero = null_zero(info)
    if zero is None:
        return value
    return F.coalesce(value, F.lit(zero).cast(info.spark_type()))


def sanitize(value: Column, info) -> Column:
    """Zero dates, enum members and NOT NULL, in that order."""
    if info.type == "enum" and info.values:
        value = enum_fold(value, info)
    elif info.type in TEMPORAL and info.nullable:
        value = value_or_null_date(value)
    elif info.type in NUMERIC:
        value = value.cast(info.spark_type())
    return not_null_fallback(value, info)


def value_or_null_date(value: Column) -> Column:
    """Zero dates in a text source become NULL; real temporal columns never hold one."""
    text = value.cast("string")
    return F.when(text.isin(*ZERO_DATES), F.lit(None)).otherwise(value)


def coercion_counts(df: DataFrame, spec) -> DataFrame:
    """How many rows each column's rules change: (column_name, rule, rows), in one scan."""
    from carryover.operators.counting import labelled_counts
    from carryover.spec import source_expr

    checks = []
    for name, info in spec.columns.items():
        raw = source_expr(spec, name)
        if info.type == "enum" and info.values:
            outside = ~raw.isin(*info.values)
            if not info.nullable:
                outside = outside | raw.isNull()
            checks.append(((name, "enum_fallback"), outside))
        elif null_zero(info) is not None:
            checks.append(((name, "not_null_fallback"), raw.isNull()))
        if info.type in TEMPORAL and info.nullable:
            checks.append(((name, "zero_date"), raw.cast("string").isin(*ZERO_DATES)))
    return labelled_counts(df, ["column_name", "rule"], checks)


def code_map(value: Column, mapping: Mapping[str, str]) -> Column:
    """Case-sensitive code rewrite; a code outside the map is kept."""
    pairs = [F.lit(x) for old, new in mapping.items() for x in (old, new)]
    return F.coalesce(F.create_map(*pairs)[value], value)


def code_map_report(df: DataFrame, column: str, mapping: Mapping[str, str], known: Iterable[str]) -> DataFrame:
    """Per code: rows, the code it becomes and whether it is rewritten, known or unknown."""
    known = sorted(set(known))
    counted = df.groupBy(F.col(column).alias("code")).agg(F.count(F.lit(1)).alias("rows"))
    becomes = code_map(F.col("code"), mapping)
    state = (F.when(F.col("code").isin(*mapping), "rewritten")
             .when(F.col("code").isin(*known), "known").otherwise("unknown"))
    return counted.select(F.coalesce("code", F.lit("<NULL>")).alias("code"),
                          F.coalesce(becomes, F.lit("<NULL>")).alias("canonical"),
                          state.alias("state"), "rows")


def marker_rewrite(value: Column, marker: str, replacement: str) -> Column:
    return F.replace(value, F.lit(marker), F.lit(replacement))


def basename_rewrite(path: Column, root: str) -> Column:
    """Point a stored path at its file name below ``root``. Rewriting twice changes nothing."""
    from carryover.functions.text import basename

    root = root.rstrip("/") + "/"
    return F.when(path.isNull() | (path == ""), path).otherwise(F.concat(F.lit(root), basename(path)))


def resolve_segments(path: Column) -> Column:
    """An absolute path with ``.``, ``..`` and doubled separators resolved."""
    segments = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s != "..", F.concat(acc, F.array(s)))
        .when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def context_rewrite(path: Column, marker: str, root: str) -> Column:
    """``<anything><marker>/<context>/<tail>`` becomes ``<root>/<tail>``.

    The result is resolved first and must lie at or below ``root``; a tail that
    climbs out gives NULL, as does a path without the marker and a context.
    """
    root = root.rstrip("/")
    # what follows the first occurrence of the marker: a context, then the tail
    start = F.locate(marker + "/", path)
    parts = F.split(F.substring(path, start + len(marker) + 1, F.char_length(path)), "/")
    marked = (start > 0) & (F.get(parts, F.lit(0)) != "")
    moved = resolve_segments(F.concat(F.lit(root + "/"), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "/")))
    inside = (moved == root) | moved.startswith(root + "/")
    slash = F.when(path.endswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.when(marked & inside, F.concat(moved, slash))


def prefix_rule(key: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """Disposition of the first rule, in the order given, whose prefix starts ``key``."""
    chain = None
    for prefix, disposition in rules:
        test = key.startswith(prefix)
        chain = F.when(test, disposition) if chain is None else chain.when(test, disposition)
    return F.lit(otherwise) if chain is None else chain.otherwise(otherwise)


def key_disposition(key: Column, value: Column, *, defaults: Mapping[str, str], new_defaults: Mapping[str, str],
                    exact: Mapping[str, str], prefixes: Sequence[tuple[str, str]],
                    always_carried: Sequence[str] = ()) -> Column:
    """What happens to one setting.

    An untouched default is skipped (``new-default`` where the new default
    differs); otherwise an exact rule, else the first matching prefix, else
    ``unknown``. Keys below ``always_carried`` are never treated as untouched.
    """
    def mapped(table: Mapping[str, str]) -> Column:
        if not table:
            return F.lit(None).cast("string")
        return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]

    explicit = F.lit(False)
    for prefix in always_carried:
        explicit = explicit | key.startswith(prefix)
    untouched = F.coalesce(mapped(defaults) == value, F.lit(False)) & ~explicit
    ruled = F.coalesce(mapped(exact), prefix_rule(key, prefixes, "unknown"))
    return F.when(untouched, F.when(mapped(new_defaults).isNotNull(), "new-default")
                  .otherwise("skipped")).otherwise(ruled)


TOKEN = r"\$\{([^}]*)\}"


def template_tokens(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(TOKEN), F.lit(1))


def token_rename(value: Column, renames: Mapping[str, str], runtime: Sequence[str] = ()) -> Column:
    """Struct (state, value, renamed, unmapped) for a text with ``${token}`` markers.

    A value with a token outside the map, or with a marker that never closes, is
    ``needs-review`` and comes back unchanged.
    """
    accepted = F.array(*[F.lit(x) for x in (*runtime, *renames.values())]) if (runtime or renames) else F.array()
    known = F.array(*[F.lit(x) for x in renames]) if renames else F.array().cast("array<string>")
    tokens = template_tokens(value)
    unmapped = F.filter(tokens, lambda t: ~F.array_contains(known, t) & ~F.array_contains(accepted, t))
    changed = F.filter(tokens, lambda t: F.array_contains(known, t) & ~F.array_contains(accepted, t))
    # an opening marker that no brace follows anywhere to its right
    unclosed = F.regexp_like(value, F.lit(r"\$\{[^}]*$"))
    rewritten = value
    for old, new in renames.items():
        if old not in set(renames.values()) and old not in runtime:
            rewritten = F.replace(rewritten, F.lit("${" + old + "}"), F.lit("${" + new + "}"))
    review = unclosed | (F.size(unmapped) > 0)
    return F.struct(
        F.when(review, "needs-review").when(F.size(changed) > 0, "renamed").otherwise("unchanged").alias("state"),
        F.when(review, value).otherwise(rewritten).alias("value"),
        F.size(changed).cast("bigint").alias("renamed"),
        F.size(unmapped).cast("bigint").alias("unmapped"))


def expired(flag: Column, expiry: Column, now: Column) -> Column:
    return (flag == 1) & (expiry.isNull() | (expiry < now))


def bad_name(name: Column) -> Column:
    """Outside 1 to 30 ASCII letters and digits."""
    return ~F.regexp_like(name, F.lit("^[a-zA-Z0-9]{1,30}$"))


def whole_word_refs(text: Column, names: Sequence[str]) -> Column:
    """Which of ``names`` occur in ``text`` as whole words, any case, in sorted order."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z_][a-z0-9_]*"), F.lit(0))
    wanted = F.array(*[F.lit(n.lower()) for n in names])
    return F.array_sort(F.array_intersect(wanted, words))
