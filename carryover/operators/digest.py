"""Order-independent content digests of tables.

Each row is rendered without ambiguity (``~`` for NULL, ``length:value`` else,
joined by the unit separator) and hashed once; the table's digest is the row
count, the sum of the first 64 bits, the exclusive or of the next 64 and the
number of rows that could not be hashed. All lanes combine map-side, so a digest
costs one scan and a one-row shuffle, whatever the table's size or order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, types as S
from pyspark.sql import functions as F

FORMAT_VERSION = 1
# The NULL marker and the field separator of a rendered row.
NULL_MARK = "~"
SEPARATOR = "\x1f"


class Unrenderable(ValueError):
    """A type with no single agreed rendering; the digest refuses instead of guessing."""


def rendering_class(dtype: S.DataType) -> str:
    """``bytes`` or ``text``: two columns are comparable only within one class."""
    return "bytes" if isinstance(dtype, S.BinaryType) else "text"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def rendered(name: str, dtype: S.DataType, scale: int | None = None) -> str:
    """SQL for the text form of a column. Fractions need a declared decimal scale; nested types are refused."""
    c = quoted(name)
    if isinstance(dtype, (S.FloatType, S.DoubleType)):
        if scale is None:
            raise Unrenderable("a floating-point column needs a declared decimal scale")
        return f"string(try_cast({c} AS decimal(38,{scale})))"
    if isinstance(dtype, (S.TimestampNTZType, S.TimestampType)):
        return f"date_format({c}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
    if isinstance(dtype, S.DateType):
        return f"date_format({c}, 'yyyy-MM-dd')"
    if isinstance(dtype, S.BooleanType):
        return f"string(int({c}))"
    if isinstance(dtype, S.BinaryType):
        return f"hex({c})"
    if isinstance(dtype, (S.IntegralType, S.DecimalType, S.StringType)):
        return f"string({c})"
    raise Unrenderable(f"no rendering for {dtype.simpleString()}")


def row_hashes(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), large: Sequence[str] = (),
               scales: Mapping[str, int] | None = None) -> DataFrame:
    """(keep..., _h): SHA-256 of each row over ``columns`` in the order given.

    A large value is hashed on its own first (binary as its raw bytes). Two projections,
    so each value is rendered once and the generated code stays small. ``concat`` (not
    ``concat_ws``): a value that could not be rendered leaves the whole row unhashed,
    which the digest counts.
    """
    if not columns:
        raise ValueError("a row hash needs at least one column")
    scales = scales or {}
    schema = df.schema
    kept = [quoted(k) for k in keep]
    texts, parts = list(kept), []
    for i, name in enumerate(columns):
        dtype, t = schema[name].dataType, f"_t{i}"
        raw = name in large and isinstance(dtype, S.BinaryType)
        texts.append(f"{quoted(name) if raw else rendered(name, dtype, scales.get(name))} AS {t}")
        absent = f"{t} IS NULL"
        if isinstance(dtype, (S.FloatType, S.DoubleType)):
            # only here can a stored value fail to render
            texts.append(f"{quoted(name)} IS NULL AS _n{i}")
            absent = f"_n{i}"
        length = f"octet_length({t})" if raw else f"char_length({t})"
        shown = f"sha2({t}, 256)" if name in large else t
        parts.append(f"CASE WHEN {absent} THEN '{NULL_MARK}' ELSE concat({length}, ':', {shown}) END")
    joined = f", '{SEPARATOR}', ".join(parts)
    return df.selectExpr(*texts).selectExpr(*kept, f"sha2(concat({joined}), 256) AS _h")


# Widths of the three addends the 64-bit sum is kept in; none of them overflows below 2**41 rows.
_LOW, _MIDDLE = 21, 42


def lanes(hashed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., rows, total, parity, unhashed) of row hashes."""
    kept = [quoted(k) for k in keys]
    halves = hashed.selectExpr(*kept, "bigint(conv(substring(_h, 1, 16), 16, -10)) AS _a",
                               "bigint(conv(substring(_h, 17, 16), 16, -10)) AS _b")
    mask = (1 << _LOW) - 1
    counted = halves.groupBy(*keys).agg(*map(F.expr, (
        "count(1) AS rows", f"sum(shiftrightunsigned(_a, {_MIDDLE})) AS _hi",
        f"sum(shiftrightunsigned(_a, {_LOW}) & {mask}L) AS _mid", f"sum(_a & {mask}L) AS _lo",
        "bit_xor(_b) AS _xor", "count(_a) AS _hashed")))
    total = " + ".join(f"cast(coalesce({name}, 0) AS decimal(20,0)) * {1 << shift}BD"
                       for name, shift in (("_hi", _MIDDLE), ("_mid", _LOW), ("_lo", 0)))
    return counted.selectExpr(*kept, "rows", f"string(cast({total} AS decimal(38,0))) AS total",
                              "coalesce(_xor, 0L) AS parity", "rows - _hashed AS unhashed")


def table_digest(df: DataFrame, columns: Sequence[str] | None = None, *, where: Column | None = None,
                 large: Sequence[str] = (), scales: Mapping[str, int] | None = None) -> DataFrame:
    """One row: rows, total (decimal text, it outruns 64 bits), parity, unhashed."""
    if df.sparkSession.conf.get("spark.sql.session.timeZone") != "UTC":
        raise RuntimeError("digests are rendered in UTC: set spark.sql.session.timeZone")
    if where is not None:
        df = df.where(where)
    columns = list(columns or df.columns)
    return lanes(row_hashes(df, columns, large=large, scales=scales))


def grouped_digest(df: DataFrame, keys: Sequence[str], columns: Sequence[str], *, large: Sequence[str] = (),
                   scales: Mapping[str, int] | None = None) -> DataFrame:
    """A digest per key, still combined map-side (a hot key costs nothing extra)."""
    return lanes(row_hashes(df, columns, keys, large, scales), keys)


def digest_document(tables: Mapping[str, DataFrame], *, large: Mapping[str, Sequence[str]] | None = None,
                    scales: Mapping[str, Mapping[str, int]] | None = None) -> DataFrame:
    """Digests of several tables with the columns used; a table that cannot be measured says why.

    Columns: table_name, columns (``name:class``), rows, total, parity, unhashed, error.
    """
    large, scales = large or {}, scales or {}
    out = None
    for name in sorted(tables):
        df = tables[name]
        shape = F.array(*[F.lit(f"{f.name}:{rendering_class(f.dataType)}") for f in df.schema])
        try:
            measured = table_digest(df, large=large.get(name, ()), scales=scales.get(name))
            row = measured.select(F.lit(name).alias("table_name"), shape.alias("columns"), "rows", "total", "parity",
                                  "unhashed", F.lit(None).cast("string").alias("error"))
        except Unrenderable as refused:
            row = df.agg(F.count(F.lit(1)).alias("_")).select(
                F.lit(name).alias("table_name"), shape.alias("columns"),
                *[F.lit(None).cast(t).alias(c) for c, t in
                  (("rows", "bigint"), ("total", "string"), ("parity", "bigint"), ("unhashed", "bigint"))],
                F.lit(str(refused)).alias("error"))
        out = row if out is None else out.unionByName(row)
    return out


def digest_compare(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """verified / failed / unverified per table, and the lane or the reason.

    A missing table, a missing column and a change of rendering class are
    differences (failed). A table nobody could measure in full is not a table that
    agreed (unverified).
    """
    e = expected.select(F.lower("table_name").alias("_t"), F.struct(*expected.columns).alias("e"))
    a = actual.select(F.lower("table_name").alias("_t"), F.struct(*actual.columns).alias("a"))
    joined = e.join(a, "_t", "full_outer")
    lost = F.array_except(F.col("e.columns"), F.col("a.columns"))
    names = F.transform(F.col("a.columns"), lambda c: F.substring_index(c, ":", 1))
    gone = F.filter(lost, lambda c: ~F.array_contains(names, F.substring_index(c, ":", 1)))
    status = (F.when(F.col("e").isNull() | F.col("e.error").isNotNull(), "unverified")
              .when(F.col("a").isNull() | (F.size(lost) > 0), "failed")
              .when(F.col("a.error").isNotNull() | (F.col("e.unhashed") > 0) | (F.col("a.unhashed") > 0), "unverified")
              .when(lane().isNotNull(), "failed").otherwise("verified"))
    why = (F.when(F.col("e").isNull(), "not in the expected document")
           .when(F.col("e.error").isNotNull(), "not measured at the source")
           .when(F.col("a").isNull(), "table missing")
           .when(F.size(gone) > 0, "column missing")
           .when(F.size(lost) > 0, "column hashes differently")
           .when(F.col("a.error").isNotNull(), "not measured here")
           .when((F.col("e.unhashed") > 0) | (F.col("a.unhashed") > 0), "unhashed rows")
           .otherwise(lane()))
    return joined.select(F.coalesce("e.table_name", "a.table_name").alias("table_name"),
                         status.alias("status"), why.alias("why"))


def lane() -> Column:
    """The first lane of the pair (e, a) that disagrees, NULL when all agree."""
    return (F.when(F.col("e.rows") != F.col("a.rows"), "rows")
            .when((F.col("e.total") != F.col("a.total")) | (F.col("e.parity") != F.col("a.parity")), "content"))
