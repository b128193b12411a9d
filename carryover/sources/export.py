"""Archive tables as CSV that loses nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, types as S
from pyspark.sql import functions as F


def csv_fields(df: DataFrame) -> DataFrame:
    """Every column as CSV text: binary as hex, moments with microseconds, NULL kept apart from ''."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, S.BinaryType):
            c = F.hex(c)
        elif isinstance(f.dataType, (S.TimestampType, S.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, (S.ArrayType, S.MapType, S.StructType)):
            c = F.to_json(c)
        else:
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def csv_lines(df: DataFrame) -> DataFrame:
    """One ``line`` per row: NULL is an empty field, text always quoted, quotes doubled."""
    fields = csv_fields(df)
    quoted = [F.when(F.col(c).isNull(), F.lit("")).otherwise(
        F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))) for c in fields.columns]
    return fields.select(F.array_join(F.array(*quoted), ",").alias("line"))


def export_csv(df: DataFrame, path: str, order: Sequence[str]) -> int:
    """Write the table in total order as CSV files and return the rows read back.

    The files sort by name, so reading them in name order gives the total order; the
    sort is a range exchange, not one task. Row width is checked on the way back.
    """
    ordered = csv_fields(df.orderBy(*order))
    ordered.write.mode("overwrite").csv(path, header=True, quoteAll=False, nullValue="", emptyValue='""',
                                        escape='"', lineSep="\n", ignoreLeadingWhiteSpace=False,
                                        ignoreTrailingWhiteSpace=False)
    schema = ", ".join(f"`{c}` string" for c in ordered.columns)
    back = df.sparkSession.read.schema(schema + ", `_corrupt` string").csv(
        path, header=True, multiLine=True, escape='"', nullValue="", columnNameOfCorruptRecord="_corrupt",
        mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    # every column is read: a row is only checked for its width when it is parsed whole
    whole, broken, *_ = back.agg(F.count(F.lit(1)), F.count("_corrupt"), *[F.count(c) for c in ordered.columns]).first()
    if broken:
        raise ValueError(f"{broken} exported rows do not have the table's width")
    return whole
