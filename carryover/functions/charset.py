"""Double-encoded text: find it, repair it row by row, and refuse what one repair cannot settle.

UTF-8 text that was once read as a single-byte charset and stored as UTF-8 again
shows up as pairs such as ``Ã©`` for ``é``. A value is double-encoded when every
character fits the single-byte charset and the bytes it would have there are
themselves valid UTF-8. All functions are null-safe Column expressions that never
raise, whatever order the optimizer evaluates them in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.operators.counting import labelled_counts

# Windows-1252, the 27 positions that differ from ISO-8859-1 and the
# characters stored there, in byte order; 81 8D 8F 90 9D are undefined and map to themselves.
CP1252_BYTES = (0x80, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x8E,
                0x91, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9E, 0x9F)
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_UNDEFINED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
C1_CHARS = "".join(chr(b) for b in CP1252_BYTES)

_FOREIGN = ("[^\\x00-\\x7F\\xA0-\\xFF" + "".join(f"\\x{b:02X}" for b in CP1252_UNDEFINED) + CP1252_CHARS + "]")

# What mojibake looks like after a repair. Compared without case, as
# the reference's collation does.
MARKER = "(?iu)(?:[\\xC3\\xC2][\\x{80}-\\x{BF}]|\\xE2(?:\\x{20AC}|\\x{201E}\\xA2))"
RESIDUAL_SPAN = "\\xE2[\\x{80}-\\x{9F}]"

# Exact spans and their meaning, version 1.
EXACT_RULES = (
    ("iso8859-1-en-dash", "â\u0080\u0093", "–"),
    ("iso8859-1-less-or-equal", "â\u0089¤", "≤"),
)


def _hop(value: Column) -> Column:
    """The value after one step back, NULL where that step is not lossless."""
    # plain ASCII is settled by its length alone, before any pattern is tried
    fits = F.when(_not_ascii(value), F.when(~F.regexp_like(value, F.lit(_FOREIGN)), value))
    as_bytes = F.encode(F.translate(fits, CP1252_CHARS, C1_CHARS), "ISO-8859-1")
    return F.try_validate_utf8(as_bytes.cast("string"))


def _not_ascii(value: Column) -> Column:
    return F.octet_length(value) != F.char_length(value)


def is_double_encoded(value: Column) -> Column:
    return _hop(value).isNotNull()


def repair(value: Column) -> Column:
    """One lossless step back where the row allows it, the stored value otherwise."""
    return F.coalesce(_hop(value), value)


def has_marker(value: Column) -> Column:
    return F.coalesce(_not_ascii(value) & F.regexp_like(value, F.lit(MARKER)), F.lit(False))


def validated_repair(value: Column) -> Column:
    """The repaired value if it is a fixed point without a marker, else the original."""
    candidate = repair(value)
    doubt = is_double_encoded(candidate) | has_marker(candidate)
    return F.when(doubt, value).otherwise(candidate)


def has_exact_span(value: Column, rules=EXACT_RULES) -> Column:
    found = F.lit(False)
    for _, span, _ in rules:
        found = found | F.contains(value, F.lit(span))
    return F.coalesce(found, F.lit(False))


def exact_candidate(value: Column) -> Column:
    """Exact spans win, chosen from the original value; otherwise the lossless step."""
    replaced = value
    for _, span, meaning in EXACT_RULES:
        replaced = F.replace(replaced, F.lit(span), F.lit(meaning))
    return F.when(has_exact_span(value), replaced).otherwise(repair(value))


def exact_doubt(candidate: Column) -> Column:
    residual = F.regexp_like(candidate, F.lit(RESIDUAL_SPAN))
    return F.coalesce(residual | has_marker(candidate) | is_double_encoded(candidate), F.lit(False))


def exact_span_repair(value: Column) -> Column:
    candidate = exact_candidate(value)
    return F.when(exact_doubt(candidate), value).otherwise(candidate)


def with_hops(df: DataFrame, column: str) -> DataFrame:
    """Add the first and second step back and the three disjoint lanes of the census."""
    staged = df.withColumn("_h1", _hop(F.col(column)))
    staged = staged.withColumn("_h2", _hop(F.col("_h1")))
    double = F.col("_h1").isNotNull()
    multi = double & F.col("_h2").isNotNull()
    partial = double & F.col("_h2").isNull() & has_marker(F.col("_h1"))
    return staged.select("*", double.alias("_double"), multi.alias("_multi"), partial.alias("_partial"),
                         (~double & has_marker(F.col(column))).alias("_bad"))


def census_lanes(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[tuple[str, str, str, Column]]]:
    """``df`` with what the census needs, and (column, lane, accept, predicate) for each lane of each column."""
    lanes, checks = df, []
    for i, column in enumerate(dict.fromkeys(columns)):
        flags = {"_double": f"_double{i}", "_multi": f"_multi{i}", "_partial": f"_partial{i}", "_bad": f"_bad{i}"}
        lanes = with_hops(lanes, column).drop("_h1", "_h2").withColumnsRenamed(flags)
        double, multi, partial, bad = (F.col(flag) for flag in flags.values())
        checks += [(column, "repairable", "charset-repair", double & ~multi & ~partial), (column, "multi", "keep-unrepairable-text", multi),
                   (column, "partial", "keep-unrepairable-text", partial), (column, "bad", "keep-unrepairable-text", bad)]
    return lanes, checks


def charset_census(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """Rows per column in each lane: repairable, multi, partial, bad.

    ``repairable`` needs one sign-off (repair them); the other three need another
    (keep them as they are). All columns are read in one scan.
    """
    lanes, checks = census_lanes(df.select(*dict.fromkeys(columns)), columns)
    return labelled_counts(lanes, ["table_name", "column_name", "lane", "accept"],
                           [((table, column, lane, accept), test) for column, lane, accept, test in checks])


def exact_span_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows repaired, rows left in doubt, and rows per exact rule."""
    value, candidate = F.col(column), exact_candidate(F.col(column))
    doubt = exact_doubt(candidate)
    changed = F.coalesce(candidate != value, F.lit(False))
    checks = [(("repaired",), (has_exact_span(value) | changed) & ~doubt), (("doubt",), doubt)]
    checks += [((name,), has_exact_span(value, ((name, span, meaning),)) & ~doubt)
               for name, span, meaning in EXACT_RULES]
    return labelled_counts(df, ["lane"], checks)
