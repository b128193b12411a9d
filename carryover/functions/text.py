"""Comparison keys for text.

Keys are compared the way the target's collation compares them; values are
compared byte by byte. Folding is a plain column, so it hashes, sorts and can be
written down.
"""

from __future__ import annotations

import unicodedata
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(value: Column) -> Column:
    """Case-insensitive, trailing spaces ignored, leading spaces significant."""
    return F.lower(F.rtrim(value))


def _accent_table() -> tuple[str, str]:
    plain, accented = [], []
    for point in range(0x00C0, 0x0250):
        char = chr(point)
        base = unicodedata.normalize("NFD", char)[0]
        if base != char and base.isascii():
            accented.append(char)
            plain.append(base)
    return "".join(accented), "".join(plain)


def fold_accents(value: Column) -> Column:
    """As :func:`fold`, with accented Latin letters equal to their base letter."""
    return fold(F.translate(value, *_accent_table()))


def basename(path: Column) -> Column:
    """Last segment of a path written with either separator."""
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def is_blank(value: Column) -> Column:
    return F.trim(value) == ""


# A character reference behind its ampersand: a number, or a name that need not be closed.
REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_BETWEEN = "\x1f"


def _named() -> Column:
    """The names of HTML, with and without their semicolon as the standard lists them, as one constant map."""
    names = sorted(html5)
    side = lambda texts: F.split(F.lit(_BETWEEN.join(texts)), _BETWEEN)
    return F.map_from_arrays(side(names), side([html5[n] for n in names]))


def _renumbered() -> dict[int, str]:
    """Numbers that stand for another character: the bytes of Windows-1252, zero and the carriage return."""
    out = {0x00: "\ufffd", 0x0D: "\r"}
    for byte in range(0x80, 0xA0):
        try:
            out[byte] = bytes([byte]).decode("cp1252")
        except UnicodeDecodeError:
            out[byte] = chr(byte)
    return out


def _by_number(number: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in _renumbered().items() for x in pair])
    none = [number.between(0x1, 0x8), number == 0xB, number.between(0xE, 0x1F), number == 0x7F, number.between(0xFDD0, 0xFDEF), number % 0x10000 >= 0xFFFE]
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    outside = number.isNull() | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    return (F.when(outside, "\ufffd").when(table[number].isNotNull(), table[number])
            .when(reduce(Column.__or__, none), "").otherwise(plain))


def decoded_references(value: Column) -> Column:
    """``value`` with its HTML character references as browsers read them; what is no reference stays as it is."""
    named = _named()

    def replaced(part: Column) -> Column:
        ref = F.regexp_extract(part, REFERENCE, 1)
        digits = F.regexp_extract(ref, "^#[xX]?0*([0-9a-fA-F]*);?$", 1)
        short = F.when(F.char_length(digits) <= 8, F.when(digits == "", "0").otherwise(digits))
        number = F.when(F.regexp_like(ref, F.lit("^#[xX]")), F.conv(short, 16, 10)).otherwise(short).try_cast("bigint")
        # a name that runs on into other text: its longest beginning that is a name
        size = F.get(F.filter(F.sequence(F.char_length(ref) - 1, F.lit(2), F.lit(-1)), lambda n: named[F.substring(ref, F.lit(1), n)].isNotNull()), F.lit(0))
        begun = F.when(F.char_length(ref) > 2, size)
        said = (F.when(ref.startswith("#"), _by_number(number)).when(named[ref].isNotNull(), named[ref])
                .when(begun.isNotNull(), F.concat(named[F.substring(ref, F.lit(1), begun)], F.substring(ref, begun + 1, F.char_length(ref))))
                .otherwise(F.concat(F.lit("&"), ref)))
        return F.when(ref == "", F.concat(F.lit("&"), part)).otherwise(F.concat(said, F.substring(part, F.char_length(ref) + 1, F.char_length(part))))

    parts = F.split(value, "&")
    behind = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), replaced)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(behind, ""))
