"""Column expressions: bit-fields, scaled coordinates, comparisons, header flags.  All run inside Catalyst."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def low_bit(mask: int) -> int:
    """Number of the lowest set bit."""
    if mask <= 0:
        raise ValueError("a mask has a bit set")
    return (mask & -mask).bit_length() - 1


def lowest_bit(value: Column) -> Column:
    """Number of the lowest set bit of a value above 0."""
    return F.bit_count(value.bitwiseAND(-value) - 1).cast("int")


def popcount(value: Column) -> Column:
    return F.bit_count(value).cast("int")


def unpack(container: Column, mask: int) -> Column:
    return F.shiftright(container.bitwiseAND(F.lit(mask)), low_bit(mask))


def pack(container: Column, mask: int, value: Column) -> Column:
    """The container with a sub-field set; a value that the field cannot hold raises, negative ones included."""
    top = mask >> low_bit(mask)
    checked = F.when((value >= 0) & (value <= top), value).otherwise(F.raise_error(F.lit(f"value outside 0..{top}")).cast("int"))
    return container.bitwiseAND(F.lit(0xFF & ~mask)).bitwiseOR(F.shiftleft(checked.cast("int"), low_bit(mask)))


def scale(raw: Column, by: float, offset: float) -> Column:
    return raw.cast("double") * F.lit(float(by)) + F.lit(float(offset))


def unscale(value: Column, by: float, offset: float) -> Column:
    """Nearest raw integer, halves to even; out of range raises, as the session's ANSI casts do."""
    return F.rint((value - F.lit(float(offset))) / F.lit(float(by))).cast("int")


def unscale_literal(value: float, by: float, offset: float) -> int:
    return int(round((value - offset) / by))


_OPS = {"==": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def compare(left: Column, op: str, right: object) -> Column:
    return getattr(left, _OPS[op])(F.lit(right))


def compare_scaled_raw(raw: Column, op: str, value: float, by: float, offset: float) -> Column:
    """Compare raw integers with the rounded literal; reaches the scan as it stands."""
    return compare(raw, op, unscale_literal(value, by, offset))


def compare_scaled_float(raw: Column, op: str, value: float, by: float, offset: float) -> Column:
    """The exact comparison of scaled values, beside a wider one of raw integers that reaches the scan."""
    exact = compare(scale(raw, by, offset), op, float(value))
    if by <= 0 or not math.isfinite(value) or op == "!=":
        return exact
    at = (value - offset) / by
    if abs(at) > 2**31 - 16:
        return exact
    if op in (">", ">=", "=="):
        exact = (raw >= F.lit(math.floor(at) - 2)) & exact
    if op in ("<", "<=", "=="):
        exact = (raw <= F.lit(math.ceil(at) + 2)) & exact
    return exact


def compare_subfield(container: Column, mask: int, op: str, value: int) -> Column:
    """Compare masked bits with the shifted literal; values that the field cannot hold follow arithmetic."""
    top = mask >> low_bit(mask)
    if not 0 <= value <= top:
        return F.lit({"==": False, "!=": True, "<": value > top, "<=": value > top, ">": value < 0, ">=": value < 0}[op])
    return compare(container.bitwiseAND(F.lit(mask)), op, value << low_bit(mask))


def wrap_unsigned(value: Column, bits: int) -> Column:
    """Modular arithmetic of unsigned columns."""
    return F.pmod(value, F.lit(1 << bits))


def scaled_vector(raw: Column, scales: Sequence[float], offsets: Sequence[float]) -> Column:
    return F.zip_with(F.zip_with(raw, F.array(*map(F.lit, map(float, scales))), lambda v, s: v.cast("double") * s), F.array(*map(F.lit, map(float, offsets))), lambda v, o: v + o)


# Bits of the header's global encoding, as fixed by the public format.
ENCODING_BITS = {"gps_standard": 1, "waveform_internal": 2, "waveform_external": 4, "synthetic_returns": 8, "wkt": 16, "gps_offset": 64}


def encoding_flag(value: Column, name: str) -> Column:
    return (value.bitwiseAND(F.lit(ENCODING_BITS[name])) != 0).cast("int")


def set_encoding_flag(value: Column, name: str, on: bool = True) -> Column:
    """The global encoding with a flag set or cleared; an offset GPS time is a standard one, too."""
    bit = ENCODING_BITS[name] | (ENCODING_BITS["gps_standard"] if on and name == "gps_offset" else 0)
    return value.bitwiseOR(F.lit(bit)) if on else value.bitwiseAND(F.lit(0xFFFF & ~bit))


def randomised(value: Column, seed: Column, top: int) -> Column:
    """A value from 0 to top that hides the old one: a hash of it, of the row's seed and nothing else, so runs repeat it."""
    return F.pmod(F.xxhash64(value, seed), F.lit(top + 1)).cast("int")


def is_compressed_format(byte: Column) -> Column:
    return ((byte.bitwiseAND(F.lit(0xC0))) == 0x80).cast("int")


def plain_format(byte: Column) -> Column:
    return byte.bitwiseAND(F.lit(0x3F))


def mark_compressed(byte: Column) -> Column:
    return byte.bitwiseOR(F.lit(0x80))


def doy_date(year: Column, day: Column) -> Column:
    """Date of a day of the year; null where it is none of that year."""
    first = F.make_date(year, F.lit(1), F.lit(1))
    date = F.date_add(first, day - 1)
    return F.when((day >= 1) & (F.year(date) == year), date)


def c_string(value: Column) -> Column:
    """What stands before the first NUL."""
    return F.substring_index(value, "\u0000", 1)


def class_label(value: Column, width: int = 15) -> Column:
    """Letters, digits and spaces alone, as many as a label has room for."""
    return F.substring(F.regexp_replace(value, "[^A-Za-z0-9 ]", ""), 1, width)
