"""Catalogue of dimensions, bit-fields, point formats and file versions."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import types as T

from .errors import UnsupportedFormat

# Fixed values of the public LAS format: record layouts, masks, versions.
CORE_HEAD = (("X", "i4"), ("Y", "i4"), ("Z", "i4"), ("intensity", "u2"), ("bit_fields", "u1"))
OLD_TAIL = (("raw_classification", "u1"), ("scan_angle_rank", "i1"), ("user_data", "u1"), ("point_source_id", "u2"))
NEW_TAIL = (("classification_flags", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "i2"), ("point_source_id", "u2"))
GPS = (("gps_time", "f8"),)
RGB = (("red", "u2"), ("green", "u2"), ("blue", "u2"))
NIR = (("nir", "u2"),)
WAVE = (("wavepacket_index", "u1"), ("wavepacket_offset", "u8"), ("wavepacket_size", "u4"), ("return_point_wave_location", "f4"), ("x_t", "f4"), ("y_t", "f4"), ("z_t", "f4"))
_OLD, _NEW = CORE_HEAD + OLD_TAIL, CORE_HEAD + NEW_TAIL + GPS
FORMATS = {0: _OLD, 1: _OLD + GPS, 2: _OLD + RGB, 3: _OLD + GPS + RGB, 4: _OLD + GPS + WAVE, 5: _OLD + GPS + RGB + WAVE, 6: _NEW, 7: _NEW + RGB, 8: _NEW + RGB + NIR, 9: _NEW + WAVE, 10: _NEW + RGB + NIR + WAVE}
OLD_BITS = {"return_number": ("bit_fields", 0x07), "number_of_returns": ("bit_fields", 0x38), "scan_direction_flag": ("bit_fields", 0x40), "edge_of_flight_line": ("bit_fields", 0x80), "classification": ("raw_classification", 0x1F), "synthetic": ("raw_classification", 0x20), "key_point": ("raw_classification", 0x40), "withheld": ("raw_classification", 0x80)}
NEW_BITS = {"return_number": ("bit_fields", 0x0F), "number_of_returns": ("bit_fields", 0xF0), "synthetic": ("classification_flags", 0x01), "key_point": ("classification_flags", 0x02), "withheld": ("classification_flags", 0x04), "overlap": ("classification_flags", 0x08), "scanner_channel": ("classification_flags", 0x30), "scan_direction_flag": ("classification_flags", 0x40), "edge_of_flight_line": ("classification_flags", 0x80)}
VERSION_FORMATS = {"1.1": (0, 1), "1.2": tuple(range(4)), "1.3": tuple(range(6)), "1.4": tuple(range(11)), "1.5": tuple(range(6, 11))}
HEADER_SIZES = {"1.1": 227, "1.2": 227, "1.3": 235, "1.4": 375, "1.5": 393}
# Names of dimensions in older releases of the public API.
ALIASES = {"flag_byte": "bit_fields", "return_num": "return_number", "num_returns": "number_of_returns", "scan_dir_flag": "scan_direction_flag", "edge_flight_line": "edge_of_flight_line", "pt_src_id": "point_source_id", "wave_packet_desc_index": "wavepacket_index", "byte_offset_to_waveform_data": "wavepacket_offset", "waveform_packet_size": "wavepacket_size", "return_point_waveform_loc": "return_point_wave_location"}

_SPARK = {"i1": T.ByteType(), "u1": T.ShortType(), "i2": T.ShortType(), "u2": T.IntegerType(), "i4": T.IntegerType(), "u4": T.LongType(), "i8": T.LongType(), "u8": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType()}


@dataclass(frozen=True)
class ExtraDim:
    """A user dimension: 1 to 3 elements of a base type, optionally scaled, with an optional no-data value."""

    name: str
    kind: str
    count: int = 1
    scales: tuple[float, ...] | None = None
    offsets: tuple[float, ...] | None = None
    no_data: float | None = None
    description: str = ""
    #: Raw extremes of each element, no-data left out, as files keep them; a cloud's own operations do not follow them.
    mins: tuple[float, ...] | None = field(default=None, compare=False)
    maxs: tuple[float, ...] | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if len(self.name.encode()) > 32 or len(self.description.encode()) > 32:
            raise ValueError("names and descriptions have 32 bytes at most")
        if (self.scales is None) != (self.offsets is None) or any(x is not None and len(x) != self.count for x in (self.scales, self.offsets)):
            raise ValueError("scales and offsets go together, one an element")
        if self.count > 3 and self.kind != "u1":
            raise ValueError("more than three elements only as bytes")


@dataclass(frozen=True)
class FileMeta:
    """What a file's header says beside format, scales and statistics; it travels with a cloud from file to file."""

    encoding: int = 0
    source_id: int = 0
    guid: bytes = b"\0" * 16
    system: str = ""
    software: str = "pointengine"
    created: dt.date | None = None


def spark_type(kind: str, count: int = 1) -> T.DataType:
    return _SPARK[kind] if count == 1 else T.ArrayType(_SPARK[kind], containsNull=False)


def layout(fmt: int) -> tuple[tuple[str, str], ...]:
    if fmt not in FORMATS:
        raise UnsupportedFormat(f"point format {fmt}")
    return FORMATS[fmt]


def bit_fields(fmt: int) -> dict[str, tuple[str, int]]:
    """Sub-field -> (container, mask)."""
    layout(fmt)
    return OLD_BITS if fmt < 6 else NEW_BITS


def dimension_names(fmt: int) -> list[str]:
    """All names of a format, containers replaced by their sub-fields."""
    bits, out = bit_fields(fmt), []
    for name, _ in layout(fmt):
        inside = [b for b, (c, _) in bits.items() if c == name]
        out += inside or [name]
    return out


def lost_dimensions(old: int, new: int) -> list[str]:
    have = set(dimension_names(new))
    return [d for d in dimension_names(old) if d not in have]


def preferred_version(fmt: int) -> str:
    layout(fmt)
    return "1.2" if fmt < 4 else "1.3" if fmt < 6 else "1.4"


def check_version(version: str, fmt: int) -> None:
    layout(fmt)
    if fmt not in VERSION_FORMATS.get(version, ()):
        raise UnsupportedFormat(f"point format {fmt} in a file of version {version}")


def record_size(fmt: int) -> int:
    return sum(int(k[1]) for _, k in layout(fmt))


def kind_range(kind: str) -> tuple[float, float]:
    bits = 8 * int(kind[1])
    return {"u": (0, 2**bits - 1), "i": (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1), "f": (float("-inf"), float("inf"))}[kind[0]]


def limits(name: str, kinds: dict[str, str], bits: dict[str, tuple[str, int]]) -> tuple[float, float]:
    """Least and greatest value of a dimension or sub-field of a format."""
    if name in bits:
        mask = bits[name][1]
        return 0, mask // (mask & -mask)
    return kind_range(kinds[name])


def type_limits(kind: T.DataType) -> tuple[float, float]:
    """Least and greatest value of a column's type."""
    wide = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}.get(type(kind))
    return (-(2 ** (wide - 1)), 2 ** (wide - 1) - 1) if wide else (float("-inf"), float("inf"))


def waveform_capable(fmt: int) -> bool:
    return any(n == "wavepacket_index" for n, _ in layout(fmt))


def point_schema(fmt: int, extra: tuple[ExtraDim, ...] = (), index: bool = True) -> T.StructType:
    """Schema of a scan: sub-fields unpacked, so that filters on them reach columnar storage."""
    kinds = dict(layout(fmt))
    out = [T.StructField("point_idx", T.LongType(), False)] if index else []
    out += [T.StructField(n, spark_type(kinds.get(n, "u1")), False) for n in dimension_names(fmt)]
    for e in extra:
        meta = {"kind": e.kind, "count": e.count} | ({"scales": list(e.scales), "offsets": list(e.offsets)} if e.scales else {}) | ({"no_data": e.no_data} if e.no_data is not None else {})
        out.append(T.StructField(e.name, spark_type(e.kind, e.count), False, meta))
    return T.StructType(out)
