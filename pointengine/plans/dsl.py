"""The filter language: ``classification == 2 and (x > 10.0 or user_data in [1, 2])`` -> one Column.

Operators associate to the right without precedence; ``not`` reaches to the end of its group.  Names are bound
when the filter is built, so an unknown one fails before a job starts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column

from ..errors import FilterSyntaxError, UnknownDimension
from ..functions import exprs

# Names that another public tool's filters use for these dimensions.
TOOL_NAMES = {"Intensity": "intensity", "ReturnNumber": "return_number", "NumberOfReturns": "number_of_returns", "ScanDirectionFlag": "scan_direction_flag", "EdgeOfFlightLine": "edge_of_flight_line", "Classification": "classification", "ScanAngleRank": "scan_angle_rank", "UserData": "user_data", "PointSourceId": "point_source_id", "GpsTime": "gps_time", "Red": "red", "Green": "green", "Blue": "blue", "Infrared": "nir", "ScanChannel": "scanner_channel", "ClassFlags": "classification_flags"}

_TOKEN = re.compile(r" *(?:(\()|(\))|(\[[^\]]*\])|(==|!=|<=|>=|<|>)|(&&|\|\|)|(!)|([^ ()<>=!&|\[\]]+))")


def number(text: str) -> int | float:
    text = text.strip()
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    raise FilterSyntaxError(f"{text!r} is no number")


def number_list(text: str) -> list[int | float]:
    text = text.strip()
    if text[:1] + text[-1:] not in ("[]", "()"):
        raise FilterSyntaxError(f"{text!r} is no list")
    return [number(x) for x in text[1:-1].split(",")]


def tokens(text: str) -> list[str]:
    out, at = [], 0
    while text[at:].strip(" "):
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterSyntaxError(f"cannot read {text[at:]!r}")
        out.append(m[m.lastindex])
        at = m.end()
    return out


def parse(text: str) -> tuple:
    """('and' | 'or', left, right), ('not', x) or ('cmp', field, op, value)."""
    todo = tokens(text)[::-1]

    def take(what: str) -> str:
        if not todo:
            raise FilterSyntaxError(f"{what} is missing")
        return todo.pop()

    def rest(left: tuple) -> tuple:
        if not todo or todo[-1] == ")":
            return left
        word = {"&&": "and", "||": "or"}.get(w := todo.pop(), w)
        if word not in ("and", "or"):
            raise FilterSyntaxError(f"'and' or 'or' should stand before {w!r}")
        return (word, left, expression())

    def expression() -> tuple:
        first = take("an expression")
        if first == "(":
            inner = expression()
            if take("a closing parenthesis") != ")":
                raise FilterSyntaxError("a closing parenthesis is missing")
            return rest(inner)
        if first in ("not", "!"):
            return ("not", expression())
        op = take("a comparison")
        if op not in (*exprs._OPS, "in"):
            raise FilterSyntaxError(f"{op!r} compares nothing")
        value = take("a value")
        return rest(("cmp", first, op, number_list(value) if op == "in" else number(value)))

    out = expression()
    if todo:
        raise FilterSyntaxError(f"{todo[-1]!r} is left over")
    return out


def names(fields: dict[str, Column]) -> Callable[[str], Column]:
    """Resolver of field names, with the other tool's names as aliases."""

    def find(name: str) -> Column:
        own = name if name in fields else TOOL_NAMES.get(name, name)
        if own not in fields:
            raise UnknownDimension(f"{name!r}; known are {', '.join(sorted(fields))}")
        return fields[own]

    return find


def build(tree: tuple, find: Callable[[str], Column], scaled: dict[str, tuple[Column, float, float]] | None = None) -> Column:
    """scaled: x, y, z -> (raw column, scale, offset); their comparisons also bound the raw column."""
    if tree[0] == "not":
        return ~build(tree[1], find, scaled)
    if tree[0] in ("and", "or"):
        left, right = build(tree[1], find, scaled), build(tree[2], find, scaled)
        return left & right if tree[0] == "and" else left | right
    _, field, op, value = tree
    if op == "in":
        return find(field).isin(*value)
    if scaled and field in scaled:
        return exprs.compare_scaled_float(scaled[field][0], op, float(value), *scaled[field][1:])
    return exprs.compare(find(field), op, value)


def where(text: str, fields: dict[str, Column], scaled: dict[str, tuple[Column, float, float]] | None = None) -> Column:
    return build(parse(text), names(fields | {k: exprs.scale(*v) for k, v in (scaled or {}).items()}), scaled)


__all__ = ["build", "names", "number", "number_list", "parse", "tokens", "where"]
