"""Predicates from values: scalars, lists, ranges and raw fragments, as Columns."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH_SIZE = 512
#: Pieces of a TO_CHAR layout and of Spark's.
_LAYOUT = {
    "YYYY": "yyyy", "YY": "yy", "MM": "MM", "MON": "MMM", "DD": "dd", "HH24": "HH", "HH12": "hh", "HH": "hh",
    "MI": "mm", "SS": "ss", "DDD": "DDD", "AM": "a", "PM": "a",
}
_RAW = re.compile(r"[<>]| null\b", re.I)
_SAFE = re.compile(
    r"""^\s*(?:(?P<op><=|>=|<>|<|>)\s*(?P<value>-?\d+(?:\.\d+)?|'(?:[^']|'')*')|is\s+(?P<no>not\s+)?null)\s*$""",
    re.I,
)


@dataclass(frozen=True)
class Between:
    low: int
    high: int


@dataclass(frozen=True)
class Days:
    """Dates or times from the beginning of the day ``first`` to the end of ``last``."""

    first: date
    last: date

    @property
    def end(self) -> date:
        return self.last + timedelta(days=1)


@dataclass(frozen=True)
class LessOrEqual:
    value: int


@dataclass(frozen=True)
class GreaterThan:
    value: int


@dataclass(frozen=True)
class GreaterOrEqual:
    value: int


def _scalar(value):
    if isinstance(value, str) and re.fullmatch(r"-?\d{1,18}", value.strip()):
        return int(value)
    return value


_LITERAL = re.compile(r"\s*(?:(-?\d+(?:\.\d+)?)|'((?:[^']|'')*)')\s*(,|$)")


def in_values(items: Iterable) -> list:
    """The values of a list; an item in parentheses is a list of literals, numbers or quoted text, as it stands in SQL."""
    out = []
    for item in items:
        text = item.strip() if isinstance(item, str) else ""
        if not (text.startswith("(") and text.endswith(")")):
            out.append(_scalar(item))
            continue
        at, inner = 0, text[1:-1]
        while at < len(inner):
            m = _LITERAL.match(inner, at)
            if not m:
                raise ValueError(f"not a list of literals: {item!r}")
            number, quoted, _ = m.groups()
            out.append(quoted.replace("''", "'") if number is None else float(number) if "." in number else int(number))
            at = m.end()
    return out


def criterion(key: str | Column, value) -> Column:
    """The predicate ``key`` against ``value``.

    Text that reads as an integer compares as one; text with ``<``, ``>`` or " null" is a raw
    fragment, which must be one comparison with a literal or a null test; values are literals,
    never concatenated.
    """
    col = F.col(f"`{key}`") if isinstance(key, str) else key
    match value:
        case Between():
            return col.between(value.low, value.high)
        case Days():
            return (col >= F.lit(value.first)) & (col < F.lit(value.end))
        case LessOrEqual():
            return col <= value.value
        case GreaterThan():
            return col > value.value
        case GreaterOrEqual():
            return col >= value.value
        case None:
            return col.isNull()
        case str() if _RAW.search(value):
            m = _SAFE.match(value)
            if not m:
                raise ValueError(f"not a comparison with a literal: {value!r}")
            if not m["op"]:
                return col.isNotNull() if m["no"] else col.isNull()
            text = m["value"]
            literal = F.lit(text[1:-1].replace("''", "'")) if text[0] == "'" else F.expr(text)
            return {
                "<=": col <= literal, ">=": col >= literal, "<>": col != literal, "<": col < literal, ">": col > literal,
            }[m["op"]]
        case list() | tuple() | set() | frozenset():
            return col.isin(in_values(value))
        case _:
            return col == _scalar(value)


def conjunction(*filters: Mapping | None, pseudo: Mapping[str, str] | None = None) -> Column | None:
    """All criteria joined by AND, keys in order within each mapping; None if there are none.

    A key that names a pseudo-column is compared as that column's expression.
    """
    parts = []
    for one in filters:
        for key in sorted(one or {}):
            expression = (pseudo or {}).get(key)
            parts.append(criterion(F.expr(expression) if expression else key, one[key]))
    return reduce(and_, parts) if parts else None


def batches(filters: Iterable[Mapping], size: int = BATCH_SIZE) -> list[dict]:
    """Equality filters grouped into filters of value lists, at most ``size`` of them in each.

    Values are sets: a list never repeats one.
    """
    out: list[dict] = []
    held: dict[str, list] = defaultdict(list)
    n = 0
    for one in filters:
        for key, value in one.items():
            if value not in held[key]:
                held[key].append(value)
        n += 1
        if n == size:
            out.append(dict(held))
            held, n = defaultdict(list), 0
    if n:
        out.append(dict(held))
    return out


def batches_by(plan: Iterable[tuple[str, Mapping]], size: int = BATCH_SIZE) -> dict[str, list[dict]]:
    """One list of batches for each method of a plan of (method, filter) pairs."""
    by: dict[str, list] = defaultdict(list)
    for method, one in plan:
        by[method].append(one)
    return {method: batches(some, size) for method, some in by.items()}


def layout(text: str) -> str:
    """A TO_CHAR layout (YYYY-MM-DD HH24:MI:SS) as one of Spark's; quoted text and punctuation stay."""
    def one(m: re.Match) -> str:
        return m[0].replace('"', "'") if m[0][0] == '"' else _LAYOUT[m[0].upper()]

    names = "|".join(sorted(_LAYOUT, key=len, reverse=True))
    return re.sub(rf'"[^"]*"|{names}', one, text, flags=re.I)


_CALLS = (
    (re.compile(r"\bto_char\s*\(\s*([^(),]+?)\s*,\s*'([^']*)'\s*\)", re.I), lambda m: f"date_format({m[1]}, '{layout(m[2])}')"),
    (
        re.compile(
            r"\bround\s*\(\s*\(\s*cast\s*\(\s*([^()]+?)\s+as\s+date\s*\)\s*-\s*to_date\s*\(\s*'(?:1970-01-01|01-01-1970|19700101)'\s*,\s*'[^']*'\s*\)\s*\)"
            r"\s*\*\s*86400\s*\)",
            re.I,
        ),
        lambda m: f"unix_seconds(cast({m[1]} as timestamp))",
    ),
    (re.compile(r"\bunix_timestamp\s*\(\s*\)", re.I), lambda m: "unix_timestamp(current_timestamp())"),
    (re.compile(r"\bsysdate\b(?:\s*\(\s*\))?", re.I), lambda m: "current_timestamp()"),
    (re.compile(r"current_timestamp\(\)\s*-\s*(\d+)\b(?!\s*(?:day|hour|min|sec))", re.I), lambda m: f"current_timestamp() - interval {m[1]} days"),
    (re.compile(r"\binterval\s+(\d+)\s+(day|hour|minute|second|month|year)s?\b", re.I), lambda m: f"interval {m[1]} {m[2]}"),
)


def translated(expression: str) -> str:
    """Scalars of other databases as Spark's: TO_CHAR of a time, seconds since 1970 from days, SYSDATE - n.

    DATE, DATE_FORMAT with Spark's layouts, casts by ``::``, UNIX_SECONDS, NOW and COALESCE are Spark's own.
    """
    for pattern, made in _CALLS:
        expression = pattern.sub(made, expression)
    return expression
