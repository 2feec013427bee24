"""Column helpers for the arithmetic and text rules the reports rely on.

The source reports were written for a dialect in which integer division
truncates, ``DATEDIFF`` counts unit boundaries and ``+`` on text is
null-propagating.  These helpers express those rules with built-in functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def big(c: Column | str) -> Column:
    return col(c).cast("bigint")


def int_div(a: Column | str, b: Column | str | int) -> Column:
    """Truncating division; a zero divisor gives NULL instead of an error."""
    b = F.lit(b) if isinstance(b, int) else col(b)
    return F.call_function("div", big(a), F.nullif(b.cast("bigint"), F.lit(0).cast("bigint")))


def ratio(a: Column | str, b: Column | str | int, precision: int, scale: int) -> Column:
    """Exact ``a / b`` of whole numbers rounded half up to ``DECIMAL(precision, scale)``."""
    b = F.lit(b) if isinstance(b, int) else col(b)
    wide = DecimalType(20, 0)
    return F.try_divide(col(a).cast(wide), b.cast(wide)).cast(DecimalType(precision, scale))


def guarded_div(a: Column | str, b: Column | str) -> Column:
    """Truncating division that reports 0 when the divisor is 0."""
    return F.when(col(b) == 0, F.lit(0).cast("bigint")).otherwise(int_div(a, b))


def pages_to_mb(pages: Column | str) -> Column:
    """8 KB pages to whole megabytes."""
    return int_div(big(pages) * 8, 1024)


def boundaries(unit: str, start: Column | str, end: Column | str) -> Column:
    """Number of ``unit`` boundaries crossed between two timestamps (not full units).

    Calendar days and clock fields are compared, so zone-less times give the same
    answer under any session time zone.
    """
    per_day, clock = {
        "DAY": (1, lambda c: F.lit(0)),
        "HOUR": (24, F.hour),
        "MINUTE": (1440, lambda c: F.hour(c) * 60 + F.minute(c)),
        "SECOND": (86400, lambda c: (F.hour(c) * 60 + F.minute(c)) * 60 + F.second(c)),
    }[unit]
    start, end = col(start), col(end)
    days = F.datediff(end.cast("date"), start.cast("date")).cast("bigint")
    return days * per_day + (clock(end) - clock(start))


def clock_text(c: Column | str) -> Column:
    """Time of day as ``hh:mm:ss``."""
    two = lambda field: F.lpad(text(field), 2, "0")
    return F.concat(two(F.hour(col(c))), F.lit(":"), two(F.minute(col(c))), F.lit(":"), two(F.second(col(c))))


def decode(c: Column | str, mapping: Mapping, default: Column | str | None = None) -> Column:
    """Code-to-text lookup as a CASE expression (stays in generated code)."""
    source = col(c)
    chain = None
    for code, text in mapping.items():
        chain = (chain if chain is not None else F).when(source == F.lit(code), F.lit(text))
    if default is None:
        return chain
    return chain.otherwise(F.lit(default) if isinstance(default, str) else default)


def quote(c: Column | str, left: str = "[", right: str = "]") -> Column:
    """Delimited identifier; the closing mark is doubled inside."""
    return F.concat(F.lit(left), F.replace(col(c), F.lit(right), F.lit(right * 2)), F.lit(right))


def text(c: Column | str) -> Column:
    return col(c).cast("string")


def blank_if_null(c: Column | str) -> Column:
    return F.coalesce(text(c), F.lit(""))


def like_pattern(pattern: str) -> str:
    """``%`` is a wildcard, every other character (also ``_``) is literal."""
    return pattern.replace("\\", "\\\\").replace("_", "\\_")


def last_name_part(c: Column | str) -> Column:
    """Last part of a dotted name; dots and doubled ``]`` inside brackets belong to the part."""
    part = F.regexp_extract(col(c), r"(\[(?:[^\]]|\]\])*\]|[^\[\].]+)$", 1)
    return F.when(part.startswith("["), F.regexp_replace(F.regexp_replace(part, r"^\[|\]$", ""), r"\]\]", "]")).otherwise(part)


def int_to_timestamp(day: Column | str, clock: Column | str) -> Column:
    """``yyyymmdd`` and ``hhmmss`` integers to a timestamp without zone."""
    stamp = F.concat(F.lpad(text(day), 8, "0"), F.lpad(text(clock), 6, "0"))
    return F.to_timestamp_ntz(stamp, F.lit("yyyyMMddHHmmss"))


def clock_12h(clock: Column | str, quirk: bool = False) -> Column:
    """``hhmmss`` integer as ``h:mm AM/PM``.

    With ``quirk`` the noon hour prints as ``0:mm PM``, as the old report did.
    """
    hour = F.call_function("div", big(clock) % 1000000, F.lit(10000).cast("bigint"))
    minute = F.call_function("div", big(clock) % 10000, F.lit(100).cast("bigint"))
    noon = F.lit(0 if quirk else 12).cast("bigint")
    shown = (
        F.when(hour == 0, F.lit(12).cast("bigint"))
        .when(hour < 12, hour)
        .when(hour == 12, noon)
        .otherwise(hour - 12)
    )
    return F.concat(
        text(shown), F.lit(":"), F.lpad(text(minute), 2, "0"),
        F.when(hour < 12, F.lit(" AM")).otherwise(F.lit(" PM")),
    )


def duration_text(seconds: Column | str) -> Column:
    """Whole seconds as ``[d.]hh:mm:ss``."""
    s = big(seconds)
    days = int_div(s, 86400)
    rest = s % 86400
    return F.concat(
        F.when(days > 0, F.concat(text(days), F.lit("."))).otherwise(F.lit("")),
        F.lpad(text(int_div(rest, 3600)), 2, "0"), F.lit(":"),
        F.lpad(text(int_div(rest % 3600, 60)), 2, "0"), F.lit(":"),
        F.lpad(text(rest % 60), 2, "0"),
    )


def ordered_text(entries: Column, separator: str = ",") -> Column:
    """Join an array of strings after sorting it."""
    return F.array_join(F.array_sort(entries), separator)
