"""Scalar expressions under the names an analyst uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from insightspark.functions.columns import as_col, ratio

safe_divide = ratio


def week_start(c) -> Column:
    """Monday of the week as a date."""
    return F.date_trunc("week", as_col(c)).cast("date")


def month_start(c) -> Column:
    return F.date_trunc("month", as_col(c)).cast("date")


def days_between(end, start) -> Column:
    return F.date_diff(as_col(end), as_col(start))


def weeks_between(end, start) -> Column:
    """Calendar weeks crossed, Monday based."""
    return (F.date_diff(week_start(end), week_start(start)) / 7).cast("int")


def months_between_calendar(end, start) -> Column:
    e, s = as_col(end), as_col(start)
    return (F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)


def safe_timestamp(c, fmt: str | None = None) -> Column:
    """Timestamp, NULL where the text does not parse."""
    return F.try_to_timestamp(as_col(c), F.lit(fmt)) if fmt else F.try_to_timestamp(as_col(c))


def json_field(c, path: str) -> Column:
    return F.get_json_object(as_col(c), path)


def blank(c) -> Column:
    """True for text that is empty after trimming."""
    return F.length(F.trim(as_col(c))) == 0


def row_md5(cols: list[str], sep: str = "|", null_text: str = "") -> Column:
    """MD5 over the text of the columns joined with a bar."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(null_text)) for c in cols]
    return F.md5(F.concat_ws(sep, *parts))


def row_hash64(cols: list[str]) -> Column:
    """Cheap 64-bit row hash."""
    return F.xxhash64(*[F.col(c) for c in cols])


def round_half_even(c, digits: int) -> Column:
    return F.bround(as_col(c), digits)
