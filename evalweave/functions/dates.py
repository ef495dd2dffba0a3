"""Date ranges of acquisition runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and their short forms, in order.
MONTHS = "january february march april may june july august september october november december".split()


def previous_month(day: Column) -> Column:
    """First and last day of the month before."""
    first = F.add_months(F.trunc(day, "MM"), -1).cast("date")
    return F.struct(first.alias("first"), F.last_day(first).alias("last"))


def month_range(text: Column, today: Column | None = None) -> Column:
    """``june 2025``, ``Jun 2025`` or ``06/2025`` as its first and last day; null for months
    that don't exist and years before 1900 or after the present one."""
    t = F.lower(F.trim(text))
    word, year = F.regexp_extract(t, r"^([a-z]+|\d{1,2})[\s/,-]+(\d{4})$", 1), F.regexp_extract(t, r"^([a-z]+|\d{1,2})[\s/,-]+(\d{4})$", 2).try_cast("int")
    names = F.create_map(*[x for k, m in enumerate(MONTHS, 1) for n in {m, m[:3]} for x in (F.lit(n), F.lit(k))])
    month = F.coalesce(F.try_element_at(names, word), word.try_cast("int"))
    now = F.current_date() if today is None else today
    first = F.when(month.between(1, 12) & (year >= 1900) & (year <= F.year(now)), F.make_date(year, month, F.lit(1)))
    return F.when(first.isNotNull(), F.struct(first.alias("first"), F.last_day(first).alias("last")))


def is_stale(written: Column, now: Column, days: int = 7) -> Column:
    """Whole days since a file was written, stale from ``days`` on; never written is stale."""
    return F.coalesce(F.floor((F.unix_seconds(now) - F.unix_seconds(written)) / 86_400) >= days, F.lit(True))
