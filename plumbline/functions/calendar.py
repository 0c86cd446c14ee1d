"""Calendar periods: bins, positions on the calendar and labels.

Periods are the unit names ``s min h D W MS QS YS`` with an optional multiple for the first
five, such as ``5min`` or ``2D``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = {"s": 1, "min": 60, "h": 3600, "D": 86_400, "W": 604_800}
MONTHS = {"MS": 1, "QS": 3, "YS": 12}


def parse(period: str) -> tuple[int, str]:
    match = re.fullmatch(r"(\d*)(s|min|h|D|W|MS|QS|YS)", period)
    if not match or (match.group(1) and match.group(2) in MONTHS):
        raise ValueError(f"unknown period {period!r}")
    return int(match.group(1) or 1), match.group(2)


def micros(ts: Column) -> Column:
    """Microseconds from 1970-01-01 on the local calendar of ``ts``, whatever the session's time zone."""
    at = ts.cast("timestamp_ntz")
    clock = F.hour(at) * 3600 + F.minute(at) * 60
    return (F.unix_date(at.cast("date")).cast("long") * 86_400_000_000 + clock.cast("long") * 1_000_000
            + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long"))


def from_micros(at: Column) -> Column:
    """The inverse of ``micros`` as a zone-free time."""
    seconds = (at.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)


def bin_index(ts: Column, period: str) -> Column:
    """Integer position of the period holding ``ts``; consecutive periods differ by one."""
    n, unit = parse(period)
    if unit in MONTHS:
        return F.floor(((F.year(ts) - 1970) * 12 + F.month(ts) - 1) / MONTHS[unit]).cast("long")
    step = n * SECONDS[unit] * 1_000_000
    shift = 3 * 86_400_000_000 if unit == "W" else 0   # 1970-01-01 is a Thursday; weeks start on Monday
    at = micros(ts) + shift
    return ((at - F.pmod(at, F.lit(step).cast("long"))) / step).cast("long")    # exact: the quotient is whole


def bin_start(index: Column, period: str) -> Column:
    """First moment of the period at ``index`` (weeks: their closing Sunday, as the label)."""
    n, unit = parse(period)
    index = index.cast("long")
    if unit in MONTHS:
        month = index * MONTHS[unit]
        return F.make_timestamp_ntz(F.floor(month / 12).cast("int") + 1970, F.pmod(month, F.lit(12)).cast("int") + 1,
                                    F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    step = n * SECONDS[unit] * 1_000_000
    start = index * step
    if unit == "W":
        start = start - 3 * 86_400_000_000 + 6 * 86_400_000_000 + (n - 1) * 604_800_000_000
    return from_micros(start)


MINUTES = {**{u: s / 60 for u, s in SECONDS.items()}, "MS": 43_200, "QS": 129_600, "YS": 525_600}    # months of 30 days, years of 365


def widen(period: str, gap_minutes: int | None, resample_minutes: int | None) -> str:
    """The coarsest of a period, the field's own gap and its configured interval (minutes).

    A gap or interval is expressed in the largest unit that is not above it, rounded up; months, quarters and years
    have no multiples.
    """
    n, unit = parse(period)
    wanted = max(gap_minutes or 0, resample_minutes or 0)
    if wanted <= n * MINUTES[unit]:
        return period
    unit = max((u for u in MINUTES if MINUTES[u] <= wanted), key=MINUTES.get)
    n = 1 if unit in MONTHS else -int(-wanted // MINUTES[unit])
    return f"{n if n > 1 else ''}{unit}"
