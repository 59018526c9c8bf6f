"""Calendar expressions on a fixed 365-slot year.

A slot is the day number on a non-leap calendar; 29 February shares slot 59 with 28 February, so 1 March is slot 60 in
every year.  ``position`` puts every slot of every year on one integer line (365 steps per year).  On that line a
circular day-of-year window around (window year, slot) is a plain interval, which is why the window operators need
neither an explode nor a range join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days before each month on a non-leap calendar.
DAYS_BEFORE_MONTH = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]
SLOTS = 365
SEASONS = ["Winter", "Spring", "Summer", "Autumn"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slot_of(month: str | Column, day: str | Column) -> Column:
    """Slot 1..365 of a (month, day)."""
    m, d = _c(month), _c(day)
    before = F.element_at(F.array(*[F.lit(n) for n in DAYS_BEFORE_MONTH]), m.cast("int"))
    return (before + F.when((m == 2) & (d == 29), F.lit(28)).otherwise(d)).cast("int")


def slot(date: str | Column) -> Column:
    d = _c(date)
    return slot_of(F.month(d), F.dayofmonth(d))


def position(date: str | Column) -> Column:
    """Place of a date on the 365-steps-per-year line."""
    d = _c(date)
    return (F.year(d) * SLOTS + slot(d) - 1).cast("int")


def position_year(pos: str | Column) -> Column:
    return F.floor(_c(pos) / SLOTS).cast("int")


def position_slot(pos: str | Column) -> Column:
    return (F.pmod(_c(pos), F.lit(SLOTS)) + 1).cast("int")


def slot_date(slot_col: str | Column, year: int = 2001) -> Column:
    """Date of a slot in a (non-leap) label year."""
    return F.date_add(F.lit(dt.date(year, 1, 1)), (_c(slot_col) - 1).cast("int"))


def slot_month(slot_col: str | Column) -> Column:
    return F.month(slot_date(slot_col))


def slot_day(slot_col: str | Column) -> Column:
    return F.dayofmonth(slot_date(slot_col))


def all_slots() -> Column:
    """Generator of the 365 slots."""
    return F.explode(F.sequence(F.lit(1), F.lit(SLOTS)))


def circular_distance(row_slot: str | Column, target: str | Column) -> Column:
    """Signed distance -182..182 between two slots."""
    return F.pmod(_c(row_slot) - _c(target) + 182, F.lit(SLOTS)) - 182


def window_year(year: str | Column, row_slot: str | Column, target: str | Column) -> Column:
    """Year a row counts for in the window around ``target`` (a late December row belongs to the next January)."""
    raw = _c(row_slot) - _c(target)
    return (_c(year) + F.when(raw > 182, 1).when(raw < -182, -1).otherwise(0)).cast("int")


def day_label(month: str | Column, day: str | Column) -> Column:
    """``Jan 5``."""
    return F.concat_ws(" ", F.element_at(F.array(*[F.lit(m) for m in MONTHS]), _c(month).cast("int")),
                       _c(day).cast("string"))


def is_leap(year: str | Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(_c(year), F.lit(2), F.lit(1)))) == 29


def month_end(year: str | Column, month: str | Column) -> Column:
    return F.last_day(F.make_date(_c(year), _c(month), F.lit(1)))


def days_in_month(year: str | Column, month: str | Column) -> Column:
    return F.dayofmonth(month_end(year, month))


def season_index(month: str | Column) -> Column:
    """0 winter (Dec-Feb), 1 spring, 2 summer, 3 autumn."""
    return F.floor((_c(month) % 12) / 3).cast("int")


def season_name(index: str | Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEASONS]), _c(index) + 1)


def season_year(date: str | Column) -> Column:
    """December counts for the winter of the next year."""
    d = _c(date)
    return (F.year(d) + F.when(F.month(d) == 12, 1).otherwise(0)).cast("int")


def season_end(year: str | Column, index: str | Column) -> Column:
    return month_end(year, (_c(index) * 3 + 2).cast("int"))


def month_day(date: str | Column) -> Column:
    return F.date_format(_c(date), "MM-dd")


def month_day_no_leap(date: str | Column) -> Column:
    """Month-day key of a 365-row climatology: 29 February is looked up as 28 February."""
    md = month_day(date)
    return F.when(md == "02-29", F.lit("02-28")).otherwise(md)


def month_day_window(center: str, days: int) -> list[str]:
    """The ``MM-dd`` labels within ``days // 2`` of a center day, wrapped over the year end."""
    base = dt.date(2001, *map(int, center.split("-")))
    half = days // 2
    return [(base + dt.timedelta(days=k)).strftime("%m-%d") for k in range(-half, half + 1)]


def local_dates(start: str | Column, end: str | Column, interval: str | Column, offset: str | Column) -> Column:
    """Calendar dates of the steps start, start+interval, ... < end (epoch seconds) at a UTC offset in seconds.

    The session time zone must be UTC: the offset is added to the instant before the date is cut.
    """
    s, e, step, off = _c(start), _c(end), _c(interval), _c(offset)
    steps = F.when(e > s, F.sequence(s, e - 1, step)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(steps, lambda t: F.to_date(F.timestamp_seconds(t + off)))


def date_in_zone(ts: str | Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(_c(ts), zone))


def provenance_tag(date: str | Column, today: str | Column, days: int = 7,
                   preliminary: str = "era5t", final: str = "era5") -> Column:
    """Rows younger than ``days`` are preliminary."""
    return F.when(_c(date) >= F.date_sub(_c(today), days), F.lit(preliminary)).otherwise(F.lit(final))
