"""Calendar of a fixed offset (default UTC+08:00): keys of instants, and half-open windows.

Windows are plain (start, end) pairs of naive UTC datetimes computed from a `now` argument, never from
the clock; `within` turns one into a predicate that also bounds the partition column `day`.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OFFSET_HOURS = 8
Window = tuple[datetime, datetime]
EPOCH = datetime(1970, 1, 1)


def local(ts: str | Column, offset: int = OFFSET_HOURS) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts + F.expr(f"INTERVAL {offset} HOURS")


def day(ts: str | Column, offset: int = OFFSET_HOURS) -> Column:
    return local(ts, offset).cast("date")


def day_key(ts: str | Column) -> Column:
    return F.date_format(day(ts), "yyyy-MM-dd")


def week_key(ts: str | Column) -> Column:
    d = day(ts)
    return F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def month_key(ts: str | Column) -> Column:
    return F.date_format(day(ts), "yyyy-MM")


def hour_key(ts: str | Column) -> Column:
    return F.hour(local(ts))


def literal(t: datetime) -> Column:
    return F.expr(f"timestamp_ntz'{t:%Y-%m-%d %H:%M:%S.%f}'")


def within(window: Window, ts: str = "started_at", day_column: str | None = None) -> Column:
    start, end = window
    p = (F.col(ts) >= literal(start)) & (F.col(ts) < literal(end))
    if day_column:  # partitions prune only on their own column
        lo = (start + timedelta(hours=OFFSET_HOURS)).date()
        hi = (end + timedelta(hours=OFFSET_HOURS, microseconds=-1)).date()
        p &= F.col(day_column).between(F.lit(lo), F.lit(hi))
    return p


def stored_day(usage) -> str | None:
    """The day column that a stored table is partitioned by, if `usage` has it."""
    return "day" if dict(usage.dtypes).get("day") == "date" else None


def _today(now: datetime) -> date:
    return (now + timedelta(hours=OFFSET_HOURS)).date()


def _utc(d: date) -> datetime:
    return datetime(d.year, d.month, d.day) - timedelta(hours=OFFSET_HOURS)


def _months_later(d: date, n: int) -> date:
    m = d.year * 12 + d.month - 1 + n
    return date(m // 12, m % 12 + 1, 1)


def _span(period: str, d: date) -> tuple[date, date]:
    """First day of the period around d, and of the next."""
    if period == "day":
        return d, d + timedelta(days=1)
    if period == "week":
        start = d - timedelta(days=d.weekday())
        return start, start + timedelta(days=7)
    if period == "month":
        start = d.replace(day=1)
        return start, _months_later(start, 1)
    if period == "year":
        return date(d.year, 1, 1), date(d.year + 1, 1, 1)
    raise ValueError(f"unknown period {period!r}")


def current(period: str, now: datetime) -> Window:
    """Period around `now`; all: the epoch to now."""
    if period == "all":
        return EPOCH, now
    start, end = _span(period, _today(now))
    return _utc(start), _utc(end)


def previous(period: str, now: datetime) -> Window:
    """The last full day, week or month; all: the same as current."""
    if period == "all":
        return EPOCH, now
    start, _ = _span(period, _today(now))
    before, _ = _span(period, start - timedelta(days=1))
    return _utc(before), _utc(start)


def last_n_days(n: int, now: datetime) -> Window:
    """The n - 1 days before today, and today so far."""
    return _utc(_today(now) - timedelta(days=max(n, 1) - 1)), now


def current_year(now: datetime) -> Window:
    return current("year", now)


def custom(start: date, end: date) -> Window:
    """Both days inclusive; swapped if inverted."""
    lo, hi = min(start, end), max(start, end)
    return _utc(lo), _utc(hi + timedelta(days=1))


def preset_windows(now: datetime) -> dict[str, Window]:
    return {
        "today": current("day", now),
        "yesterday": previous("day", now),
        "this_week": current("week", now),
        "last_week": previous("week", now),
        "this_month": current("month", now),
        "this_year": current_year(now),
        "365d": last_n_days(365, now),
        "7d": last_n_days(7, now),
        "30d": last_n_days(30, now),
    }


def presets(spark: SparkSession, now: datetime) -> DataFrame:
    """name, window_start, window_end: nine rows, for a range join."""
    rows = [(name, s, e) for name, (s, e) in preset_windows(now).items()]
    return spark.createDataFrame(rows, "name string, window_start timestamp_ntz, window_end timestamp_ntz")
