"""Several results of one view from one scan of its rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import series
from ..operators.aggregate import merge, rollup, stats, with_total

#: grouping_id over (provider, model, project, day) of each part of the dashboard.
LEVELS = {15: "total", 7: "provider", 3: "provider_model", 13: "project", 14: "day"}


def dashboard(usage: DataFrame, window: calendar.Window) -> DataFrame:
    """Totals, and sums by provider, provider and model, project and day, in one aggregation; `level` names them."""
    rows = usage.where(calendar.within(window, day_column=calendar.stored_day(usage))).withColumn("day", calendar.day_key("started_at"))
    cols = [F.col(c) for c in ("provider", "model", "project", "day")]
    p, m, j, d = cols
    out = rows.groupingSets([[], [p], [p, m], [j], [d]], p, m, j, d).agg(F.grouping_id().alias("gid"), *stats())
    names = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    return with_total(out).withColumn("level", names[F.col("gid").cast("int")]).drop("gid")


def charts(usage: DataFrame, window: calendar.Window) -> dict[str, DataFrame]:
    """Series by provider and by model, both from the one by provider, model and day."""
    fine = series.daily(usage, "provider", "model", window=window)
    return {"provider_model": fine, "provider": merge(fine, "provider", "day"), "model": series.model_series(fine)}


def report(usage: DataFrame, today: date, window: calendar.Window) -> dict[str, DataFrame]:
    """The report of a year: days, activity, grid, levels, hours of today, and breakdowns of a window."""
    days = series.daily(usage, window=calendar.custom(series.grid_start(today), today))
    cells = series.grid(days, today)
    hourly = series.hours(usage, today)
    return {
        "days": days, "activity": series.activity(days, today), "busiest": series.busiest_day(days, today), "grid": cells,
        "levels": series.level_histogram(cells), "hours": hourly, "peak": series.peak_hour(hourly),
        "providers": rollup(usage, "provider", window=window, order="total_tokens"), "models": rollup(usage, "model", window=window, order="total_tokens"),
    }


Part = Callable[[DataFrame, calendar.Window], DataFrame]

#: Parts of a view, each few rows a window.
PARTS: dict[str, Part] = {
    "total": lambda u, w: rollup(u, window=w),
    "provider": lambda u, w: rollup(u, "provider", window=w),
    "provider_model": lambda u, w: rollup(u, "provider", "model", window=w),
    "project": lambda u, w: rollup(u, "project", window=w),
    "day": lambda u, w: rollup(u, "day", window=w),
}


@dataclass
class View:
    """Rows of the parts that could be had, and what went wrong with the last of the others; `number` says which of two views is newer."""

    number: int
    rows: dict[str, list[Row]] = field(default_factory=dict)
    error: str | None = None


def view(usage: DataFrame, window: calendar.Window, number: int, parts: dict[str, Part] | None = None) -> View:
    """All parts, each evaluated on its own: one that fails leaves the others whole. `dashboard` has them from one scan."""
    out = View(number)
    for name, part in (PARTS if parts is None else parts).items():
        try:
            out.rows[name] = part(usage, window).collect()
        except Exception as x:  # noqa: BLE001  whatever a part's job raises
            out.error = f"{name}: {x}"
    return out


def applied(shown: View | None, new: View) -> View:
    """The view to show: a view that is older than the one shown is passed over."""
    return shown if shown is not None and new.number < shown.number else new
