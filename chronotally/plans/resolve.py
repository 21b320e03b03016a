"""The two choices in front of a plan: which grain's store to read, and under which roll-up mask."""

from __future__ import annotations

from collections.abc import Iterable

from ..functions import intervals, masks
from ..functions.text import Period
from .model import StatConfig


def choose_store(config: StatConfig, period: Period, now_ms: int, precision: intervals.Interval | None = None, retention: dict[str, int] = intervals.RETENTION, max_points: int = intervals.MAX_POINTS) -> intervals.Interval:
    """The asked grain; else the finest that gives about max_points or fewer, is configured and still keeps the start.

    Open ends are 1970 and now. The endless grain is chosen for wholly unbounded queries only: its one bucket starts at
    0, so a query with a bound would get nothing from it, or everything."""
    if precision is not None:
        return precision
    bounded = period.from_ms is not None or period.to_ms is not None
    most = intervals.interval("DAY") if bounded else intervals.INTERVALS[-1]
    start, end = period.from_ms or 0, now_ms if period.to_ms is None else period.to_ms
    found = intervals.best_fit(end - start, max_points) if end != start else intervals.INTERVALS[-1]
    found = max(found, intervals.interval(config.precision), key=intervals.position)
    while found.purgeable and not intervals.is_kept(start, now_ms, found, retention):
        found = intervals.coarser(found)
    # a statistic of a coarser precision has no finer store to go back to
    return min(found, max(most, intervals.interval(config.precision), key=intervals.position), key=intervals.position)


def choose_mask(config: StatConfig, filtered: Iterable[str] = (), requested: Iterable[str] = (), rolled_up: Iterable[str] = ()) -> int:
    """The stored mask that rolls up most of the tags that neither filter nor output needs, and none of the others; tags
    asked for as rolled up always are. Of equal ones the least mask."""
    needed = (set(filtered) | set(requested)) - set(rolled_up)
    best = masks.of_positions(i for i, f in enumerate(config.fields) if f not in needed)
    if config.rollup == "ALL":
        return best
    forced = masks.of_tags(list(config.fields), rolled_up)
    fit = [m for m in config.masks() if m & ~best == 0 and m & forced == forced] or [0]
    return min(fit, key=lambda m: (-masks.matches(m, best), m))
