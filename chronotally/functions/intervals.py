"""The time grains, and what is computed from a time and a grain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX = 2**63 - 1


@dataclass(frozen=True)
class Interval:
    """column_ms: length of a bucket; row_ms: length of a block of buckets, by which data are kept and purged."""

    name: str
    short: str
    column_ms: int
    row_ms: int
    purgeable: bool = True


# The five grains, finest first, and how many blocks of each are kept.
INTERVALS = [
    Interval("SECOND", "s", 1_000, 3_600_000),
    Interval("MINUTE", "m", 60_000, 86_400_000),
    Interval("HOUR", "h", 3_600_000, 2_419_200_000),
    Interval("DAY", "d", 86_400_000, 31_449_600_000),
    Interval("FOREVER", "f", LONG_MAX, LONG_MAX, False),
]
RETENTION = {"SECOND": 48, "MINUTE": 60, "HOUR": 39, "DAY": 6, "FOREVER": 1}
BY_NAME = {i.name: i for i in INTERVALS}
#: The most points of one series that a query aims for when it chooses a grain itself.
MAX_POINTS = 200


def interval(name: str) -> Interval:
    """By name, in any case."""
    try:
        return BY_NAME[name.upper()]
    except KeyError:
        raise ValueError(f"no such interval: {name}") from None


def by_short_name(short: str) -> Interval:
    return next(i for i in INTERVALS if i.short == short)


def by_column_ms(ms: int) -> Interval:
    return next(i for i in INTERVALS if i.column_ms == ms)


def position(i: Interval) -> int:
    return INTERVALS.index(i)


def coarser(i: Interval) -> Interval | None:
    return INTERVALS[position(i) + 1] if position(i) + 1 < len(INTERVALS) else None


def finer(i: Interval) -> Interval | None:
    return INTERVALS[position(i) - 1] if position(i) else None


def truncate_ms(ms: int, step: int) -> int:
    """Towards zero, as integer division of the engine's times goes; the endless step gives 0."""
    return 0 if step == LONG_MAX else int(ms / step) * step if abs(ms) < 2**52 else ms - ms % step


def bucket(ms: Column, i: Interval) -> Column:
    """The start of the bucket that a time in ms lies in; 0 for the endless grain."""
    return F.lit(0).cast("long") if i.column_ms == LONG_MAX else _floored(ms, i.column_ms)


def row_bucket(ms: Column, i: Interval) -> Column:
    """The number of the block that a time lies in."""
    return F.lit(0).cast("long") if i.row_ms == LONG_MAX else _div(ms, i.row_ms)


def column_index(ms: Column, i: Interval) -> Column:
    """The place of a bucket in its block."""
    return F.lit(0).cast("long") if i.row_ms == LONG_MAX else _div(ms - row_bucket(ms, i) * i.row_ms, i.column_ms)


def full_time(row: Column, index: Column, i: Interval) -> Column:
    """The bucket's start, of its block and its place there."""
    return F.lit(0).cast("long") if i.row_ms == LONG_MAX else row * i.row_ms + index * i.column_ms


def _div(ms: Column, step: int) -> Column:
    return F.call_function("div", ms, F.lit(step).cast("long"))


def _floored(ms: Column, step: int) -> Column:
    return _div(ms, step) * F.lit(step).cast("long")


def best_fit(period_ms: int, max_points: int = MAX_POINTS) -> Interval:
    """The finest grain that cuts the period into at most max_points buckets, more or less."""
    if period_ms == 0 or max_points <= 0:
        raise ValueError("needs a period and a number of points")
    wanted, found = period_ms // max_points, INTERVALS[-1]
    for i in reversed(INTERVALS):
        if i.column_ms < wanted:
            break
        found = i
    return found


def cutoff_ms(now_ms: int, i: Interval, retention: dict[str, int] = RETENTION) -> int:
    """The earliest time that a store of this grain keeps: a number of whole blocks before the one that now lies in."""
    if not i.purgeable:
        return -LONG_MAX
    return truncate_ms(now_ms, i.row_ms) - i.row_ms * retention[i.name]


def is_kept(ms: int, now_ms: int, i: Interval, retention: dict[str, int] = RETENTION) -> bool:
    return ms >= cutoff_ms(now_ms, i, retention)


def base_store(ms: Column, precision: Column, now_ms: int, retention: dict[str, int] = RETENTION) -> Column:
    """The name of the grain at which an event enters: the configured one, or the first coarser one that still keeps its time."""
    out: Column = F.lit(INTERVALS[-1].name)
    rank = lambda name: F.get(F.array(*(F.lit(k) for k in range(len(INTERVALS)))), F.array_position(F.array(*(F.lit(i.name) for i in INTERVALS)), name).cast("int") - 1)
    configured = rank(precision)
    for k, i in reversed(list(enumerate(INTERVALS[:-1]))):
        out = F.when((configured <= k) & (ms >= cutoff_ms(now_ms, i, retention)), F.lit(i.name)).otherwise(out)
    return out
