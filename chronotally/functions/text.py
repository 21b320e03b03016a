"""Dates, periods, sizes and identifiers as text."""

from __future__ import annotations

import re
from calendar import monthrange
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths of time units in ms, and binary multiples of sizes.
UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
SIZES = {"": 1, "k": 1024, "m": 1024**2, "g": 1024**3, "t": 1024**4}
RELATIVE = re.compile(r"(now|second|minute|hour|day|week|month|year)\(\)((?:\s*[+-]\s*\d+\s*(?:ms|[smhdwMy]))*)")
STEP = re.compile(r"([+-])\s*(\d+)\s*(ms|[smhdwMy])")


def parse_duration_ms(text: str) -> int:
    """'5m', '1s', '250ms', '2d'; a bare number is ms."""
    m = re.fullmatch(r"\s*(\d+)\s*(ms|[smhdw])?\s*", text)
    if not m:
        raise ValueError(f"no duration: {text!r}")
    return int(m[1]) * UNITS[m[2] or "ms"]


def parse_size(text: str) -> int:
    """'2k', '10M', '512'."""
    m = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)(?:i?b)?\s*", text.lower())
    if not m:
        raise ValueError(f"no size: {text!r}")
    return int(m[1]) * SIZES[m[2]]


def size_text(size: int) -> str:
    for unit in ("", "K", "M", "G"):
        if size < 1024:
            return f"{size:.1f}{unit}".replace(".0", "") if unit else str(size)
        size /= 1024
    return f"{size:.1f}T"


def _shift(at: datetime, sign: int, n: int, unit: str) -> datetime:
    if unit not in "My":
        return at + timedelta(milliseconds=sign * n * UNITS[unit])
    months = at.year * 12 + at.month - 1 + sign * n * (12 if unit == "y" else 1)
    year, month = divmod(months, 12)
    last = monthrange(year, month + 1)[1]
    return at.replace(year=year, month=month + 1, day=min(at.day, last))


def parse_time_ms(text: str, now_ms: int, zone: str = "UTC") -> int:
    """An ISO date or time (the zone applies where it names none), ms since 1970, or `unit()` with steps: `day() - 2d`.

    now() is now_ms, and day(), hour() and so on are the starts of the current ones in the zone."""
    text = text.strip()
    if re.fullmatch(r"-?\d+", text) and len(text) > 4:
        return int(text)
    if m := RELATIVE.fullmatch(text):
        at = datetime.fromtimestamp(now_ms / 1000, ZoneInfo(zone))
        cut = {"second": {"microsecond": 0}, "minute": {"second": 0}, "hour": {"minute": 0}, "day": {"hour": 0}, "month": {"day": 1}, "year": {"month": 1}}
        if m[1] != "now":
            for unit in ("second", "minute", "hour", "day"):
                at = at.replace(**cut[unit])
                if unit == m[1]:
                    break
            if m[1] == "week":
                at -= timedelta(days=at.weekday())
            for unit in ("month", "year"):
                if m[1] == unit or m[1] == "year":
                    at = at.replace(**cut[unit])
        for sign, n, unit in STEP.findall(m[2]):
            at = _shift(at, 1 if sign == "+" else -1, int(n), unit)
        return _ms(at)
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"no time: {text!r}") from None
    return _ms(at if at.tzinfo else at.replace(tzinfo=ZoneInfo(zone)))


def _ms(at: datetime) -> int:
    return (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)


def time_ms(text: Column) -> Column:
    """ISO text as ms since 1970; null where it is none."""
    return F.unix_millis(F.try_to_timestamp(text))


def time_text(ms: Column) -> Column:
    """ISO text with ms, in UTC where the session is."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def id_text(parts: Column) -> Column:
    """The parts of an identifier, joined by colons."""
    return F.array_join(parts, ":")


def tags_text(tags: Column) -> Column:
    """tag|value pairs of array<struct<name,value>>, comma-joined."""
    return F.array_join(F.transform(tags, lambda t: F.concat_ws("|", t["name"], F.coalesce(t["value"], F.lit("")))), ",")


@dataclass(frozen=True)
class Period:
    """Half-open [from_ms, to_ms) in ms; an end of None is open."""

    from_ms: int | None = None
    to_ms: int | None = None

    def duration(self) -> int | None:
        return None if self.from_ms is None or self.to_ms is None else self.to_ms - self.from_ms

    def hours(self) -> float:
        return (self.duration() or 0) / UNITS["h"]

    def days(self) -> float:
        return (self.duration() or 0) / UNITS["d"]

    def text(self) -> str:
        """The duration as hh:mm:ss.SSS."""
        n = self.duration() or 0
        return f"{n // UNITS['h']:02d}:{n // UNITS['m'] % 60:02d}:{n // 1000 % 60:02d}.{n % 1000:03d}"

    def is_empty(self) -> bool:
        return self.duration() is not None and self.duration() <= 0

    def contains(self, ms: int) -> bool:
        return (self.from_ms is None or ms >= self.from_ms) and (self.to_ms is None or ms < self.to_ms)

    def is_before(self, ms: int) -> bool:
        return self.to_ms is not None and self.to_ms <= ms

    def is_after(self, ms: int) -> bool:
        return self.from_ms is not None and self.from_ms > ms

    def union(self, other: Period) -> Period:
        low = None if None in (self.from_ms, other.from_ms) else min(self.from_ms, other.from_ms)
        return Period(low, None if None in (self.to_ms, other.to_ms) else max(self.to_ms, other.to_ms))

    def condition(self, ms: Column) -> Column:
        out = F.lit(True)
        if self.from_ms is not None:
            out = out & (ms >= self.from_ms)
        if self.to_ms is not None:
            out = out & (ms < self.to_ms)
        return out
