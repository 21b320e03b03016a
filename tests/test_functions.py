"""Grains, masks, times and texts: the cases of the blueprint's test plan."""

from __future__ import annotations

from datetime import UTC, datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronotally.functions import intervals as iv
from chronotally.functions import masks, text


def ms(iso: str) -> int:
    return int(datetime.fromisoformat(iso).replace(tzinfo=UTC).timestamp() * 1000)


@pytest.mark.parametrize(
    ("name", "start"),
    [("SECOND", "2009-01-01T10:11:12"), ("MINUTE", "2009-01-01T10:11:00"), ("HOUR", "2009-01-01T10:00:00"), ("DAY", "2009-01-01T00:00:00"), ("FOREVER", "1970-01-01T00:00:00")],
)
def test_bucket(spark, name, start):
    at = ms("2009-01-01T10:11:12.134")
    i = iv.interval(name)
    row = spark.range(1).select(F.lit(at).alias("t")).select(iv.bucket(F.col("t"), i).alias("b"), iv.row_bucket(F.col("t"), i).alias("r"), iv.column_index(F.col("t"), i).alias("c")).select("b", iv.full_time(F.col("r"), F.col("c"), i).alias("again")).first()
    assert row["b"] == ms(start) == row["again"] == iv.truncate_ms(at, i.column_ms)


@pytest.mark.parametrize(("period", "points", "name"), [(40 * 60_000, 100, "MINUTE"), (100 * 60_000, 100, "MINUTE"), (iv.LONG_MAX, 100, "FOREVER"), (1, 100, "SECOND"), (3_600_000 * 101, 100, "DAY")])
def test_best_fit(period, points, name):
    assert iv.best_fit(period, points).name == name


def test_best_fit_needs_a_period():
    with pytest.raises(ValueError):
        iv.best_fit(0)


def test_retention():
    now, keep = ms("2015-05-12T14:01:01"), {i.name: 2 for i in iv.INTERVALS}
    second = iv.interval("SECOND")
    assert iv.cutoff_ms(now, second, keep) == ms("2015-05-12T12:00:00")
    assert iv.cutoff_ms(now, iv.interval("MINUTE"), keep) == ms("2015-05-10T00:00:00")
    assert not iv.is_kept(ms("2015-05-12T11:59:59.999"), now, second, keep)
    assert iv.is_kept(ms("2015-05-12T12:00:00"), now, second, keep)
    assert iv.is_kept(0, now, iv.interval("FOREVER"), keep)


def test_late_events_enter_coarser_stores(spark):
    now, keep = ms("2017-03-05T12:30:00"), {i.name: 1 for i in iv.INTERVALS}
    days = {0: "SECOND", 2 / 24: "MINUTE", 2: "HOUR", 56: "DAY", 730: "FOREVER"}
    rows = spark.createDataFrame([(now - int(d * 86_400_000), s) for d, s in days.items()], "t long, want string")
    got = rows.select("want", iv.base_store(F.col("t"), F.lit("SECOND"), now, keep).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    assert rows.select(iv.base_store(F.col("t"), F.lit("DAY"), now, keep).alias("s")).distinct().count() == 2


def test_grains_in_order():
    assert all(b.column_ms % a.column_ms == 0 for a, b in zip(iv.INTERVALS[:3], iv.INTERVALS[1:4], strict=True))
    assert iv.coarser(iv.interval("day")).name == "FOREVER" and iv.coarser(iv.INTERVALS[-1]) is None
    assert iv.finer(iv.INTERVALS[0]) is None and iv.by_short_name("h").name == "HOUR" and iv.by_column_ms(60_000).name == "MINUTE"
    with pytest.raises(ValueError):
        iv.interval("fortnight")


def test_masks():
    assert masks.all_masks(0) == [0] and masks.all_masks(2) == [0, 1, 2, 3]
    assert masks.of_positions([2, 0]) == masks.of_tags(["a", "b", "c"], ["c", "a"]) == masks.of_values([masks.ROLLED_UP, None, masks.ROLLED_UP]) == 5
    assert masks.positions(5) == [0, 2] and masks.booleans(5, 3) == [True, False, True]
    assert masks.is_rolled_up(5, 2) and not masks.is_rolled_up(5, 1) and masks.matches(0b1101, 0b1011) == 2
    assert masks.convert(masks.of_tags(["a", "b"], ["b"]), ["a", "b"], ["aa", "b", "c"]) == 2
    for wrong in ([15], [-1]):
        with pytest.raises(ValueError):
            masks.of_positions(wrong)
    with pytest.raises(ValueError):
        masks.all_masks(16)


@given(st.sets(st.integers(0, 14)))
def test_mask_positions_round_trip(at):
    assert masks.positions(masks.of_positions(at)) == sorted(at)


def test_time_literals():
    now = ms("2024-02-29T13:45:12.5")
    assert text.parse_time_ms("2024-01-01T00:00:00.000Z", now) == ms("2024-01-01T00:00:00")
    assert text.parse_time_ms("2024-01-01T00:00:00", now, "Europe/Paris") == ms("2023-12-31T23:00:00")
    assert text.parse_time_ms("now()", now) == now and text.parse_time_ms("1704067200000", now) == ms("2024-01-01T00:00:00")
    assert text.parse_time_ms("day() - 2d", now) == ms("2024-02-27T00:00:00") and text.parse_time_ms("hour()+30m", now) == ms("2024-02-29T13:30:00")
    assert text.parse_time_ms("month()", now) == ms("2024-02-01T00:00:00") and text.parse_time_ms("year() - 1M", now) == ms("2023-12-01T00:00:00")
    assert text.parse_time_ms("day() - 1y", now) == ms("2023-02-28T00:00:00") and text.parse_time_ms("week()", now) == ms("2024-02-26T00:00:00")
    with pytest.raises(ValueError):
        text.parse_time_ms("yesterday", now)


def test_periods_and_sizes():
    p = text.Period(0, 3_661_001)
    assert p.text() == "01:01:01.001" and p.contains(0) and not p.contains(3_661_001) and text.Period(1, 1).is_empty()
    assert p.union(text.Period(-5, None)) == text.Period(-5, None) and p.is_before(3_661_001) and text.Period(5).is_after(4)
    assert text.parse_duration_ms("5m") == 300_000 and text.parse_size("2k") == 2048 and text.size_text(1536) == "1.5K"
