"""Configurations, requests and the two choices in front of a plan."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronotally.functions import intervals as iv
from chronotally.functions.masks import ROLLED_UP, of_positions
from chronotally.functions.text import Period
from chronotally.plans.model import PRECISION, TIME, Registry, StatConfig, UnknownStatistic, UnsupportedRequest, config_from_xml
from chronotally.plans.request import condition, resolve, term, tree
from chronotally.plans.resolve import choose_mask, choose_store

NOW = 1_706_659_200_000
FIELDS = ("tag0", "tag1", "tag2", "tag3")
ALL = StatConfig("u", "s", "COUNT", "ALL", "SECOND", FIELDS)
CUSTOM = StatConfig("u", "s", "COUNT", "CUSTOM", "SECOND", FIELDS, tuple(of_positions(x) for x in ([], [0, 1, 2, 3], [0, 2], [1, 3], [0, 1], [2, 3])))
NONE = StatConfig("u", "s", "COUNT", "NONE", "SECOND", FIELDS)
CASES = [((), (), [0, 1, 2, 3]), ((), (0, 2), [1, 3]), ((1, 3), (), [0, 2]), ((1, 3), (0, 2), []), ((1,), (2,), [0, 3])]


@pytest.mark.parametrize(("filtered", "requested", "want"), CASES)
def test_mask_choice(filtered, requested, want):
    names = [[FIELDS[i] for i in x] for x in (filtered, requested)]
    assert choose_mask(ALL, *names) == of_positions(want)
    assert choose_mask(NONE, *names) == 0
    if want != [0, 3]:
        assert choose_mask(CUSTOM, *names) == of_positions(want)


def test_mask_of_rolled_up_tags():
    assert choose_mask(ALL, requested=FIELDS, rolled_up=["tag1"]) == 2
    assert choose_mask(CUSTOM, requested=FIELDS, rolled_up=["tag0", "tag1"]) == 3


def test_store_choice():
    assert choose_store(ALL, Period(), NOW).name == "FOREVER"
    assert choose_store(ALL, Period(NOW - 2000, NOW), NOW).name == "SECOND"
    assert choose_store(ALL, Period(NOW - 2000, NOW), NOW, iv.interval("hour")).name == "HOUR"
    assert choose_store(StatConfig("u", "s", precision="MINUTE"), Period(NOW - 2000, NOW), NOW).name == "MINUTE"
    old = NOW - 10 * 86_400_000
    assert choose_store(ALL, Period(old, old + 2000), NOW).name == "MINUTE"
    assert choose_store(ALL, Period(NOW - 3_600_000 * 201, NOW), NOW).name == "DAY"
    assert choose_store(ALL, Period(1, None), NOW).name == "DAY"
    assert choose_store(ALL, Period(5, 5), NOW).name == "DAY"


def test_dates():
    def period(condition, value):
        return resolve(NONE, tree("AND", term(TIME, condition, value)), [], NOW).period

    a, b = "2024-01-01T00:00:00.000Z", "2024-01-02T00:00:00.000Z"
    t, u = 1_704_067_200_000, 1_704_153_600_000
    assert period("EQUALS", a) == Period(t, t + 1) and period("BETWEEN", f"{a},{b}") == Period(t, u + 1)
    assert period("LESS_THAN", a) == Period(None, t) and period("LESS_THAN_OR_EQUAL_TO", a) == Period(None, t + 1)
    assert period("GREATER_THAN", a) == Period(t + 1, None) and period("GREATER_THAN_OR_EQUAL_TO", a) == Period(t, None)
    assert resolve(NONE, None, [], NOW).period == Period()
    for condition, value in (("BETWEEN", a), ("BETWEEN", f"{b},{a}"), ("EQUALS", f"{a},{b}"), ("CONTAINS", a)):
        with pytest.raises(UnsupportedRequest):
            period(condition, value)


def test_special_terms():
    date, grain, tag = term(TIME, "EQUALS", "now()"), term(PRECISION, "EQUALS", "hour"), term("tag0", "EQUALS", "x")
    found = resolve(NONE, tree("AND", date, tree("OR", tag, tag), grain), ["tag1", "other"], NOW)
    assert found.precision.name == "HOUR" and found.filtered == {"tag0"} and found.requested == ("tag1",)
    assert resolve(NONE, date, [], NOW).tree is None
    for wrong in (tree("AND", date, date), tree("OR", date, tag), tree("AND", tree("AND", grain)), tree("AND", term(PRECISION, "IN", "hour")), tree("AND", term(None, "EQUALS", "x")), term("Statistic Count", "EQUALS", "1"), tree("NOT", tag, tag)):
        with pytest.raises(UnsupportedRequest):
            resolve(NONE, wrong, [], NOW)


def test_rolled_up_terms():
    one = tree("AND", term("tag0", "EQUALS", ROLLED_UP), term("tag1", "EQUALS", "x"))
    assert resolve(ALL, one, [], NOW).rolled_up == {"tag0"} and resolve(ALL, one, [], NOW).filtered == {"tag1"}
    for config in (NONE, CUSTOM):
        with pytest.raises(UnsupportedRequest):
            resolve(config, one, [], NOW)
    both = tree("AND", term("tag0", "EQUALS", ROLLED_UP), term("tag1", "EQUALS", ROLLED_UP))
    assert resolve(CUSTOM, both, [], NOW).rolled_up == {"tag0", "tag1"}


def test_filters(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "tag0 string")

    def kept(node):
        return [r[0] for r in rows.where(condition(resolve(NONE, node, [], NOW).tree, lambda f: F.col(f) if f == "tag0" else None)).collect()]

    a, b = term("tag0", "EQUALS", "a"), term("tag0", "EQUALS", "b")
    assert kept(a) == ["a"] and kept(tree("NOT", a)) == ["b", None] and kept(tree("OR", a, b)) == ["a", "b"] and kept(tree("AND", a, b)) == []
    assert kept(term("tag0", "IN", "a,b")) == ["a", "b"] and kept(term("tag0", "IN", "a,")) == ["a", None] and kept(term("tag0", "IN", None)) == [None]
    assert kept(term("tag0", "EQUALS", "")) == [None] and kept(term("nosuch", "EQUALS", "a")) == [] and kept(tree("NOT", term("nosuch", "EQUALS", "a"))) == ["a", "b", None]
    assert kept(tree("OR", a, {**b, "enabled": False})) == ["a"] and kept(tree("AND", a, enabled=False)) == ["a", "b", None]
    with pytest.raises(UnsupportedRequest):
        kept(term("tag0", "CONTAINS", "a"))


def test_configs():
    c = config_from_xml(
        "<data><field><fieldName>user</fieldName></field><field><fieldName>feed</fieldName></field><customRollUpMask/><customRollUpMask><rolledUpTagPosition>0</rolledUpTagPosition>"
        "<rolledUpTagPosition>1</rolledUpTagPosition></customRollUpMask><customRollUpMask><rolledUpTagPosition>1</rolledUpTagPosition></customRollUpMask></data>",
        "u", "name",
    )
    assert c.fields == ("feed", "user") and c.masks() == [0, 2, 3] and c.supports(["user"]) and not c.supports(["feed"])
    assert StatConfig("u", "s", fields=("b", "A", "b")).fields == ("A", "b")
    assert StatConfig("u", "s", "VALUE").all_fields()[4] == "Statistic Value" and c.problems() == ["not enabled"]
    registry = Registry.from_json('[{"uuid": "u", "name": "s", "kind": "VALUE", "fields": ["x"]}]')
    assert registry.get("u").kind == "VALUE"
    with pytest.raises(UnknownStatistic):
        registry.get("v")
    for wrong in ({"kind": "X"}, {"rollup": "X"}, {"precision": "X"}, {"custom_masks": (1,)}, {"fields": tuple(map(str, range(16)))}):
        with pytest.raises(ValueError):
            StatConfig("u", "s", **wrong)
