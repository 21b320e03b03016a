"""Statistics' configurations, and the registry that holds them."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals, masks

# Names of the result's columns besides tags.
NAME, UUID, TIME, COUNT, PRECISION, PRECISION_MS = "Statistic Name", "Statistic UUID", "Date Time", "Statistic Count", "Precision", "Precision ms"
VALUE, MIN, MAX = "Statistic Value", "Min Statistic Value", "Max Statistic Value"
STATIC_FIELDS = {"COUNT": [NAME, UUID, TIME, COUNT, PRECISION, PRECISION_MS], "VALUE": [NAME, UUID, TIME, COUNT, VALUE, MIN, MAX, PRECISION, PRECISION_MS]}
NAME_PATTERN = r"[a-zA-Z0-9_\- .()]+"


class UnknownStatistic(LookupError):
    """No statistic has that uuid."""


class UnsupportedRequest(ValueError):
    """A request that means nothing here."""


@dataclass(frozen=True)
class StatConfig:
    """fields are kept without repeats, sorted whatever their case; custom_masks are over that order."""

    uuid: str
    name: str
    kind: str = "COUNT"
    rollup: str = "NONE"
    precision: str = "HOUR"
    fields: tuple[str, ...] = ()
    custom_masks: tuple[int, ...] = ()
    enabled: bool = False
    description: str = ""

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", tuple(sorted(set(self.fields), key=lambda f: (f.lower(), f))))
        object.__setattr__(self, "custom_masks", tuple(sorted(set(self.custom_masks))))
        if self.kind not in STATIC_FIELDS:
            raise ValueError(f"no such kind: {self.kind}")
        if self.rollup not in ("NONE", "ALL", "CUSTOM"):
            raise ValueError(f"no such roll-up: {self.rollup}")
        intervals.interval(self.precision)
        if len(self.fields) > masks.MAX_TAGS:
            raise ValueError(f"at most {masks.MAX_TAGS} fields")
        if any(m >> len(self.fields) for m in self.custom_masks):
            raise ValueError("a mask rolls up a field that is not there")

    def masks(self) -> list[int]:
        """Of all combinations that are stored; the base is always one."""
        return {"NONE": [0], "ALL": masks.all_masks(len(self.fields)), "CUSTOM": sorted({0, *self.custom_masks})}[self.rollup]

    def static_fields(self) -> list[str]:
        return STATIC_FIELDS[self.kind]

    def all_fields(self) -> list[str]:
        return [*self.static_fields(), *self.fields]

    def is_tag(self, name: str) -> bool:
        return name in self.fields

    def position(self, tag: str) -> int:
        return self.fields.index(tag)

    def supports(self, rolled_up: Iterable[str]) -> bool:
        """Whether just these tags rolled up are a stored combination."""
        return masks.of_tags(list(self.fields), rolled_up) in self.masks()

    def problems(self) -> list[str]:
        out = []
        if not re.fullmatch(NAME_PATTERN, self.name):
            out.append(f"name {self.name!r} has characters that are not allowed")
        if not self.enabled:
            out.append("not enabled")
        return out


@dataclass(frozen=True)
class Registry:
    configs: Mapping[str, StatConfig] = field(default_factory=dict)

    @classmethod
    def of(cls, *configs: StatConfig) -> Registry:
        return cls({c.uuid: c for c in configs})

    @classmethod
    def from_json(cls, text: str) -> Registry:
        """A list of objects with the fields of StatConfig."""
        return cls.of(*(StatConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items()}) for x in json.loads(text)))

    @classmethod
    def from_rows(cls, df: DataFrame) -> Registry:
        """A table of configurations (columns as StatConfig's fields), one row for each statistic."""
        return cls.of(*(StatConfig(**{k: tuple(v or ()) if isinstance(v, list) or k in ("fields", "custom_masks") else v for k, v in r.asDict().items()}) for r in df.collect()))

    def get(self, uuid: str) -> StatConfig:
        if uuid not in self.configs:
            raise UnknownStatistic(uuid)
        return self.configs[uuid]

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row for each statistic, small enough to broadcast: a registry is held in the driver anyway."""
        kind = "stat_uuid string, stat_name string, kind string, rollup string, precision string, enabled boolean, fields array<string>, masks array<int>"
        return spark.createDataFrame([(c.uuid, c.name, c.kind, c.rollup, c.precision, c.enabled, list(c.fields), c.masks()) for c in self.configs.values()], kind)


def config_from_xml(text: str, uuid: str, name: str, **more: object) -> StatConfig:
    """Fields and custom masks from their XML form: field/fieldName, and customRollUpMask/rolledUpTagPosition, whose
    positions are those of the sorted fields."""
    root = ET.fromstring(text)
    found = [e.text or "" for e in root.iter("fieldName")]
    custom = [masks.of_positions(int(p.text) for p in m.iter("rolledUpTagPosition")) for m in root.iter("customRollUpMask")]
    return StatConfig(uuid=uuid, name=name, fields=tuple(found), custom_masks=tuple(custom), **{"rollup": "CUSTOM" if custom else "NONE"} | more)


def describe(spark: SparkSession, config: StatConfig) -> DataFrame:
    """(name, type, queryable, conditions) of each field of a statistic, tags last."""
    dates = ["BETWEEN", "EQUALS", "GREATER_THAN", "GREATER_THAN_OR_EQUAL_TO", "LESS_THAN", "LESS_THAN_OR_EQUAL_TO"]
    kinds = {TIME: ("DATE", True, dates), PRECISION: ("TEXT", True, ["EQUALS"]), NAME: ("TEXT", False, []), UUID: ("TEXT", False, [])}
    rows = [(f, *kinds.get(f, ("NUMBER", False, []))) for f in config.static_fields()]
    rows += [(f, "TEXT", True, ["EQUALS", "IN"]) for f in config.fields]
    return spark.createDataFrame(rows, "name string, type string, queryable boolean, conditions array<string>").select("name", "type", "queryable", F.array_join("conditions", ",").alias("conditions"))
