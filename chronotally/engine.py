"""One object for all of it: a registry, a store and a clock."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .functions import intervals
from .operators import rollup, search, store, validate
from .plans import model
from .plans.model import Registry


@dataclass(frozen=True)
class Engine:
    """root is the store's folder, which all executors must reach; now_ms is what every call takes as now. A strict engine
    takes events of enabled statistics only and answers only for statistics in good order."""

    spark: SparkSession
    registry: Registry
    root: str
    now_ms: int
    retention: dict[str, int] = field(default_factory=lambda: dict(intervals.RETENTION))
    max_points: int = intervals.MAX_POINTS
    strict: bool = False

    def ingest(self, events: DataFrame, batch_id: int, retry: bool = False) -> DataFrame:
        """Writes a batch of events under its number; returns the bad ones. A number that was used raises BatchExists,
        unless retry says that the same batch is written again and replaces what is there of it."""
        if not retry:
            store.refuse_known(self.spark, self.root, batch_id)
        checked = validate.validate(events, self.registry, self.strict)
        store.write_batch(rollup.partials_of(validate.good(checked), self.registry, self.now_ms, self.retention), self.root, batch_id, rollup.widest(self.registry))
        return validate.bad(checked)

    def partials(self) -> DataFrame:
        return store.read(self.spark, self.root)

    def compact(self) -> list[int]:
        """Merges the store's batches but the newest into one; returns the numbers of those merged."""
        return store.compact_in_place(self.spark, self.root)

    def search(self, request: Mapping[str, Any]) -> DataFrame:
        if self.strict:
            search.require(self.registry.get(request["source_uuid"]))
        return search.search(self.partials(), self.registry, request, self.now_ms, self.retention, self.max_points)

    def describe(self, uuid: str) -> DataFrame:
        return model.describe(self.spark, self.registry.get(uuid))

    def tag_values(self, uuid: str, tag: str, part: str = "") -> DataFrame:
        return store.tag_values(self.partials(), self.registry.get(uuid), tag, part)

    def purge_old(self) -> int:
        return store.purge_old(self.spark, self.root, self.now_ms, self.retention)

    def purge_all(self, uuids: list[str] | None = None) -> int:
        return store.purge_all(self.spark, self.root, uuids)
