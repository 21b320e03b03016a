"""Set algebra over named results."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Correlator:
    """Named sets of rows of one schema; rows are distinct within a set, and nulls equal nulls."""

    sets: dict[str, DataFrame] = field(default_factory=dict)

    def add(self, name: str, rows: DataFrame) -> Correlator:
        for other in self.sets.values():
            if rows.columns != other.columns:
                raise ValueError(f"{name} has columns {rows.columns}, not {other.columns}")
        return Correlator({**self.sets, name: rows.distinct()})

    def complement(self, name: str) -> DataFrame:
        """The rows of all other sets that are not in this one, as often as other sets have them."""
        mine, others = self.sets[name], [d for n, d in self.sets.items() if n != name]
        if not others:
            return mine.limit(0)
        right = mine.toDF(*(f"{c} of {name}" for c in mine.columns))
        on = [F.col(f"`{c}`").eqNullSafe(F.col(f"`{c} of {name}`")) for c in mine.columns]
        return reduce(DataFrame.unionAll, others).join(right, on, "left_anti")

    def intersection(self, names: Iterable[str] | None = None) -> DataFrame:
        """The rows that every named set, or every set, has."""
        chosen = [self.sets[n] for n in (names if names is not None else self.sets)]
        if len(chosen) < 2:
            raise ValueError("an intersection takes two sets or more")
        return reduce(DataFrame.intersect, chosen)
