"""Queries: resolve a request, scan the partials that answer it, merge them and shape the result."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals, masks
from ..plans import model
from ..plans.model import Registry, StatConfig, UnsupportedRequest
from ..plans.request import Criteria, condition, resolve
from ..plans.resolve import choose_mask, choose_store
from .rollup import TAGS, mean, merge

REFERENCE = re.compile(r"\$\{([^}]+)\}")
AGGREGATE = re.compile(r"\b(count|sum|min|max|avg|mean|first|last|count_distinct|percentile|approx_percentile|stddev|variance|collect_set|collect_list)\s*\(", re.I)


def points(partials: DataFrame, criteria: Criteria, now_ms: int, retention: dict[str, int] = intervals.RETENTION, max_points: int = intervals.MAX_POINTS, raw_points: bool = False) -> DataFrame:
    """The statistic's columns and the requested tags, one row for each bucket and combination of those tags.

    Reads one grain and one mask of one statistic. Where the stored mask rolls up less than could be, rows are merged to
    the requested tags, unless raw_points asks for the stored ones."""
    config = criteria.config
    grain = choose_store(config, criteria.period, now_ms, criteria.precision, retention, max_points)
    mask = choose_mask(config, criteria.filtered, criteria.requested, criteria.rolled_up)
    tags = {f: TAGS[i] for i, f in enumerate(config.fields)}
    rows = partials.where((F.col("store") == grain.name) & (F.col("stat_uuid") == config.uuid) & (F.col("mask") == mask))
    if grain.row_ms != intervals.LONG_MAX:  # whole blocks first: they are partitions
        if criteria.period.from_ms is not None:
            rows = rows.where(F.col("row_bucket") >= criteria.period.from_ms // grain.row_ms)
        if criteria.period.to_ms is not None:
            rows = rows.where(F.col("row_bucket") <= (criteria.period.to_ms - 1) // grain.row_ms)
    rows = rows.where(criteria.period.condition(F.col("bucket_ms")))
    rows = rows.where(condition(criteria.tree, lambda f: F.col(tags[f]) if f in tags else None))
    shown = [f for f in config.fields if f in criteria.requested or (raw_points and not masks.is_rolled_up(mask, config.position(f)))]
    merged = merge(rows, ["bucket_ms", *(tags[f] for f in shown)])
    out: dict[str, Column] = {
        model.NAME: F.lit(config.name),
        model.UUID: F.lit(config.uuid),
        model.TIME: F.col("bucket_ms"),
        model.COUNT: F.col("cnt"),
        model.PRECISION: F.lit(grain.name),
        model.PRECISION_MS: F.lit(grain.column_ms).cast("long"),
    }
    if config.kind == "VALUE":
        out |= {model.VALUE: mean(), model.MIN: F.col("least"), model.MAX: F.col("most")}
    return merged.select(*(out[f].alias(f) for f in config.static_fields()), *(F.col(tags[f]).alias(f) for f in shown))


def referred(fields: list[Mapping[str, Any]]) -> list[str]:
    """The names that the output fields' expressions refer to."""
    return list(dict.fromkeys(n for f in fields for n in REFERENCE.findall(f.get("expression") or f"${{{f['name']}}}")))


def _column(expression: str, there: list[str]) -> Column:
    """A Spark SQL expression over ${field}; a field that is not there is null."""
    return F.expr(REFERENCE.sub(lambda m: f"`{m[1]}`" if m[1] in there else "CAST(NULL AS STRING)", expression))


def shape(df: DataFrame, fields: list[Mapping[str, Any]], max_sizes: list[int] | None = None) -> DataFrame:
    """The output columns, grouped, sorted and trimmed.

    A field: name, expression (default ${name}), group (depth, from 0), sort ({order, descending}). With groups, one row
    comes for each combination of the grouped fields; other expressions aggregate, or take a first value. max_sizes[0] is
    the most rows, or with groups the most values of the first group, and max_sizes[1] those of the next depth within one
    of it, and so on; ties are cut in the order of the sort and then of all columns."""
    if not fields:
        return df
    max_sizes = max_sizes or []
    expressions = {f["name"]: _column(f.get("expression") or f"${{{f['name']}}}", df.columns) for f in fields}
    groups = [f["name"] for f in sorted((f for f in fields if f.get("group") is not None), key=lambda f: f["group"])]
    if groups:
        given = {f["name"]: f.get("expression") or f"${{{f['name']}}}" for f in fields}
        keys = df.withColumns({f"key {i}": expressions[g] for i, g in enumerate(groups)})
        others = [expressions[n].alias(n) if AGGREGATE.search(e) else F.first(expressions[n], ignorenulls=True).alias(n) for n, e in given.items() if n not in groups]
        at = [f"key {i}" for i in range(len(groups))]
        out = (keys.groupBy(*at).agg(*others) if others else keys.select(*at).distinct()).withColumnsRenamed(dict(zip(at, groups, strict=True)))
        out = out.select(*expressions)
    else:
        out = df.select(*(e.alias(n) for n, e in expressions.items()))
    sorts = [F.col(f"`{f['name']}`").desc_nulls_last() if f["sort"].get("descending") else F.col(f"`{f['name']}`").asc_nulls_last() for f in sorted((f for f in fields if f.get("sort")), key=lambda f: f["sort"].get("order", 0))]
    rest = [F.col(f"`{n}`").asc_nulls_last() for n in expressions]
    if not groups:
        out = out.orderBy(*sorts, *rest) if sorts else out
        return out.limit(max_sizes[0]) if max_sizes else out
    for depth, most in enumerate(max_sizes[: len(groups)]):
        if depth == len(groups) - 1:
            if depth == 0:
                return out.orderBy(*(sorts or rest), *rest).limit(most)
            window = Window.partitionBy(*(f"`{g}`" for g in groups[:depth])).orderBy(*sorts, *rest)
            out = out.withColumn("place in group", F.row_number().over(window)).where(F.col("`place in group`") <= most).drop("place in group")
        else:
            key = [F.col(f"`{g}`") for g in groups[: depth + 1]]
            heads = out.select(*key).distinct()
            order = [F.col(f"`{groups[depth]}`").asc_nulls_last()]
            if depth == 0:
                heads = heads.orderBy(*order).limit(most)
            else:
                heads = heads.withColumn("n", F.row_number().over(Window.partitionBy(*key[:-1]).orderBy(*order))).where(F.col("n") <= most).drop("n")
            out = _semi(out, heads, groups[: depth + 1])
    return out.orderBy(*(sorts or rest), *rest)


def _semi(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    renamed = right.toDF(*(f"{n} of heads" for n in names))
    on = [F.col(f"`{n}`").eqNullSafe(F.col(f"`{n} of heads`")) for n in names]
    return left.join(renamed, on, "left_semi")


def sizes(text: str | None) -> list[int]:
    """'1000000,100,10,1' as numbers; none where that is not what it is."""
    try:
        return [int(x) for x in text.split(",")] if text else []
    except ValueError:
        return []


def search(partials: DataFrame, registry: Registry, request: Mapping[str, Any], now_ms: int, retention: dict[str, int] = intervals.RETENTION, max_points: int = intervals.MAX_POINTS) -> DataFrame:
    """Answers {source_uuid, expression, fields, time_zone, params, max_sizes, raw_points}; a statistic that is not there
    raises UnknownStatistic, a request that means nothing UnsupportedRequest, and no data give no rows."""
    config: StatConfig = registry.get(request["source_uuid"])
    fields = list(request.get("fields") or [])
    wanted = referred(fields) if fields else list(config.all_fields())
    criteria = resolve(config, request.get("expression"), wanted, now_ms, request.get("time_zone") or "UTC", request.get("params"))
    found = points(partials, criteria, now_ms, retention, max_points, bool(request.get("raw_points")))
    most = request.get("max_sizes")
    return shape(found, fields, sizes(most) if isinstance(most, str) else most)


def require(config: StatConfig) -> StatConfig:
    """For callers that answer only for statistics in good order."""
    if config.problems():
        raise UnsupportedRequest("; ".join(config.problems()))
    return config
