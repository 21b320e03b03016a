"""Validation of events against their configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import Registry
from ..sources.events import VALIDATION


def validate(events: DataFrame, registry: Registry, check_enabled: bool = False) -> DataFrame:
    """Events with their configuration's columns (stat_name, kind, rollup, precision, enabled, fields, masks), and an
    error code and message where something is wrong. The first fault counts; errors that events came with stay."""
    config = registry.frame(events.sparkSession)
    found = events.join(F.broadcast(config), "stat_uuid", "left")
    unknown = F.array_except(F.transform(F.coalesce("tags", F.array()), lambda t: t["name"]), F.coalesce("fields", F.array()))
    fault = (
        F.when(F.col("error_code").isNotNull(), F.col("error_message"))
        .when(F.col("stat_uuid").isNull(), "the event has no key")
        .when(F.col("kind").isNull(), F.concat(F.lit("no configuration for "), F.col("stat_uuid")))
        .when(F.lit(check_enabled) & ~F.col("enabled"), "the statistic is not enabled")
        .when(F.col("time_ms").isNull(), "the event has no time")
        .when((F.col("kind") == "COUNT") & F.col("count").isNull(), "a COUNT event needs a count")
        .when((F.col("kind") == "VALUE") & F.col("value").isNull(), "a VALUE event needs a value")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown tags: "), F.array_join(unknown, ",")))
    )
    out = found.withColumn("error_message", fault)
    return out.withColumn("error_code", F.when(F.col("error_message").isNotNull(), F.coalesce("error_code", F.lit(VALIDATION))))


def good(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("error_code").isNull())


def bad(validated: DataFrame) -> DataFrame:
    """(stat_uuid, error_code, error_message, raw): raw is the message with the error in a comment, as far as there is one."""
    note = F.concat(F.coalesce("raw", F.lit("")), F.lit("<!-- "), F.col("error_code"), F.lit(" - "), F.col("error_message"), F.lit(" -->"))
    return validated.where(F.col("error_code").isNotNull()).select("stat_uuid", "error_code", "error_message", note.alias("raw"))
