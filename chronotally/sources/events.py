"""Statistic events from tables, JSON and XML messages, in one shape.

An event has: stat_uuid STRING, time_ms BIGINT, count BIGINT, value DOUBLE, tags ARRAY<STRUCT<name,value>>, ids
ARRAY<STRING>, raw STRING (its message, for a bad event's record), error_code and error_message STRING (null if good).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import time_ms

UNMARSHALLING, VALIDATION = "UNMARSHALLING_ERROR", "VALIDATION_ERROR"
TAGS = "array<struct<name:string,value:string>>"
#: A batch of events as an XML message.
XML_SCHEMA = (
    "statistic ARRAY<STRUCT<time STRING, count BIGINT, value DOUBLE, tags STRUCT<tag ARRAY<STRUCT<_name STRING, _value STRING>>>, "
    "identifiers STRUCT<compoundIdentifier ARRAY<STRUCT<longIdentifier ARRAY<STRUCT<_VALUE BIGINT, _name STRING>>, stringIdentifier ARRAY<STRUCT<_VALUE STRING, _name STRING>>>>>>>, "
    "_corrupt_record STRING"
)


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def from_table(df: DataFrame, uuid: str, time: str | Column, tags: Mapping[str, str | Column], count: Column | None = None, value: Column | None = None, ids: Column | None = None) -> DataFrame:
    """Each row of any table as one event; time is a timestamp column, with or without a zone (UTC then)."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    listed = F.array(*(F.struct(F.lit(k).alias("name"), col(c).cast("string").alias("value")) for k, c in tags.items())).cast(TAGS)
    return df.select(
        F.lit(uuid).alias("stat_uuid"),
        F.unix_millis(col(time).cast("timestamp")).alias("time_ms"),
        (_null("long") if count is None else count.cast("long")).alias("count"),
        (_null("double") if value is None else value.cast("double")).alias("value"),
        listed.alias("tags"),
        (_null("array<string>") if ids is None else F.array(ids.cast("string"))).alias("ids"),
        _null("string").alias("raw"),
        _null("string").alias("error_code"),
        _null("string").alias("error_message"),
    )


def from_xml(messages: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Messages (statistic uuid, XML text) as events, one for each statistic element.

    A message that is not well formed, has a field of the wrong type or no statistic element becomes one bad event."""
    parsed = messages.select(F.col(key).alias("stat_uuid"), F.col(value).alias("raw"), F.from_xml(F.col(value), XML_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("m"))
    bad = F.col("m").isNull() | F.col("m._corrupt_record").isNotNull() | F.col("m.statistic").isNull()
    one = F.explode(F.when(bad, F.array(F.lit(None).cast(f"struct<{XML_SCHEMA.split('STRUCT<', 1)[1].rsplit('>,', 1)[0]}"))).otherwise(F.col("m.statistic"))).alias("s")
    each = parsed.select("stat_uuid", "raw", bad.alias("bad"), one)
    ids = F.transform(F.col("s.identifiers.compoundIdentifier"), lambda c: F.array_join(F.concat(F.transform(F.coalesce(c["longIdentifier"], F.array()), lambda x: x["_VALUE"].cast("string")), F.transform(F.coalesce(c["stringIdentifier"], F.array()), lambda x: x["_VALUE"])), ":"))
    tags = F.transform(F.coalesce(F.col("s.tags.tag"), F.array()), lambda t: F.struct(t["_name"].alias("name"), t["_value"].alias("value")))
    return each.select(
        "stat_uuid",
        time_ms(F.col("s.time")).alias("time_ms"),
        F.col("s.count").alias("count"),
        F.col("s.value").alias("value"),
        tags.cast(TAGS).alias("tags"),
        ids.alias("ids"),
        "raw",
        F.when(F.col("bad"), UNMARSHALLING).alias("error_code"),
        F.when(F.col("bad"), "the message is not a batch of statistics").alias("error_message"),
    )


def from_json(messages: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Messages (statistic uuid, JSON object or array of objects {time, count, value, tags: {name: value}, ids: [..]})."""
    one = "struct<time:string,count:bigint,value:double,tags:map<string,string>,ids:array<string>>"
    text = F.when(F.trim(value).startswith("["), F.col(value)).otherwise(F.concat(F.lit("["), F.col(value), F.lit("]")))
    parsed = messages.select(F.col(key).alias("stat_uuid"), F.col(value).alias("raw"), F.from_json(text, f"array<{one}>").alias("m"))
    bad = F.col("m").isNull() | F.exists("m", lambda x: x["time"].isNull() & x["count"].isNull() & x["value"].isNull())
    each = parsed.select("stat_uuid", "raw", bad.alias("bad"), F.explode(F.when(bad, F.array(F.lit(None).cast(one))).otherwise(F.col("m"))).alias("s"))
    tags = F.transform(F.map_entries(F.coalesce(F.col("s.tags"), F.create_map().cast("map<string,string>"))), lambda t: F.struct(t["key"].alias("name"), t["value"].alias("value")))
    return each.select(
        "stat_uuid",
        time_ms(F.col("s.time")).alias("time_ms"),
        F.col("s.count").alias("count"),
        F.col("s.value").alias("value"),
        tags.cast(TAGS).alias("tags"),
        F.col("s.ids").alias("ids"),
        "raw",
        F.when(F.col("bad"), UNMARSHALLING).alias("error_code"),
        F.when(F.col("bad"), "the message is not an event").alias("error_message"),
    )


def to_xml(events: DataFrame) -> DataFrame:
    """(key, value): each event as a message of one statistic element."""
    tag = F.transform("tags", lambda t: F.struct(t["name"].alias("_name"), t["value"].alias("_value")))
    from ..functions.text import time_text

    one = F.struct(time_text(F.col("time_ms")).alias("time"), F.col("count"), F.col("value"), F.struct(tag.alias("tag")).alias("tags"))
    return events.select(F.col("stat_uuid").alias("key"), F.to_xml(F.struct(F.array(one).alias("statistic")), {"rowTag": "statistics"}).alias("value"))


def read_stream(spark: SparkSession, path: str, schema: str, form: str = "parquet", **options: str) -> DataFrame:
    """A stream of files; for a message broker name its format and options (kafka, subscribe=..) and cast key and value."""
    reader = spark.readStream.format(form).options(**options)
    return reader.load() if form == "kafka" else reader.schema(schema).load(path)
