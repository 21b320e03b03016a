"""The contract's queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import intervals, masks
from .functions.text import id_text, tags_text
from .operators import rollup, search, store, validate
from .operators.correlate import Correlator
from .plans import model
from .plans.model import Registry, StatConfig
from .plans.request import term, tree
from .sources import events as ev
from .streaming import ingest

#: 2024-01-31T00:00Z, which is now wherever now matters.
NOW = 1_706_659_200_000
DAY = 86_400_000
TAGS = ("event_type", "user")
VALUE = StatConfig("events-value", "Event values", "VALUE", "ALL", "SECOND", TAGS, enabled=True)
COUNT = StatConfig("events-count", "Event counts", "COUNT", "NONE", "MINUTE", TAGS, enabled=True)
DAILY = StatConfig("events-daily", "Daily event counts", "COUNT", "ALL", "DAY", TAGS, enabled=True)
QUANTITY = StatConfig("lineitem-quantity", "Quantities", "VALUE", "CUSTOM", "DAY", ("returnflag", "linestatus"), (0, 1, 3), enabled=True)
ORDERS = StatConfig("orders-price", "Order prices", "VALUE", "ALL", "DAY", ("status", "priority"), enabled=True)
Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, config: StatConfig = VALUE, null_errors: bool = False) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    kind = F.nullif("event_type", F.lit("error")) if null_errors else F.col("event_type")
    count, value = (F.lit(1), None) if config.kind == "COUNT" else (None, F.col("value"))
    return ev.from_table(rows, config.uuid, "ts", {"event_type": kind, "user": "user_id"}, count, value, F.col("event_id"))


def _partials(events: DataFrame, config: StatConfig) -> DataFrame:
    registry = Registry.of(config)
    return rollup.partials_of(validate.good(validate.validate(events, registry)), registry, NOW)


def _field(name: str, of: str | None = None, **more: object) -> dict:
    return {"name": name, "expression": f"${{{of or name}}}" if not of or "$" not in of else of, **more}


COUNTED = [_field("bucket_ms", model.TIME), _field("n", model.COUNT)]
MEASURED = [*COUNTED, _field("v", f"round(${{{model.VALUE}}}, 9)"), _field("mn", model.MIN), _field("mx", model.MAX)]


def _ask(spark: SparkSession, sf_dir: str, config: StatConfig, expression: dict | None, fields: list[dict], null_errors: bool = False, **more: object) -> DataFrame:
    found = _partials(_events(spark, sf_dir, config, null_errors), config)
    return search.search(found, Registry.of(config), {"source_uuid": config.uuid, "expression": expression, "fields": fields, **more}, NOW)


def _at(*children: dict, precision: str | None = None) -> dict:
    return tree("AND", *children, *([term(model.PRECISION, "EQUALS", precision)] if precision else []))


WEEK = term(model.TIME, "BETWEEN", "2024-01-08T00:00:00.000Z,2024-01-14T23:59:59.999Z")
WEEK_SQL = "(epoch_us(ts) // 1000) >= 1704672000000 AND (epoch_us(ts) // 1000) < 1705276800000"


def _bucket(step: int) -> str:
    return f"((epoch_us(ts) // 1000) // {step}) * {step}"


def _sql(keys: dict[str, str], where: str = "true", table: str = "events", measures: str = "count(*) n, round(sum(value) / count(*), 9) v, min(value) mn, max(value) mx") -> str:
    listed = ", ".join(f"{e} AS {k}" for k, e in keys.items())
    return f"SELECT {listed}, {measures} FROM {table} WHERE {where} GROUP BY {', '.join(map(str, range(1, len(keys) + 1)))}"


def count_minute_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, COUNT, _at(precision="minute"), [*COUNTED, _field("event_type"), _field("user")])


def value_hour_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grain follows from the week (HOUR), and the mask from the tags asked for."""
    kinds = term("event_type", "IN", "click,view")
    return _ask(spark, sf_dir, VALUE, _at(WEEK, kinds), [*MEASURED, _field("event_type")])


def _masked(spark: SparkSession, partials: DataFrame, config: StatConfig, grain: str) -> DataFrame:
    rows = rollup.merge(partials.where((F.col("store") == grain) & (F.col("stat_uuid") == config.uuid)), ["mask", "bucket_ms", *rollup.TAGS[: len(config.fields)]])
    tags = [F.col(rollup.TAGS[i]).alias(f) for i, f in enumerate(config.fields)]
    return rows.select("mask", "bucket_ms", *tags, F.col("cnt").alias("n"), F.round(rollup.mean(), 9).alias("v"), F.col("least").alias("mn"), F.col("most").alias("mx"))


def rollup_all_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, _partials(_events(spark, sf_dir), VALUE), VALUE, "HOUR")


def rollup_all_masks_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cube, built one tag at a time."""
    good = validate.good(validate.validate(_events(spark, sf_dir), Registry.of(VALUE)))
    return _masked(spark, rollup.fan_out_wide(rollup.cascade(rollup.base(good, NOW)), 2), VALUE, "HOUR")


def rollup_custom_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev.from_table(_table(spark, sf_dir, "lineitem"), QUANTITY.uuid, "l_shipdate", {"returnflag": "l_returnflag", "linestatus": "l_linestatus"}, value=F.col("l_quantity"))
    return _masked(spark, _late(rows, QUANTITY), QUANTITY, "DAY")


def _late(events: DataFrame, config: StatConfig) -> DataFrame:
    """Partials of old data, under a now of their own time."""
    registry = Registry.of(config)
    return rollup.partials_of(validate.good(validate.validate(events, registry)), registry, 1_000_000_000_000)


def orders_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev.from_table(_table(spark, sf_dir, "orders"), ORDERS.uuid, "o_orderdate", {"status": "o_orderstatus", "priority": "o_orderpriority"}, value=F.col("o_totalprice"))
    request = {"source_uuid": ORDERS.uuid, "expression": _at(precision="day"), "fields": [*COUNTED, _field("v", f"round(${{{model.VALUE}}}, 5)"), _field("status")]}
    return search.search(_late(rows, ORDERS), Registry.of(ORDERS), request, NOW)


def cascade_day_from_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, VALUE, _at(precision="DAY"), [*MEASURED, _field("event_type")])


def forever_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, VALUE, _at(precision="FOREVER"), MEASURED)


def filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, VALUE, _at(term("event_type", "IN", "click,view"), precision="DAY"), MEASURED)


def filter_and_or_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = tree("OR", term("event_type", "EQUALS", "click"), term("user", "EQUALS", "7"), tree("NOT", term("event_type", "EQUALS", "view")))
    return _ask(spark, sf_dir, VALUE, _at(some, term("user", "IN", "1,2,3,4,5,6,7,8,9"), precision="DAY"), [*MEASURED, _field("event_type"), _field("user")], True)


def filter_null_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, VALUE, _at(term("event_type", "EQUALS", ""), precision="DAY"), MEASURED, True)


def filter_disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = tree("OR", term("user", "EQUALS", "1"), enabled=False)
    return _ask(spark, sf_dir, VALUE, _at(off, term("user", "EQUALS", "2", enabled=False), term("event_type", "EQUALS", "click"), precision="DAY"), MEASURED)


def filter_unknown_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing equals an unknown value, and NOT of that is everything."""
    never = term("event_type", "EQUALS", "nosuch")
    return _ask(spark, sf_dir, VALUE, _at(tree("NOT", never), precision="DAY"), MEASURED)


def filter_rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ask(spark, sf_dir, VALUE, _at(term("user", "EQUALS", masks.ROLLED_UP), precision="DAY"), [*MEASURED, _field("user")])


_DATES = {
    "date_eq": ("EQUALS", "2024-01-15T00:00:00.000Z", "= 1705276800000"),
    "date_between": ("BETWEEN", "2024-01-10T00:00:00.000Z,2024-01-20T00:00:00.000Z", "BETWEEN 1704844800000 AND 1705708800000"),
    "date_lt": ("LESS_THAN", "2024-01-15T00:00:00.000Z", "< 1705276800000"),
    "date_le": ("LESS_THAN_OR_EQUAL_TO", "2024-01-15T00:00:00.000Z", "<= 1705276800000"),
    "date_gt": ("GREATER_THAN", "2024-01-15T00:00:00.000Z", "> 1705276800000"),
    "date_ge": ("GREATER_THAN_OR_EQUAL_TO", "day() - 16d", ">= 1705276800000"),
}


def _dated(condition: str, value: str) -> Query:
    return lambda spark, sf_dir: _ask(spark, sf_dir, DAILY, _at(term(model.TIME, condition, value)), [*COUNTED, _field("event_type"), _field("precision", model.PRECISION)])


_PERIODS = {
    "second": ("2024-01-30T11:00:00.000Z,2024-01-30T11:02:59.999Z", 1_000, "(epoch_us(ts) // 1000) >= 1706612400000 AND (epoch_us(ts) // 1000) < 1706612580000"),
    "minute": ("2024-01-30T09:00:00.000Z,2024-01-30T11:59:59.999Z", 60_000, "(epoch_us(ts) // 1000) >= 1706605200000 AND (epoch_us(ts) // 1000) < 1706616000000"),
    "hour": ("2024-01-08T00:00:00.000Z,2024-01-14T23:59:59.999Z", 3_600_000, WEEK_SQL),
    "day": ("2024-01-01T00:00:00.000Z,2024-01-30T23:59:59.999Z", DAY, "(epoch_us(ts) // 1000) >= 1704067200000 AND (epoch_us(ts) // 1000) < 1706659200000"),
    "forever": (None, 9 * 10**18, "true"),
}


def _automatic(between: str | None) -> Query:
    dated = [term(model.TIME, "BETWEEN", between)] if between else []
    return lambda spark, sf_dir: _ask(spark, sf_dir, VALUE, tree("AND", *dated, term("event_type", "EQUALS", "click")), [*MEASURED, _field("precision", model.PRECISION)])


def late_bump_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = validate.good(validate.validate(_events(spark, sf_dir), Registry.of(VALUE)))
    return rollup.base(good, NOW).groupBy("store").agg(F.sum("cnt").alias("n"))


def retention_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of partials made eight days ago if they are written now."""
    registry = Registry.of(VALUE)
    good = validate.good(validate.validate(_events(spark, sf_dir), registry))
    made = rollup.with_blocks(rollup.cascade(rollup.base(good, NOW - 8 * DAY)).withColumn("mask", F.lit(0)))
    return rollup.kept(made, NOW).groupBy("store").agg(F.sum("cnt").alias("n"))


def _root(spark: SparkSession) -> str:
    return f"{rollup.shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"


def purge_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry, root = Registry.of(VALUE), _root(spark)
    good = validate.good(validate.validate(_events(spark, sf_dir), registry))
    store.write_batch(rollup.fan_out(rollup.cascade(rollup.base(good, NOW - 8 * DAY)), registry), root, 0, len(TAGS))
    store.purge_old(spark, root, NOW)
    return store.read(spark, root).where("mask = 0").groupBy("store").agg(F.sum("cnt").alias("n"))


def partials_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, one of them written twice, merged when they are read."""
    registry, root = Registry.of(VALUE), _root(spark)
    rows = _events(spark, sf_dir).withColumn("part", F.pmod(F.get("ids", F.lit(0)).cast("long"), F.lit(3)))
    for part in (0, 1, 2, 1):
        store.write_batch(_partials(rows.where(F.col("part") == part).drop("part"), VALUE), root, part, len(TAGS))
    request = {"source_uuid": VALUE.uuid, "expression": _at(precision="DAY"), "fields": [*MEASURED, _field("event_type")]}
    return search.search(store.read(spark, root), registry, request, NOW)


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, to = _root(spark), _root(spark)
    rows = _events(spark, sf_dir).withColumn("part", F.pmod(F.get("ids", F.lit(0)).cast("long"), F.lit(2)))
    for part in (0, 1):
        store.write_batch(_partials(rows.where(F.col("part") == part).drop("part"), VALUE), root, part, len(TAGS))
    store.compact(spark, root, to)
    kept = store.read(spark, to)
    return kept.groupBy("store", "mask").agg(F.count("*").alias("cells"), F.sum("cnt").alias("n"))


def compacted_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, the first two merged into one between the last two."""
    registry, root = Registry.of(VALUE), _root(spark)
    rows = _events(spark, sf_dir).withColumn("part", F.pmod(F.get("ids", F.lit(0)).cast("long"), F.lit(4)))
    for part in (0, 1, 2, 3):
        if part == 3:
            store.compact_in_place(spark, root)
        store.write_batch(_partials(rows.where(F.col("part") == part).drop("part"), VALUE), root, part, len(TAGS))
    request = {"source_uuid": VALUE.uuid, "expression": _at(precision="HOUR"), "fields": [*MEASURED, _field("event_type")]}
    return search.search(store.read(spark, root), registry, request, NOW)


def stored_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week of two tag values from the stored files: one grain, one mask and two blocks of them are read."""
    root = _root(spark)
    store.write_batch(_partials(_events(spark, sf_dir), VALUE), root, 0, len(TAGS))
    request = {"source_uuid": VALUE.uuid, "expression": _at(WEEK, term("event_type", "IN", "click,view"), term("user", "IN", "1,2,3,4,5,6,7,8,9")), "fields": [*MEASURED, _field("event_type"), _field("user")]}
    return search.search(store.read(spark, root), Registry.of(VALUE), request, NOW)


def streamed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream of files, run to its end into a store that is asked then; events of user 7, made bad, are set aside."""
    root, registry = _root(spark), Registry.of(VALUE)
    # a stream of files takes folders and patterns, and the table may be one file
    messages = ev.read_stream(spark, f"{sf_dir}/events*.parquet", _table(spark, sf_dir, "events").schema.simpleString()[7:-1].replace(":", " "))
    decode = lambda df: ev.from_table(df, VALUE.uuid, "ts", {"event_type": F.col("event_type"), "user": "user_id"}, value=F.when(F.col("user_id") != 7, F.col("value")))
    ingest.start(messages, decode, registry, root, f"{root}-bad", f"{root}-offsets", lambda: NOW, available_now=True).awaitTermination()
    bad = spark.read.parquet(f"{root}-bad").select(F.lit(None).cast("long").alias("bucket_ms"), F.lit("bad").alias("event_type"))
    request = {"source_uuid": VALUE.uuid, "expression": _at(precision="HOUR"), "fields": [_field("bucket_ms", model.TIME), _field("event_type"), _field("n", model.COUNT)]}
    return search.search(store.read(spark, root), registry, request, NOW).unionByName(bad.groupBy("bucket_ms", "event_type").agg(F.count("*").alias("n")))


def reduction_by_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how many percent hourly partials are fewer than their events, under each mask."""
    rows = _partials(_events(spark, sf_dir), VALUE).where("store = 'HOUR'")
    return rows.groupBy("mask").agg(F.round(rollup.reduction_percent(F.sum("cnt"), F.count("*")), 6).alias("percent"))


def tag_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, null_errors=True).groupBy(tags_text(F.col("tags")).alias("tags")).agg(F.count("*").alias("n"))


def purge_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two statistics are stored and all data of one are dropped."""
    root, both = _root(spark), Registry.of(VALUE, COUNT)
    rows = _events(spark, sf_dir).unionByName(_events(spark, sf_dir, COUNT))
    store.write_batch(rollup.partials_of(validate.good(validate.validate(rows, both)), both, NOW), root, 0, len(TAGS))
    store.purge_all(spark, root, [VALUE.uuid])
    return store.read(spark, root).where("mask = 0").groupBy("stat_uuid", "store").agg(F.sum("cnt").alias("n"))


def filter_single_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches of one child mean their child, and a NOT of a NOT nothing."""
    one = tree("OR", tree("AND", tree("OR", term("event_type", "EQUALS", "click"))))
    return _ask(spark, sf_dir, VALUE, _at(tree("NOT", tree("NOT", one)), tree("AND", term("user", "IN", "1,2,3")), precision="DAY"), [*MEASURED, _field("user")])


def date_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates counted from now by several steps."""
    dated = term(model.TIME, "BETWEEN", "month() + 1w - 12h,day() - 1w")
    return _ask(spark, sf_dir, VALUE, _at(dated, precision="HOUR"), MEASURED)


def configured_by_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statistic whose fields and one custom mask are declared in XML."""
    fields = "".join(f"<field><fieldName>{f}</fieldName></field>" for f in TAGS)
    xml = f"<data>{fields}<customRollUpMask><rolledUpTagPosition>1</rolledUpTagPosition></customRollUpMask></data>"
    config = model.config_from_xml(xml, "events-xml", "Events by XML", kind="VALUE", precision="HOUR", enabled=True)
    return _masked(spark, _partials(_events(spark, sf_dir, config), config), config, "HOUR")


def validate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.pmod(F.get("ids", F.lit(0)).cast("long"), F.lit(10))
    rows = _events(spark, sf_dir).withColumn("part", part)
    wrong = F.array(F.struct(F.lit("colour").alias("name"), F.lit("red").alias("value"))).cast(ev.TAGS)
    rows = rows.withColumns({
        "time_ms": F.when(F.col("part") != 0, F.col("time_ms")),
        "tags": F.when(F.col("part") == 1, wrong).otherwise(F.col("tags")),
        "value": F.when(F.col("part") != 2, F.col("value")),
        "stat_uuid": F.when(F.col("part") == 3, F.lit("nosuch")).when(F.col("part") != 4, F.col("stat_uuid")),
    })
    checked = validate.validate(rows, Registry.of(VALUE))
    return checked.groupBy("error_code", "error_message").agg(F.count("*").alias("n"))


def xml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = ev.from_xml(ev.to_xml(_events(spark, sf_dir)))
    return validate.good(validate.validate(back, Registry.of(VALUE))).groupBy(rollup.tag_at(0).alias("event_type")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.sum("time_ms").alias("times"))


def json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    made = F.to_json(F.struct(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"), "value", F.create_map(F.lit("event_type"), "event_type", F.lit("user"), F.col("user_id").cast("string")).alias("tags")))
    back = ev.from_json(rows.select(F.lit(VALUE.uuid).alias("key"), made.alias("value")))
    return search.search(_partials(back, VALUE), Registry.of(VALUE), {"source_uuid": VALUE.uuid, "expression": _at(precision="DAY"), "fields": MEASURED}, NOW)


def event_ids_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = validate.good(validate.validate(_events(spark, sf_dir), Registry.of(VALUE)))
    return rollup.event_ids(good, intervals.interval("DAY"), 5, "cast(id as bigint)").select("bucket_ms", id_text(F.col("ids")).alias("ids"))


def _correlator(spark: SparkSession, sf_dir: str) -> Correlator:
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), "event_type", F.col("ts").cast("date").alias("day"))
    of = lambda day: rows.where(F.col("day") == F.lit(day).cast("date")).drop("day")
    return Correlator().add("today", of("2024-01-11")).add("yesterday", of("2024-01-10"))


def corr_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _correlator(spark, sf_dir).complement("today")


def corr_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _correlator(spark, sf_dir).intersection()


def tag_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.tag_values(_partials(_events(spark, sf_dir), VALUE), VALUE, "user")


def tag_values_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.tag_values(_partials(_events(spark, sf_dir), VALUE), VALUE, "event_type", "i")


def describe_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.describe(spark, VALUE)


def stat_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _partials(_events(spark, sf_dir, COUNT), COUNT)
    rows = [(c.uuid, store.exists(found, c)) for c in (COUNT, DAILY)]
    return spark.createDataFrame(rows, "stat_uuid string, there boolean")


def finest_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(c.uuid, store.finest_store(_partials(_events(spark, sf_dir, c), c), c).name) for c in (COUNT, DAILY)]
    return spark.createDataFrame(found, "stat_uuid string, store string")


def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.counts(_partials(_events(spark, sf_dir, COUNT), COUNT), Registry.of(COUNT))


def result_group_sort_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten users with most clicks and views, with an expression over the result's fields."""
    fields = [_field("user", group=0), _field("n", f"sum(${{{model.COUNT}}})", sort={"order": 0, "descending": True}), _field("days", f"count(DISTINCT ${{{model.TIME}}})")]
    return _ask(spark, sf_dir, VALUE, _at(term("event_type", "IN", "${kinds}"), precision="DAY"), fields, params={"kinds": "click,view"}, max_sizes="10")


def result_nested_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event type the three users with most events."""
    fields = [_field("event_type", group=0), _field("user", group=1), _field("n", f"sum(${{{model.COUNT}}})", sort={"order": 0, "descending": True})]
    return _ask(spark, sf_dir, VALUE, _at(precision="DAY"), fields, max_sizes=[100, 3])


def mask_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = spark.createDataFrame([(m, masks.positions(m)) for m in masks.all_masks(4)], "mask int, positions array<int>")
    return every.select("mask", masks.text(F.col("mask")).alias("digits"), masks.hex_text(F.col("mask")).alias("hex"), F.size("positions").alias("n"))


def time_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    i = intervals.interval("MINUTE")
    cut = _table(spark, sf_dir, "events").select("event_id", intervals.bucket(ms, i).alias("bucket_ms"), intervals.row_bucket(ms, i).alias("block"), intervals.column_index(ms, i).alias("place"))
    return cut.withColumn("again", intervals.full_time(F.col("block"), F.col("place"), i))


_CUBE = """SELECT CAST(m.mask AS INTEGER) mask, ((epoch_us(ts) // 1000) // 3600000) * 3600000 bucket_ms,
 CASE WHEN mask & 1 <> 0 THEN '<<<<ROLLED_UP>>>>' ELSE event_type END event_type, CASE WHEN mask & 2 <> 0 THEN '<<<<ROLLED_UP>>>>' ELSE CAST(user_id AS VARCHAR) END "user",
 count(*) n, round(sum(value) / count(*), 9) v, min(value) mn, max(value) mx FROM events, (SELECT unnest(range(4)) mask) m GROUP BY 1, 2, 3, 4"""
_TYPE, _USER, _DAYS = {"event_type": "event_type"}, {'"user"': "user_id::VARCHAR"}, {"bucket_ms": _bucket(DAY)}
_NULLED = "(SELECT * REPLACE (nullif(event_type, 'error') AS event_type) FROM events)"
_KEPT = "SELECT 'SECOND' AS store, count(*) AS n FROM events WHERE (epoch_us(ts) // 1000) >= 1706486400000 UNION ALL SELECT s, count(*) FROM events, (SELECT unnest(['MINUTE', 'HOUR', 'DAY', 'FOREVER']) s) GROUP BY 1"
_DAY_SETS = "a AS (SELECT DISTINCT user_id::VARCHAR \"user\", event_type FROM events WHERE ts::DATE = '2024-01-11'), b AS (SELECT DISTINCT user_id::VARCHAR \"user\", event_type FROM events WHERE ts::DATE = '2024-01-10')"
_SQL: dict[str, str] = {
    "count_minute_none": _sql({"bucket_ms": _bucket(60_000), **_TYPE, **_USER}, measures="count(*) n"),
    "value_hour_by_type": _sql({"bucket_ms": _bucket(3_600_000), **_TYPE}, f"event_type IN ('click', 'view') AND {WEEK_SQL}"),
    "rollup_all_masks": _CUBE,
    "rollup_all_masks_wide": _CUBE,
    "rollup_custom_masks": """SELECT CAST(m.mask AS INTEGER) mask, (epoch_ms(l_shipdate) // 86400000) * 86400000 bucket_ms,
 CASE WHEN mask & 1 <> 0 THEN '<<<<ROLLED_UP>>>>' ELSE l_linestatus END linestatus, CASE WHEN mask & 2 <> 0 THEN '<<<<ROLLED_UP>>>>' ELSE l_returnflag END returnflag,
 count(*) n, round(sum(l_quantity) / count(*), 9) v, min(l_quantity) mn, max(l_quantity) mx FROM lineitem, (SELECT unnest([0, 1, 3]) mask) m GROUP BY 1, 2, 3, 4""",
    "orders_by_status": "SELECT (epoch_ms(o_orderdate) // 86400000) * 86400000 bucket_ms, o_orderstatus status, count(*) n, round(sum(o_totalprice) / count(*), 5) v FROM orders GROUP BY 1, 2",
    "cascade_day_from_hour": _sql({**_DAYS, **_TYPE}),
    "forever_totals": _sql({"bucket_ms": "0::BIGINT"}),
    "filter_in": _sql(_DAYS, "event_type IN ('click', 'view')"),
    "filter_and_or_not": _sql({**_DAYS, **_TYPE, **_USER}, "user_id BETWEEN 1 AND 9 AND (coalesce(event_type = 'click', false) OR user_id = 7 OR NOT coalesce(event_type = 'view', false))", _NULLED),
    "filter_null_tag": _sql(_DAYS, "event_type IS NULL", _NULLED),
    "filter_disabled": _sql(_DAYS, "event_type = 'click'"),
    "filter_unknown_value": _sql(_DAYS),
    "filter_rolled_up": _sql({**_DAYS, '"user"': "'<<<<ROLLED_UP>>>>'"}),
    **{k: _sql({**_DAYS, **_TYPE, "precision": "'DAY'"}, f"{_bucket(DAY)} {sql}", measures="count(*) n") for k, (_, _, sql) in _DATES.items()},
    **{f"auto_precision_{k}": _sql({"bucket_ms": _bucket(step) if k != "forever" else "0::BIGINT", "precision": f"'{k.upper()}'"}, f"event_type = 'click' AND {where}") for k, (_, step, where) in _PERIODS.items()},
    "late_bump_store": "SELECT CASE WHEN (epoch_us(ts) // 1000) >= 1706486400000 THEN 'SECOND' ELSE 'MINUTE' END AS store, count(*) AS n FROM events GROUP BY 1",
    "retention_filter": _KEPT,
    "purge_old": _KEPT,
    "partials_merge": _sql({**_DAYS, **_TYPE}),
    "compacted_in_place": _sql({"bucket_ms": _bucket(3_600_000), **_TYPE}),
    "stored_scan": _sql({"bucket_ms": _bucket(3_600_000), **_TYPE, **_USER}, f"event_type IN ('click', 'view') AND user_id BETWEEN 1 AND 9 AND {WEEK_SQL}"),
    "streamed_ingest": f"SELECT {_bucket(3_600_000)} bucket_ms, event_type, count(*) n FROM events WHERE user_id <> 7 GROUP BY 1, 2 UNION ALL SELECT NULL::BIGINT, 'bad', count(*) FROM events WHERE user_id = 7 HAVING count(*) > 0",
    "reduction_by_mask": f"SELECT mask, round(100 - count(*) / sum(n) * 100, 6) AS \"percent\" FROM ({_CUBE}) GROUP BY 1",
    "tag_texts": f"SELECT 'event_type|' || coalesce(event_type, '') || ',user|' || user_id AS tags, count(*) n FROM {_NULLED} GROUP BY 1",
    "purge_one": "SELECT 'events-count' AS stat_uuid, s AS store, count(*) n FROM events, (SELECT unnest(['MINUTE', 'HOUR', 'DAY', 'FOREVER']) s) GROUP BY 2",
    "filter_single_children": _sql({**_DAYS, **_USER}, "event_type = 'click' AND user_id BETWEEN 1 AND 3"),
    "date_steps": _sql({"bucket_ms": _bucket(3_600_000)}, f"{_bucket(3_600_000)} BETWEEN 1704628800000 AND 1706054400000"),
    "configured_by_xml": f"SELECT * FROM ({_CUBE}) WHERE mask IN (0, 2)",
    "compacted": """WITH e AS (SELECT (epoch_us(ts) // 1000) t, event_type a, user_id b FROM events),
 s AS (SELECT * FROM (VALUES ('SECOND', 1000), ('MINUTE', 60000), ('HOUR', 3600000), ('DAY', 86400000), ('FOREVER', 9000000000000000000)) v(store, step)), m AS (SELECT unnest(range(4)) mask),
 k AS (SELECT store, mask::INTEGER mask, t // step, CASE WHEN mask & 1 <> 0 THEN '*' ELSE a END, CASE WHEN mask & 2 <> 0 THEN '*' ELSE b::VARCHAR END, count(*) c FROM e, s, m WHERE store <> 'SECOND' OR t >= 1706486400000 GROUP BY ALL)
 SELECT store, mask, count(*) cells, sum(c)::BIGINT n FROM k GROUP BY ALL""",
    "validate_split": """SELECT CASE WHEN p < 5 THEN 'VALIDATION_ERROR' END error_code, CASE p WHEN 0 THEN 'the event has no time' WHEN 1 THEN 'unknown tags: colour' WHEN 2 THEN 'a VALUE event needs a value'
 WHEN 3 THEN 'no configuration for nosuch' WHEN 4 THEN 'the event has no key' END error_message, count(*) n FROM (SELECT event_id % 10 p FROM events) GROUP BY 1, 2""",
    "xml_roundtrip": "SELECT event_type, count(*) n, round(sum(value), 4) total, sum((epoch_us(ts) // 1000))::BIGINT times FROM events GROUP BY 1",
    "json_events": _sql(_DAYS),
    "event_ids_capped": """SELECT bucket_ms, string_agg(event_id::VARCHAR, ':' ORDER BY event_id) ids FROM (SELECT ((epoch_us(ts) // 1000) // 86400000) * 86400000 bucket_ms, event_id,
 row_number() OVER (PARTITION BY (epoch_us(ts) // 1000) // 86400000 ORDER BY event_id) r FROM events) WHERE r <= 5 GROUP BY 1""",
    "corr_complement": f"WITH {_DAY_SETS} SELECT * FROM b EXCEPT SELECT * FROM a",
    "corr_intersect": f"WITH {_DAY_SETS} SELECT * FROM b INTERSECT SELECT * FROM a",
    "tag_values": "SELECT DISTINCT user_id::VARCHAR AS value FROM events",
    "tag_values_partial": "SELECT DISTINCT event_type AS value FROM events WHERE contains(event_type, 'i')",
    "describe_source": """SELECT * FROM (VALUES ('Statistic Name', 'TEXT', false, ''), ('Statistic UUID', 'TEXT', false, ''),
 ('Date Time', 'DATE', true, 'BETWEEN,EQUALS,GREATER_THAN,GREATER_THAN_OR_EQUAL_TO,LESS_THAN,LESS_THAN_OR_EQUAL_TO'), ('Statistic Count', 'NUMBER', false, ''), ('Statistic Value', 'NUMBER', false, ''),
 ('Min Statistic Value', 'NUMBER', false, ''), ('Max Statistic Value', 'NUMBER', false, ''), ('Precision', 'TEXT', true, 'EQUALS'), ('Precision ms', 'NUMBER', false, ''),
 ('event_type', 'TEXT', true, 'EQUALS,IN'), ('user', 'TEXT', true, 'EQUALS,IN')) v(name, type, queryable, conditions)""",
    "stat_exists": "SELECT 'events-count' AS stat_uuid, count(*) > 0 AS there FROM events UNION ALL SELECT 'events-daily', false",
    "finest_store": "SELECT * FROM (VALUES ('events-count', 'MINUTE'), ('events-daily', 'DAY')) v(stat_uuid, store)",
    "store_counts": """SELECT store, 'COUNT' kind, count(*) cells FROM (SELECT DISTINCT store, (epoch_us(ts) // 1000) // step, event_type, user_id FROM events,
 (VALUES ('MINUTE', 60000), ('HOUR', 3600000), ('DAY', 86400000), ('FOREVER', 9000000000000000000)) v(store, step)) GROUP BY 1""",
    "result_group_sort_trim": "SELECT user_id::VARCHAR \"user\", count(*) n, count(DISTINCT ts::DATE) AS \"days\" FROM events WHERE event_type IN ('click', 'view') GROUP BY 1 ORDER BY n DESC, \"user\" LIMIT 10",
    "result_nested_groups": """SELECT event_type, "user", n FROM (SELECT event_type, user_id::VARCHAR "user", count(*) n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id::VARCHAR) r FROM events GROUP BY 1, 2) WHERE r <= 3""",
    "mask_functions": "SELECT m::INTEGER mask, lpad(bin(m), 15, '0') digits, lpad(hex(m), 4, '0') hex, bit_count(m)::INTEGER n FROM (SELECT unnest(range(16)) m)",
    "time_functions": "SELECT event_id, ((epoch_us(ts) // 1000) // 60000) * 60000 bucket_ms, (epoch_us(ts) // 1000) // 86400000 block, ((epoch_us(ts) // 1000) % 86400000) // 60000 place, ((epoch_us(ts) // 1000) // 60000) * 60000 AS again FROM events",
}
_PLAIN = (
    value_hour_by_type, count_minute_none, rollup_all_masks, rollup_all_masks_wide, rollup_custom_masks, orders_by_status, cascade_day_from_hour, forever_totals, filter_in, filter_and_or_not, filter_null_tag,
    filter_disabled, filter_unknown_value, filter_rolled_up, late_bump_store, retention_filter, purge_old, partials_merge, compacted, compacted_in_place, stored_scan, streamed_ingest, reduction_by_mask, tag_texts, purge_one, filter_single_children,
    date_steps, configured_by_xml, validate_split, xml_roundtrip, json_events, event_ids_capped, corr_complement,
    corr_intersect, tag_values, tag_values_partial, describe_source, stat_exists, finest_store, store_counts, result_group_sort_trim, result_nested_groups, mask_functions, time_functions,
)


def queries() -> dict[str, Query]:
    dates = {k: _dated(c, v) for k, (c, v, _) in _DATES.items()}
    return {f.__name__: f for f in _PLAIN} | dates | {f"auto_precision_{k}": _automatic(b) for k, (b, _, _) in _PERIODS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
