"""Events to answers: decoding, validation, roll-ups, store, search, streams and set algebra."""

from __future__ import annotations

import shutil
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronotally.engine import Engine
from chronotally.functions.masks import ROLLED_UP
from chronotally.operators import rollup, store, validate
from chronotally.operators.correlate import Correlator
from chronotally.operators.search import require, sizes
from chronotally.plans.model import Registry, StatConfig, UnknownStatistic, UnsupportedRequest
from chronotally.plans.request import term, tree
from chronotally.sources import events as ev
from chronotally.streaming import ingest

START = datetime(2024, 1, 30, tzinfo=UTC)
NOW = int(START.timestamp() * 1000) + 3_600_000
TAGS = ("user", "colour", "state")
COUNT = StatConfig("c", "counts", "COUNT", "ALL", "SECOND", TAGS, enabled=True)
VALUE = StatConfig("v", "values", "VALUE", "ALL", "SECOND", TAGS, enabled=True)
BOTH = Registry.of(COUNT, VALUE)
MESSAGE = """<statistics xmlns="statistics:4">
 <statistic><time>2024-01-30T00:00:01.000Z</time><count>2</count><tags><tag name="user" value="u1"/><tag name="state" value="IN"/></tags>
  <identifiers><compoundIdentifier><longIdentifier name="a">1</longIdentifier><stringIdentifier name="b">x</stringIdentifier></compoundIdentifier></identifiers></statistic>
 <statistic><time>2024-01-30T00:00:02.000Z</time><count>3</count></statistic></statistics>"""


def sample(spark, uuid="c", steps=1000):
    """12 events each 250 ms: two users, three colours, two states."""
    each = spark.range(steps).select((F.lit(NOW - 3_600_000) + F.col("id") * 250).alias("ms"))
    for name, values in (("user", ["user1", "user2"]), ("colour", ["Red", "Green", "Blue"]), ("state", ["IN", "OUT"])):
        each = each.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    value = F.when(F.col("colour") == "Red", 10.1).when(F.col("colour") == "Green", 20.2).otherwise(69.7)
    return ev.from_table(each.withColumn("ts", F.timestamp_millis("ms")), uuid, "ts", {t: t for t in TAGS}, F.lit(1) if uuid == "c" else None, value if uuid == "v" else None)


def valid(events, registry=BOTH):
    return validate.good(validate.validate(events, registry))


def test_volume_is_conserved_in_every_store_and_mask(spark):
    got = rollup.partials_of(valid(sample(spark).unionByName(sample(spark, "v"))), BOTH, NOW).cache()
    rows = {(r["store"], r["stat_uuid"], r["mask"]): r for r in got.groupBy("store", "stat_uuid", "mask").agg(F.count("*").alias("cells"), F.sum("cnt").alias("n"), F.sum("total").alias("t")).collect()}
    buckets = {"SECOND": 250, "MINUTE": 5, "HOUR": 1, "DAY": 1, "FOREVER": 1}
    assert len(rows) == 5 * 2 * 8 and all(r["n"] == 12_000 for r in rows.values())
    assert all(rows[s, "c", 0]["cells"] == 12 * n and rows[s, "c", 7]["cells"] == n for s, n in buckets.items())
    assert all(abs(r["t"] - 4000 * 100.0) < 1e-3 for k, r in rows.items() if k[1] == "v")
    wide = rollup.fan_out_wide(rollup.cascade(rollup.base(valid(sample(spark)), NOW)), 3)
    narrow = got.where("stat_uuid = 'c'").select(*wide.columns)
    assert wide.exceptAll(narrow).isEmpty() and narrow.exceptAll(wide).isEmpty()


@pytest.mark.parametrize(("kind", "custom", "want"), [("NONE", (), 1), ("ALL", (), 4), ("CUSTOM", (1, 3), 3)])
def test_flat_map(spark, kind, custom, want):
    config = StatConfig("f", "f", "COUNT", kind, "SECOND", ("a", "b"), custom)
    one = spark.createDataFrame([(NOW,)], "ms long").withColumn("ts", F.timestamp_millis("ms"))
    full = ev.from_table(one, "f", "ts", {"a": F.lit("x"), "b": F.lit("y")}, F.lit(1))
    bare = ev.from_table(one, "f", "ts", {}, F.lit(1))
    for events in (full, bare):
        got = rollup.partials_of(valid(events, Registry.of(config)), Registry.of(config), NOW).where("store = 'HOUR'")
        assert got.count() == want and got.agg(F.sum("cnt")).first()[0] == want


def test_tag_alignment(spark):
    one = spark.createDataFrame([(NOW,)], "ms long").withColumn("ts", F.timestamp_millis("ms"))
    events = ev.from_table(one, "c", "ts", {"user": F.lit("first")}, F.lit(1))
    again = events.withColumn("tags", F.concat("tags", F.array(F.struct(F.lit("user").alias("name"), F.lit("second").alias("value"))), F.array(F.struct(F.lit("state").alias("name"), F.lit("").alias("value")))))
    row = rollup.base(valid(again), NOW).first()
    assert [row[f"tag_{i}"] for i in range(3)] == [None, None, "first"]


def test_xml(spark):
    wrong = MESSAGE.replace("statistic>", "other>")
    number = MESSAGE.replace(">2<", ">abc<")
    rows = [("c", MESSAGE), ("c", wrong), ("c", "<statistics><statistic>"), ("c", number), ("x", MESSAGE), (None, MESSAGE), ("v", MESSAGE), ("c", MESSAGE.replace("2024-01-30T00:00:01.000Z", "soon")), ("c", None)]
    checked = validate.validate(ev.from_xml(spark.createDataFrame(rows, "key string, value string")), BOTH).cache()
    assert checked.where("error_code = 'UNMARSHALLING_ERROR'").count() == 4
    errors = {(r["stat_uuid"], r["error_message"]) for r in checked.where("error_code = 'VALIDATION_ERROR'").collect()}
    assert errors == {("x", "no configuration for x"), (None, "the event has no key"), ("v", "a VALUE event needs a value"), ("c", "the event has no time")}
    good = validate.good(checked).orderBy("time_ms").collect()
    assert [(r["count"], r["ids"]) for r in good if r["ids"]] == [(2, ["1:x"])] and sorted(r["count"] for r in good) == [2, 3, 3]
    noted = validate.bad(checked).where("stat_uuid = 'x'").first()
    assert noted["raw"].endswith("<!-- VALIDATION_ERROR - no configuration for x -->") and "<statistic>" in noted["raw"]
    back = ev.from_xml(ev.to_xml(validate.good(checked)))
    assert back.select("time_ms", "count", "tags").exceptAll(validate.good(checked).select("time_ms", "count", "tags")).isEmpty()


def test_json_and_validation(spark):
    rows = [("c", '{"time": "2024-01-30T00:00:01Z", "count": 1, "tags": {"user": "u"}}'), ("c", '[{"time": "2024-01-30T00:00:01Z"}, {"time": "2024-01-30T00:00:01Z", "count": 1, "tags": {"size": "L"}}]'), ("c", "nonsense")]
    checked = validate.validate(ev.from_json(spark.createDataFrame(rows, "key string, value string")), BOTH)
    assert sorted(r["error_message"] or "" for r in checked.collect()) == ["", "a COUNT event needs a count", "the message is not an event", "unknown tags: size"]
    off = Registry.of(StatConfig("c", "counts", fields=TAGS))
    assert validate.validate(ev.from_json(spark.createDataFrame(rows[:1], "key string, value string")), off, check_enabled=True).first()["error_message"] == "the statistic is not enabled"


def test_store_and_search(spark, tmp_path):
    engine = Engine(spark, BOTH, str(tmp_path / "store"), NOW)
    ask = {"source_uuid": "v", "expression": tree("AND", term("Precision", "EQUALS", "minute"), term("colour", "EQUALS", "Red"))}
    assert engine.search(ask).count() == 0 and not store.exists(engine.partials(), VALUE)
    assert engine.ingest(sample(spark, "v"), 0).count() == 0
    once = engine.search(ask).collect()
    engine.ingest(sample(spark, "v"), 1)
    engine.ingest(sample(spark, "v"), 1, retry=True)
    twice = engine.search(ask).collect()
    assert len(once) == len(twice) == 5 * 4 and engine.search(ask).columns == [*VALUE.static_fields(), *VALUE.fields]
    assert sum(r["Statistic Count"] for r in twice) == 2 * sum(r["Statistic Count"] for r in once) == 8000
    assert all(abs(r["Statistic Value"] - 10.1) < 1e-9 and r["Min Statistic Value"] == r["Max Statistic Value"] == 10.1 for r in twice)
    store.compact(spark, engine.root, str(tmp_path / "small"))
    small = Engine(spark, BOTH, str(tmp_path / "small"), NOW)
    assert small.partials().count() * 2 == engine.partials().count()
    assert {tuple(r[:4]) for r in small.search(ask).collect()} == {tuple(r[:4]) for r in twice}
    assert sorted(r[0] for r in engine.tag_values("v", "colour").collect()) == ["Blue", "Green", "Red"]
    assert [r[0] for r in engine.tag_values("v", "colour", "ee").collect()] == ["Green"]
    assert store.finest_store(small.partials(), VALUE).name == "SECOND" and store.counts(small.partials(), BOTH).count() == 5
    assert Engine(spark, BOTH, engine.root, NOW + 10 * 86_400_000).purge_old() == 2
    assert store.finest_store(engine.partials(), VALUE).name == "MINUTE"
    assert engine.purge_all(["c"]) == 0 and engine.purge_all() > 0 and engine.partials().count() == 0
    with pytest.raises(UnknownStatistic):
        engine.search({"source_uuid": "nosuch"})


def test_no_batch_is_lost(spark, tmp_path):
    engine = Engine(spark, BOTH, str(tmp_path / "s"), NOW)
    counted = lambda: engine.partials().where("store = 'DAY' and mask = 0").agg(F.sum("cnt")).first()[0]
    for batch in (0, 1, 2):
        engine.ingest(sample(spark, steps=8), batch)
        assert counted() == (batch + 1) * 96
    with pytest.raises(store.BatchExists):
        engine.ingest(sample(spark, steps=8), 1)
    assert engine.compact() == [0, 1] and store.batches(spark, engine.root) == [-2, 2] and counted() == 288 and engine.compact() == []
    for taken in (0, 1, 2, -2):
        with pytest.raises(store.BatchExists):
            engine.ingest(sample(spark, steps=8), taken)
    engine.ingest(sample(spark, steps=8), 2, retry=True)
    assert counted() == 288
    engine.ingest(sample(spark, steps=8), 3)
    assert engine.compact() == [-2, 2] and store.batches(spark, engine.root) == [-3, 3] and counted() == 384


def test_a_swap_that_was_cut_short_is_finished(spark, tmp_path, monkeypatch):
    root = tmp_path / "s"
    engine = Engine(spark, BOTH, str(root), NOW)
    for batch in range(3):
        engine.ingest(sample(spark, steps=8), batch)
    monkeypatch.setattr(store, "finish", lambda *a: None)
    engine.compact()  # ends when the list is there
    assert [p.name for p in root.glob("_replaces*") if not p.name.endswith("crc")] == ["_replaces.0_1"]
    shutil.rmtree(root / "batch_id=0")  # and one of the old batches has gone
    monkeypatch.undo()
    assert engine.partials().where("store = 'DAY' and mask = 0").agg(F.sum("cnt")).first()[0] == 288
    assert store.batches(spark, engine.root) == [-2, 2] and not list(root.glob("_replaces*"))


def test_events_are_read_once(spark, tmp_path):
    """Of all grains and masks one scan, and a shuffle each for entering, time and masks; of two tags no more columns."""
    sample(spark, steps=8).drop("error_code").write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e")).withColumn("error_code", F.lit(None).cast("string"))
    two = Registry.of(StatConfig("c", "counts", "COUNT", "ALL", "SECOND", ("user", "colour"), enabled=True))
    plan = rollup.partials_of(valid(events, two), two, NOW)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 1 and plan.count("Exchange hashpartitioning") == 3 and "tag_2" not in plan.split("Exchange hashpartitioning")[-1]


def test_many_tags_go_one_at_a_time(spark, monkeypatch):
    tags = tuple(f"t{i}" for i in range(8))
    many = StatConfig("w", "wide", "COUNT", "ALL", "DAY", tags, enabled=True)
    few = StatConfig("n", "narrow", "COUNT", "ALL", "DAY", tags[:2], enabled=True)
    both = Registry.of(many, few)
    each = spark.range(40).select(F.timestamp_millis(F.lit(NOW) - F.col("id")).alias("ts"), *((F.col("id") % (2 + i % 3)).cast("string").alias(t) for i, t in enumerate(tags)))
    events = ev.from_table(each, "w", "ts", {t: t for t in tags}, F.lit(1)).unionByName(ev.from_table(each, "n", "ts", {t: t for t in tags[:2]}, F.lit(1)))
    called = []
    real = rollup.fan_out_wide
    monkeypatch.setattr(rollup, "fan_out_wide", lambda partials, n: called.append(n) or real(partials, n))
    wide = rollup.partials_of(valid(events, both), both, NOW).where("store = 'DAY'").cache()
    assert called == [8] and {r["stat_uuid"]: r["n"] for r in wide.groupBy("stat_uuid").agg(F.count_distinct("mask").alias("n")).collect()} == {"w": 256, "n": 4}
    monkeypatch.setattr(rollup, "WIDE", 256)
    narrow = rollup.partials_of(valid(events, both), both, NOW).where("store = 'DAY'").cache()
    assert called == [8] and wide.exceptAll(narrow).isEmpty() and narrow.exceptAll(wide).isEmpty()


def test_strict_engines(spark, tmp_path):
    off = Registry.of(StatConfig("c", "counts", fields=TAGS))
    strict = Engine(spark, off, str(tmp_path / "s"), NOW, strict=True)
    assert strict.ingest(sample(spark, steps=2), 0).count() == 24
    with pytest.raises(UnsupportedRequest):
        strict.search({"source_uuid": "c"})


def test_pushed_down(spark, tmp_path):
    engine = Engine(spark, BOTH, str(tmp_path / "s"), NOW)
    engine.ingest(sample(spark, steps=10), 0)
    ask = {"source_uuid": "c", "expression": tree("AND", term("Date Time", "GREATER_THAN", "day()"), term("colour", "EQUALS", "Red")), "fields": [{"name": "n", "expression": "${Statistic Count}"}]}
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = engine.search(ask)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "row_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualNullSafe(tag_0,Red)" in plan and "EqualTo(mask,6)" in plan


def test_dates_on_truncated_times(spark):
    daily = StatConfig("d", "daily", "COUNT", "ALL", "DAY", ("tag1",))
    base = datetime(2024, 1, 5, 11, 30, tzinfo=UTC)
    days = [base + timedelta(days=5 * i) for i in range(5)]
    rows = spark.createDataFrame([(d,) for d in days], "ts timestamp")
    got = rollup.partials_of(valid(ev.from_table(rows, "d", "ts", {"tag1": F.lit("x")}, F.lit(100)), Registry.of(daily)), Registry.of(daily), NOW)
    from chronotally.operators.search import search

    starts = [d.strftime("%Y-%m-%dT00:00:00.000Z") for d in days]
    want = {"EQUALS": [2], "LESS_THAN": [0, 1], "LESS_THAN_OR_EQUAL_TO": [0, 1, 2], "GREATER_THAN": [3, 4], "GREATER_THAN_OR_EQUAL_TO": [2, 3, 4], "BETWEEN": [1, 2, 3]}
    for condition, hit in want.items():
        value = f"{starts[1]},{starts[3]}" if condition == "BETWEEN" else starts[2]
        found = search(got, Registry.of(daily), {"source_uuid": "d", "expression": tree("AND", term("Date Time", condition, value))}, NOW)
        assert sorted(datetime.fromtimestamp(r["Date Time"] / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%S.000Z") for r in found.collect()) == [starts[i] for i in hit]


def test_shaping(spark):
    from chronotally.operators.search import search

    got = rollup.partials_of(valid(sample(spark, steps=40)), BOTH, NOW).cache()
    total = {"name": "n", "expression": "sum(${Statistic Count})", "sort": {"order": 0, "descending": True}}
    colour = {"name": "colour", "group": 0}
    ask = {"source_uuid": "c", "expression": term("Precision", "EQUALS", "second"), "fields": [colour, total], "max_sizes": [2]}
    assert [(r["colour"], r["n"]) for r in search(got, BOTH, ask, NOW).collect()] == [("Blue", 160), ("Green", 160)]
    nested = {**ask, "fields": [colour, {"name": "user", "group": 1}, total], "max_sizes": [2, 1]}
    assert [(r["colour"], r["user"]) for r in search(got, BOTH, nested, NOW).collect()] == [("Blue", "user1"), ("Green", "user1")]
    missing = {**ask, "fields": [{"name": "x", "expression": "${nosuch}"}, {"name": "twice", "expression": "${Statistic Count} * 2", "sort": {"order": 0}}], "max_sizes": "3"}
    assert [tuple(r) for r in search(got, BOTH, missing, NOW).collect()] == [(None, 8)] * 3 or search(got, BOTH, missing, NOW).count() == 3
    rolled = {"source_uuid": "c", "expression": tree("AND", term("Precision", "EQUALS", "day"), term("user", "EQUALS", ROLLED_UP)), "fields": [{"name": "user"}, {"name": "n", "expression": "${Statistic Count}"}]}
    assert [tuple(r) for r in search(got, BOTH, rolled, NOW).collect()] == [(ROLLED_UP, 480)]
    filled = {**ask, "expression": tree("AND", term("Precision", "EQUALS", "day"), term("colour", "EQUALS", "${c}")), "params": {"c": "Red"}, "max_sizes": None}
    assert [r["colour"] for r in search(got, BOTH, filled, NOW).collect()] == ["Red"]
    assert sizes("10,x") == [] and sizes("10,2") == [10, 2] and sizes(None) == []
    with pytest.raises(UnsupportedRequest):
        require(StatConfig("u", "bad*name"))


def test_custom_mask_grain(spark):
    from chronotally.operators.search import search

    config = StatConfig("k", "custom", "COUNT", "CUSTOM", "HOUR", ("a", "b"), (1,))
    rows = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p")], "a string, b string").withColumn("ts", F.timestamp_millis(F.lit(NOW)))
    got = rollup.partials_of(valid(ev.from_table(rows, "k", "ts", {"a": "a", "b": "b"}, F.lit(1)), Registry.of(config)), Registry.of(config), NOW)
    ask = {"source_uuid": "k", "expression": term("Precision", "EQUALS", "hour"), "fields": [{"name": "a"}, {"name": "n", "expression": "${Statistic Count}"}]}
    assert sorted(map(tuple, search(got, Registry.of(config), ask, NOW).collect())) == [("x", 2), ("y", 1)]
    assert search(got, Registry.of(config), {**ask, "raw_points": True}, NOW).count() == 3


def test_merge_identity(spark):
    schema = "k int, cnt long, total double, least double, most double"
    rows = spark.createDataFrame([(1, 0, None, None, None), (1, 2, 3.0, 1.0, 2.0), (2, 0, None, None, None)], schema)
    got = {r["k"]: r for r in rollup.merge(rows, ["k"]).withColumn("mean", rollup.mean()).collect()}
    assert tuple(got[1])[1:] == (2, 3.0, 1.0, 2.0, 1.5) and got[2]["mean"] == 0.0
    many = spark.range(400_000).select(F.lit(1).alias("k"), F.lit(1).cast("long").alias("cnt"), *(F.lit(0.1).alias(c) for c in ("total", "least", "most")))
    assert abs(rollup.merge(many, ["k"]).first()["total"] - 40_000) < 1e-3


def test_streaming_equals_batch_and_restarts(spark, tmp_path):
    source, root, bad, checkpoint = (str(tmp_path / x) for x in ("in", "store", "bad", "check"))
    messages = ev.to_xml(sample(spark, steps=12)).unionByName(spark.createDataFrame([("c", "<oops")], "key string, value string"))
    schema = "key string, value string"

    def run():
        stream = ev.read_stream(spark, source, schema, maxFilesPerTrigger="1")
        query = ingest.start(stream, ev.from_xml, BOTH, root, bad, checkpoint, lambda: NOW, available_now=True)
        query.awaitTermination()
        assert ingest.health(query)["active"] is False

    halves = messages.withColumn("h", F.monotonically_increasing_id() % 2)
    halves.where("h = 0").drop("h").coalesce(1).write.parquet(source)
    run()
    halves.where("h = 1").drop("h").coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    keys = rollup.KEYS
    streamed = rollup.merge(store.read(spark, root), keys).select(*keys, "cnt")
    batch = rollup.partials_of(valid(sample(spark, steps=12)), BOTH, NOW).select(*keys, "cnt")
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()
    assert [r["error_code"] for r in spark.read.parquet(bad).collect()] == ["UNMARSHALLING_ERROR"]
    events = ev.from_xml(messages)
    ingest.ingest_batch(events, BOTH, root + "2", bad + "2", 7, NOW)
    ingest.ingest_batch(events, BOTH, root + "2", bad + "2", 7, NOW)
    again = rollup.merge(store.read(spark, root + "2"), keys).select(*keys, "cnt")
    assert again.exceptAll(batch).isEmpty()


def test_correlator(spark):
    make = lambda rows: spark.createDataFrame(rows, "user string, door string")
    c = Correlator().add("yesterday", make([("user1", "door1"), ("user2", "door1"), ("user3", "door1"), ("user3", "door1"), (None, "door2")])).add("today", make([("user1", "door1"), ("user2", "door1"), (None, "door2")]))
    assert [tuple(r) for r in c.complement("today").collect()] == [("user3", "door1")] and c.complement("yesterday").count() == 0
    assert c.intersection().count() == 3 and c.intersection(["today", "yesterday"]).count() == 3
    with pytest.raises(ValueError):
        c.intersection(["today"])
    with pytest.raises(ValueError):
        c.add("more", spark.createDataFrame([("x",)], "user string"))


def test_compaction_deals_rows_before_it_merges(spark, tmp_path, monkeypatch):
    """Tasks are cut by rows, and stored rows are not gathered by the tasks that read them."""
    monkeypatch.setattr(store, "ROWS", 100)
    engine = Engine(spark, BOTH, str(tmp_path / "store"), NOW)
    for batch in range(3):
        engine.ingest(sample(spark, steps=8), batch)
    read = lambda: {tuple(r)[:-4]: (r["cnt"],) for r in rollup.merge(engine.partials(), rollup.KEYS).collect()}
    before, seen, checkpointed = read(), [], store.checkpointed
    monkeypatch.setattr(store, "checkpointed", lambda df: seen.append(df) or checkpointed(df))
    stored = spark.read.option("basePath", engine.root).parquet(*(f"{engine.root}/batch_id={n}" for n in (0, 1))).count()
    assert engine.compact() == [0, 1] and read() == before
    [merged] = seen
    plan = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert merged.rdd.getNumPartitions() == stored // 100 + 1 > 2 and plan.count("Exchange") == 1 and plan.index("HashAggregate") < plan.index("Exchange") and "HashAggregate" not in plan[plan.index("Exchange") :]


def test_what_is_written_has_small_tasks_and_no_sampling(spark, tmp_path, monkeypatch):
    """Rows of a batch are shuffled once more and not written twice; tasks are cut by TASK_BYTES, and settings are put back."""
    monkeypatch.setattr(rollup, "TASK_BYTES", 10_000)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    set_before = [spark.conf.get(n, None) for n in names]
    seen, save, checkpointed = [], store._save, store.checkpointed
    monkeypatch.setattr(store, "_save", lambda dealt, path: seen.append(dealt) or save(dealt, path))
    monkeypatch.setattr(store, "checkpointed", lambda df: seen.append(df) or checkpointed(df))
    engine = Engine(spark, BOTH, str(tmp_path / "s"), NOW)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or there is one task, which cannot be split
    try:
        engine.ingest(sample(spark), 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(seen) == 1 and "REBALANCE_PARTITIONS_BY_COL" in seen[0]._jdf.queryExecution().executedPlan().toString()
    seconds = list((tmp_path / "s" / "batch_id=0" / "store=SECOND").rglob("*.parquet"))
    assert len({p.parent for p in seconds}) == 1 and len(seconds) > 4  # one block, by more tasks than it has shares
    assert "tag_3" not in spark.read.parquet(str(seconds[0])).columns and engine.partials().where("tag_3 is not null").isEmpty()
    assert engine.partials().where("store = 'FOREVER' and mask = 7").first()["cnt"] == 12_000
    assert [spark.conf.get(n, None) for n in names] == set_before
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        Engine(spark, BOTH, str(tmp_path / "t"), NOW).ingest(sample(spark), 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    other = store.read(spark, str(tmp_path / "t")).select(*rollup.KEYS, "cnt")
    assert len(seen) == 3 and other.exceptAll(engine.partials().select(*other.columns)).isEmpty() and other.count() == engine.partials().count()


def test_wide_fan_out_has_small_tasks(spark, monkeypatch):
    name, events, seen = "spark.sql.adaptive.advisoryPartitionSizeInBytes", valid(sample(spark, steps=40)), []
    real, before = type(events).checkpoint, spark.conf.get(name, None)
    monkeypatch.setattr(type(events), "checkpoint", lambda df: seen.append(df.sparkSession.conf.get(name)) or real(df))
    made = rollup.fan_out_wide(rollup.cascade(rollup.base(events, NOW, tags=3)), 3)
    assert [int(s.rstrip("b")) for s in seen] == [rollup.TASK_BYTES] * 3 and spark.conf.get(name, None) == before
    assert made.where("store = 'FOREVER' and mask = 7").first()["cnt"] == 480
