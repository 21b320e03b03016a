"""Partial aggregates of events: in time, from finer to coarser grains, and over tags, under roll-up masks.

A partial has: store, stat_uuid, mask, row_bucket, bucket_ms, tag_0 .. tag_14 (values in the order of the statistic's
fields), cnt, total, least, most. Partials of one key merge by sum, sum, min and max, in any order and number.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import intervals, masks
from ..plans.model import Registry

TAGS = [f"tag_{i}" for i in range(masks.MAX_TAGS)]
MEASURES = ["cnt", "total", "least", "most"]
KEYS = ["store", "stat_uuid", "mask", "bucket_ms", *TAGS]
#: Statistics of more masks than this are fanned out one tag at a time.
WIDE = 64
#: About so many bytes of files, or of shuffled rows, go to one task of what is written out: its copies take many times that memory.
TASK_BYTES = 8 << 20
COLUMNS = ["store", "stat_uuid", "mask", "row_bucket", "bucket_ms", *TAGS, *MEASURES]
SCHEMA = "store string, stat_uuid string, mask int, row_bucket long, bucket_ms long, " + ", ".join(f"{t} string" for t in TAGS) + ", cnt long, total double, least double, most double"


def tags_of(df: DataFrame) -> list[str]:
    """The tags that df has columns for: as many as the widest statistic needs, until with_blocks() adds the others as nulls."""
    return [t for t in TAGS if t in df.columns]


def merge(partials: DataFrame, keys: list[str]) -> DataFrame:
    """One partial for each key; combined in each task before the shuffle."""
    return partials.groupBy(*keys).agg(F.sum("cnt").alias("cnt"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


def mean(count: str = "cnt", total: str = "total") -> Column:
    """Of merged partials; 0 where nothing was counted."""
    return F.when(F.coalesce(F.col(count), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.col(total) / F.col(count))


def tag_at(i: int) -> Column:
    """An event's first tag of the name that the i-th field has; null where it is missing or empty."""
    named = F.filter("tags", lambda t: t["name"] == F.get("fields", F.lit(i)))
    return F.nullif(F.get(named, F.lit(0))["value"], F.lit(""))


def base(valid: DataFrame, now_ms: int, retention: dict[str, int] = intervals.RETENTION, tags: int = masks.MAX_TAGS) -> DataFrame:
    """Partials under mask 0 at the grain where each event enters: the configured one, or coarser for late events. No
    statistic has more than so many tags."""
    at = valid.withColumn("store", intervals.base_store(F.col("time_ms"), F.col("precision"), now_ms, retention))
    start = F.lit(0).cast("long")
    for i in intervals.INTERVALS[:-1]:
        start = F.when(F.col("store") == i.name, intervals.bucket(F.col("time_ms"), i)).otherwise(start)
    is_value = F.col("kind") == "VALUE"
    value = F.when(is_value, F.col("value"))
    rows = at.select(
        "store", "stat_uuid", start.alias("bucket_ms"), *(tag_at(i).alias(t) for i, t in enumerate(TAGS[:tags])),
        F.when(is_value, F.lit(1).cast("long")).otherwise(F.col("count")).alias("cnt"), value.alias("total"), value.alias("least"), value.alias("most"),
    )
    return merge(rows, ["store", "stat_uuid", "bucket_ms", *TAGS[:tags]])


def cascade(entered: DataFrame) -> DataFrame:
    """Partials of every grain, from the one where they enter: each is copied to the grains from there on, at most five
    times, and merged by grain and bucket. One scan and one shuffle; copies are merged in each task before it."""
    raised = F.array(*(F.struct(F.lit(i.name).alias("store"), intervals.bucket(F.col("bucket_ms"), i).cast("long").alias("bucket_ms")) for i in intervals.INTERVALS))
    first = F.array_position(F.array(*(F.lit(i.name) for i in intervals.INTERVALS)), F.col("store")).cast("int")
    raised = F.slice(raised, first, len(intervals.INTERVALS))
    rest = [c for c in entered.columns if c not in ("store", "bucket_ms")]
    return merge(entered.select(*rest, F.inline(raised)), ["store", "stat_uuid", "bucket_ms", *tags_of(entered)])


def fan_out(partials: DataFrame, registry: Registry) -> DataFrame:
    """Partials under every mask of their statistic, of those under mask 0.

    Copies are made of partials, not of events, and merged in each task before they are shuffled. Statistics of more than
    WIDE masks for all tags go through fan_out_wide()."""
    wide: dict[int, list[str]] = {}
    for c in registry.configs.values():
        if c.rollup == "ALL" and 1 << len(c.fields) > WIDE:
            wide.setdefault(len(c.fields), []).append(c.uuid)
    narrow = Registry.of(*(c for c in registry.configs.values() if not any(c.uuid in found for found in wide.values())))
    out = [fan_out_wide(partials.where(F.col("stat_uuid").isin(found)), tags) for tags, found in wide.items()]
    if narrow.configs or not out:
        config = narrow.frame(partials.sparkSession).select("stat_uuid", "masks")
        each = partials.join(F.broadcast(config), "stat_uuid").withColumn("mask", F.explode("masks")).drop("masks")
        rolled = each.withColumns({t: masks.rolled(F.col(t), F.col("mask"), i) for i, t in enumerate(tags_of(partials))})
        out.append(with_blocks(merge(rolled, _keys(partials))))
    return reduce(DataFrame.unionByName, out)


def _keys(partials: DataFrame) -> list[str]:
    return ["store", "stat_uuid", "mask", "bucket_ms", *tags_of(partials)]


def fan_out_wide(partials: DataFrame, tags: int) -> DataFrame:
    """As fan_out() for statistics that roll up ALL of their `tags` tags, one tag at a time: partials with a tag rolled up
    come from merged ones, so that 2^n copies of every partial are never made at once. Each step is written out, in small tasks."""
    done = partials.withColumn("mask", F.lit(0))
    for i, t in enumerate(TAGS[:tags]):
        rolled = merge(done.withColumn(t, F.lit(masks.ROLLED_UP)).withColumn("mask", F.col("mask").bitwiseOR(F.lit(1 << i))), _keys(partials))
        done = checkpointed(done.unionByName(rolled))
    return with_blocks(done)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    with small_tasks(df.sparkSession):
        return df.checkpoint()


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile has tasks of TASK_BYTES, or of a part of the shuffle if that is more: a task of the 64 MB and more that Spark
    gives it by itself holds millions of partials, and copies of each. The session's settings are put back."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name in names:
            spark.conf.set(name, TASK_BYTES)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where that is unset, a session on one machine gets
    a folder of its own, and a cluster's is refused, as its executors would write to disks that others don't see."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = f"{tempfile.gettempdir()}/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(own)
    return own


def with_blocks(partials: DataFrame) -> DataFrame:
    block = F.lit(0).cast("long")
    for i in intervals.INTERVALS[:-1]:
        block = F.when(F.col("store") == i.name, intervals.row_bucket(F.col("bucket_ms"), i)).otherwise(block)
    none = {t: F.lit(None).cast("string") for t in TAGS if t not in partials.columns}
    return partials.withColumn("row_bucket", block).withColumns(none).select(*COLUMNS)


def kept(partials: DataFrame, now_ms: int, retention: dict[str, int] = intervals.RETENTION) -> DataFrame:
    """Without partials that are older than their store keeps."""
    old = F.lit(False)
    for i in intervals.INTERVALS[:-1]:
        old = old | ((F.col("store") == i.name) & (F.col("bucket_ms") < intervals.cutoff_ms(now_ms, i, retention)))
    return partials.where(~old)


def partials_of(valid: DataFrame, registry: Registry, now_ms: int, retention: dict[str, int] = intervals.RETENTION) -> DataFrame:
    """All partials of validated events: every grain from where they enter, under every mask."""
    return kept(fan_out(cascade(base(valid, now_ms, retention, widest(registry))), registry), now_ms, retention)


def widest(registry: Registry) -> int:
    """The most tags that a statistic has."""
    return max((len(c.fields) for c in registry.configs.values()), default=0)


def event_ids(valid: DataFrame, i: intervals.Interval, most: int, order: str = "id") -> DataFrame:
    """(stat_uuid, bucket_ms, ids): the first `most` ids of each bucket, in order; ranked, so that no more are gathered."""
    rows = valid.select("stat_uuid", intervals.bucket(F.col("time_ms"), i).alias("bucket_ms"), F.explode("ids").alias("id"))
    key = F.expr(order)
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("stat_uuid", "bucket_ms").orderBy(key))).where(F.col("n") <= most)
    return ranked.groupBy("stat_uuid", "bucket_ms").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("ids"))


def reduction_percent(before: Column, after: Column) -> Column:
    """By how much aggregation has shrunk its input."""
    return 100 - after / before * 100
