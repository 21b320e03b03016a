"""The store: partials in Parquet, appended batch by batch and never changed.

<root>/batch_id=<n>/store=<grain>/stat_uuid=<uuid>/row_bucket=<block>/*.parquet, sorted by mask, bucket and tags, so that
partition pruning finds grain, statistic and time, and row-group statistics skip other masks and tags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals, masks
from ..plans.model import Registry, StatConfig
from .rollup import COLUMNS, KEYS, MEASURES, SCHEMA, TAGS, TASK_BYTES, checkpointed, merge, small_tasks

PARTITIONS = ["store", "stat_uuid", "row_bucket"]
#: About so many partials are merged, or sorted and written, by one task of compaction.
ROWS = 200_000


class BatchExists(ValueError):
    """A batch of that number is in the store."""


def write_batch(partials: DataFrame, root: str, batch_id: int, tags: int = masks.MAX_TAGS) -> None:
    """Writes one batch; writing it again replaces it, so a batch that is retried counts once. No statistic in it has more
    than so many tags; columns of others are not written, and read as nulls.

    Rows are computed once and shuffled once, by what they are partitioned by and mask. Spark splits large shares of that, so
    many tasks write a large statistic's block, and one with a single bucket, too; small ones go together."""
    spark, path = partials.sparkSession, f"{root.rstrip('/')}/batch_id={batch_id}"
    finish(spark, root)
    if spark.conf.get("spark.sql.adaptive.enabled") != "true":  # the hint would do nothing
        return _write(partials, path)
    rows = partials.select(*PARTITIONS, "mask", "bucket_ms", *TAGS[:tags], *MEASURES)
    with small_tasks(spark):
        _save(rows.hint("rebalance", *PARTITIONS, "mask").sortWithinPartitions(*PARTITIONS, "mask", "bucket_ms", *TAGS[: min(tags, 3)]), path)


def _save(dealt: DataFrame, path: str) -> None:
    dealt.write.mode("overwrite").partitionBy(*PARTITIONS).parquet(path)


def _write(partials: DataFrame, path: str) -> None:
    """Rows are written to the checkpoint folder first and counted there, and dealt by ranges of about ROWS rows."""
    order = [*PARTITIONS, "mask", "bucket_ms", *TAGS[:3]]
    rows = checkpointed(partials.select(*COLUMNS))
    _save(rows.repartitionByRange(_tasks(rows), *order).sortWithinPartitions(*order), path)


def _tasks(rows: DataFrame) -> int:
    return rows.count() // ROWS + 1


def _merged(spark: SparkSession, base: str, paths: list[str]) -> DataFrame:
    """One partial for each key of the stored files. Rows of a batch have different keys already, so they are dealt before
    they are merged, and no task gathers what it has read: many partials lie in few bytes, so tasks are cut by rows."""
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", TASK_BYTES)
    rows = own.read.schema(SCHEMA + ", batch_id long").option("basePath", base).parquet(*paths).select(*COLUMNS)
    keys = [*KEYS, "row_bucket"]
    return merge(rows.repartition(_tasks(rows), *keys), keys)


def read(spark: SparkSession, root: str) -> DataFrame:
    """All partials; several of one key are merged by whoever reads. A store that nothing was written to is empty."""
    finish(spark, root)
    files, path = _files(spark, root)
    if not files.exists(path(root)) or not files.globStatus(path(f"{root.rstrip('/')}/batch_id=*/store=*")):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA + ", batch_id long").option("basePath", root).parquet(root).select(*COLUMNS)


def _files(spark: SparkSession, root: str):
    """The file system of root, and what makes its paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def batches(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the batches in the store; a negative one, -1 - n, holds all up to n, merged."""
    files, path = _files(spark, root)
    found = files.globStatus(path(f"{root.rstrip('/')}/batch_id=*")) or []
    return sorted(int(f.getPath().getName().split("=")[1]) for f in found)


def refuse_known(spark: SparkSession, root: str, batch_id: int) -> None:
    """Raises BatchExists if a batch of that number was written, be it merged into another since."""
    known = batches(spark, root)
    if batch_id < 0 or batch_id in known or any(n < 0 and batch_id <= -1 - n for n in known):
        raise BatchExists(f"batch {batch_id} is taken")


def compact(spark: SparkSession, root: str, to: str) -> None:
    """Writes one partial for each key of all batches to another root, under the number of merged batches."""
    last = max((n if n >= 0 else -1 - n for n in batches(spark, root)), default=-1)
    finish(spark, root)
    files, path = _files(spark, root)
    base = root.rstrip("/")
    filled = bool(files.exists(path(root)) and files.globStatus(path(f"{base}/batch_id=*/store=*")))
    write_batch(_merged(spark, base, [base]) if filled else read(spark, root), to, -1 - last)


#: The merged rows and the list of what they replace, while batches are being merged in place; readers don't see such names.
_NEW, _SWAP = "_merged", "_replaces"


def compact_in_place(spark: SparkSession, root: str) -> list[int]:
    """Merges all batches but the newest, which a stream may write again, into one; returns their numbers.

    The merged rows are written beside the batches first. From the moment when the list of what they replace is there, the
    swap will be finished by whoever comes next, so a driver that is lost at any point leaves every event counted once.
    One process at a time writes to a store or compacts it."""
    finish(spark, root)
    old = batches(spark, root)
    old = [n for n in old if n < 0 or n != old[-1]]
    if len(old) < 2:
        return []
    base = root.rstrip("/")
    _write(_merged(spark, base, [f"{base}/batch_id={n}" for n in old]), f"{base}/{_NEW}")
    files, path = _files(spark, root)
    with_list = f"{base}/{_SWAP}.{'_'.join(map(str, old))}"
    files.create(path(with_list), True).close()
    finish(spark, root)
    return old


def finish(spark: SparkSession, root: str) -> None:
    """Ends a swap that compact_in_place() began; each step may be repeated."""
    files, path = _files(spark, root)
    base = root.rstrip("/")
    for found in files.globStatus(path(f"{base}/{_SWAP}.*")) or []:
        old = [int(n) for n in found.getPath().getName().split(".", 1)[1].split("_")]
        for n in old:
            files.delete(path(f"{base}/batch_id={n}"), True)
        last = max(n if n >= 0 else -1 - n for n in old)
        if files.exists(path(f"{base}/{_NEW}")):
            files.rename(path(f"{base}/{_NEW}"), path(f"{base}/batch_id={-1 - last}"))
        files.delete(found.getPath(), False)


def _delete(spark: SparkSession, pattern: str, gone) -> int:
    """Deletes the directories that match the pattern and for whose name gone(name) holds; only names are listed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    n = 0
    for found in files.globStatus(path) or []:
        if gone(found.getPath().getName()):
            files.delete(found.getPath(), True)
            n += 1
    return n


def purge_old(spark: SparkSession, root: str, now_ms: int, retention: dict[str, int] = intervals.RETENTION) -> int:
    """Drops whole blocks that are older than their grain keeps, of all statistics and masks; returns how many."""
    n = 0
    for i in intervals.INTERVALS:
        if i.purgeable:
            first = intervals.cutoff_ms(now_ms, i, retention) // i.row_ms
            n += _delete(spark, f"{root.rstrip('/')}/batch_id=*/store={i.name}/stat_uuid=*/row_bucket=*", lambda name, first=first: int(name.split("=")[1]) < first)
    return n


def purge_all(spark: SparkSession, root: str, uuids: list[str] | None = None) -> int:
    """Drops all data of the statistics, or of all."""
    return _delete(spark, f"{root.rstrip('/')}/batch_id=*/store=*/stat_uuid=*", lambda name: uuids is None or name.split("=", 1)[1] in uuids)


def exists(partials: DataFrame, config: StatConfig, i: intervals.Interval | None = None, mask: int | None = None) -> bool:
    """Whether there is any data of a statistic; reads one row."""
    rows = partials.where(F.col("stat_uuid") == config.uuid)
    if i is not None:
        rows = rows.where(F.col("store") == i.name)
    if mask is not None:
        rows = rows.where(F.col("mask") == mask)
    return not rows.limit(1).isEmpty()


def finest_store(partials: DataFrame, config: StatConfig) -> intervals.Interval | None:
    """The finest grain that has data of a statistic."""
    return next((i for i in intervals.INTERVALS if exists(partials, config, i)), None)


def counts(partials: DataFrame, registry: Registry) -> DataFrame:
    """(store, kind, cells): how many partials each grain holds of each kind."""
    kinds = registry.frame(partials.sparkSession).select("stat_uuid", "kind")
    return partials.join(F.broadcast(kinds), "stat_uuid").groupBy("store", "kind").agg(F.count("*").alias("cells"))


def tag_values(partials: DataFrame, config: StatConfig, tag: str, part: str = "") -> DataFrame:
    """(value): the distinct values of a tag that contain `part`, at the coarsest grain, where the least rows are."""
    t = F.col(TAGS[config.position(tag)])
    rows = partials.where((F.col("stat_uuid") == config.uuid) & (F.col("store") == "FOREVER") & (F.col("mask") == 0) & t.isNotNull())
    return rows.where(t.contains(part)).select(t.alias("value")).distinct()
