"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as the contracts on words write it.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
#: What stands between words of ASCII letters, digits and all other code points.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where that is unset, a session on one machine gets
    a folder of its own, and a cluster's is refused, as its executors would write to disks that others don't see."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = f"{tempfile.gettempdir()}/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(own)
    return own


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder, so that later steps survive lost executors and read one fixed result."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once even where body's lambdas use it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with one more column, computed once for each row. A generator of one row does it: the optimizer copies a plain
    projection into every later use of it, filters included, which repeats dear expressions."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """As computed(), but a column that has the name, in whatever case, is replaced."""
    [own] = fresh(df, name)
    if own == name:
        return computed(df, name, value)
    return computed(df, own, value).drop(name).withColumnRenamed(own, name)


def words(text: Column) -> Column:
    """The words between ASCII white space; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else. Text without other letters that lower() would change takes the fast way."""
    plain = ~text.rlike(r"[^\x00-\x7F\u0080-¿×ß-ÿ -⃏]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def in_order(df: DataFrame, order: list[Column], group: list[str] = (), add: dict[str, str] | None = None, pos: str = "pos") -> DataFrame:
    """Running positions over any number of rows without one task that sees them all.

    Adds `pos` (0-based place of the row within its group, in the given order, the group columns first) and for each
    `add[new] = column` the sum of that column over the rows before it. Rows are dealt by range and written once; each
    range is summed by itself, and what earlier ranges hold of the same group comes from one row per range at most,
    which is therefore small enough to broadcast. Rows that tie in `order` must be alike for a repeatable result.
    """
    add, group = add or {}, list(group)
    own = [F.col(g) for g in group]
    part, n, *sums = fresh(df, "range_no", "rows_before", *(f"{k}_before" for k in add))
    ranged = cut(df.repartitionByRange(*own, *order).withColumn(part, F.spark_partition_id()))
    by_range = ranged.groupBy(part, *group).agg(F.count("*").alias(n), *(F.sum(c).alias(s) for s, c in zip(sums, add.values(), strict=True)))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # only the first group of a range can have begun in an earlier one
    mine = fresh(ranged, part, *group)
    at = [F.col(c).alias(m) for c, m in zip([part, *group], mine, strict=True)]
    carry = by_range.select(*at, *(F.sum(c).over(earlier).alias(c) for c in (n, *sums))).where(F.col(n) > 0)
    keys = [F.col(c).eqNullSafe(F.col(m)) for c, m in zip([part, *group], mine, strict=True)]
    joined = ranged.join(F.broadcast(carry), keys, "left").drop(*mine)
    inside = Window.partitionBy(part, *group).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(
        *df.columns,
        (F.row_number().over(inside) - 1 + F.coalesce(n, F.lit(0))).cast("long").alias(pos),
        *((F.coalesce(F.sum(c).over(before), F.lit(0)) + F.coalesce(s, F.lit(0))).alias(k) for s, (k, c) in zip(sums, add.items(), strict=True)),
    )
