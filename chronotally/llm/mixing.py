"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, cut, fresh, in_order

WEIGHTS = (5, 2, 1)
#: No source is asked for more than so many times its size, and so no document is taken more often.
MOST = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, source: str = "source", size: str = "size") -> DataFrame:
    """(source, source_size, target) of every source, from rows of (source, size).

    Sources in order of code points, null last, weigh `weights` in turn and share the sum of all sizes by weight. A target
    stops at MOST times its source's size; what is over goes to the others by weight until none is above. In order of
    MOST * size / weight the sources that stop come first, so one running sum finds them. Only the rows of one per
    source, not documents, meet in one task."""
    by = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    turn = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by = by.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn).cast("long"))
    by = by.withColumn("most", MOST * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    whole, before = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))
    share = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    by = by.withColumn("share", share).withColumn("stops", F.col("ratio") <= F.col("share"))
    rest = F.first(F.when(~F.col("stops"), F.col("share")), ignorenulls=True).over(whole)
    return by.withColumn("rest", rest).select("source", "source_size", F.when(F.col("stops"), F.col("most").cast("double")).otherwise(F.col("rest") * F.col("weight")).alias("target"))


def offset(source: Column, seed: int = 0) -> Column:
    """A number in [0, 1) for each source, the same in every run with the same seed."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(source, F.lit("")), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / 4294967296


def copies(df: DataFrame, by_source: DataFrame, order: list[str], source: str = "source", seed: int = 0) -> DataFrame:
    """Adds source_size, target and copies (long) to rows of documents, in place of columns that have these names.

    A document of a source is expected target / source_size times, so before the k-th of a source (from 0) stand k times
    as many expected copies. To these running sums one random offset is added; a document is taken once for each whole
    number that its own share steps over. Documents go in the given order, best by size: then what is taken of a source
    misses its target by about one document at most. Positions come from in_order(), which no hot source slows down."""
    df = df.drop(*(c for c in df.columns if c.lower() in ("source_size", "target", "copies", "source_of")))
    [k] = fresh(df, "place_of")
    placed = in_order(df, [F.col(c) for c in order], [source], pos=k)
    b = by_source.select(F.col("source").alias("source_of"), "source_size", "target")
    joined = placed.join(b, placed[source].eqNullSafe(b["source_of"]), "left").drop("source_of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda n: F.floor(offset(F.col(source), seed) + rate * n)
    return joined.withColumn("copies", (upto(F.col(k) + 1) - upto(F.col(k))).cast("long")).drop(k)


def sizes(df: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(id, source, hash, size) of each document, written once: the hash tells texts apart, the size is a count of words."""
    return cut(df.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.xxhash64(text).alias("hash"), word_count(F.col(text)).alias("size")))


def mix(df: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns they came with.

    A null source is a source of its own; null or empty text has size 0, so a source of nothing else is not taken. Rows
    alike in id, source and text share their copies. Reruns agree; an empty table gives an empty mix."""
    slim = sizes(df, text, source, id_col)
    taken = copies(slim, cut(targets(slim)), ["size", "id", "hash"], seed=seed).groupBy("id", "source", "hash").agg(F.sum("copies").alias("copies"))
    h, no, n, *own = fresh(df, "hash_of", "no_of", "copies_of", "id_of", "source_of", "key_of")
    taken = taken.where("copies > 0").toDF(*own, n)
    hashed = df.withColumn(h, F.xxhash64(text))
    keys = [F.col(x).eqNullSafe(F.col(y)) for x, y in zip([id_col, source, h], own, strict=True)]
    alike = Window.partitionBy(id_col, source, h).orderBy(h)
    found = hashed.join(taken, keys).withColumn(no, F.row_number().over(alike)).where(F.col(no) == 1)
    return found.select(*df.columns, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias(no)).drop(no)


SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
b AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM b),
r AS (SELECT *, 3 * source_size AS most, 3 * source_size / weight AS ratio FROM w),
s AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER o, 0))::BIGINT / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::BIGINT AS share
      FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN ratio <= share THEN most::DOUBLE
             ELSE (SELECT arg_min(share, ratio) FROM s WHERE ratio > share) * weight END AS target FROM s),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
             ('0x' || substr(md5(coalesce(d.source, '') || ':0'), 1, 8))::BIGINT / 4294967296 AS u,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(u + rate * (k + 1)) - floor(u + rate * k)) * size)::BIGINT AS taken FROM p
"""
