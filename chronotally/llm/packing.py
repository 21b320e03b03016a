"""Packing: length buckets that waste the least padding, and batches of a token budget inside each bucket."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_order
from .mixing import word_count


@dataclass(frozen=True)
class Shape:
    """max_tokens: longer documents are cut into pieces of so many; budget: tokens of a batch, padding included."""

    max_tokens: int = 2048
    buckets: int = 12
    budget: int = 32768


def best_buckets(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most `buckets` length ranges with the least sum of padding, by dynamic programming.

    least[k][j] is the least padding of the first j lengths in k ranges; the last range holds lengths i..j-1 padded to
    lengths[j-1]. The cost is buckets * n^2 for n distinct lengths, which max_tokens bounds whatever the corpus."""
    if not lengths:
        return []
    order = np.argsort(lengths)
    size, n = np.array(lengths, dtype=float)[order], np.array(counts, dtype=float)[order]
    items, tokens = np.concatenate(([0.0], np.cumsum(n))), np.concatenate(([0.0], np.cumsum(n * size)))
    m = len(size)
    least, cuts = np.full(m + 1, np.inf), []
    least[0] = 0.0
    for _ in range(min(buckets, m)):
        after, cut_at = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int)
        after[0] = 0.0
        for j in range(1, m + 1):
            cost = least[:j] + size[j - 1] * (items[j] - items[:j]) - (tokens[j] - tokens[:j])
            cut_at[j] = int(np.argmin(cost))
            after[j] = cost[cut_at[j]]
        least = after
        cuts.append(cut_at)
    ends, j = [], m
    for cut_at in reversed(cuts):
        if j == 0:
            break
        ends.append(int(size[j - 1]))
        j = cut_at[j]
    return ends[::-1]


def pieces(df: DataFrame, tokens: Column, shape: Shape = Shape()) -> DataFrame:
    """One row for each piece of a document: piece (from 0), first (its first token) and length; a document of no token has one."""
    whole = F.greatest(F.lit(1), F.ceil(tokens / shape.max_tokens)).cast("int")
    out = df.select("*", tokens.cast("long").alias("n_tokens"), F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    first = F.col("piece").cast("long") * shape.max_tokens
    return out.withColumn("first", first).withColumn("length", F.least(F.lit(shape.max_tokens).cast("long"), F.col("n_tokens") - first))


def pack(df: DataFrame, text: str = "text", id_col: str = "doc_id", shape: Shape = Shape()) -> DataFrame:
    """(id, n_tokens, piece, first, length, bucket, bucket_length, batch, slot) for each piece of each document.

    A token is a word, and one more ends the document; null or empty text has that one. Batches of a bucket hold
    budget // bucket_length pieces, one at least, in an order that a hash of id and piece gives, and only a bucket's last
    batch may hold fewer. Rows that repeat are packed as often as they come; an empty table gives no pieces. Only the
    histogram of lengths, max_tokens rows at most, reaches the driver."""
    # counted once and written, as the histogram, the ranges and the places all read it
    counted = cut(df.select(F.col(id_col).alias(id_col), (word_count(F.col(text)) + 1).alias("tokens_")))
    cut_up = pieces(counted, F.col("tokens_"), shape).drop("tokens_")
    rows = cut_up.groupBy("length").count().collect()
    ends = best_buckets([r["length"] for r in rows], [r["count"] for r in rows], shape.buckets) or [shape.max_tokens]
    bucket = reduce(lambda a, e: a + (F.col("length") > e).cast("int"), ends[:-1], F.lit(0))
    filed = cut_up.withColumn("bucket", bucket).withColumn("bucket_length", F.get(F.array(*map(F.lit, ends)), F.col("bucket")).cast("long"))
    filed = filed.withColumn("mixed", F.xxhash64(id_col, "piece"))
    placed = in_order(filed, [F.col("mixed"), F.col(id_col), F.col("piece"), F.col("n_tokens")], ["bucket"], pos="at")
    room = F.greatest(F.lit(1), F.floor(F.lit(shape.budget) / F.greatest(F.lit(1), F.col("bucket_length")))).cast("long")
    placed = placed.withColumn("room", room)
    return placed.select(id_col, "n_tokens", "piece", "first", "length", "bucket", "bucket_length", F.expr("at div room").alias("batch"), (F.col("at") % F.col("room")).alias("slot"))
