"""Balanced label propagation: linked documents move to the shard of their neighbours, and shards stay even."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_order


def _quotas(wanted: Mapping[tuple[int, int], int], linked: list[int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many documents may move from shard s to t: what moves the other way makes place, and free places are dealt out."""
    shards, out = range(len(linked)), {}
    for t in shards:
        free = room[t] - linked[t]
        for s in shards:
            if s != t:
                swap = min(wanted.get((s, t), 0), wanted.get((t, s), 0))
                more = min(free, wanted.get((s, t), 0) - swap)
                free -= more
                out[s, t] = swap + more
    return out


def propagate(cells: DataFrame, room: list[int]) -> DataFrame:
    """Rounds of label propagation over cells (g, shard, n): n linked documents of group g stand in a shard.

    All members of a group are neighbours, and those in one shard are alike, so a cell moves as one. Each round every
    group names the shard that holds most of it (ties by hash); its other cells ask to move there. The number of
    requests from each shard to each other, shards^2 numbers, comes to the driver, which grants quotas so that no shard
    gets more linked documents than it has room for. Requests are granted in a fixed order until the quota is used up,
    the last one in part. Cells are summed and written to the checkpoint folder each round. Ends when nothing may move:
    a round uses up the swaps of each pair of shards and the free places, each document that moves joins the shard that
    its group has most of, and no such shard is given up, so the rounds come to an end, and mostly after two or three.
    Requests that go round in a circle of three shards or more are not granted, so a group may stay cut; see left_cut()."""
    spark, shards = cells.sparkSession, range(len(room))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        best = cells.groupBy("g").agg(F.max(F.struct("n", F.xxhash64("g", "shard").alias("tie"), F.col("shard").alias("to"))).alias("best")).select("g", F.col("best.to").alias("to"))
        asked = cut(cells.join(best, "g").withColumn("part", F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int")))
        held = {(r["shard"], r["to"]): r["n"] for r in asked.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        linked = [sum(n for (s, _), n in held.items() if s == k) for k in shards]
        wanted = {k: n for k, n in held.items() if k[0] != k[1]}
        quota = {k: n for k, n in _quotas(wanted, linked, room).items() if n}
        if not quota:
            return cells
        moving = F.col("shard") != F.col("to")
        by_part = asked.where(moving).groupBy("shard", "to", "part").agg(F.sum("n").alias("n"))
        earlier = Window.partitionBy("shard", "to").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        carry = by_part.select("shard", "to", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carry"))
        inside = Window.partitionBy("shard", "to", "part").orderBy(F.desc("n"), "g").rowsBetween(Window.unboundedPreceding, -1)
        granted: Column = F.lit(0)
        for (s, t), n in quota.items():
            granted = F.when((F.col("shard") == s) & (F.col("to") == t), n).otherwise(granted)
        # carry has a row for each pair of shards and each of `buckets` parts, whatever the number of groups
        placed = asked.where(moving).join(F.broadcast(carry), ["shard", "to", "part"]).withColumn("before", F.col("carry") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
        goes = F.least(F.col("n"), F.greatest(F.lit(0), granted - F.col("before")))
        split = placed.withColumn("goes", goes).select("g", F.explode(F.array(F.struct(F.col("to").alias("shard"), F.col("goes").alias("n")), F.struct(F.col("shard").alias("shard"), (F.col("n") - F.col("goes")).alias("n")))).alias("c")).select("g", "c.*")
        stay = asked.where(~moving).select("g", "shard", "n")
        cells = cut(stay.unionByName(split.where("n > 0")).groupBy("g", "shard").agg(F.sum("n").alias("n")))


def left_cut(cells: DataFrame, room: list[int]) -> int:
    """How many groups stand in more than one shard although one shard could hold them."""
    return cells.groupBy("g").agg(F.count("*").alias("cells"), F.sum("n").alias("n")).where((F.col("cells") > 1) & (F.col("n") <= max(room))).count()


def assign(df: DataFrame, shards: int = 8, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, size, crc32, shard, slot) for each row; counts of rows differ by one at most between shards.

    Documents of equal text are linked, null counting as empty. Rows start in ranges of ids, linked ones move by
    propagate(), and rows without links fill the shards up. A group too large for a shard fills one and goes on in
    others. Members take their group's places in order of ids (null last). Slots count from 0 in that order too. Rows
    that repeat are placed one by one; an empty table gives none."""
    whole = F.coalesce(F.col(text), F.lit(""))
    slim = cut(df.select(F.col(id_col).alias("id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("crc32"), F.unhex(F.sha2(whole, 256)).alias("text_key")))
    total = slim.count()
    room = [total // shards + (k < total % shards) for k in range(shards)]
    ids = [F.col("id").asc_nulls_last(), F.col("text_key")]
    first = in_order(slim, ids, pos="no").withColumn("shard", F.floor(F.col("no") * shards / max(total, 1)).cast("int"))
    cells = cut(first.groupBy(F.col("text_key").alias("g"), "shard").agg(F.count("*").alias("n")))
    linked = cut(cells.groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g"))
    cells = propagate(cells.join(linked, "g").select("g", "shard", "n"), room)
    # places of a group: its first n members, in order, go to its first cell, and so on; a group has `shards` cells at most
    after = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = cells.select("g", F.col("shard").alias("to"), F.coalesce(F.sum("n").over(after), F.lit(0)).alias("lo"), "n")
    by_group = places.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("lo", "to"))).alias("cells"))
    known = slim.join(by_group, slim["text_key"] == by_group["g"], "left").withColumn("key", F.when(F.col("cells").isNotNull(), F.col("text_key")))
    ranked = in_order(known.drop("g"), ids, ["key"], pos="rank")
    used = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    ends = list(accumulate(room[k] - used.get(k, 0) for k in range(shards)))
    free = F.lit(shards - 1)
    for k in reversed(range(shards - 1)):
        free = F.when(F.col("rank") < ends[k], F.lit(k)).otherwise(free)
    of_group = F.element_at(F.filter("cells", lambda c: c["lo"] <= F.col("rank")), -1)["to"]
    placed = ranked.withColumn("shard", F.when(F.col("cells").isNull(), free).otherwise(of_group)).drop("cells", "rank", "key")
    return in_order(placed, ids, ["shard"], pos="slot").select(F.col("id").alias(id_col), "size", "crc32", "shard", "slot")
