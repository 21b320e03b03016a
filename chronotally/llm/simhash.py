"""SimHash near-duplicates: fingerprints, Golay-code keys, links between fingerprints and their components.

Fingerprints differ in at most MAX_BITS of 64 bits. The bits are cut into segments of 23, 23 and 18 (the last filled up
with zeros to 23). Of 3 errors, pigeonhole leaves two shapes:

* some segment has none, and then another has one at most: keys join the exact segment i with segment j's codewords;
* each segment has exactly one: keys join the codewords of the first two.

Codewords are those of the perfect [23, 12] Golay code. Each word lies within 3 errors of exactly one codeword, so if two
words differ in one bit, the codeword next to the one lies within 4 of the other. A fingerprint is thus filed under every
codeword within 4 (6 for most words, else 1) and asks with its nearest one alone; 12 bits index a codeword.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import cut, fresh

BITS, MAX_BITS, SHINGLE, SEED = 64, 3, 3, 42
SEGMENTS = [(0, 23), (23, 23), (46, 18)]
GENERATOR = 0b101011100011
#: How many fingerprints of one key are compared with one another at once; larger groups are compared block by block.
BLOCK = 4096
#: Up to so many fingerprints of one key are compared together with other keys' in one go.
SMALL = 64


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text: of 64 bits, those set in more than half of its shingles' hashes; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # so that the bits of a very long text are never all unpacked at once
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((ones * 2 > len(hashes)) @ (np.uint64(1) << np.arange(BITS, dtype=np.uint64)))


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    """As signed 64-bit integers, which Spark has."""
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    return df.withColumn(out, _fingerprints(F.col(text)))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: the error patterns of up to 4 bits that have it, nearest first and filled up with the first; and how many there are."""
    from itertools import combinations

    def syndrome(word: int) -> int:
        for shift in range(11, -1, -1):
            if word >> (shift + 11) & 1:
                word ^= GENERATOR << shift
        return word

    one = [syndrome(1 << i) for i in range(23)]
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for at in combinations(range(23), weight):
            s = 0
            for i in at:
                s ^= one[i]
            found[s].append(sum(1 << i for i in at))
    most = max(map(len, found))
    return np.array([x + [x[0]] * (most - len(x)) for x in found], np.uint32), np.array([len(x) for x in found])


@cache
def _remainders() -> np.ndarray:
    """The syndrome of the upper 12 bits of a word."""
    out = np.zeros(1 << 12, np.uint32)
    for top in range(1 << 12):
        word = top << 11
        for shift in range(11, -1, -1):
            if word >> (shift + 11) & 1:
                word ^= GENERATOR << shift
        out[top] = word
    return out


def codebook() -> np.ndarray:
    """The 4096 codewords, each at its index."""
    top = np.arange(1 << 12)
    return top << 11 | _remainders()


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within 4 errors of each 23-bit word, nearest first; and how many there are."""
    patterns, n = _golay()
    s = _remainders()[words >> 11] ^ (words & 2047)
    return (words[:, None] ^ patterns[s]) >> 11, n[s]


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, asks) for every key of each unsigned fingerprint; asks is True for the one key of its kind that it asks with."""
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.uint32) for at, width in SEGMENTS]
    near = [codewords(p) for p in parts]
    rows, out, asks = [], [], []
    index = np.arange(len(fps))

    def add(kind: int, columns: list[np.ndarray], valid: np.ndarray, first: np.ndarray) -> None:
        value = np.full(valid.shape, kind, np.uint64)
        for bits, c in columns:
            value = (value << np.uint64(bits)) | c.astype(np.uint64)
        rows.append(np.broadcast_to(index[:, None], valid.shape)[valid])
        out.append(value[valid])
        asks.append(np.broadcast_to(first, valid.shape)[valid])

    most = near[0][0].shape[1]
    place = np.arange(most)
    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                add(kind, [(23, np.broadcast_to(parts[i][:, None], near[j][0].shape)), (12, near[j][0])], place < near[j][1][:, None], place == 0)
                kind += 1
    a, b = (np.repeat(np.arange(most), most), np.tile(np.arange(most), most))
    valid = (a < near[0][1][:, None]) & (b < near[1][1][:, None])
    add(kind, [(12, near[0][0][:, a]), (12, near[1][0][:, b])], valid, (a == 0) & (b == 0))
    return np.concatenate(rows), np.concatenate(out), np.concatenate(asks)


def _filed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 20_000):
            fps = batch["fp"].to_numpy()[at : at + 20_000].view(np.uint64)
            rows, key, asks = keys(fps)
            yield pd.DataFrame({"key": key.view(np.int64), "fp": fps[rows].view(np.int64), "asks": asks})


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what links of at most MAX_BITS connect among the fingerprints asked with (a) and filed (b)."""
    nodes = np.union1d(a, b)
    parent = np.arange(len(nodes))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    ia, ib = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        x, y = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= MAX_BITS)
        for i, j in zip(ia[at : at + step][x].tolist(), ib[y].tolist(), strict=True):
            p, q = root(i), root(j)
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads rows (key, block, fp, asks) sorted by key and block; yields edges. One (key, block) pair is held at a time."""

    def edges(frame: pd.DataFrame, last: bool) -> tuple[np.ndarray, pd.DataFrame]:
        k, c = frame["key"].to_numpy(), frame["block"].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]) | (c[1:] != c[:-1])) + 1
        bounds = np.concatenate(([0], cuts, [len(frame)]))
        done = bounds if last else bounds[:-1]
        end = done[-1]
        fp, asks, files = frame["fp"].to_numpy()[:end].view(np.uint64), frame["asks"].to_numpy()[:end], frame["files"].to_numpy()[:end]
        sizes, out = np.diff(done), [np.zeros((0, 2), np.uint64)]
        small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
        start, size = np.repeat(done[:-1], sizes), np.repeat(sizes, sizes)
        asking = np.flatnonzero(small & asks)
        for at in range(0, len(asking), 20_000):
            x = asking[at : at + 20_000]
            n = size[x]
            y = np.repeat(start[x] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            x = np.repeat(x, n)
            near = (fp[x] != fp[y]) & files[y] & (np.bitwise_count(fp[x] ^ fp[y]) <= MAX_BITS)
            out.append(np.stack([fp[x[near]], fp[y[near]]], axis=1))
        for i in np.flatnonzero(sizes > SMALL):
            here = slice(done[i], done[i + 1])
            if asks[here].any():
                out.append(np.array(_forest(np.unique(fp[here][asks[here]]), np.unique(fp[here][files[here]])), dtype=np.uint64).reshape(-1, 2))
        return np.concatenate(out), frame.iloc[end:]

    def told(found: np.ndarray) -> Iterator[pd.DataFrame]:
        if len(found):
            yield pd.DataFrame(found.view(np.int64), columns=["a", "b"])

    rest = None
    for batch in batches:
        rest = batch if rest is None or not len(rest) else pd.concat([rest, batch], ignore_index=True)
        found, rest = edges(rest, False)
        yield from told(found)
    if rest is not None and len(rest):
        yield from told(edges(rest, True)[0])


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, few enough and yet with the components of all links.

    fps has one distinct column, fp. Rows of a key that many share are dealt to blocks of about BLOCK rows, and every pair
    of blocks meets in one place, so no task holds more than two blocks and no pair is left out."""
    filed = fps.mapInPandas(_filed, "key long, fp long, asks boolean")
    sizes = filed.groupBy("key").count().where(F.col("count") > 1)
    hot = sizes.where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    n = cut(hot)
    listed = filed.join(F.broadcast(n) if n.count() <= 100_000 else n, "key", "left")
    mine = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
    k = F.coalesce("blocks", F.lit(1))
    # an asking row of block i meets the filed rows of every block j in place i * blocks + j
    asked = F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct((mine * k + j).alias("block"), F.lit(True).alias("asks"), (j == mine).alias("files"))))
    met = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct((i * k + mine).alias("block"), F.lit(False).alias("asks"), F.lit(True).alias("files")))
    single = F.array(F.struct(F.lit(0).alias("block"), F.col("asks").alias("asks"), F.lit(True).alias("files")))
    spread = F.when(k == 1, single).otherwise(F.concat(F.coalesce(asked, F.array().cast("array<struct<block:int,asks:boolean,files:boolean>>")), met))
    dealt = listed.select("key", "fp", F.inline(spread)).repartition("key", "block").sortWithinPartitions("key", "block")
    return dealt.select("key", "block", "fp", "asks", "files").mapInPandas(_linked, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node that links lead to.

    Large-star and small-star steps in turn, each written to the checkpoint folder, until nothing changes. A node with very
    many neighbours loses them to its least neighbour in the first step; sums and least values are formed before shuffling."""
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        m = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(m, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        pairs = cut(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def roots(fps: DataFrame) -> DataFrame:
    """(fp, root) for each distinct fingerprint of the one column fp: equal roots for fingerprints that links connect."""
    found = components(links(fps)).select(F.col("node").alias("fp"), "root")
    return fps.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def cluster(df: DataFrame, fp: str = "fingerprint", id_col: str = "doc_id", out: str = "component_id") -> DataFrame:
    """Adds `out`: the least id among the documents that links of at most MAX_BITS bits reach, the row itself included.

    Equal fingerprints, zero for texts without words included, link; they are compared once, as one. Null ids are left
    out of the least; where all ids are null so is the result. Repeated rows get equal results; an empty table, none. A
    column named `out` is replaced.
    df is read more than once: give it written rows, not a plan that computes fingerprints."""
    own = cut(df.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("least")))
    root = cut(roots(own.select("fp")))
    least = own.join(root, "fp").groupBy("root").agg(F.min("least").alias("least"))
    k, v = fresh(df, "fp_of", "least_of")
    best = root.join(least, "root").select(F.col("fp").alias(k), F.col("least").alias(v))
    return df.join(best, F.col(fp) == F.col(k), "left").select(*(c for c in df.columns if c.lower() != out.lower()), F.col(v).alias(out))


def dedupe(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One document of each component: the one of least id (null ids last), and of rows that share an id and a text, one.

    Text is hashed once and shuffled once, by id and hash, to meet the few that stay."""
    slim = cut(with_fingerprint(df.select(F.col(id_col).alias("id"), F.col(text).alias("t")), "t", "fp").select("id", F.xxhash64("t").alias("h"), "fp"))
    root = roots(cut(slim.select("fp").distinct()))
    # the least of each fingerprint first, so that no root gathers all rows of a large group
    of_fp = slim.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "h")).alias("best"))
    return keep_least(df, of_fp.join(root, "fp").groupBy("root").agg(F.min("best").alias("best")), text, id_col)


def keep_least(df: DataFrame, best: DataFrame, text: str, id_col: str) -> DataFrame:
    """The rows of df whose id and text hash are in best (struct<id,h>); of rows that share both, one."""
    fp, h, no = fresh(df, "fp_of", "hash_of", "no_of")
    stay = best.select(F.col("best.id").alias(fp), F.col("best.h").alias("h"))
    hashed = df.withColumn(h, F.xxhash64(F.col(text)))
    kept = hashed.join(stay, hashed[id_col].eqNullSafe(stay[fp]) & (hashed[h] == stay["h"]), "left_semi")
    alike = Window.partitionBy(id_col, h).orderBy(h)
    return kept.withColumn(no, F.row_number().over(alike)).where(F.col(no) == 1).select(*df.columns)
