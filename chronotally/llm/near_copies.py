"""Near copies: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, and one of each group that stays.

Sets that similar differ in about 15 % of a SimHash's bits, which no radius of a few bits covers, so the fingerprint is
longer than op4's and its Golay decoding is soft. A set's SimHash has GROUPS * 3 segments of 23 bits. Each segment is
decoded to the NEAREST codewords of the [23, 12] Golay code that agree best with the 23 sums whose signs are the bits, so a
bit that is nearly a tie costs little. Of a group's three segments pigeonhole leaves two right if one fails: every two of
them make keys of 24 bits, one for each choice of their codewords. Sets that share a key and differ in at most MAX_BITS bits
are candidates, and candidates are links only if the exact similarity of their sets says so. Sets, not documents, are
compared: documents of equal sets are one. tests/llm measures the recall of the keys against brute force.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh
from .simhash import SEED, codebook, components

SHINGLE, GROUPS, NEAREST = 5, 6, 2
SEGMENTS = 3 * GROUPS
BITS = 23 * SEGMENTS
LONGS = -(-BITS // 64)
#: A link's similarity is LEAST[0] / LEAST[1] at least. Of BITS bits such sets differ in 62.6 with a deviation of 7.3; five deviations more are let through.
LEAST, MAX_BITS = (4, 5), 99
_random = np.random.default_rng(SEED)
_MULTIPLIERS = _random.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _random.integers(0, 2**63, LONGS, dtype=np.uint64)
#: Fingerprints of one key are compared in blocks of about so many, and sets in blocks of about so many shingles.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 17
#: Up to so many rows are sent to all executors to find theirs.
SENT = 100_000
#: A worker remembers the hashes of so many words; then it starts anew.
MEMORY = 200_000
FP = [f"f{i}" for i in range(LONGS)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return out


_words = _Words()


def _mixed(z: np.ndarray) -> np.ndarray:
    """The shifts and multipliers of the SplitMix64 finalizer."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, of lower-cased words between ASCII white space; of SHINGLE words or fewer, the one of all."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out += hashes[i : i + n] * _MULTIPLIERS[i]
    return np.unique(_mixed(out))


def sums(hashes: np.ndarray) -> np.ndarray:
    """For each bit, by how many more shingles set it than don't."""
    ones = np.zeros(LONGS * 64, np.int64)
    for at in range(0, len(hashes), 255 * 16):  # so that a very long text's bits are never all held at once
        more = _mixed(hashes[at : at + 255 * 16, None] + _ADDED[None, :])
        for k in range(0, len(more), 255):  # of 255 rows a byte holds the sum
            bits = np.unpackbits(more[k : k + 255].view(np.uint8).reshape(-1, LONGS * 8), axis=1, bitorder="little")
            ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return (ones * 2 - len(hashes))[:BITS]


@cache
def _signs() -> np.ndarray:
    """Each codeword as 23 times +1 or -1, one in a column."""
    return np.ascontiguousarray((((codebook()[:, None] >> np.arange(23)) & 1) * 2.0 - 1).astype(np.float32).T)


def decoded(margins: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the NEAREST codewords of each segment, best first, of rows of sums."""
    out = []
    for at in range(0, len(margins), 64):
        score = margins[at : at + 64].reshape(-1, 23).astype(np.float32) @ _signs()
        row, best = np.arange(len(score)), []
        for _ in range(NEAREST):
            best.append(score.argmax(axis=1))
            score[row, best[-1]] = -np.inf
        out.append(np.stack(best, axis=1).reshape(-1, SEGMENTS, NEAREST))
    return np.concatenate(out) if out else np.zeros((0, SEGMENTS, NEAREST), np.int64)


def keys(near: np.ndarray) -> np.ndarray:
    """The keys of each row of decoded segments: the number of a pair of segments of one group, and a codeword of each."""
    out = []
    for g in range(GROUPS):
        for no, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
            both = near[:, 3 * g + i, :, None] << 12 | near[:, 3 * g + j, None, :]
            out.append((3 * g + no) << 24 | both.reshape(len(near), -1))
    return np.concatenate(out, axis=1).astype(np.int32)


def packed(margins: np.ndarray) -> np.ndarray:
    """The bits of each row of sums as LONGS signed 64-bit integers."""
    bits = np.zeros((len(margins), LONGS * 64), np.uint8)
    bits[:, :BITS] = margins > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def _key(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.iloc[at : at + 1000]
            margins, node, n = np.zeros((len(part), BITS), np.int32), [], []
            for i, t in enumerate(part["t"]):
                hashes = shingles(t)
                margins[i] = sums(hashes)
                node.append(_key(hashes))
                n.append(len(hashes))
            fp = packed(margins)
            found = {"id": part["id"].to_numpy(), "h": part["h"].to_numpy(), "node": node, "n": n, **{f: fp[:, i] for i, f in enumerate(FP)}}
            yield pd.DataFrame(found | {"keys": list(keys(decoded(margins)))})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 500):
            found = [shingles(t) for t in batch["t"].iloc[at : at + 500]]
            yield pd.DataFrame({"node": [_key(s) for s in found], "hashes": [s.view(np.int64) for s in found]})


def _sent(df: DataFrame) -> DataFrame:
    """df, marked to be sent to all executors if it has few rows, which are counted."""
    return F.broadcast(df) if df.count() <= SENT else df


def _may(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return F.least(n, m) * LEAST[1] >= F.greatest(n, m) * LEAST[0]


def _near(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether two rows of nodes are candidates."""
    bits = reduce(lambda x, y: x + y, (F.bit_count(a(f).bitwiseXOR(b(f))) for f in FP))
    return _may(a("n"), b("n")) & (bits <= MAX_BITS)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of nodes, those whose sets (node, hashes) are similar enough. Spark splits the join on an `a` of many pairs."""
    left, right = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(right.hint("shuffle_merge"), "b").join(left.hint("shuffle_merge"), "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * sum(LEAST) >= (F.size("x") + F.size("y")) * LEAST[0]).select("a", "b")


def _grouped(work: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """work() on each (key, place) of rows sorted by both; one of them is held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            k, p = batch["key"].to_numpy(), batch["place"].to_numpy()
            cuts = (np.flatnonzero((k[1:] != k[:-1]) | (p[1:] != p[:-1])) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if a == b:
                    continue
                now = (k[a], p[a])
                if now != last and held:
                    yield work(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0])
                    held = []
                held.append(batch.iloc[a:b])
                last = now
        if held:
            yield work(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0])

    return run


def _candidates(group: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """For each asking row its candidates among the others of another root."""
    root, n = group["root"].to_numpy(), group["n"].to_numpy()
    fp = np.stack([group[f].to_numpy() for f in FP], axis=1).view(np.uint64)
    for i in np.flatnonzero(group["asks"].to_numpy()):
        other = np.flatnonzero((root != root[i]) & (np.minimum(n, n[i]) * LEAST[1] >= np.maximum(n, n[i]) * LEAST[0]))
        yield i, other[np.bitwise_count(fp[other] ^ fp[i]).sum(axis=1) <= MAX_BITS]


def _close(group: pd.DataFrame) -> pd.DataFrame:
    """The rows of a group that are, or have, a candidate."""
    found = np.zeros(len(group), bool)
    for i, near in _candidates(group):
        if len(near):
            found[i] = found[near] = True
    return group.loc[found, ["key", "node", "root", "asks", "n", *FP]]


def _forest(group: pd.DataFrame) -> pd.DataFrame:
    """The links between asking and other rows that connect what all of them connect. Rows of one root are connected already."""
    node, hashes, out = group["node"].to_numpy(), group["hashes"].to_list(), []
    at = np.unique(group["root"].to_numpy(), return_inverse=True)[1]
    parent = np.arange(at.max() + 1)
    for i, near in _candidates(group):
        for j in near:
            if parent[at[i]] != parent[at[j]]:
                common = len(np.intersect1d(hashes[i], hashes[j], assume_unique=True))
                if common * sum(LEAST) >= (len(hashes[i]) + len(hashes[j])) * LEAST[0]:
                    parent[parent == parent[at[j]]] = parent[at[i]]
                    out.append((node[i], node[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _dealt(rows: DataFrame, weight: Column, block: int, more: DataFrame) -> DataFrame:
    """rows (key, node, asks, ...) joined with `more` by node and dealt by key into places of about `block` in weight on
    either side: an asking row of block i meets the rows of every block j in place i * blocks + j. Sorted by key and place.
    A key of one block has one place, 0, and meets no list of blocks."""
    sums = rows.groupBy("key").agg(F.sum(weight).alias("all"), F.sum(F.when(F.col("asks"), weight)).alias("ask")).where(F.col("all") > block)
    hot = cut(sums.select("key", *(F.ceil(F.greatest(F.lit(1), F.coalesce(c, F.lit(1))) / block).cast("int").alias(c) for c in ("all", "ask"))))
    if hot.isEmpty():
        dealt = rows.withColumn("place", F.lit(0)).join(more, "node")
        return dealt.repartition("key", "place").sortWithinPartitions("key", "place")
    listed = rows.join(_sent(hot), "key", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("all", "ask")})
    mine = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    of = lambda place, asks: F.struct(place.cast("int").alias("place"), F.lit(asks).alias("asks"))
    met = F.transform(F.sequence(F.lit(0), F.col("ask") - 1), lambda i: F.struct((i * F.col("all") + mine(F.col("all"))).cast("int").alias("place"), (F.col("asks") & (i == mine(F.col("ask")))).alias("asks")))
    # the asking row stands in its own block's place already, with that mark
    asked = F.when(F.col("asks"), F.filter(F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda j: of(mine(F.col("ask")) * F.col("all") + j, True)), lambda x: x["place"] != mine(F.col("ask")) * F.col("all") + mine(F.col("all"))))
    spread = F.concat(met, F.coalesce(asked, F.array().cast("array<struct<place:int,asks:boolean>>")))
    dealt = listed.select("key", *(c for c in rows.columns if c not in ("key", "asks")), F.inline(spread)).join(more, "node")
    return dealt.repartition("key", "place").sortWithinPartitions("key", "place")


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes (node, n, FP, keys, id, h), few enough and yet with the components of all candidates' links.

    Every key's nodes are compared with its least and its greatest one at once, which then leave the key; so does a key whose
    other nodes are all connected. That settles dense groups with one link a node, and small keys whole. In the keys that stay,
    the nodes outside of one component are compared with all others: their fingerprints in blocks, then the sets of those
    that have candidates. texts has (id, h, t), the documents to take sets from."""
    fps = nodes.select("node", "n", *FP)
    sets: DataFrame | None = None

    def with_sets_of(wanted: DataFrame) -> DataFrame:
        new = wanted.distinct() if sets is None else wanted.distinct().join(sets.select("node"), "node", "left_anti")
        rows = cut(nodes.join(new, "node", "left_semi").select(F.col("id").alias("id_"), F.col("h").alias("h_")))
        own = texts.join(_sent(rows), texts["id"].eqNullSafe(F.col("id_")) & (texts["h"] == F.col("h_")), "left_semi")
        more = cut(own.select("t").mapInPandas(_sets, "node long, hashes array<long>").dropDuplicates(["node"]))
        return more if sets is None else sets.unionByName(more)

    filed = nodes.select("node", F.explode("keys").alias("key"))
    ends = filed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last")
    rest = cut(filed.join(ends, "key"))
    of = lambda side: fps.select(*(F.col(c).alias(f"{side}_{c}") for c in fps.columns))
    inner = rest.where("node <> first and node <> last")
    star = lambda rows, centre: rows.where(F.col("node") != F.col(centre)).select(F.col(centre).alias("a"), F.col("node").alias("b"))
    pairs = star(rest, "first").union(star(inner, "last")).distinct()
    beside = pairs.join(of("b"), F.col("b") == F.col("b_node")).join(of("a"), F.col("a") == F.col("a_node"))
    stars = cut(beside.where(_near(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))).select("a", "b"))
    sets = with_sets_of(stars.select(F.col("a").alias("node")).union(stars.select("b")))
    near = cut(verified(stars, sets))
    root = components(near).select(F.col("node").alias("of"), F.col("root").alias("of_root"))
    left = inner.select("key", "node").join(root, F.col("node") == F.col("of"), "left").select("key", "node", F.coalesce("of_root", "node").alias("root"))
    mains = left.groupBy("key").agg(F.min("root").alias("main"), F.max("root").alias("other")).where("main <> other").drop("other")
    opened = cut(left.join(mains, "key").select("key", "node", "root", (F.col("root") != F.col("main")).alias("asks")))
    kinds = "key int, node long, root long, asks boolean, n int, " + ", ".join(f"{f} long" for f in FP)
    close = _dealt(opened, F.lit(1), BLOCK, fps).mapInPandas(_grouped(_close), kinds)
    # a row that asks in one place may be asked in others
    close = cut(close.groupBy("key", "node", "root", "n", *FP).agg(F.bool_or("asks").alias("asks")))
    sets = with_sets_of(close.select("node"))
    more = _dealt(close, F.col("n"), BLOCK_SHINGLES, sets).mapInPandas(_grouped(_forest), "a long, b long")
    return near.unionByName(cut(more.distinct()))


def dedupe(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One document of each component of near copies: the one of least id (null ids last), and of rows that share an id and
    a text, one. Texts without words, null included, are copies of one another; an empty table gives none. Text is read
    three times and only shuffled where more than SENT documents go."""
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))
    [kind] = fresh(df, "kind")
    kinds = df.select(F.col(id_col).alias(kind)).schema[0].dataType.simpleString()
    slim = cut(texts.mapInPandas(_signed, f"id {kinds}, h long, node long, n int, {', '.join(f'{f} long' for f in FP)}, keys array<int>"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("best")
    least = slim.groupBy("node").agg(best, *(F.first(c).alias(c) for c in ("n", *FP, "keys")))
    nodes = cut(least.select("node", "n", *FP, "keys", "best.id", "best.h"))
    found = components(links(nodes, texts)).select(F.col("node").alias("of"), "root")
    rooted = nodes.join(found, F.col("node") == F.col("of"), "left").select("node", "id", "h", F.coalesce("root", "node").alias("root"))
    stay = rooted.groupBy("root").agg(best).select(F.col("best.id").alias("id"), F.col("best.h").alias("h"))
    each = slim.groupBy("id", "h").agg(F.count("*").alias("rows"))
    goes = cut(each.join(stay.withColumn("stays", F.lit(True)), each["id"].eqNullSafe(stay["id"]) & (each["h"] == stay["h"]), "left").select(each["id"], each["h"], "rows", F.coalesce("stays", F.lit(False)).alias("stays")).where("rows > 1 or not stays"))
    return without(df, goes, text, id_col)


def without(df: DataFrame, goes: DataFrame, text: str, id_col: str) -> DataFrame:
    """df without the rows whose id and text hash are in goes (id, h, rows, stays); where those stay, one of the rows."""
    i, h, g, no = fresh(df, "id_of", "hash_of", "goes_of", "no_of")
    listed = goes.select(F.col("id").alias(i), F.col("h").alias(g), "stays")
    hashed = df.withColumn(h, F.xxhash64(F.col(text)))
    same = hashed[id_col].eqNullSafe(F.col(i)) & (F.col(h) == F.col(g))
    kept = hashed.join(_sent(listed), same, "left_anti").select(*df.columns)
    many = listed.where("stays")
    if many.isEmpty():
        return kept
    alike = Window.partitionBy(id_col, h).orderBy(h)
    once = hashed.join(_sent(many), same, "left_semi").withColumn(no, F.row_number().over(alike)).where(F.col(no) == 1).select(*df.columns)
    return kept.unionByName(once)
