"""I-Match fingerprints: hashes of a document's terms that lie in randomised subsets of a lexicon of middling frequency."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_WORD, cut


@dataclass(frozen=True)
class Band:
    """Terms in at least `low` and at most `high` of all documents (and in two at least) make up the lexicon; each of
    `subsets` lexicons keeps one in `thin` of them, chosen by a hash. The rates of `thin` take turns: the dense subsets
    tell short documents apart and the sparse ones survive edits of long ones. Documents of T distinct terms on average
    leave at most T / low terms in the lexicon, however many documents there are."""

    low: float = 0.005
    high: float = 0.1
    subsets: int = 24
    thin: tuple[int, ...] = (48, 192)
    seed: int = 7


#: A lexicon of more terms is joined by shuffling instead of being sent to every executor.
SENT = 200_000


def terms(text: Column) -> Column:
    """Distinct terms in lower case: runs of ASCII letters and digits and of all other code points beyond ASCII."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), NOT_WORD), ""))


def fit_lexicon(df: DataFrame, text: str = "text", band: Band = Band()) -> tuple[DataFrame, int]:
    """(term, mask) for the terms of the band that are in a subset, bit k of mask standing for subset k; and their number.

    Document frequencies are counted over all documents, summed up before they are shuffled."""
    n = df.count()
    each = df.select(F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    low, high = max(2.0, band.low * n), max(2.0, band.high * n)
    kept = each.groupBy("term").count().where(F.col("count").between(low, high))
    mask: Column = F.lit(0)
    for k in range(band.subsets):
        mask = mask + F.when(F.pmod(F.xxhash64("term", F.lit(band.seed * 1000 + k)), F.lit(band.thin[k % len(band.thin)])) == 0, 1 << k).otherwise(0)
    lexicon = cut(kept.select("term", mask.alias("mask")).where("mask <> 0"))
    return lexicon, lexicon.count()


def fingerprints(df: DataFrame, keys: list[str], texts: dict[str, str], lexicon: tuple[DataFrame, int], band: Band = Band()) -> DataFrame:
    """(keys, copies, and for each name in texts a struct name<sigs: array<string>, whole: string>) for rows told apart by
    keys; copies counts the rows that share them.

    sigs[k] hashes the sorted terms of the row's text texts[name] that are in subset k and is null if there are none;
    whole hashes the text. Null counts as empty. Where df is dealt by two of its key columns, no shuffle follows. All
    texts of a row are exploded together, each distinct term once, with a bit for each text that has it."""
    names = list(texts)
    bits = {name: 1 << i for i, name in enumerate(names)}
    whole = [F.lpad(F.hex(F.xxhash64(F.coalesce(F.col(c), F.lit("")))), 16, "0").alias(f"whole_{name}") for name, c in texts.items()]
    sets = df.select(*keys, *whole, *(terms(F.coalesce(F.col(c), F.lit(""))).alias(f"terms_{name}") for name, c in texts.items()))
    flagged = lambda found, flag: F.transform(found, lambda t: F.struct(t.alias("term"), F.lit(flag).alias("flag")))
    if len(names) == 2:
        a, b = (F.col(f"terms_{name}") for name in names)
        listed = [flagged(F.array_intersect(a, b), 3), flagged(F.array_except(a, b), 1), flagged(F.array_except(b, a), 2)]
    else:
        listed = [flagged(F.col(f"terms_{name}"), bits[name]) for name in names]
    # one more element, which no text has, keeps rows without any term of the lexicon
    here = F.concat(*listed, F.array(F.struct(F.lit("").alias("term"), F.lit(0).alias("flag"))))
    passed = [*keys, *(f"whole_{name}" for name in names)]
    each = sets.select(*passed, F.explode(here).alias("x")).select(*passed, "x.*")
    table, size = lexicon
    table = table.unionByName(table.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(0).alias("mask")))
    found = each.join(F.broadcast(table) if size <= SENT else table, "term")
    got = found.groupBy(*passed).agg(F.sort_array(F.collect_set(F.when(F.col("mask") != 0, F.struct("term", "mask", "flag")))).alias("got"), F.count_if(F.col("term") == "").alias("copies"))

    def sig(k: int, bit: int) -> Column:
        mine = F.filter("got", lambda x: (x["mask"].bitwiseAND(1 << k) != 0) & (x["flag"].bitwiseAND(bit) != 0))
        joined = F.array_join(F.transform(mine, lambda x: x["term"]), " ")
        return F.when(F.length(joined) > 0, F.substring(F.md5(joined), 1, 8))

    out = [F.struct(F.array(*(sig(k, bits[name]) for k in range(band.subsets))).alias("sigs"), F.col(f"whole_{name}").alias("whole")).alias(name) for name in names]
    return got.select(*keys, "copies", *out)


def text_of(fp: Column) -> Column:
    """A fingerprint as one string: its subsets' hashes, '.' for none; that of the whole text where no subset has a term."""
    sigs = F.array_join(fp["sigs"], "-", ".")
    return F.when(F.exists(fp["sigs"], lambda s: s.isNotNull()), sigs).otherwise(F.concat(F.lit("text-"), fp["whole"]))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among the subsets in which either has one; for texts without any, 1 if they are equal."""
    pairs = F.arrays_zip(a["sigs"].alias("a"), b["sigs"].alias("b"))
    seen = F.size(F.filter(pairs, lambda x: x["a"].isNotNull() | x["b"].isNotNull()))
    same = F.size(F.filter(pairs, lambda x: x["a"] == x["b"]))
    return F.when(seen > 0, same / seen).otherwise((a["whole"] == b["whole"]).cast("double"))


def _neighbours(rows: DataFrame) -> DataFrame:
    """(id, key, hash, n, and those of the row before: before_key, before_hash, before_n) of distinct (id, key, hash, n),
    in order of id (null last), then hash; before the first stands the last. Ranges are looked at by themselves; what
    passes between them is one row for each range."""
    order = [F.col("id").asc_nulls_last(), F.col("hash")]
    ranged = cut(rows.distinct().repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    me = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "key", "n")
    inside = Window.partitionBy("part").orderBy(*order)
    lasts = ranged.groupBy("part").agg(F.max(me).alias("last"))
    by_part = Window.partitionBy(F.lit(0)).orderBy("part")
    carry = lasts.select(F.col("part"), F.coalesce(F.lag("last").over(by_part), F.max("last").over(Window.partitionBy(F.lit(0)))).alias("carry"))
    before = F.coalesce(F.lag(me).over(inside), F.col("carry"))
    return ranged.join(F.broadcast(carry), "part").select("id", "key", "hash", "n", before.alias("b")).select("id", "key", "hash", "n", F.col("b.key").alias("before_key"), F.col("b.hash").alias("before_hash"), F.col("b.n").alias("before_n"))


def edited_pairs(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, key, hash, n, before_key, before_hash, text, edited): each text and one whose last floor(n / 4) code points are
    replaced by the first as many, or all, of the next document's, in order of id; after the last comes the first.

    Null text counts as empty. Rows alike in id and text are one document of that order, and each row gets its result.
    Texts are shuffled once, by id and hash; then only the heads that move to the document before are."""
    whole = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.xxhash64(whole).alias("hash"), whole.alias("text"))
    beside = cut(_neighbours(docs.select("id", "key", "hash", F.length("text").alias("n"))))
    # of the same three columns for both uses, so that Spark shuffles the texts once and reads them twice
    full = docs.select("key", "hash", "text").join(beside.hint("shuffle_hash"), ["key", "hash"])
    quarter = lambda n: F.floor(F.col(n) / 4).cast("int")
    head = full.select(F.col("before_key").alias("key"), F.col("before_hash").alias("hash"), F.substring(F.col("text"), F.lit(1), quarter("before_n")).alias("head"))
    joined = full.join(head.dropDuplicates(["key", "hash"]).hint("shuffle_hash"), ["key", "hash"])
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - quarter("n")), F.col("head"))
    return joined.select("id", "key", "hash", "n", "before_key", "before_hash", "text", edited.alias("edited"))
