"""Quality rules: repetition and length rules, and how far a document's histograms diverge from its language's.

All of it is built of DataFrame functions over one row at a time. The language references are sums over all documents
of a language, one row for each of the few languages that COMMON_WORDS lists and one for all others, so they become
literals of the second pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, computed, fresh, let, words

# Frequent function words, most frequent first.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "be", "by", "at", "from", "this"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo"],
}
#: Stands for all languages that COMMON_WORDS does not list, null included: they share one reference of character classes.
OTHER = ""
CLASSES = ["upper", "digit", "mark", "wide", "space", "small"]


@dataclass(frozen=True)
class Limits:
    """A distance is the square root of the Jensen-Shannon divergence in bits: 0 for equal histograms, 1 for disjoint ones."""

    min_words: int = 50
    max_repeat_percent: int = 50
    class_distance: float = 0.30
    class_min_chars: int = 400
    word_distance: float = 0.25
    word_min_words: int = 150


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, counted once each. Hashes show that a text has no such window;
    where they don't, the windows' words are compared, joined by a space, which no word holds."""
    n = F.size(w)
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, first, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])

    def by_sort(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(placed, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])), lambda x: x["i"])))

    def by_list(g: Column, found: Column) -> Column:
        return F.filter(F.transform(g, lambda h, i: F.when(F.array_contains(found, h), i)), lambda i: i.isNotNull())

    def repeats(g: Column) -> Column:
        twice = let(F.sort_array(g), lambda s: F.array_distinct(F.filter(s, lambda h, k: F.get(s, k - 1) == h)))
        # the same starts either way; a short list is searched faster than pairs are sorted
        return let(twice, lambda found: covered(F.when(F.size(found) <= 24, by_list(g, found)).otherwise(by_sort(g))))

    joined = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(joined, repeats)))


def _class_counts(text: Column, w: Column) -> list[Column]:
    """Code points by class, in the order of CLASSES: `wide` are those beyond ASCII, `space` ASCII white space and `small`
    what no other class takes, so the counts add up to the text's length."""
    n = F.length(text)
    upper, digit = (F.length(F.regexp_replace(text, f"[^{x}]+", "")) for x in ("A-Z", "0-9"))
    mark = F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]"))
    wide = F.when(F.octet_length(text) == n, 0).otherwise(F.length(F.regexp_replace(text, r"[\x00-\x7F]+", "")))
    space = n - F.length(F.array_join(w, ""))
    return [upper, digit, mark, wide, space, n - upper - digit - mark - wide - space]


def _common_counts(w: Column, lang: Column) -> Column:
    """How often each common word of the language stands in the text, and last how many words are none of them; null for other languages."""
    def counts(listed: list[str]) -> Column:
        each = lambda c: [F.size(c) - F.size(F.array_remove(c, k)) for k in listed]
        return let(F.filter(w, lambda x: x.isin(listed)), lambda c: F.array(*(n.cast("long") for n in [*each(c), F.size(w) - F.size(c)])))

    out = F.lit(None).cast("array<bigint>")
    for code, listed in COMMON_WORDS.items():
        out = F.when(lang == code, counts(listed)).otherwise(out)
    return out


def histograms(text: Column, w: Column, lang: Column) -> list[Column]:
    whole = F.coalesce(text, F.lit(""))
    return [F.array(*(c.cast("long") for c in _class_counts(whole, w))).alias("classes"), _common_counts(w, lang).alias("common")]


def features(df: DataFrame, text: str = "text", lang: str = "lang", out: str = "quality") -> DataFrame:
    """Adds a struct `out`, in place of a column of that name, of what the rules look at: counts, and the two histograms."""
    columns, whole = [c for c in df.columns if c.lower() != out.lower()], F.coalesce(F.col(text), F.lit(""))
    w, repeat = fresh(df, "words_of", "n_repeat_")
    df = df.withColumn(w, words(whole)).withColumn(repeat, _repeat_words(F.col(w)).cast("long"))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(NOT_SPACE))
    got = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(F.col(w), "")).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.col(repeat).alias("n_repeat_words"),
        F.length(whole).cast("long").alias("n_chars"),
        F.col(lang).alias("lang"),
        *histograms(F.col(text), F.col(w), F.col(lang)),
    )
    [name] = fresh(df, out)
    return computed(df, name, got).select(*columns, F.col(name).alias(out))


def _group(lang: Column) -> Column:
    return F.when(lang.isin(list(COMMON_WORDS)), lang).otherwise(OTHER)


def references(df: DataFrame, quality: str = "quality") -> dict[str, tuple[list[float] | None, list[float] | None]]:
    """Shares of character classes and of common words over all documents of each language that COMMON_WORDS has, and of
    character classes over those of all other languages together, from columns classes, common and lang of the struct
    `quality`. One grouped sum of one row for each listed language and one more."""
    k, q = len(CLASSES), lambda name: F.col(f"{quality}.{name}")
    sums = [F.sum(F.get(q("classes"), F.lit(i))).alias(f"c{i}") for i in range(k)]
    sums += [F.sum(F.get(q("common"), F.lit(i))).alias(f"w{i}") for i in range(1 + max(map(len, COMMON_WORDS.values())))]
    out = {}
    for row in df.groupBy(_group(q("lang")).alias("lang")).agg(*sums).collect():
        both = []
        for part in (row[1 : 1 + k], row[1 + k :]):
            full = sum(x or 0 for x in part)
            both.append([(x or 0) / full for x in part] if full else None)
        out[row["lang"]] = tuple(both)
    return out


def fit_references(df: DataFrame, text: str = "text", lang: str = "lang") -> dict:
    """references() straight from documents, without the dearer counts."""
    slim = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).withColumn("w", words(F.col("text")))
    return references(computed(slim, "quality", F.struct("lang", *histograms(F.col("text"), F.col("w"), F.col("lang")))).select("quality"))


def _distance(counts: Column, share: Column) -> Column:
    """Jensen-Shannon distance of a histogram of counts from one of shares; null if either is null or empty."""
    term = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def apart(total: Column) -> Column:
        each = F.zip_with(counts, share, lambda c, q: let(c / total, lambda p: term(p, (p + q) / 2) + term(q, (p + q) / 2)))
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / 2))

    return let(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), lambda n: F.when(n > 0, apart(n)))


def judge(df: DataFrame, references: dict, limits: Limits = Limits(), quality: str = "quality") -> DataFrame:
    """Replaces the struct of features() by one of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    class_distance, word_distance, base_failed and kept.

    Null text counts as empty (no words, so rejected). A document whose language is null or not listed is judged by its
    character classes against those of all such documents together, not by words; one too short for a histogram to mean
    much is judged by the base rules alone. Rows are judged one by one: repeated rows get equal verdicts, an empty table
    gives an empty one, and columns of any other name stay as they are."""
    q = lambda name: F.col(f"{quality}.{name}")

    def share(i: int) -> Column:
        out = F.lit(None).cast("array<double>")
        for code, both in references.items():
            if both[i]:
                out = F.when(_group(q("lang")) == code, F.array(*map(F.lit, both[i]))).otherwise(out)
        return out

    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    far = F.struct(
        *(q(c).alias(c) for c in counts),
        F.when(q("n_chars") >= limits.class_min_chars, _distance(q("classes"), share(0))).alias("class_distance"),
        F.when(q("n_words") >= limits.word_min_words, _distance(q("common"), share(1))).alias("word_distance"),
        ((q("n_words") < limits.min_words) | (100 * q("n_repeat_words") > limits.max_repeat_percent * q("n_words"))).alias("base_failed"),
    )
    df = df.withColumn(quality, far)
    near = (F.coalesce(q("class_distance"), F.lit(0.0)) <= limits.class_distance) & (F.coalesce(q("word_distance"), F.lit(0.0)) <= limits.word_distance)
    return df.withColumn(quality, F.col(quality).withField("kept", ~q("base_failed") & near))


def filter_documents(df: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that the rules keep, with the columns they came with. Text is read twice, once for the references."""
    [out] = fresh(df, "quality")
    return judge(features(df, text, lang, out), fit_references(df, text, lang), limits, out).where(F.col(f"{out}.kept")).drop(out)
