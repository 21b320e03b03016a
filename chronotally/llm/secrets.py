"""Secret scans: known shapes, and windows of high Shannon entropy inside candidate strings.

Everything is an expression over one row, so a scan is one pass without a shuffle and a text of any length is scanned whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, with_column

# The base shapes, as (kind, pattern of a match, group that counts, code points it needs).
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: Where none of these match no base shape is found; the last two say the same as their shape and its length.
GATES = [BASE[0][1], r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}"]
# Words that mark examples.
MARKERS = "(?i:0123456789|abcdefgh|example|sample|dummy|placeholder|changeme|xxxxxx)"
#: Candidates: runs of the characters that encoded keys use, without the parts between / _ and - that hold a marking word.
_PART = "[A-Za-z0-9+]"
CANDIDATE, WINDOW = rf"(?<!{_PART})(?=[A-Za-z0-9+/_-]{{20}})(?:(?!(?<!{_PART}){_PART}*{MARKERS})[A-Za-z0-9+/_-]){{20,}}+={{0,2}}", 20
# Character classes of a candidate, as (class, pattern of the whole, bits a window of 20 characters must exceed).
# A uniform choice of 16, 36 and 64 symbols gives windows of about 3.4, 3.9 and 4.1 bits.
CLASSES = [("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 2.9), ("base32", r"^(?:[0-9a-z]+|[0-9A-Z]+)={0,2}$", 3.4), ("base64", r"", 3.7)]
#: Letters that look like words: up to three, or capitals and lower-case runs of two or more in camelCase, short words of one included.
_SHORT = "(?:Am|An|As|At|Be|By|Db|Do|Go|He|Id|If|In|Io|Ip|Is|It|Js|Me|My|No|Of|Ok|On|Or|So|To|Ui|Up|Us|We)(?![a-z])"
_WORDS = rf"(?:[A-Za-z]{{1,3}}+(?![A-Za-z])|(?:[a-z](?=[A-Z]))?+(?:[a-z]{{2,}}+|[A-Z](?![a-z])|[A-Z][a-z]{{2,}}+|{_SHORT})*+(?![A-Za-z]))"
# A candidate is let through if it is a UUID, or has nothing but words and counts of up to four digits between
# separators, words being of two letters or more where there are counts. ODD finds a part that is neither.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ODD = rf"(?<![A-Za-z0-9])(?!(?:{_WORDS}|[0-9]{{1,4}}+)(?![A-Za-z0-9]))[A-Za-z0-9]"
COUNT, LETTER = "[0-9]", "(?<![A-Za-z0-9])[A-Za-z](?![A-Za-z0-9])"
ENTROPY = "entropy"
KINDS = [k for k, *_ in BASE] + [ENTROPY]
SPAN = "array<struct<start:int,rank:int,end:int,bits:double>>"


def places(text: Column, pattern: str | Column, keep: Callable[[Column], Column]) -> Column:
    """struct<start,end,match> of the leftmost non-overlapping matches for which keep(match) holds, in code points."""
    pattern = pattern if isinstance(pattern, Column) else F.lit(pattern)
    both = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(F.coalesce(x["hit"], F.lit("")))
        here = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.when(x["hit"].isNotNull() & keep(x["hit"]), F.concat(a["found"], F.array(here))).otherwise(a["found"]).alias("found"))

    return F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda a: a["found"])


def window_entropy(s: Column) -> Column:
    """The most bits per character that a window of WINDOW characters of s, all of them ASCII, has.

    Counts of the window's characters are kept up to date: each step adds one character and, once the window is full,
    takes one away; of the sum of c * log2(c) over the counts only those two terms change. The counts are a string with
    one place for each character, whose code is the count and 32 more: to replace one costs no walk over the others."""
    term = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    codes = F.transform(F.filter(F.split(s, ""), lambda x: x != ""), F.ascii)
    held = lambda n, code: F.ascii(F.substring(n, code + 1, F.lit(1))) - 32
    put = lambda n, code, count: F.overlay(n, F.char(count + 32), code + 1, F.lit(1))

    def step(c: Column):
        def one(a: Column, i: Column) -> Column:
            new, old = F.get(c, i), F.get(c, i - WINDOW)

            def full(x: Column) -> Column:
                less = held(a["n"], old)
                kept = put(a["n"], old, less - 1)
                more = held(kept, new)
                return F.struct(put(kept, new, more + 1).alias("n"), (x + term(less - 1) - term(less) + term(more + 1) - term(more)).alias("sum"))

            def filling(x: Column) -> Column:
                more = held(a["n"], new)
                return F.struct(put(a["n"], new, more + 1).alias("n"), (x + term(more + 1) - term(more)).alias("sum"))

            same = (i >= WINDOW) & (new == old)
            now = F.when(same, F.struct(a["n"].alias("n"), a["sum"].alias("sum"))).when(i >= WINDOW, full(a["sum"])).otherwise(filling(a["sum"]))
            bits = lambda x: F.log2(F.lit(float(WINDOW))) - x["sum"] / WINDOW
            most = lambda x: F.when((i >= WINDOW - 1) & (bits(x) > a["most"]), bits(x)).otherwise(a["most"])
            return let(now, lambda x: F.struct(x["n"].alias("n"), x["sum"].alias("sum"), most(x).alias("most")))

        return one

    start = F.struct(F.repeat(F.lit(" "), F.lit(128)).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("most"))
    return let(codes, lambda c: F.aggregate(F.sequence(F.lit(0), F.size(c) - 1), start, step(c), lambda a: a["most"]))


def _entropy_places(text: Column) -> Column:
    allowed = lambda s: s.rlike(UUID) | ~(s.rlike(ODD) | (s.rlike(COUNT) & s.rlike(LETTER)))

    def limit(s: Column) -> Column:
        out = F.lit(CLASSES[-1][2])
        for _, pattern, bits in reversed(CLASSES[:-1]):
            out = F.when(s.rlike(pattern), F.lit(bits)).otherwise(out)
        return out

    scored = lambda found: F.transform(found, lambda x: F.struct(x["start"], x["end"], window_entropy(x["hit"]).alias("bits"), limit(x["hit"]).alias("limit")))
    return F.filter(scored(places(text, CANDIDATE, lambda s: ~allowed(s))), lambda x: x["bits"] > x["limit"])


def scan(text: Column) -> Column:
    """All detections in a text, as array<struct<start,rank,end,bits>>: rank is the place in KINDS, bits is null for base
    shapes. Sorted by start, then rank. Null text counts as empty. An entropy detection inside a base one is left out;
    base detections always stay."""
    whole = F.coalesce(text, F.lit(""))
    none = F.array().cast(SPAN)
    base = []
    for rank, ((_, pattern, group, least), gate) in enumerate(zip(BASE, GATES, strict=True)):
        found = F.transform(places(whole, pattern, _long_enough(pattern, group, least)), _ranked(rank))
        base.append(F.when(whole.rlike(gate), found).otherwise(none))

    def with_entropy(b: Column) -> Column:
        inside = lambda x: F.exists(b, lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]))
        more = F.transform(F.filter(_entropy_places(whole), lambda x: ~inside(x)), lambda x: F.struct(x["start"].alias("start"), F.lit(len(BASE)).alias("rank"), x["end"].alias("end"), x["bits"].alias("bits")))
        return F.sort_array(F.concat(b, F.when(whole.rlike(CANDIDATE), more).otherwise(none)))

    return let(F.concat(*base), with_entropy)


def _long_enough(pattern: str, group: int, least: int):
    return lambda s: F.length(F.regexp_extract(s, pattern, group) if group else s) >= least


def _ranked(rank: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(None).cast("double").alias("bits"))


def written(spans: Column) -> Column:
    """kind:start:end of each detection, comma-joined in their order."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def detect(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Adds the detections as column `out`, in place of one that has its name; other columns, whatever their nulls, stay as
    they are. Null and empty texts have none, repeated rows agree, and an empty table gives none."""
    return with_column(df, out, scan(F.col(text)))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every detection replaced by `mark`; detections that overlap or touch become one."""
    first = F.struct(F.lit(1).alias("at"), F.lit(False).alias("in"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, x: Column) -> Column:
        joined = F.lit(1) + x["start"] <= a["at"]
        gap = F.substring(text, a["at"], x["start"] + 1 - a["at"])
        parts = F.when(joined & a["in"], a["parts"]).otherwise(F.concat(a["parts"], F.array(F.when(joined, F.lit("")).otherwise(gap), F.lit(mark))))
        return F.struct(F.greatest(a["at"], x["end"] + 1).alias("at"), F.lit(True).alias("in"), parts.alias("parts"))

    def joined(a: Column) -> Column:
        return F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"], F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, first, step, joined))


def redact_documents(df: DataFrame, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """The documents with secrets masked, all of them, with the columns they came with; null text stays null. Where
    n_chars names a column, it becomes the length of the new text for the documents that change."""
    [found] = fresh(df, "secrets")
    hit = F.size(found) > 0
    out = detect(df, text, found).withColumn(text, F.when(hit, redact(F.col(text), F.col(found))).otherwise(F.col(text)))
    if n_chars:
        out = out.withColumn(n_chars, F.when(hit, F.length(text).cast("long")).otherwise(F.col(n_chars)))
    return out.drop(found)
