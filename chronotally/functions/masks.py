"""Roll-up masks: bit i of a mask says that tag i, in the sorted order of a statistic's fields, is rolled up."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what stands in place of a tag's value where it is rolled up.
ROLLED_UP = "<<<<ROLLED_UP>>>>"
MAX_TAGS = 15


def of_positions(positions: Iterable[int]) -> int:
    out = 0
    for p in positions:
        if not 0 <= p < MAX_TAGS:
            raise ValueError(f"position {p} is not in 0..{MAX_TAGS - 1}")
        out |= 1 << p
    return out


def of_tags(fields: list[str], rolled_up: Iterable[str]) -> int:
    at = {f: i for i, f in enumerate(fields)}
    missing = [t for t in rolled_up if t not in at]
    if missing:
        raise ValueError(f"no such tags: {missing}")
    return of_positions(at[t] for t in rolled_up)


def of_values(values: Iterable[str | None]) -> int:
    """From the tags' values in order."""
    return of_positions(i for i, v in enumerate(values) if v == ROLLED_UP)


def positions(mask: int) -> list[int]:
    return [i for i in range(MAX_TAGS) if mask >> i & 1]


def booleans(mask: int, tags: int) -> list[bool]:
    return [bool(mask >> i & 1) for i in range(tags)]


def is_rolled_up(mask: int, position: int) -> bool:
    return bool(mask >> position & 1)


def matches(a: int, b: int) -> int:
    """How many positions both roll up."""
    return (a & b).bit_count()


def all_masks(tags: int) -> list[int]:
    """Every mask of so many tags, the base first."""
    if not 0 <= tags <= MAX_TAGS:
        raise ValueError(f"at most {MAX_TAGS} tags")
    return list(range(1 << tags))


def convert(mask: int, old: list[str], new: list[str]) -> int:
    """The mask over new fields that rolls up the same tags, and those new ones that the old list lacks not."""
    names = {old[i] for i in positions(mask) if i < len(old)}
    return of_positions(i for i, f in enumerate(new) if f in names)


def text(mask: Column) -> Column:
    """15 binary digits."""
    return F.lpad(F.bin(mask.cast("long")), MAX_TAGS, "0")


def hex_text(mask: Column) -> Column:
    return F.lpad(F.hex(mask.cast("long")), 4, "0")


def rolled(tag: Column, mask: Column, position: int) -> Column:
    """A tag's value under a mask."""
    return F.when(mask.bitwiseAND(1 << position) != 0, F.lit(ROLLED_UP)).otherwise(tag)
