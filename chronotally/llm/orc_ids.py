"""Token ids in ORC files: written in order of ids with row indexes and Bloom filters, and read back stripe by stripe."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_order

SCHEMA = "doc_id long, ids array<int>"
#: A worker remembers the ids of so many words, and of so many of those before them.
MEMORY = 200_000
# How a word tokenizer of this kind normalizes text and cuts it; white space always ends a piece and is dropped.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A word of Latin-1 letters, which NFC leaves alone, then marks that no rule above joins to letters.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!%&*#$?;:]*)")


class Memory(dict):
    """Bytes of what find() gives for a key. When MEMORY keys are held they become the older half, which is asked, too."""

    def __init__(self, find: Callable[[str], bytes]) -> None:
        super().__init__()
        self.find, self.old = find, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        out = self.old.get(key)
        if out is None:
            out = self.find(key)
        self[key] = out
        return out


class Encoder:
    """A tokenizer's ids of texts, as bytes of little-endian 32-bit integers.

    Where a tokenizer drops white space, the ids of a text are those of its words between blanks or line ends in turn, so
    each word is encoded once. Where its normalizer and its cuts are the ones above, letters and marks of a plain word are
    pieces of their own, which the model is asked for in lower case. All else goes through the whole tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        shape = json.loads(self.tokenizer.to_str())
        steps = (shape.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        first, normalizer = steps[0], shape.get("normalizer") or {}
        cuts = first.get("type") == "Split" and first.get("invert") is True and first.get("behavior") == "Removed" and first.get("pattern") == {"Regex": CUT}
        bytes_only = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        # other normalizers could join or drop white space, and added tokens of letters or with blanks would be cut here
        added = all(re.fullmatch(r"<\|\w+\|>", x["content"]) for x in shape.get("added_tokens") or [])
        self.by_word = cuts and bytes_only and added and normalizer.get("type") == "Sequence" and normalizer.get("normalizers") == NORMALIZER
        byte = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: byte.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.pieces, self.words = Memory(self._piece), Memory(self._word)

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(piece if piece.isascii() else piece.translate(self.letters))]).tobytes()

    def _word(self, word: str) -> bytes:
        if found := PLAIN.fullmatch(word):
            letters, marks = found.groups()
            return self.pieces[letters.lower()] + self.pieces[marks] if marks else self.pieces[letters.lower()]
        return self._whole(word)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


@cache
def encoder_of(path: str) -> Encoder:
    """One for each tokenizer and worker process, so that what it remembers serves later tasks too."""
    return Encoder(path)


def encode(df: DataFrame, tokenizer: str, end_id: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of each row, in the order of the rows: the ids of the whole text, null counting as empty, then end_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [encoder.encode(t or "") + end for t in part.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(x) // 4 for x in found]).astype(np.int32)
                values = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["doc_id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def write(df: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", id_col: str = "doc_id") -> None:
    """Writes the ids of all documents as ORC, in ascending order of ids (null ids last) over the numbered files.

    Texts, smaller than their ids, are dealt by range before encoding. ORC writes the ids run-length encoded, an index
    entry for every 1,000 rows and a Bloom filter on doc_id, so a reader skips stripes that hold none of the ids it seeks.
    Rows that repeat are written as often as they come; columns besides id and text are left out."""
    slim = df.select(F.col(id_col).alias("id_"), F.col(text).alias("text_"))
    order = [F.col("id_").asc_nulls_last(), F.xxhash64("text_")]
    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    ids = encode(dealt, tokenizer, end_id, "text_", "id_")
    ids.write.option("orc.compress", "ZSTD").option("orc.row.index.stride", 1000).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def digest(ids: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of written ids: start counts the ids of all documents before, in ascending
    order of doc_id, null last; documents of equal ids stand in order of n_tokens and checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "n_tokens", "ids_crc32"])

    # written before it is dealt by range, which reads its rows twice
    found = cut(ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("n_tokens"), F.col("ids_crc32")]
    return in_order(found, order, add={"start": "n_tokens"}, pos="no").select("doc_id", "start", "n_tokens", "ids_crc32")
