"""Packing by power-of-two decomposition.

A document's ids (then an end id) are cut into pieces whose lengths are powers
of two: as many of the full context as fit, then the binary digits of the rest, largest
first. A piece is a sequence of its own, so no sequence crosses documents and none is padded.
Sequence ids carry the bucket (log2 of the length) in their top bits, so equal
lengths lie together. One narrow stage; nothing is shuffled.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from tracemill.llm.common import BoundedCache

CONTEXT = 4096
END_ID = 2
WORDS_KEPT = 600_000
_PUNCTUATION = ".,;:!?#%&*$|"
_SPACES = str.maketrans("\n\t\r", "   ")


class WordIds:
    """Ids of texts whose tokenizer drops white space: each run between plain spaces is encoded once and remembered.

    Neither the normaliser nor the splitting pattern of such a tokenizer looks across white space, so the
    ids of a text are those of its runs in order. A run of plain letters (Latin-1) goes straight to the merges, as lower
    case in the byte alphabet; final punctuation after letters is a piece of its own. Any other run takes the whole tokenizer.
    """

    def __init__(self, tokenizer_file: str):
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = self.tokenizer.model
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.alphabet = {chr(k): "".join(p for p, _ in spell(chr(k))) for k in range(0xC0, 0x100)}
        self.packed = BoundedCache(self._pack, WORDS_KEPT)

    def _pack(self, word: str) -> bytes:
        if word and "'" not in word and "<" not in word and max(word) < "\u0100":
            letters = word.rstrip(_PUNCTUATION)
            if letters and letters[-1].isalpha() and letters != word:
                return self.packed[letters] + self.packed[word[len(letters) :]]
            if word.isalpha() and not self.odd.intersection(word):
                word = word.lower()
                if not word.isascii():
                    word = "".join(self.alphabet.get(c, c) for c in word)
                ids = [t.id for t in self.model.tokenize(word)]
                return struct.pack(f"<{len(ids)}I", *ids)
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    #: Latin-1 letters outside the range of `alphabet`.
    odd = frozenset("\u00aa\u00b5\u00ba")

    def encode(self, text: str) -> bytes:
        words = text.translate(_SPACES).split(" ") if "\t" in text or "\r" in text else text.replace("\n", " ").split(" ")
        return b"".join(map(self.packed.__getitem__, words))


@cache
def word_ids(tokenizer_file: str) -> WordIds:
    """One per worker process."""
    return WordIds(tokenizer_file)


def pieces(length: int, context: int = CONTEXT) -> Iterator[tuple[int, int]]:
    """(start, piece length) of a power-of-two decomposition."""
    start = 0
    while length - start >= context:
        yield start, context
        start += context
    bit = context >> 1
    while start < length:
        if (length - start) & bit:
            yield start, bit
            start += bit
        bit >>= 1


def pack(docs: DataFrame, tokenizer_file: str, context: int = CONTEXT, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset and, with keep_ids, ids (packed 32-bit).

    Null and empty texts are documents of the end id alone. Repeated rows are
    packed once per row; a null doc_id is carried along; other columns are ignored.
    sequence_id is unique within one result.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = word_ids(tokenizer_file)
        end = np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
        kinds = [pa.int64()] * 5 + [pa.binary()]
        for batch in frames:
            ids, texts = (batch.column(k).to_pylist() for k in (0, 1))
            for low in range(0, len(ids), 500):
                rows = []
                for doc_id, text in zip(ids[low : low + 500], texts[low : low + 500], strict=True):
                    packed = tool.encode(text or "") + end
                    total = len(packed) // 4
                    for start, length in pieces(total, context):
                        cut = packed[4 * start : 4 * (start + length)]
                        rows.append((doc_id, start, length, zlib.crc32(cut), total, cut if keep_ids else None))
                yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    )
    bucket = F.round(F.log2("length")).cast("int")
    out = cut.withColumn("bucket", bucket).withColumn(
        "sequence_id", F.shiftleft(F.col("bucket").cast("long"), 58) + F.monotonically_increasing_id()
    )
    out = out.withColumn("offset", F.lit(0).cast("long"))
    return out if keep_ids else out.drop("ids")


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the sequences in one folder per length, so that a trainer reads batches of equal shape."""
    packed.write.mode("overwrite").partitionBy("bucket").parquet(path)
