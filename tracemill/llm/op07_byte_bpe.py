"""Byte-level BPE encoding and decoding with a lazily determinised transducer.

Text is cut by the vocabulary's splitting pattern; each piece runs through
`Transducer` once per worker and is then remembered (a bounded memo). Decoding streams
token bytes through an incremental UTF-8 machine. Whole texts, any length; work is per
row, so the job is one narrow stage over the input splits.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.bpe_transducer import StreamDecoder, Transducer, read_ranks
from tracemill.llm.common import BoundedCache

PIECES_KEPT = 1_200_000


class Codec:
    def __init__(self, vocabulary: str, pattern: str):
        ranks = read_ranks(vocabulary)
        self.transducer, self.decoder = Transducer(ranks), StreamDecoder(ranks)
        self.pieces = regex.compile(pattern).findall
        self.packed = BoundedCache(self._pack, PIECES_KEPT)

    def _pack(self, piece: str) -> bytes:
        return struct.pack(f"<{len(ids := self.transducer.encode(piece.encode('utf-8')))}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.pieces(text)))


@cache
def codec(vocabulary: str, pattern: str) -> Codec:
    """One per worker process."""
    return Codec(vocabulary, pattern)


def _rows(batch: pa.RecordBatch, *columns: str):
    return zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids packed as little-endian 32-bit integers; null text counts as empty."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary, pattern)
        for batch in frames:
            rows = [(doc_id, tool.encode(text or "")) for doc_id, text in _rows(batch, "doc_id", "text")]
            yield pa.record_batch(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([len(r[1]) // 4 for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.binary()),
                ],
                names=["doc_id", "n_tokens", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, content, valid): the bytes of packed ids, and whether they are whole UTF-8; null ids count as none."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary, pattern).decoder
        for batch in frames:
            rows = [(doc_id, *tool.decode(np.frombuffer(ids or b"", "<u4"))) for doc_id, ids in _rows(batch, "doc_id", "ids")]
            yield pa.record_batch(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.binary()),
                    pa.array([r[2] for r in rows], pa.bool_()),
                ],
                names=["doc_id", "content", "valid"],
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary, valid boolean")


def round_trip_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, valid_utf8): encode and decode in one pass, keeping digests only.

    One row per input row, repeated rows and null ids included; other columns are ignored.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocabulary, pattern)
        for batch in frames:
            out = []
            for doc_id, text in _rows(batch, "doc_id", "text"):
                packed = tool.encode(text or "")
                content, valid = tool.decoder.decode(np.frombuffer(packed, "<u4"))
                out.append(
                    (doc_id, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(content).hexdigest(), valid)
                )
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "valid_utf8"]
            yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, valid_utf8 boolean"
    )
