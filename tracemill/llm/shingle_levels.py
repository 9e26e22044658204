"""How common each word shingle is over all documents, as one table of fixed size.

Every document's distinct shingles are counted exactly (over all documents),
grouped by ranges of the hash space: tasks send packed, locally combined blocks
instead of one row per shingle. A reducer writes, for its range, one byte per
cell: 0 where each shingle that falls in the cell is in one document only, else
1 + floor(log2) of the largest document frequency there. The table has 2**cells_log2 bytes whatever
the input's size, so it may be broadcast. More shingles than cells make
cells coarser; users of the table must stay exact for any content of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import batches, forgetting, shingle_sequences

CELLS_LOG2 = 25
#: Shingles that one reducing group holds, about, and the fewest ranges (as a power of two).
PER_RANGE, LEAST_RANGES_LOG2 = 2_000_000, 8
_FLUSH = 1_000_000


def _blocks(ranges_log2: int, column: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    shift = np.uint64(64 - ranges_log2)
    low = np.uint64(32 - ranges_log2)

    def flush(parts: list[np.ndarray]) -> pd.DataFrame:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        part = (values >> shift).astype(np.int64)
        bounds = np.searchsorted(part, np.arange((1 << ranges_log2) + 1))
        small = ((values >> low) & np.uint64(0xFFFFFFFF)).astype("<u4")
        many = counts > 1
        rows = []
        for r in np.flatnonzero(np.diff(bounds)):
            cut = slice(bounds[r], bounds[r + 1])
            again = many[cut]
            rows.append(
                (int(r), small[cut][~again].tobytes(), small[cut][again].tobytes(), counts[cut][again].astype("<u4").tobytes())
            )
        return pd.DataFrame(rows, columns=["part", "once", "more", "times"])

    @forgetting
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for frame in batches(frames, column):
            for h in map(np.unique, shingle_sequences(frame[column])):
                parts.append(h)
                held += len(h)
                if held >= _FLUSH:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def _levels(ranges_log2: int, cells_log2: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    cells = 1 << (cells_log2 - ranges_log2)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        once = np.concatenate([np.frombuffer(b, "<u4") for b in group["once"]])
        more = np.concatenate([np.frombuffer(b, "<u4") for b in group["more"]])
        times = np.concatenate([np.frombuffer(b, "<u4") for b in group["times"]])
        values, at = np.unique(np.concatenate([once, more]), return_inverse=True)
        total = np.bincount(at, np.concatenate([np.ones(len(once)), times]))
        again = total > 1
        out = np.zeros(cells, np.uint8)
        cell = (values[again].astype(np.uint64) >> np.uint64(32 - (cells_log2 - ranges_log2))).astype(np.int64)
        np.maximum.at(out, cell, (1 + np.floor(np.log2(total[again]))).astype(np.uint8))
        return pd.DataFrame({"part": group["part"].iloc[:1], "cells": [zlib.compress(out.tobytes(), 1) if again.any() else None]})

    return run


def shingle_levels(docs: DataFrame, column: str = "text", cells_log2: int = CELLS_LOG2, per_range: int = PER_RANGE) -> Broadcast:
    """Broadcast numpy bytes, one per cell; `level_of` reads it. Null and empty texts count nothing.

    The hash space is cut into so many ranges that one holds about `per_range` shingles, whatever the input's size (up to a
    range for each cell). Callers destroy the broadcast after its last use.
    """
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0  # a word takes some six bytes
    ranges_log2 = min(max(LEAST_RANGES_LOG2, (size // (6 * per_range)).bit_length()), cells_log2)
    blocks = docs.select(column).mapInPandas(_blocks(ranges_log2, column), "part int, once binary, more binary, times binary")
    rows = blocks.groupBy("part").applyInPandas(_levels(ranges_log2, cells_log2), "part int, cells binary").filter(F.col("cells").isNotNull())
    table = np.zeros(1 << cells_log2, np.uint8)
    step = 1 << (cells_log2 - ranges_log2)
    for part, cells in rows.collect():  # 2**cells_log2 bytes in all, before compression
        table[part * step : (part + 1) * step] = np.frombuffer(zlib.decompress(cells), np.uint8)
    return docs.sparkSession.sparkContext.broadcast(table)


def level_of(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return table[(hashes >> np.uint64(64 - (len(table).bit_length() - 1))).astype(np.int64)]
