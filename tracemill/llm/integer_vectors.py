"""Integer vectors for operators 12 and 13: floors of scaled components, packed as 32-bit integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Integers beyond this size are refused: sums of their squares could leave 64 bits.
LARGEST = 1 << 23
_KIND = np.dtype("<i4")


def whole(column: pa.ListArray, scale: int) -> tuple[list[bytes | None], list[int]]:
    """Each list's integers floor(scale * x), packed, or None where the list is null or holds a null or non-finite component."""
    known, lengths = np.asarray(column.is_valid()), np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()  # leaves null lists out
    bad = np.asarray(flat.is_null())
    components = np.asarray(flat.fill_null(0.0), np.float64)
    bad |= ~np.isfinite(components)
    values = np.floor(scale * components)
    ends = np.cumsum(np.where(known, lengths, 0))
    starts = ends - np.where(known, lengths, 0)
    faults = np.concatenate([[0], np.cumsum(bad)])
    good = known & (faults[ends] == faults[starts])
    large = np.concatenate([[0], np.cumsum(np.abs(np.where(bad, 0, values)) > LARGEST)])
    if (large[ends] > large[starts])[good].any():
        raise ValueError(f"a component is beyond {LARGEST} when scaled by {scale}: its squares don't fit")
    packed = np.where(bad, 0, np.clip(values, -LARGEST, LARGEST)).astype(_KIND)
    return [packed[a:b].tobytes() if ok else None for ok, a, b in zip(good.tolist(), starts.tolist(), ends.tolist(), strict=True)], lengths.tolist()


def packed_vectors(vectors: DataFrame, scale: int, keep: list[str], vector: str = "embedding") -> DataFrame:
    """The `keep` columns and `ints` (binary, little-endian 32-bit integers floor(scale * x)) of the rows whose vector is whole.

    Rows whose vector is null, or holds a null or non-finite component, are left out; an empty vector is whole. A component whose
    integer is beyond 2**23 in size is an error.
    """
    slim = vectors.select(*keep, F.col(vector).cast("array<double>").alias("ints"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints, _ = whole(batch.column(len(keep)), scale)
            made = pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(ints, pa.binary())], names=[*keep, "ints"])
            yield made.filter(made.column(len(keep)).is_valid())

    return slim.mapInArrow(run, T.StructType([*slim.schema.fields[: len(keep)], T.StructField("ints", T.BinaryType())]))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of packed integers of one length, as 64-bit integers."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), _KIND).reshape(len(rows), -1).astype(np.int64)


def floors(sums: np.ndarray, counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """floor(sum / count) by row; rows without a count stay as before."""
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], before)
