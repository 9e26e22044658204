"""Operator 13, vector code compression: product codes trained and assigned by exponion search, in exact integers.

For each part of a vector the search starts at the entry that the last round gave it. With u the distance to that entry a, and v the least
distance seen so far, no entry farther than u + v from a can be as near as v (triangle inequality), so a's list of entries,
sorted by their distance from a, is read up to that radius only, and the radius shrinks as v does. Squared distances
are 64-bit integers; radii are rounded up, and the bound itself is read, so ties are decided by the index alone.

A round is one narrow pass that writes the vectors with their new codes, and sums of at most parts * entries rows a task. The driver sees codebooks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import durable, measured, small
from tracemill.llm.integer_vectors import floors, matrix, packed_vectors

#: Entries of a list that are read before the radius is taken anew, and vectors searched together.
READ, TOGETHER = 16, 4096
#: Before the first round, a part starts at the best of every so many entries.
SPREAD = 16


class Neighbours:
    """For each entry of a codebook all entries by their distance from it, then by index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = np.stack([((entries - e) ** 2).sum(1) for e in entries])
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)

    def first_guess(self, x: np.ndarray) -> np.ndarray:
        some = self.entries[::SPREAD]
        return np.stack([((x - e) ** 2).sum(1) for e in some], axis=1).argmin(1) * SPREAD

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index of the nearest entry, ties to the lower one; squared distance; distances computed)."""
        first = ((x - self.entries[start]) ** 2).sum(1)
        best, least, root = start.copy(), first.copy(), np.sqrt(first)
        active, computed = np.arange(len(x)), len(x)
        for low in range(0, len(self.entries), READ):
            reach = (root[active] + np.sqrt(least[active])) ** 2 * (1 + 1e-12) + 1
            active = active[self.gaps[start[active], low] <= reach]
            if not len(active):
                break
            which = self.order[start[active], low : low + READ]
            gap = np.take(self.entries, which, axis=0)
            np.subtract(x[active, None, :], gap, out=gap)
            found = np.einsum("mkw,mkw->mk", gap, gap)
            computed += found.size
            near = found.min(1)
            index = np.where(found == near[:, None], which, len(self.entries)).min(1)
            better = (near < least[active]) | ((near == least[active]) & (index < best[active]))
            hit = active[better]
            best[hit], least[hit] = index[better], near[better]
        return best, least, computed


def encode(rows: np.ndarray, books: list[Neighbours], codes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, error of each row) of vectors whose last codes are given, or not yet."""
    width = rows.shape[1] // len(books)
    out, error = np.zeros((len(rows), len(books)), np.uint8), np.zeros(len(rows), np.int64)
    for low in range(0, len(rows), TOGETHER):
        for p, book in enumerate(books):
            x = rows[low : low + TOGETHER, p * width : (p + 1) * width]
            begin = book.first_guess(x) if codes is None else codes[low : low + TOGETHER, p].astype(np.int64)
            index, distance, _ = book.nearest(x, begin)
            out[low : low + TOGETHER, p] = index
            error[low : low + TOGETHER] += distance
    return out, error


def compress(
    vectors: DataFrame, entries: int = 256, parts: int = 4, rounds: int = 4, scale: int = 1024, key: str = "vec_id", keep: tuple[str, ...] = (), vector: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """((key, the `keep` columns, code as hexadecimal, error) of every whole vector, durable; codebooks by part, entry and place).

    Components x become floor(scale * x); vectors are cut into equal consecutive parts. A part's codebook starts as that part of the so many
    least keys; each round assigns all parts and moves each entry to the floors of its parts' means; unused entries stay.

    Left out: null vectors and those with null or non-finite components; also empty vectors and lengths that the parts don't divide or that aren't the
    length of the least key's vector, as no codebook fits them. Rows without a key don't start an entry but get a code; rows that
    repeat a key count one by one, and equal keys start in the order of their packed integers. With fewer keys than entries the codebooks are
    smaller; without a start there is no row. A component beyond 2**23 after scaling is an error. At most 256 entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code's part has two hexadecimal digits: 1 to 256 entries")
    own = list(dict.fromkeys([key, *keep]))
    packed = packed_vectors(vectors, scale, own, vector).filter((F.length("ints") > 0) & (F.length("ints") % (4 * parts) == 0))
    now = durable(packed.withColumn("codes", F.lit(None).cast("binary")))
    first = now.filter(F.col(key).isNotNull()).orderBy(key, F.length("ints"), "ints").limit(1).collect()
    fields = list(now.schema.fields[: len(own)])
    none = now.filter("false").select(*own, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    if not first:
        return none, np.zeros((parts, 0, 0), np.int64)
    size = len(first[0].ints)
    now = now.filter(F.length("ints") == size)
    start = now.filter(F.col(key).isNotNull()).orderBy(key, "ints").limit(entries).select("ints").collect()  # as many rows as entries
    width = size // 4 // parts
    books = np.array([np.frombuffer(r.ints, "<i4") for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)

    def coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        known = [Neighbours(b) for b in books]
        for batch in batches:
            if batch.num_rows:
                rows, last = matrix(batch.column(len(own))), batch.column(len(own) + 1)
                codes = None if last.null_count else np.frombuffer(b"".join(last.to_pylist()), np.uint8).reshape(len(rows), parts)
                yield batch, rows, *encode(rows, known, codes)

    extra = [T.StructField("ints", T.BinaryType()), T.StructField("codes", T.BinaryType()), T.StructField("slot", T.IntegerType())]
    extra += [T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))]
    optional = [T.StructField(f.name, f.dataType) for f in fields]

    for _ in range(rounds):

        def step(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            k = books.shape[1]
            total, count = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
            names, kinds = [*own, "ints", "codes", "slot", "n", "sums"], [pa.int32(), pa.int64(), pa.list_(pa.int64())]
            seen = None
            for batch, rows, codes, _ in coded(batches, books):
                seen = batch.schema
                for p in range(parts):
                    slot = codes[:, p].astype(np.int64) + p * k
                    order = np.argsort(slot, kind="stable")
                    which, begin = np.unique(slot[order], return_index=True)
                    total[which] += np.add.reduceat(rows[order, p * width : (p + 1) * width], begin, axis=0)
                    count += np.bincount(slot, minlength=parts * k)
                made = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(own) + 1], made, *(pa.nulls(len(rows), t) for t in kinds)], names=names)
            if seen is not None:
                used = np.flatnonzero(count)
                sums = [pa.array(used, kinds[0]), pa.array(count[used]), pa.array(total[used].tolist(), kinds[2])]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(used), f.type) for f in list(seen)[: len(own)]), pa.nulls(len(used), pa.binary()), pa.nulls(len(used), pa.binary()), *sums], names=names)

        both = durable(now.mapInArrow(step, T.StructType([*optional, *extra])))
        now = both.filter(F.col("slot").isNull()).select(*own, "ints", "codes")
        by_slot = both.filter(F.col("slot").isNotNull()).groupBy("slot")
        summed = by_slot.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums")).collect()  # a row for an entry
        flat = books.reshape(-1, width)
        total, count = np.zeros_like(flat), np.zeros(len(flat), np.int64)
        for row in summed:
            total[row.slot], count[row.slot] = row.sums, row.n
        books = floors(total, count, flat).reshape(books.shape)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, codes, error in coded(batches, books):
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=[*own, "code", "error"])

    schema = T.StructType([*optional, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return durable(now.mapInArrow(last, schema)), books


def codes_with_errors(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): errors also summed over equal labels, null labels together. compress() says what is left out."""
    found, books = compress(vectors, keep=("label",))
    sums, count = measured(found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    out = found.join(small(sums, count.rows), F.col("label").eqNullSafe(F.col("of")))
    mark = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(mark).alias("codebooks_sha256"))
