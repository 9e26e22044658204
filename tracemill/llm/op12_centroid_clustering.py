"""Operator 12, centroid clustering: Lloyd's rounds over integer vectors, with centroids screened by block norms.

A vector's compressed form is the list of its segments' norms, computed once. For each segment the inner product with a centroid is
at most the product of both norms (Cauchy-Schwarz), so |x|^2 + |c|^2 - 2 * sum of |x_s||c_s| bounds the squared distance from below. The
centroid with the least bound gets an exact distance first; only centroids whose bound doesn't exceed it get
theirs, in 64-bit integers. Bounds are rounded down by more than their error, so ties are never pruned.

A round is one narrow pass and a sum of at most `clusters` rows a task; the driver sees the summed centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import durable
from tracemill.llm.integer_vectors import floors, matrix, packed_vectors

#: Error of a bound, relative to the squared sizes; norms are kept in single precision.
SLACK = 1e-6
#: Pairs of a vector and a centroid that are compared at once.
AT_ONCE = 1 << 15


def segment_norms(rows: np.ndarray, segments: int) -> np.ndarray:
    """The norm of each of so many near-equal consecutive segments, for each row."""
    starts = np.unique(np.arange(segments) * rows.shape[1] // segments)
    return np.sqrt(np.add.reduceat(rows * rows, starts, axis=1)).astype(np.float32)


def nearest(rows: np.ndarray, norms: np.ndarray, centroids: np.ndarray, centroid_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, exact distances computed); ties go to the smaller number."""
    n, k = len(rows), len(centroids)
    number, distance, exact = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    step = max(1, AT_ONCE // k)
    ours, theirs = norms.astype(np.float64), centroid_norms.astype(np.float64)
    sizes, sizes_c = (ours * ours).sum(1), (theirs * theirs).sum(1)
    for low in range(0, n, step):
        x = rows[low : low + step]
        total = sizes[low : low + step, None] + sizes_c
        bound = total * (1 - SLACK) - 2 * (ours[low : low + step] @ theirs.T)
        first = bound.argmin(1)
        best = ((x - centroids[first]) ** 2).sum(1)
        open_ = bound <= best[:, None]
        open_[np.arange(len(x)), first] = True
        at, which = np.nonzero(open_)  # by row, then by number, so a row's first least distance has the smaller number
        found = ((x[at] - centroids[which]) ** 2).sum(1)
        begin = np.flatnonzero(np.diff(at, prepend=-1))
        least = np.minimum.reduceat(found, begin)
        hit = np.flatnonzero(found == least[at])
        winner = hit[np.flatnonzero(np.diff(at[hit], prepend=-1))]
        number[low : low + step], distance[low : low + step] = which[winner], least
        exact += len(at)
    return number, distance, exact


def starts(prepared: DataFrame, key: str, clusters: int, order: Column) -> np.ndarray:
    """The vectors of the so many least keys; equal keys by their vectors. At most `clusters` rows reach the driver."""
    rows = prepared.filter(F.col(key).isNotNull()).select(order.alias("o"), "ints").orderBy("o", "ints").limit(clusters).collect()
    return np.array([np.frombuffer(r.ints, "<i4") for r in rows], np.int64)


def cluster(
    vectors: DataFrame, clusters: int, rounds: int, order: Column, scale: int = 256, dimensions: int = 64, segments: int = 16, key: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """((key, cluster, distance) of every whole vector of so many dimensions, durable; the final centroids).

    Components x become floor(scale * x). Centroids start as the vectors with the least `order`, a column over `key`; then each of so many rounds
    assigns every vector to the nearest centroid and moves each centroid to the floors of its vectors' means; empty ones stay.

    Left out: null vectors, other lengths, null or non-finite components. A null key doesn't start a centroid but is assigned; rows that
    repeat a key count one by one. With fewer vectors than centroids there are fewer centroids; without a start, no row.
    A component beyond 2**23 after scaling is an error. Other columns are ignored.
    """
    slim = vectors.select(key, vector).filter(F.size(vector) == dimensions)
    field = slim.schema.fields[0]

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = segment_norms(matrix(batch.column(1)), segments) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in norms], pa.binary())], names=[key, "ints", "norms"])

    packed = packed_vectors(slim, scale, [key], vector)
    prepared = durable(packed.mapInArrow(compress, T.StructType([*packed.schema.fields, T.StructField("norms", T.BinaryType())])))
    centroids = starts(prepared, key, clusters, order)
    if not len(centroids):
        return prepared.filter("false").select(key, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids

    def assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        centroid_norms = segment_norms(centroids, segments)
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column(1))
                norms = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(len(rows), -1)
                yield batch, rows, *nearest(rows, norms, centroids, centroid_norms)[:2]

    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(now), np.zeros(len(now), np.int64)
            for _, rows, number, _ in assigned(batches, now):
                order = np.argsort(number, kind="stable")
                which, begin = np.unique(number[order], return_index=True)
                total[which] += np.add.reduceat(rows[order], begin, axis=0)
                count += np.bincount(number, minlength=len(now))
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
            )

        parts = prepared.mapInArrow(sums, "cluster int, n long, sums array<long>").groupBy("cluster")
        summed = parts.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dimensions))).alias("sums")).collect()  # a row for a centroid
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for row in summed:
            total[row.cluster], count[row.cluster] = row.sums, row.n
        centroids = floors(total, count, centroids)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, number, distance in assigned(batches, centroids):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(distance)], names=[key, "cluster", "distance"])

    schema = T.StructType([field, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return durable(prepared.mapInArrow(last, schema)), centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(vectors: DataFrame, clusters: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every whole vector of 64 components.

    Centroids start as the vectors with the least sha256 of `seed:vec_id`. cluster() says what is left out.
    """
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found, centroids = cluster(vectors, clusters, rounds, order)
    spark = vectors.sparkSession
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for a centroid
    rows = [(k, sums.get(k, 0), digest(c)) for k, c in enumerate(centroids)]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(known), "cluster")  # as many rows as centroids
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256")
