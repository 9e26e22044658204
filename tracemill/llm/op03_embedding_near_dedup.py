"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

Unit vectors are projected on Gaussian directions and quantised; a table's key
joins several projections, and several tables are used. Two unit vectors of cosine c lie
sqrt(2 - 2c) apart. The number of projections follows the count of the commonest label, so that a bucket holds a few
unrelated vectors at most; the number of tables follows from it, so that a pair at the threshold shares a
bucket of some table with probability 0.999, and closer pairs with more. Equal vectors of one label are collapsed first.
Buckets larger than `block` are dealt in blocks, and each pair of blocks is compared in a
task of its own, so no bucket is gathered whole and no pair is left out: a bucket of k vectors sends each k / block times.
A pair is counted in the first table that it shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import durable, measured, mix, pairs_in_runs, small
from tracemill.llm.components import connected_components

WIDTH, BLOCK, SEED = 2.0, 512, 20
#: Chance of missing a pair at the threshold, and unrelated vectors of a label that share a bucket, about.
MISS, UNRELATED = 0.001, 4
_CHUNK = 20_000


def collision_chance(cosine: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection agrees for unit vectors of this cosine."""
    t = width / math.sqrt(max(2 - 2 * cosine, 1e-300))
    return 1 - math.erfc(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def table_plan(vectors: int, threshold: float, width: float = WIDTH) -> tuple[int, int]:
    """(tables, projections) for so many vectors of one label."""
    projections = max(4, math.ceil(math.log(max(vectors, 1) / UNRELATED) / -math.log(collision_chance(0.0, width))))
    return math.ceil(math.log(MISS) / math.log1p(-(collision_chance(threshold, width) ** projections))), projections


def _matrix(vectors, kind: str) -> np.ndarray:
    """Unit rows, in double precision, of packed vectors of one length."""
    rows = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _packed(value, kind: str) -> bytes | None:
    if value is None or not len(value):
        return None
    v = np.array([np.nan if x is None else x for x in value] if getattr(value, "dtype", None) == object else value, kind)
    return v.tobytes() if np.isfinite(v).all() and v.any() else None


class Tables:
    """Hash tables for vectors of one length."""

    def __init__(self, size: int, tables: int, projections: int, width: float):
        random = np.random.default_rng([SEED, size])
        self.directions = random.standard_normal((size, tables * projections))
        self.shifts = random.uniform(0, width, tables * projections)
        self.size, self.shape, self.width = size, (tables, projections), width

    def keys(self, units: np.ndarray, labels: np.ndarray) -> np.ndarray:
        tables, projections = self.shape
        cells = np.floor((units @ self.directions + self.shifts) / self.width).astype(np.int64).astype(np.uint64).reshape(len(units), tables, projections)
        h = np.full((len(units), tables), self.size, np.uint64) ^ np.arange(1, tables + 1, dtype=np.uint64)[None, :] << np.uint64(32)
        h = mix(h ^ mix(labels.astype(np.int64).astype(np.uint64))[:, None])
        for k in range(projections):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k])
        return h.view(np.int64)


class AllTables(dict):
    """Tables by length, made when first used."""

    def __init__(self, *plan):
        super().__init__()
        self.plan = plan

    def __missing__(self, size: int) -> Tables:
        self[size] = Tables(size, *self.plan)
        return self[size]


def _runs(frame: pd.DataFrame, kind: str, threshold: float, known: AllTables) -> pd.DataFrame | None:
    """Of rows sorted by (bucket, low, high): for each linked row the linked weight and a root of its run; and each link of a row marked `repeats`."""
    ends = frame[["bucket", "low", "high"]].to_numpy()
    starts = np.concatenate([[0], np.flatnonzero((ends[1:] != ends[:-1]).any(axis=1)) + 1])
    counts = np.diff(np.concatenate([starts, [len(frame)]]))
    i, j = pairs_in_runs(starts[counts > 1], counts[counts > 1])
    own, cross = frame["own"].to_numpy(), (frame["low"] != frame["high"]).to_numpy()
    size, vectors = frame["vector"].str.len().to_numpy(), frame["vector"].to_numpy()
    fits = (~cross[i] | (own[i] != own[j])) & (size[i] == size[j])
    i, j = i[fits], j[fits]
    slot, label = frame["slot"].to_numpy(), frame["label"].to_numpy()
    found_i, found_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(0, len(i), _CHUNK):
        for length in np.unique(size[i[k : k + _CHUNK]]):
            pick = size[i[k : k + _CHUNK]] == length
            p, q = i[k : k + _CHUNK][pick], j[k : k + _CHUNK][pick]
            use, at = np.unique(np.concatenate([p, q]), return_inverse=True)
            units = _matrix(vectors[use], kind)
            a, b = at[: len(p)], at[len(p) :]
            near = np.flatnonzero(np.einsum("ij,ij->i", units[a], units[b]) >= threshold)
            if not len(near):
                continue
            need, at = np.unique(np.concatenate([a[near], b[near]]), return_inverse=True)
            keys = known[units.shape[1]].keys(units[need], label[use[need]])
            first = (keys[at[: len(near)]] == keys[at[len(near) :]]).argmax(axis=1) == slot[p[near]]
            found_i.append(p[near][first])
            found_j.append(q[near][first])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    if not len(i):
        return None
    weight = frame["weight"].to_numpy(np.int64)
    links = np.bincount(i, weight[j], len(frame)) + np.bincount(j, weight[i], len(frame))
    root = np.arange(len(frame))
    while True:  # least row of each run's linked set
        least = np.minimum(root[i], root[j])
        new = root.copy()
        for at in (root[i], root[j], i, j):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    rows = np.unique(np.concatenate([i, j]))
    ids, node, marked = frame["vec_id"].to_numpy(np.int64), frame["node"].to_numpy(np.int64), frame["repeats"].to_numpy(bool)
    out = pd.DataFrame({"node": node[rows], "vec_id": ids[rows], "links": links[rows].astype(np.int64), "root": ids[root[rows]]})
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    each = pd.DataFrame({"node": node[a[marked[a]]], "other": node[b[marked[a]]]})
    return pd.concat([out.assign(other=pd.NA), each], ignore_index=True).astype("Int64")[["node", "vec_id", "links", "root", "other"]]


def _compare(kind: str, threshold: float, plan: tuple):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, known = None, AllTables(*plan)
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = frame.iloc[-1]
            open_run = (frame["bucket"] == last["bucket"]) & (frame["low"] == last["low"]) & (frame["high"] == last["high"])
            held = frame[open_run]
            done = frame[~open_run].reset_index(drop=True)
            if len(done) and (out := _runs(done, kind, threshold, known)) is not None:
                yield out
        if held is not None and (out := _runs(held.reset_index(drop=True), kind, threshold, known)) is not None:
            yield out

    return run


def embedding_links(vectors: DataFrame, threshold: float = 0.93, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Only equal, non-null labels are compared. Null or empty vectors, zero vectors, and vectors with null
    or non-finite components link with nothing; nor do vectors of different
    lengths. n_links counts other vec_ids: rows that repeat a vec_id are one vector in all counts and repeated in the result;
    if their vectors differ, that id has the links of each of them. A null vec_id links with nothing and has a null
    component. An empty table gives an empty one; other columns are ignored.
    """
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    slim = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding" if kind == "<f4" else F.col("embedding").cast("array<double>").alias("embedding")
    )

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            content = [None if pd.isna(x) or pd.isna(k) else _packed(v, kind) for x, k, v in zip(frame["label"], frame["vec_id"], frame["embedding"], strict=True)]
            mark = [None if v is None else xxhash.xxh3_128_digest(v) for v in content]
            yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "label": frame["label"].astype("Int64"), "mark": mark, "vector": content})

    base = durable(slim.mapInPandas(packed, "vec_id long, label long, mark binary, vector binary").withColumn("row", F.monotonically_increasing_id()))
    valid = base.filter(F.col("vector").isNotNull())
    # a node is one vector of one label; the id of its first row stands for it
    nodes = durable(valid.groupBy("label", "mark").agg(F.min("row").alias("node")))
    member = durable(valid.select("vec_id", "label", "mark").join(nodes, ["label", "mark"]).select("vec_id", "node").distinct())
    repeated, several = measured(member.groupBy("vec_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("vec_id"))
    repeated = small(repeated, several.rows)
    # ids with one vector are counted by weight, the others one by one
    weight = member.join(repeated, "vec_id", "left_anti").groupBy("node").agg(F.count(F.lit(1)).alias("weight"))
    of_repeated = member.join(repeated, "vec_id", "left_semi")
    marked = of_repeated.select("node").distinct().withColumn("repeats", F.lit(True))
    first = valid.select("vec_id", "label", "vector", F.col("row").alias("node")).join(nodes.select("node"), "node", "left_semi")
    first = first.join(weight, "node", "left").join(marked, "node", "left")
    reps, count = measured(first.withColumns({"weight": F.coalesce("weight", F.lit(0)), "repeats": F.coalesce("repeats", F.lit(False))}))
    most = reps.groupBy("label").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0
    plan = (*table_plan(most, threshold, width), width)

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = AllTables(*plan)
        for frame in frames:
            for _, part in frame.groupby(frame["vector"].str.len()):
                units = _matrix(part["vector"].to_numpy(), kind)
                yield pd.DataFrame({"node": part["node"], "keys": list(known[units.shape[1]].keys(units, part["label"].to_numpy()))})

    keyed = durable(reps.select("node", "label", "vector").mapInPandas(keys, "node long, keys array<long>"))
    slots = keyed.select("node", F.posexplode("keys").alias("slot", "bucket"))
    shared = slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    shared = durable(shared.select("bucket", F.ceil(F.col("k") / block).cast("int").alias("blocks")))  # so that the join can split a large bucket
    own, other = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = slots.join(shared, "bucket").select("node", "slot", "bucket", own, other)
    placed = placed.select("node", "slot", "bucket", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    ordered = placed.join(reps, "node").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "node")
    found = durable(ordered.mapInPandas(_compare(kind, threshold, plan), "node long, vec_id long, links long, root long, other long"))

    sums = found.filter(F.col("other").isNull()).groupBy("node").agg(F.sum("links").alias("links"))
    near = member.join(sums, "node", "left").join(weight, "node", "left")
    near = near.select("vec_id", "node", (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(0))).alias("n"))
    if several.rows:
        each = found.filter(F.col("other").isNotNull()).select("node", "other").unionByName(marked.select("node", F.col("node").alias("other")))
        touch = durable(of_repeated.join(each, "node").select("vec_id", F.col("other").alias("node")).distinct())
        beside = touch.groupBy("node").agg(F.count(F.lit(1)).alias("beside"))  # repeated ids next to or in a node
        single = near.join(repeated, "vec_id", "left_anti").join(beside, "node", "left").select("vec_id", (F.col("n") - 1 + F.coalesce("beside", F.lit(0))).alias("n"))
        others = touch.join(of_repeated.select(F.col("vec_id").alias("it"), "node"), "node").filter(F.col("it") != F.col("vec_id")).groupBy("vec_id").agg(F.count_distinct("it").alias("its"))
        multiple = touch.join(weight, "node", "left").groupBy("vec_id").agg(F.sum(F.coalesce("weight", F.lit(0))).alias("n")).join(others, "vec_id", "left")
        counted = single.unionByName(multiple.select("vec_id", (F.col("n") + F.coalesce("its", F.lit(0))).alias("n")))
    else:
        counted = near.select("vec_id", (F.col("n") - 1).alias("n"))
    edges = member.join(reps.select("node", F.col("vec_id").alias("a")), "node").select("a", F.col("vec_id").alias("b"))
    edges = edges.unionByName(found.filter(F.col("other").isNull()).select(F.col("root").alias("a"), F.col("vec_id").alias("b")))
    part = connected_components(edges).withColumnRenamed("id", "vec_id")
    out = base.select("vec_id").join(counted, "vec_id", "left").join(part, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept")
    )
