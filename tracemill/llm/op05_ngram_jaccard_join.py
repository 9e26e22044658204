"""N-gram Jaccard join by grouped prefixes: links between documents with similar shingle sets.

Method. Shingles are ordered by how common they are, then by hash; two sets
with Jaccard similarity of 0.8 or more share a shingle in their prefixes (the
first size - ceil(0.8 * size) + 1 shingles). Prefix shingles that only one
document has match nothing and are left out. Documents with the same text
sequence form a class, represented by its least doc_id. Representatives with identical
prefix and size form a group, and only one member of a group posts the prefix.

Candidates come in two rounds, so that a large group of near copies never
makes all its pairs. First each document is verified against the poster of
its group, and each poster against the poster with the smallest share of unmatched shingles in every posting
list (the original, as a rule, where the others are its edited copies). Links found make components. Then, for every posting list that still spans
several components, groups are expanded and all pairs across components that pass the bound
below are verified. Bound: shingles that only one document has match nothing, so an overlap is at most the
lesser count of the others; and the first shingle that two sets share stands so early in both prefixes that the
needed overlap still fits behind it. Pairs within one component can't change it, so components are exact:
no link is lost and no link below the bound is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import SIMILARITY_PERCENT, batches, durable, forgetting, hashed_texts, measured, small
from tracemill.llm.components import connected_components
from tracemill.llm.hubs import against_hubs
from tracemill.llm.shingle_levels import CELLS_LOG2, level_of, shingle_levels

_SETS = "doc_id long, n long, m long, sequence binary, prefix_key binary, prefix array<long>, content binary"


def prefix_length(size: int, percent: int = SIMILARITY_PERCENT) -> int:
    return size - -(-percent * size // 100) + 1


def similar(overlap, size_a, size_b, percent: int = SIMILARITY_PERCENT):
    """Jaccard >= percent / 100 in whole numbers."""
    return 100 * overlap >= percent * (size_a + size_b - overlap)


def _sets(levels: Broadcast, percent: int):
    @forgetting
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = levels.value
        for frame in batches(frames, "text"):
            rows = []
            for doc_id, (words, shingles) in zip(frame["doc_id"], hashed_texts(frame["text"]), strict=True):
                h = np.unique(shingles)
                n = len(h)
                if not n:
                    rows.append((doc_id, 0, 0, None, None, None, None))
                    continue
                sequence = xxhash.xxh3_128_digest(words.tobytes())
                level = level_of(table, h)
                length = prefix_length(n, percent)
                first = np.lexsort((h, level))[:length]
                shared = first[level[first] > 0]
                if not len(shared):
                    rows.append((doc_id, n, 0, sequence, None, None, None))
                    continue
                key = xxhash.xxh3_128_digest(h[first].tobytes() + n.to_bytes(8, "little"))
                rows.append((doc_id, n, int((level > 0).sum()), sequence, key, h[shared].view(np.int64), h.tobytes()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SETS.split(", ")]).astype({"doc_id": "Int64"})

    return run


def _shingles(content: bytes) -> np.ndarray:
    return np.frombuffer(content, np.uint64)


def _similar_sets(percent: int):
    def match(hub: np.ndarray, content: bytes) -> list[tuple]:
        x, y = sorted((hub, _shingles(content)), key=len)
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        return [()] if similar(int((y[at] == x).sum()), len(x), len(y), percent) else []

    return match


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes n and counts m of matchable shingles allow the similarity."""
    overlap = F.least("m_a", "m_b")
    return pairs.filter(100 * overlap >= percent * (F.col("n_a") + F.col("n_b") - overlap))


def _early(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs that may meet for the first time at this shingle: the overlap still fits from its place on."""
    needed = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    return pairs.filter((F.col("place_a") <= F.col("size_a") - needed) & (F.col("place_b") <= F.col("size_b") - needed))


def _side(rows: DataFrame, c: str) -> DataFrame:
    return rows.select(
        "kind",
        "token",
        F.col("component").alias(f"component_{c}"),
        F.col("doc_id").alias(c),
        *(F.col(x).alias(f"{x}_{c}") for x in ("n", "m", "size", "place")),
    )


def shingle_sets(docs: DataFrame, levels: Broadcast, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """One row per input row: set size n, matchable shingles m, fingerprint of the sequence and, where another document shares a prefix shingle, prefix and set."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_sets(levels, percent), _SETS)


def _first_round(posting: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, doc_id, partners): members with their group's poster, posters with the purest poster of every list."""
    several = groups.filter("k > 1").select("prefix_key", F.col("poster").alias("hub"), F.col("n").alias("n_a"), F.col("m").alias("m_a"), F.col("k").alias("partners"))
    inner = posting.select("doc_id", F.col("n").alias("n_b"), F.col("m").alias("m_b"), "prefix_key").join(several, "prefix_key").drop("prefix_key")
    tokens = groups.select("poster", "n", "m", F.explode("prefix").alias("token"))
    unmatched = (1_000_000 * (F.col("n") - F.col("m")) / F.col("n")).cast("long")
    lists = tokens.groupBy("token").agg(
        F.min(F.struct(unmatched.alias("unmatched"), "poster", "n", "m")).alias("first"), F.count(F.lit(1)).alias("partners")
    )
    # written, so that the join below can split a list that many documents are on
    lists = durable(lists.filter("partners > 1").select("token", F.col("first.poster").alias("hub"), F.col("first.n").alias("n_a"), F.col("first.m").alias("m_a"), "partners"))
    star = tokens.select(F.col("poster").alias("doc_id"), F.col("n").alias("n_b"), F.col("m").alias("m_b"), "token").join(lists, "token").drop("token")
    pairs = _possible(star.unionByName(inner).filter(F.col("hub") != F.col("doc_id")), percent)
    return pairs.groupBy("hub", "doc_id").agg(F.max("partners").alias("partners"))


def _second_round(posting: DataFrame, groups: DataFrame, part: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, doc_id, partners, component_a, component_b) that may link components, from lists and groups that span several."""
    members = posting.select("doc_id", "n", "m", "prefix_key").join(part.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    members = durable(members.withColumn("component", F.coalesce("component", "doc_id")))
    ranges = members.groupBy("prefix_key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    spans = groups.select("prefix_key", "poster", "prefix").join(ranges, "prefix_key")
    on = spans.select(F.lit(0).alias("kind"), F.explode("prefix").alias("token"), "x", "y")
    # a group is a list too; its own kind keeps its poster's id apart from shingles
    on = on.unionByName(spans.filter(F.col("x") != F.col("y")).select(F.lit(1).alias("kind"), F.col("poster").alias("token"), "x", "y"))
    several = on.groupBy("kind", "token").agg(F.min("x").alias("x"), F.max("y").alias("y")).filter(F.col("x") != F.col("y"))
    several, count = measured(several.select("kind", "token"))
    posted = groups.select(F.lit(0).alias("kind"), "prefix_key", F.posexplode("prefix").alias("rank", "token"))
    posted = posted.unionByName(groups.select(F.lit(1).alias("kind"), "prefix_key", F.lit(None).cast("int").alias("rank"), F.col("poster").alias("token")))
    open_lists = posted.join(small(several, count.rows), ["kind", "token"])
    # a prefix's place counts the shingles that match nothing, which stand before it
    place = F.coalesce(F.col("rank") + F.col("n") - F.col("m"), F.lit(0)).alias("place")
    spread = open_lists.join(members, "prefix_key").select("kind", "token", "component", "doc_id", "n", "m", place, F.col("n").alias("size"))
    spread = durable(spread)
    # a component's members on a list, at their best; then the members themselves
    parts = spread.groupBy("kind", "token", "component").agg(
        F.min("n").alias("n"), F.max("n").alias("size"), F.max("m").alias("m"), F.min("place").alias("place")
    )
    parts = parts.withColumn("doc_id", F.col("component"))
    across = _side(parts, "a").join(_side(parts, "b"), ["kind", "token"]).filter(F.col("component_a") < F.col("component_b"))
    across = _early(_possible(across, percent), percent).select("kind", "token", "component_a", "component_b")
    rest = across.join(_side(spread, "a"), ["kind", "token", "component_a"]).join(_side(spread, "b"), ["kind", "token", "component_b"])
    rest = _early(_possible(rest, percent), percent).select(F.col("a").alias("hub"), F.col("b").alias("doc_id"), "component_a", "component_b")
    return rest.distinct().withColumn("partners", F.lit(1))


def jaccard_classes(docs: DataFrame, percent: int = SIMILARITY_PERCENT, cells_log2: int = CELLS_LOG2) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text; other columns are ignored).

    Null and empty texts have size 0 and link with nothing. Repeated rows give
    repeated results; rows with one doc_id are one node. A null doc_id is kept with
    a null component_id and links with nothing. An empty table gives an empty one.
    """
    levels = shingle_levels(docs, cells_log2=cells_log2)
    sets = durable(shingle_sets(docs, levels, percent).withColumn("row", F.monotonically_increasing_id()))
    levels.destroy()
    named = sets.filter(F.col("doc_id").isNotNull() & F.col("sequence").isNotNull())
    same = named.groupBy("sequence").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("copies"))
    same, count = measured(same.filter("copies > 1").select("sequence", F.col("first.doc_id").alias("of"), F.col("first.row").alias("first_row")))
    copies = named.select("doc_id", "row", "sequence").join(small(same, count.rows), "sequence").filter(F.col("row") != F.col("first_row"))
    copies, count = measured(copies.select("doc_id", "row", "of"))
    # one row of each text
    posting = named.filter(F.col("prefix").isNotNull()).join(small(copies.select("row"), count.rows), "row", "left_anti")
    groups = posting.groupBy("prefix_key").agg(F.min(F.struct("doc_id", "n", "m", "prefix")).alias("p"), F.count(F.lit(1)).alias("k"))
    groups = durable(groups.select("prefix_key", F.col("p.doc_id").alias("poster"), "p.n", "p.m", "p.prefix", "k"))

    verified = lambda pairs: against_hubs(pairs, posting, _shingles, _similar_sets(percent))
    links = verified(_first_round(posting, groups, percent)).select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
    part = connected_components(links.unionByName(copies.select(F.col("of").alias("a"), F.col("doc_id").alias("b"))))
    # what is left: lists and groups that span several components
    late = verified(_second_round(posting, groups, part, percent))
    merged = connected_components(late, "component_a", "component_b").select(F.col("id").alias("merged"), F.col("component").alias("whole"))
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(part.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = out.withColumn("component", F.coalesce("component", "doc_id")).join(merged, F.col("component") == F.col("merged"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("whole", "component").alias("component_id"))
