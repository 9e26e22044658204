"""Candidate pairs compared hub by hub: each partner's content travels once for a pair, the hub's once for a share of its partners."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import forgetting, measured, small

#: A hub with more partners in one list is dealt to several tasks, with about so many partners each.
PARTNERS = 512


def against_hubs(
    pairs: DataFrame,
    contents: DataFrame,
    prepare: Callable[[bytes], Any],
    match: Callable[[Any, bytes], list[tuple]],
    found: str = "",
) -> DataFrame:
    """Rows (hub, doc_id, tags of the pair, what `match` found) for pairs (hub, doc_id, partners, tags).

    partners: how many the hub may have, as known where the pair comes from; contents: (doc_id, content). match gets
    the hub's prepared content and the partner's, and returns a tuple for each row to make, of the columns in `found`.
    Rows of contents that repeat a doc_id are compared each.
    """
    tags = [f for f in pairs.schema if f.name not in ("hub", "doc_id", "partners")]
    share = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("partners") / PARTNERS)).cast("int")
    dealt = pairs.withColumn("share", share).drop("partners").withColumn("is_hub", F.lit(False))
    hubs = dealt.select("hub", "share").distinct().withColumns({"doc_id": F.col("hub"), "is_hub": F.lit(True)})
    hubs = hubs.withColumns({f.name: F.lit(None).cast(f.dataType) for f in tags})
    needs, count = measured(dealt.unionByName(hubs))
    rows = contents.select("doc_id", "content").join(small(needs, count.rows), "doc_id")
    names = ["hub", "doc_id", *(f.name for f in tags)]

    @forgetting
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, []
        for frame in frames:
            out = []
            columns = [frame[c] for c in (*names, "share", "is_hub", "content")]
            for *key, share, is_hub, content in zip(*columns, strict=True):
                if is_hub:
                    if (key[0], share) != current:
                        current, held = (key[0], share), []
                    held.append(prepare(content))
                    continue
                for hub in held:
                    out.extend((*key, *more) for more in match(hub, content))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    kinds = {f.name: f.dataType.simpleString() for f in tags}
    schema = ", ".join([f"{n} {kinds.get(n, 'long')}" for n in names] + ([found] if found else []))
    ordered = rows.repartition("hub", "share").sortWithinPartitions("hub", "share", F.desc("is_hub"))
    return ordered.mapInPandas(run, schema)
