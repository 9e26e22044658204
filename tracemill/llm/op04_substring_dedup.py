"""Near-duplicate passages by compact windows of min-hashes.

Tokens are word shingles. For every hash function, a compact window (l, c, r)
says that each run of shingles inside [l, r] that holds c has its least hash at c; c's neighbours in the
Cartesian tree of the minima bound the window. Windows of two functions (a band) that overlap in an interval holding both
minima and a run of the least passage length make one signature. Signatures are joined with the first document that has
them, never all with all; both intervals must be able to hold a passage, and each pair of documents so
found is verified shingle by shingle over whole texts. Minima whose shingle only one document has match nothing and are
dropped where they are found; keys that very many documents share are dealt to several first documents, which are joined in turn.

A first document that holds only part of a passage could keep the others' copies apart. So a second round takes the
signatures that lie in no passage found: they are joined with the next first document among them, and every document
of such a signature hashes the whole runs around it, all of whose shingles are shared. Equal runs are exact repeats, and
the first document that has one holds that very run, so verification can't fail. A passage is reported against the
document that stands for its class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import SHINGLE_WORDS, SIMILARITY_PERCENT, batches, durable, forgetting, fresh_name, measured, mix, shingle_sequences, small
from tracemill.llm.hubs import against_hubs
from tracemill.llm.shingle_levels import CELLS_LOG2, level_of, shingle_levels

PASSAGE_WORDS = 50
#: Bands of two functions each. At similarity 0.8 one run of the least length shares a band with probability 0.95; longer passages have more runs.
BANDS = 3
#: Alignments of one passage may drift by so many words (insertions and deletions).
DRIFT = 10
#: A key that up to 2**k documents share is dealt to 2**(k - DEALT_LOG2) first documents.
DEALT_LOG2 = 10
_SPANS = "start_word int, end_word int, other_start int, other_end int, similarity double"
#: A window's ends are kept as distances from c, at most so much; a passage around c can't need more.
_REACH = 1023
#: Shingles laid out at once; longer documents come in parts that overlap.
_PART = 1 << 20
_PLACE = np.uint64((1 << 22) - 1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _nearest_smaller(values: np.ndarray, step: int) -> np.ndarray:
    """For each place, the nearest one in direction `step` with a smaller value; walls of value 0 stand at both ends and stay put."""
    size = len(values)
    near = np.clip(np.arange(size) + step, 0, size - 1)
    left = np.flatnonzero((values > 0) & (values[near] >= values))
    while len(left):  # jump along what is known of the places passed
        near[left] = near[near[left]]
        left = left[values[near[left]] >= values[left]]
    return near


def run_minima(values: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """For every start of a run of `width` shingles, the place of its least value, -1 where the run crosses documents. Ties go to the left."""
    if len(values) < width:
        return np.empty(0, np.int64)
    least, span = (values & ~_PLACE) | np.arange(len(values), dtype=np.uint64), 1  # the place breaks ties and comes along
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return np.where(owner[: len(least)] == owner[width - 1 :], (least & _PLACE).astype(np.int64), -1)


def compact_windows(values: np.ndarray, owner: np.ndarray, minima: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of the compact windows of these minima, over fewer than 2**22 shingles laid end to end; owner tells documents apart."""
    c = minima[minima >= 0]
    if not len(c):
        return (np.empty(0, np.int64),) * 3
    c = c[np.concatenate([[True], c[1:] != c[:-1]])]
    marked = (values & ~_PLACE) | np.arange(len(values), dtype=np.uint64)
    # a wall before every document's first minimum and one at the end
    first = np.concatenate([[True], owner[c[1:]] != owner[c[:-1]]])
    slots = np.arange(len(c)) + np.cumsum(first)
    laid = np.zeros(len(c) + int(first.sum()) + 1, np.uint64)
    laid[slots] = marked[c] + np.uint64(1)
    at = np.full(len(laid), -1, np.int64)
    at[slots] = c
    starts = np.searchsorted(owner, owner[c], "left")
    ends = np.searchsorted(owner, owner[c], "right") - 1
    left, right = at[_nearest_smaller(laid, -1)[slots]], at[_nearest_smaller(laid, 1)[slots]]
    return c, np.where(left < 0, starts, left + 1), np.where(right < 0, ends, right - 1)


def band_windows(h: np.ndarray, owner: np.ndarray, width: int, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, c, other c, l, r): intervals in which two functions' compact windows overlap, holding both minima and a run of `width`."""
    of = []
    for f in (2 * band, 2 * band + 1):
        values = mix(h ^ mix(np.array([f + 1], np.uint64)))
        minima = run_minima(values, owner, width)
        c, left, right = compact_windows(values, owner, minima)
        bounds = np.zeros((2, len(h)), np.int64)
        bounds[0, c], bounds[1, c] = left, right
        of.append((values, minima, bounds))
    (v, m, x), (w, n, y) = of
    if not len(m):
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 4)
    new = np.flatnonzero((m >= 0) & ((m != np.concatenate([[-1], m[:-1]])) | (n != np.concatenate([[-1], n[:-1]]))))
    c, d = m[new], n[new]
    key = mix(v[c] * _MULT + w[d] + np.uint64(band))
    return key, c, d, np.maximum(x[0, c], y[0, d]), np.minimum(x[1, c], y[1, d])


def _windows(levels: Broadcast, width: int, bands: int):
    margin = _REACH + width

    def parts(ids: np.ndarray, sequences: list[np.ndarray]):
        """(ids, sequences, base, low, high): some documents at once, or a part of a long one with its margins; windows count from low to high."""
        held: list[int] = []
        size = 0
        for k, sequence in enumerate(sequences):
            if len(sequence) > _PART:
                for low in range(0, len(sequence), _PART):
                    base = max(0, low - margin)
                    yield ids[[k]], [sequence[base : low + _PART + margin]], base, low - base, min(low + _PART, len(sequence)) - base
                continue
            if size + len(sequence) > _PART:
                yield ids[held], [sequences[j] for j in held], 0, 0, size
                held, size = [], 0
            held.append(k)
            size += len(sequence)
        if held:
            yield ids[held], [sequences[j] for j in held], 0, 0, size

    @forgetting
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = levels.value
        for frame in batches(frames, "text"):
            sequences = shingle_sequences(frame["text"])
            for ids, some, base, low, high in parts(frame["doc_id"].to_numpy(np.int64), sequences):
                sizes = np.array([len(s) for s in some])
                h = np.concatenate([*some, np.empty(0, np.uint64)])
                owner = np.repeat(np.arange(len(some)), sizes)
                begins = np.cumsum(sizes) - sizes - base
                level = level_of(table, h).astype(np.int64)
                for band in range(bands):
                    key, c, d, left, right = band_windows(h, owner, width, band)
                    common = np.minimum(level[c], level[d])
                    ok = (common > 0) & (c >= low) & (c < high)
                    key, c, left, right, common = key[ok], c[ok], left[ok], right[ok], common[ok]
                    doc = owner[c]
                    # a document that repeats a very common line keeps its roomiest window of it
                    often = np.flatnonzero(common > DEALT_LOG2)
                    if len(often):
                        order = often[np.lexsort((left[often] - right[often], key[often], doc[often]))]
                        again = order[1:][(key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])]
                        ok = np.ones(len(key), bool)
                        ok[again] = False
                        key, c, left, right, common, doc = key[ok], c[ok], left[ok], right[ok], common[ok], doc[ok]
                    place = (c - begins[doc]) << 26 | np.minimum(c - left, _REACH) << 16 | np.minimum(right - c, _REACH) << 6 | common
                    deals = (np.uint64(1) << np.maximum(common - DEALT_LOG2, 0).astype(np.uint64)) - np.uint64(1)
                    deal = (mix(ids[doc].astype(np.uint64)) & deals).astype(np.int32)
                    yield pd.DataFrame({"key": key.view(np.int64), "deal": deal, "doc_id": ids[doc], "place": place})

    return run


def whole_runs(h: np.ndarray, shared: np.ndarray, width: int, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of a document's runs of `width` shingles that are all shared and hold one of the places."""
    if len(h) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    alone = np.cumsum(np.concatenate([[False], ~shared]))
    near = np.zeros(len(h) + 1, np.int64)
    np.add.at(near, np.maximum(around - width + 1, 0), 1)
    np.add.at(near, around + 1, -1)
    starts = np.flatnonzero((alone[width:] == alone[:-width]) & (np.cumsum(near)[: len(h) - width + 1] > 0))
    span = 1
    while span < width:
        step = min(span, width - span)
        h = mix(h[:-step] * _MULT + h[step:])
        span += step
    return starts, h[starts]


def _whole(levels: Broadcast, width: int):
    @forgetting
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text"):
            found = []
            for places, h in zip(frame["places"], shingle_sequences(frame["text"]), strict=True):
                around = np.asarray(places, np.int64)
                # a repeated doc_id may bring a text that the places weren't found in
                found.append(whole_runs(h, level_of(levels.value, h) > 0, width, around[around < len(h)]))
            ids = np.repeat(frame["doc_id"].to_numpy(np.int64), [len(x) for x, _ in found])
            starts, values = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.uint64))
            yield pd.DataFrame({"key": values.view(np.int64), "deal": np.zeros(len(ids), np.int32), "doc_id": ids, "place": starts << 26})

    return run


def _split(place, name: str) -> dict:
    """A packed place's columns: c, reach to the left and to the right, level."""
    place = F.col(place)
    return {
        f"c_{name}": F.shiftright(place, 26),
        f"l_{name}": F.shiftright(place, 16).bitwiseAND(_REACH),
        f"r_{name}": F.shiftright(place, 6).bitwiseAND(_REACH),
        f"level_{name}": place.bitwiseAND(63),
    }


def _firsts(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with the first document of their signature; a running frame, so no group is held in memory."""
    order = Window.partitionBy(*keys).orderBy("doc_id", "place")
    return rows.withColumns({"other_id": F.first("doc_id").over(order), "other_place": F.first("place").over(order)})


def _pairs(paired: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (hub, doc_id, partners) of documents some of whose aligned intervals can hold a passage."""
    split = paired.filter(F.col("doc_id") != F.col("other_id")).withColumns(_split("place", "a") | _split("other_place", "b"))
    room = F.least("l_a", "l_b") + F.least("r_a", "r_b") + 1  # what both intervals hold of one alignment
    fits = 100 * F.least(room, F.lit(width)) >= (2 * percent - 100) * width
    partners = F.max(F.expr("shiftleft(1L, cast(least(level_a, 40) as int))")).alias("partners")
    return split.filter(fits).groupBy(F.col("other_id").alias("hub"), "doc_id").agg(partners)


class Passage:
    """A document's shingles, laid out so that another's are found in it near an alignment."""

    def __init__(self, shingles: np.ndarray):
        self.shingles = shingles
        self.known, self.first, rank = np.unique(self.shingles, return_index=True, return_inverse=True)
        self.placed = np.sort(rank.astype(np.int64) << 32 | np.arange(len(self.shingles)))

    def near(self, rank: np.ndarray, places: np.ndarray, shift: int) -> np.ndarray:
        """For shingles of these ranks at these places of another document: the nearest place here to the alignment, or -1 beyond DRIFT."""
        wanted = places - shift
        at = np.searchsorted(self.placed, rank << 32 | np.clip(wanted, 0, None))
        best, off = np.full(len(rank), -1), np.full(len(rank), DRIFT + 1)
        for k in (at, at - 1):
            found = self.placed[np.clip(k, 0, len(self.placed) - 1)]
            spot = found & 0xFFFFFFFF
            gap = np.where(found >> 32 == rank, np.abs(spot - wanted), DRIFT + 1)
            better = gap < off
            best[better], off[better] = spot[better], gap[better]
        return best


def similar_spans(a: np.ndarray, b: Passage, words: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """Spans of a (shingles in order) near spans of b: (start, stop, other start, other stop, similarity) in words, stops exclusive.

    Matches are chained along an alignment, the most frequent first; a chain that isn't similar enough is cut at its
    widest gap. A passage needs `least` matches, so the search ends when fewer are left.
    """
    if not len(a) or not len(b.shingles):
        return []
    if len(a) == len(b.shingles) and (a == b.shingles).all():
        whole = len(a) + SHINGLE_WORDS - 1
        return [(0, whole, 0, whole, 1.0)] if whole >= words else []
    least = percent * (words - SHINGLE_WORDS + 1) // 100
    at = np.minimum(np.searchsorted(b.known, a), len(b.known) - 1)
    hit = np.flatnonzero(b.known[at] == a)
    if len(hit) < least:
        return []
    rank = at[hit]
    offset = hit - b.first[rank]
    lanes, times = np.unique(offset // (DRIFT // 2), return_counts=True)
    # where no shingle stands twice, set sizes are lengths and counts of matches
    plain = len(b.known) == len(b.shingles) and len(np.unique(a)) == len(a)
    found, free = [], np.ones(len(hit), bool)
    if len(b.known) == len(b.shingles):  # all matches of an alignment lie within two lanes of it
        near = np.concatenate([[0], np.cumsum(times)])
        enough = near[np.searchsorted(lanes, lanes + 2, "right")] - near[np.searchsorted(lanes, lanes - 2)] >= least
        lanes, times = lanes[enough], times[enough]
    for lane in lanes[np.argsort(-times, kind="stable")]:
        if free.sum() < least:
            break
        shift = int(lane) * (DRIFT // 2) + DRIFT // 4
        if (free & (np.abs(offset - shift) <= DRIFT)).sum() < 3:
            continue
        mate = b.near(rank, hit, shift)
        use = np.flatnonzero(free & (mate >= 0))
        queue = [(0, len(use))]
        while queue:
            s, e = queue.pop()
            if e - s < least // 2:  # the rest of a passage's matches may lie off the alignment, but not that many
                continue
            x, y = hit[use[s:e]], mate[use[s:e]]
            low, high = int(y.min()), int(y.max())
            if x[-1] - x[0] + SHINGLE_WORDS < words:
                continue
            if plain:
                cut = slice(np.searchsorted(hit, x[0]), np.searchsorted(hit, x[-1], "right"))
                spots = hit[cut] - offset[cut]
                both = int(((spots >= low) & (spots <= high)).sum())
                union = int(x[-1] - x[0]) + high - low + 2 - both
            else:
                own, other = np.unique(a[x[0] : x[-1] + 1]), np.unique(b.shingles[low : high + 1])
                both = len(np.intersect1d(own, other, assume_unique=True))
                union = len(own) + len(other) - both
            if 100 * both >= percent * union and high - low + SHINGLE_WORDS >= words:
                found.append((int(x[0]), int(x[-1]) + SHINGLE_WORDS, low, high + SHINGLE_WORDS, both / union))
                free[(hit >= x[0]) & (hit <= x[-1])] = False
                continue
            gaps = np.maximum(x[1:] - x[:-1], np.abs(y[1:] - y[:-1]))
            if gaps.max() > 1:
                k = s + 1 + int(gaps.argmax())
                queue += [(s, k), (k, e)]
    return found


def _packed(h: np.ndarray) -> bytes:
    """The upper 40 bits of each hash: enough to tell the shingles of two documents apart, in fewer bytes to send."""
    return h.view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def _unpacked(content: bytes) -> np.ndarray:
    out = np.zeros((len(content) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(content, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _verified(slim: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Spans of the pairs' documents that are similar enough; texts are cut into shingles once a document, not once a pair."""
    wanted, count = measured(pairs.select("doc_id").union(pairs.select("hub")).distinct())
    texts = slim.join(small(wanted, count.rows), "doc_id", "left_semi")

    @forgetting
    def shingles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text"):
            yield pd.DataFrame({"doc_id": frame["doc_id"], "content": [_packed(s) for s in shingle_sequences(frame["text"])]})

    def match(hub: Passage, content: bytes) -> list[tuple]:
        return similar_spans(_unpacked(content), hub, words, percent)

    contents = texts.mapInPandas(shingles, "doc_id long, content binary")
    return against_hubs(pairs, contents, lambda b: Passage(_unpacked(b)), match, _SPANS)


def _open(paired: DataFrame, found: DataFrame) -> DataFrame:
    """Paired windows whose minimum lies in no passage found of their document."""
    spans = found.select("doc_id", "start_word", "end_word").unionByName(
        found.select(F.col("hub").alias("doc_id"), F.col("other_start").alias("start_word"), F.col("other_end").alias("end_word"))
    )
    # the longest span at each start: no more than the document's words
    spans = spans.groupBy("doc_id", "start_word").agg(F.max("end_word").alias("end_word"))
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    c = F.shiftright("place", 26)
    inside = F.exists("spans", lambda s: (s["start_word"] <= c) & (c + SHINGLE_WORDS <= s["end_word"]))
    return paired.join(spans, "doc_id", "left").filter(~F.coalesce(inside, F.lit(False))).drop("spans")


def passages(
    docs: DataFrame, words: int = PASSAGE_WORDS, percent: int = SIMILARITY_PERCENT, bands: int = BANDS, cells_log2: int = CELLS_LOG2
) -> DataFrame:
    """Passages of at least `words` words that another document has too, nearly or exactly.

    (doc_id, start_word, end_word, other_id, other_start, other_end, similarity): word places, ends
    exclusive; other_id is a document that stands for the passage. Of documents that share a passage, all but the first
    have a row for it. Null and empty texts, and those under `words` words, have none; rows with a null
    doc_id are left out; rows that repeat a doc_id are looked at each, under one id, and not compared with one another.
    An empty table gives an empty one; other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    width = words - SHINGLE_WORDS + 1
    levels = shingle_levels(slim, cells_log2=cells_log2)
    rows = _firsts(slim.mapInPandas(_windows(levels, width, bands), "key long, deal int, doc_id long, place long"), "key", "deal")
    # of a key that is dealt out, the first documents of the deals are joined in turn
    dealt = F.col("place").bitwiseAND(63) > DEALT_LOG2
    paired = durable(rows.filter((F.col("doc_id") != F.col("other_id")) | (dealt & (F.col("place") == F.col("other_place")))))
    heads = _firsts(paired.filter(F.col("doc_id") == F.col("other_id")).select("key", "deal", "doc_id", "place"), "key")
    pairs = durable(_pairs(paired.unionByName(heads), width, percent).groupBy("hub", "doc_id").agg(F.max("partners").alias("partners")))
    found = durable(_verified(slim, pairs, words, percent))

    left = durable(_open(paired.filter(F.col("doc_id") != F.col("other_id")), found))
    again = _pairs(_firsts(left.select("key", "deal", "doc_id", "place"), "key", "deal"), width, percent)
    # every document of an open signature, found or not, and the first one too
    classes, count = measured(left.select("key", "deal").distinct())
    near = paired.join(small(classes, count.rows), ["key", "deal"], "left_semi")
    near = near.select("doc_id", "place").union(near.select("other_id", "other_place"))
    near = near.select("doc_id", F.shiftright("place", 26).alias("c")).distinct().groupBy("doc_id").agg(F.collect_list("c").alias("places"))
    near, count = measured(near)
    texts = slim.join(small(near.select("doc_id"), count.rows), "doc_id", "left_semi")
    runs = texts.join(near, "doc_id").mapInPandas(_whole(levels, width), "key long, deal int, doc_id long, place long")
    exact = _firsts(runs, "key").filter(F.col("doc_id") != F.col("other_id")).groupBy(F.col("other_id").alias("hub"), "doc_id").agg(F.count(F.lit(1)).alias("partners"))
    fresh = again.unionByName(exact).groupBy("hub", "doc_id").agg(F.max("partners").alias("partners"))
    fresh = durable(fresh.join(pairs.select("hub", "doc_id"), ["hub", "doc_id"], "left_anti"))
    levels.destroy()
    found = found.unionByName(_verified(slim, fresh, words, percent))
    kept = F.min(F.struct(F.col("hub").alias("other_id"), "other_start", "other_end", "similarity")).alias("o")
    return found.groupBy("doc_id", "start_word", "end_word").agg(kept).select(
        "doc_id", "start_word", "end_word", "o.other_id", "o.other_start", "o.other_end", "o.similarity"
    )


def remove_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with every found passage cut from its text (the document that stands for it keeps it); all columns stay, other ones as they are.

    White space before a passage goes with it. Texts without a passage and rows with a null doc_id are returned as they are.
    """
    of, at = fresh_name(docs, "of_doc"), fresh_name(docs, "spans")
    spans = found.groupBy(F.col("doc_id").alias(of)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(at))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_without(t, s) for t, s in zip(texts, spans, strict=True)])

    joined = docs.join(spans, F.col("doc_id") == F.col(of), "left")
    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(cut("text", F.coalesce(at, F.array())))
    return joined.withColumn("text", text).select(*docs.columns)


def _without(text: str | None, spans) -> str | None:
    if text is None or spans is None or not len(spans):
        return text
    places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    keep = np.ones(len(places), bool)
    for s in spans:
        keep[s["start_word"] : s["end_word"]] = False
    out, at = [], 0
    for (start, stop), stays in zip(places, keep, strict=True):
        if stays:
            out.append(text[at:stop])
        at = stop
    out.append(text[at:])
    return "".join(out)
