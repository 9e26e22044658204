"""Cropped and edited copies of images by local descriptors.

Corners are found on several scales, turned by the intensity centroid of their
patch, and described by 256 binary brightness tests. Bands of the descriptor key a
Hamming table: images are joined with queries on equal bands, pairs that agree
on enough corners are compared descriptor by descriptor, and a similarity transform must bring
enough matched corners together. The strongest corners of every cell of a grid are kept, so their number follows the
image's size, and large images are described tile by tile. Equal contents are searched once. Images are binary columns of
netpbm type (PGM or PPM, 8 bits); other content has no features and matches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import batches, durable, forgetting, measured, small
from tracemill.llm.components import connected_components

#: Strongest corners kept in each cell (side in pixels of its scale) of an image, and the scales as divisors.
CORNERS, CELL, SCALES = 24, 64, (1.0, 1.25, 1.5625, 1.953, 2.441)
#: Descriptor bits, bands of the Hamming table and bits of each.
BITS, BANDS, BAND_BITS = 256, 8, 32
RADIUS, MARGIN, TURNS = 10, 13, 72
#: Bits in which matched descriptors may differ, corners that must agree in a band, and corners that the transform must explain.
MOST_BITS, LEAST_SHARED, LEAST_INLIERS = 64, 2, 8
TOLERANCE = 3.0
#: Side of a tile of a large image; tiles overlap by what a corner of the coarsest scale needs.
TILE, OVERLAP = 1024, 80
#: Bytes of images that a task decodes and describes before it hands rows on; a larger image is taken alone.
BYTES_AT_ONCE = 1_000_000
#: Keys of the queries' bands are marked in a table of 2**MARKS_LOG2 bits, of this size whatever the input's; keys of images that aren't marked are not sent.
MARKS_LOG2 = 26
_FOLD, _SPREAD = (1 << 28) - 57, 0x9E3779B1  # a key folded to 28 bits times a number of 32 fits in a long

_HEADER = re.compile(rb"^P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s")
_random = np.random.default_rng(256)
_FAR, _ANGLE = RADIUS * np.sqrt(_random.uniform(0, 1, BITS)), _random.uniform(0, 2 * np.pi, BITS)
_X, _Y = _FAR * np.cos(_ANGLE), _FAR * np.sin(_ANGLE)
# a turned patch is brighter towards greater x, so tests run across that direction: either outcome is as likely
_TESTS = np.stack(
    [_X, _Y, np.clip(_X + _random.uniform(-2, 2, BITS), 0.5 - RADIUS, RADIUS - 0.5), _random.uniform(-1, 1, BITS) * np.sqrt(RADIUS**2 - _X**2)], axis=-1
).reshape(BITS, 2, 2)


def _turned_tests() -> np.ndarray:
    """Test places for every turn: turns x BITS x 2 ends x (row, column)."""
    angle = np.arange(TURNS) * 2 * np.pi / TURNS
    cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    x, y = _TESTS[None, :, :, 0], _TESTS[None, :, :, 1]
    return np.rint(np.stack([sin * x + cos * y, cos * x - sin * y], axis=-1)).astype(np.int64)


_TURNED = _turned_tests()
_YY, _XX = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = _XX**2 + _YY**2 <= RADIUS**2
_YD, _XD = _YY[_DISC], _XX[_DISC]


def decode_image(content: bytes | None) -> np.ndarray | None:
    """Grey values of a PGM or PPM image; None for anything else."""
    head = _HEADER.match(content) if content else None
    if not head:
        return None
    kind, width, height, most = (int(g) for g in head.groups())
    channels = 3 if kind == 6 else 1
    if not 0 < most < 256 or not width * height or len(content) < head.end() + width * height * channels:
        return None
    grey = np.frombuffer(content, np.uint8, width * height * channels, head.end()).astype(np.float32)
    return grey.reshape(height, width, channels).mean(axis=2) if channels == 3 else grey.reshape(height, width)


def encode_image(grey: np.ndarray) -> bytes:
    grey = np.clip(np.rint(grey), 0, 255).astype(np.uint8)
    return b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0]) + grey.tobytes()


def _box(stack: np.ndarray, radius: int) -> np.ndarray:
    """Mean over squares, edges repeated."""
    size = 2 * radius + 1
    padded = np.pad(stack, ((0, 0), (radius + 1, radius), (radius + 1, radius)), mode="edge").astype(np.float64)
    padded[:, 0, :] = 0
    padded[:, :, 0] = 0
    sums = padded.cumsum(axis=1).cumsum(axis=2)
    return (sums[:, size:, size:] - sums[:, :-size, size:] - sums[:, size:, :-size] + sums[:, :-size, :-size]) / size**2


def _shrink(stack: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return stack
    stack = _box(stack, 1)
    rows = np.minimum(np.arange(int(stack.shape[1] / scale)) * scale, stack.shape[1] - 1.001)
    columns = np.minimum(np.arange(int(stack.shape[2] / scale)) * scale, stack.shape[2] - 1.001)
    r, c = rows.astype(int), columns.astype(int)
    a, b = (rows - r)[None, :, None], (columns - c)[None, None, :]
    top = stack[:, r][:, :, c] * (1 - b) + stack[:, r][:, :, c + 1] * b
    low = stack[:, r + 1][:, :, c] * (1 - b) + stack[:, r + 1][:, :, c + 1] * b
    return top * (1 - a) + low * a


def describe(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of images of one size: owner (image of each corner), geometry (x, y, scale, turn) and packed descriptors."""
    owners, places, codes = [], [], []
    for scale in SCALES:
        level = _box(_shrink(stack, scale), 1)
        count, height, width = level.shape
        if height <= 2 * MARGIN + 2 or width <= 2 * MARGIN + 2:
            continue
        gy, gx = np.gradient(level, axis=1), np.gradient(level, axis=2)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        corner = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = corner[:, MARGIN:-MARGIN, MARGIN:-MARGIN]
        peak = inner > 1e-6
        for dy in (-2, -1, 0, 1, 2):
            for dx in (-2, -1, 0, 1, 2):
                if dy or dx:
                    peak &= inner >= corner[:, MARGIN + dy : height - MARGIN + dy, MARGIN + dx : width - MARGIN + dx]
        image, y, x = np.nonzero(peak)
        if not len(image):
            continue
        across = width // CELL + 1
        cell = (image * (height // CELL + 1) + (y + MARGIN) // CELL) * across + (x + MARGIN) // CELL
        order = np.lexsort((x, y, -inner[image, y, x], cell))
        start = np.flatnonzero(np.concatenate([[True], cell[order][1:] != cell[order][:-1]]))
        rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        order = order[rank < CORNERS]
        image, y, x = image[order], y[order] + MARGIN, x[order] + MARGIN
        patch = level[image[:, None], y[:, None] + _YD, x[:, None] + _XD]
        patch = patch - patch.mean(axis=1, keepdims=True)
        turn = np.arctan2((patch * _YD).sum(axis=1), (patch * _XD).sum(axis=1))
        step = np.rint(turn / (2 * np.pi) * TURNS).astype(int) % TURNS
        tests = _TURNED[step]
        smooth = _box(level, 1)
        value = smooth[image[:, None, None], y[:, None, None] + tests[..., 0], x[:, None, None] + tests[..., 1]]
        owners.append(image)
        places.append(np.stack([x * scale, y * scale, np.full(len(x), scale), turn], axis=1))
        codes.append(np.packbits(value[:, :, 0] < value[:, :, 1], axis=1))
    if not owners:
        return np.empty(0, np.int64), np.empty((0, 4)), np.empty((0, BITS // 8), np.uint8)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return owner[order], np.concatenate(places)[order], np.concatenate(codes)[order]


def _bands(codes: np.ndarray) -> np.ndarray:
    """Band keys: corners x BANDS, the band's number over its bits of the descriptor."""
    size = BAND_BITS // 8
    parts = codes[:, : BANDS * size].reshape(len(codes), BANDS, size).astype(np.int64)
    keys = np.arange(BANDS, dtype=np.int64)[None, :] << BAND_BITS
    for k in range(size):
        keys = keys | parts[:, :, k] << 8 * k
    return keys


def _tiles(image: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    for top in range(0, max(image.shape[0] - OVERLAP, 1), TILE):
        for left in range(0, max(image.shape[1] - OVERLAP, 1), TILE):
            yield top, left, image[top : top + TILE + OVERLAP, left : left + TILE + OVERLAP]


def describe_each(images: list[np.ndarray | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index, geometry, descriptors) of the images that have corners; those of one size are taken together, large ones tile by tile.

    Corners in the overlap of two tiles may come twice.
    """
    shapes: dict[tuple[int, int], list[int]] = {}
    for k, image in enumerate(images):
        if image is not None:
            shapes.setdefault(image.shape, []).append(k)
    for shape, rows in shapes.items():
        if max(shape) > TILE + OVERLAP:
            for k in rows:
                places, codes = [np.empty((0, 4))], [np.empty((0, BITS // 8), np.uint8)]
                for top, left, tile in _tiles(images[k]):
                    _, place, code = describe(tile[None])
                    places.append(place + [left, top, 0, 0])
                    codes.append(code)
                if sum(map(len, codes)):
                    yield k, np.concatenate(places), np.concatenate(codes)
            continue
        step = max(1, 250_000 // (shape[0] * shape[1]))
        for low in range(0, len(rows), step):
            part = rows[low : low + step]
            owner, places, codes = describe(np.stack([images[k] for k in part]))
            bounds = np.searchsorted(owner, np.arange(len(part) + 1))
            for k, a, b in zip(part, bounds[:-1], bounds[1:], strict=True):
                if b > a:
                    yield k, places[a:b], codes[a:b]


def features(media: DataFrame) -> DataFrame:
    """(mark, bands array<long>, places binary, codes binary) of media (mark, content); undecodable rows are left out."""

    @forgetting
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "content", BYTES_AT_ONCE):
            marks = frame["mark"].to_numpy()
            out = [
                (marks[k], _bands(codes).ravel(), places.astype("<f4").tobytes(), codes.tobytes())
                for k, places, codes in describe_each([decode_image(c) for c in frame["content"]])
            ]
            if out:
                yield pd.DataFrame(out, columns=["mark", "bands", "places", "codes"])

    return media.select("mark", "content").mapInPandas(run, "mark binary, bands array<long>, places binary, codes binary")


def _marked(keys: DataFrame) -> Broadcast:
    """A table with a bit set for each band key: 2**MARKS_LOG2 bits. Keys may share a bit, so what isn't marked is absent for certain."""
    at = F.shiftright(F.pmod("key", F.lit(_FOLD)) * _SPREAD, 20).bitwiseAND((1 << MARKS_LOG2) - 1)
    words = keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()  # at most 2**(MARKS_LOG2 - 6) rows
    table = np.zeros(1 << (MARKS_LOG2 - 6), np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(table.view(np.uint64))


def _hits(media: DataFrame, marked: Broadcast) -> DataFrame:
    """(mark, key): band keys of the images that a query may have."""

    @forgetting
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = marked.value
        for frame in batches(frames, "content", BYTES_AT_ONCE):
            marks = frame["mark"].to_numpy()
            for k, _, codes in describe_each([decode_image(c) for c in frame["content"]]):
                keys = np.unique(_bands(codes))
                at = keys % _FOLD * _SPREAD >> 20 & (1 << MARKS_LOG2) - 1
                keys = keys[(table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1]
                if len(keys):
                    yield pd.DataFrame({"mark": [marks[k]] * len(keys), "key": keys})

    return media.select("mark", "content").mapInPandas(run, "mark binary, key long")


def consensus(places_a: np.ndarray, codes_a: np.ndarray, places_b: np.ndarray, codes_b: np.ndarray) -> int:
    """Matched corners that one similarity transform explains, at best."""
    wide = lambda codes: np.ascontiguousarray(codes).view(np.uint64)
    far = np.bitwise_count(wide(codes_a)[:, None, :] ^ wide(codes_b)[None, :, :]).sum(axis=2, dtype=np.int64)
    best = far.argmin(axis=1)
    rows = np.flatnonzero((far[np.arange(len(far)), best] <= MOST_BITS) & (far.argmin(axis=0)[best] == np.arange(len(far))))
    if len(rows) < LEAST_INLIERS:
        return 0
    a, b = places_a[rows], places_b[best[rows]]
    ratio = b[:, 2] / a[:, 2]
    turn = b[:, 3] - a[:, 3]
    most = 0
    # each match proposes a transform by its own scale and turn, then by that turn's rounding to none
    for angle in (turn, np.zeros(len(rows))):
        cos, sin = ratio * np.cos(angle), ratio * np.sin(angle)
        dx, dy = a[None, :, 0] - a[:, None, 0], a[None, :, 1] - a[:, None, 1]
        x = b[:, None, 0] + cos[:, None] * dx - sin[:, None] * dy
        y = b[:, None, 1] + sin[:, None] * dx + cos[:, None] * dy
        ok = (x - b[None, :, 0]) ** 2 + (y - b[None, :, 1]) ** 2 <= TOLERANCE**2
        # matches that agree on the place must agree on scale and turn too
        ok &= np.abs(np.log(ratio[None, :] / ratio[:, None])) < 0.5
        ok &= np.abs((turn[None, :] - angle[:, None] + np.pi) % (2 * np.pi) - np.pi) < 0.6
        # corners found on several scales count once
        times = ok.sum(axis=1)
        spots = np.rint(a[:, :2] / 3).astype(np.int64)
        spots = spots[:, 0] << 32 | spots[:, 1]
        for k in np.argsort(-times):
            if times[k] <= most:
                break
            most = max(most, len(np.unique(spots[ok[k]])))
    return most


def _of_class(media: DataFrame) -> DataFrame:
    """media (media_id, content) with the digest of its content, null ids and contents left out."""
    known = media.filter(F.col("media_id").isNotNull() & F.col("content").isNotNull())
    return known.select(F.col("media_id").cast("long").alias("media_id"), F.unhex(F.md5("content")).alias("mark"), "content")


def _verified(pairs: DataFrame, rows: int, described: DataFrame, all_media: DataFrame) -> DataFrame:
    """(query, mark, inliers) of so many pairs (query, mark) that are copies; each content's corners are found once."""
    found_marks = pairs.select("mark").distinct()
    first = all_media.select("media_id", "mark").join(small(found_marks, rows), "mark", "left_semi").groupBy("mark").agg(F.min("media_id").alias("media_id"))
    first, count = measured(first)
    wanted = features(all_media.join(small(first, count.rows), ["mark", "media_id"], "left_semi")).dropDuplicates(["mark"])

    @forgetting
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = lambda b: np.frombuffer(b, "<f4").reshape(-1, 4).astype(np.float64)
        codes = lambda b: np.frombuffer(b, np.uint8).reshape(-1, BITS // 8)
        for frame in frames:
            found = [
                consensus(places(r.places_a), codes(r.codes_a), places(r.places_b), codes(r.codes_b)) for r in frame.itertuples(index=False)
            ]
            out = frame[["query", "mark"]].assign(inliers=found)
            yield out[out["inliers"] >= LEAST_INLIERS]

    side = lambda df, key, name: df.select(F.col("mark").alias(key), F.col("places").alias(f"places_{name}"), F.col("codes").alias(f"codes_{name}"))
    both = pairs.join(side(described, "query", "a"), "query").join(side(wanted, "mark", "b"), "mark")
    return both.mapInPandas(run, "query binary, mark binary, inliers long")


def _node(kind: str, mark: str) -> Column:
    return F.xxhash64(F.lit(kind), mark)


def _classes(links: DataFrame) -> DataFrame:
    return durable(connected_components(links.select(_node("query", "query").alias("a"), _node("image", "mark").alias("b"))))


def _classed(df: DataFrame, kind: str, mark: str, classes: DataFrame) -> DataFrame:
    """df with the class of its query or image; one without a link is a class of its own."""
    node = _node(kind, mark)
    return df.withColumn("_node", node).join(classes.withColumnRenamed("id", "_node"), "_node", "left").withColumn("class", F.coalesce("component", "_node")).drop("_node", "component")


def _across(lists: DataFrame, hits: DataFrame, classes: DataFrame) -> DataFrame:
    """(query, mark, corners): all queries and images that share a key and are of different classes."""
    asking, seen = _classed(lists, "query", "query", classes), _classed(hits, "image", "mark", classes).withColumnRenamed("class", "other")
    apart = asking.join(seen.select("key", "other").distinct(), "key").filter(F.col("class") != F.col("other"))
    return apart.join(seen, ["key", "other"]).select("query", "mark", "corners")


def find_copies(queries: DataFrame, media: DataFrame) -> DataFrame:
    """(media_id, n_queries, query_id, inliers): images of media (media_id, content) that hold much of some queries' pictures.

    One row for each such image. Queries and images are linked when their corners match, and linked ones are a class: n_queries is how many queries the image's class has, query_id the
    least of them, inliers the most matched corners with one of those that the image was compared with. Each image is compared with the least query and each query with the least image that share enough
    with it, of those that head the lists of equal band keys; what that leaves in different classes is compared pair by pair, so no link between classes is lost and a group of near copies costs as much as it has members.
    Null, broken or featureless images match nothing; equal images match; repeated rows of an id count
    once. Empty tables give an empty one. All rows of both tables are searched, and no bucket is cut.
    """
    asked, all_media = _of_class(queries), _of_class(media)
    asking = durable(asked.select("media_id", "mark").distinct().groupBy("mark").agg(F.min("media_id").alias("query_id"), F.count(F.lit(1)).alias("asking")))
    described = durable(features(asked).dropDuplicates(["mark"]))
    keys = described.select(F.col("mark").alias("query"), F.posexplode("bands").alias("at", "key"))
    lists = durable(keys.groupBy("query", "key").agg(F.collect_set(F.floor(F.col("at") / BANDS).cast("int")).alias("corners")))
    marked = _marked(lists)
    hits = durable(_hits(all_media, marked).distinct())
    marked.destroy()
    heads = durable(lists.groupBy("key").agg(F.min(F.struct("query", "corners")).alias("head"), F.count(F.lit(1)).alias("queries")))
    # keys that several queries have; in the others' lists all images meet their one query
    crowded, count = measured(heads.filter("queries > 1").select("key"))
    lists, crowd = (df.join(small(crowded, count.rows), "key", "left_semi") for df in (lists, hits))
    stars = hits.join(heads, "key").select("head.query", "mark", "head.corners")
    stars = stars.unionByName(lists.join(crowd.groupBy("key").agg(F.min("mark").alias("mark")), "key").select("query", "mark", "corners"))
    corners = F.array_distinct(F.flatten(F.collect_set("corners"))).alias("corners")
    shared = durable(stars.groupBy("query", "mark").agg(corners))
    enough = F.size("corners") >= LEAST_SHARED
    likely = shared.filter(enough)
    pairs = likely.groupBy("mark").agg(F.min("query").alias("query")).unionByName(likely.groupBy("query").agg(F.min("mark").alias("mark"))).distinct()
    pairs, count = measured(pairs)
    links, linked = measured(_verified(pairs, count.rows, described, all_media))
    classes = _classes(links)
    apart = _classed(_classed(shared, "query", "query", classes).withColumnRenamed("class", "other"), "image", "mark", classes).filter(F.col("class") != F.col("other"))
    rest = _across(lists, crowd, classes).unionByName(apart.select("query", "mark", "corners")).groupBy("query", "mark").agg(corners).filter(enough)
    rest, count = measured(rest.select("query", "mark").join(pairs, ["query", "mark"], "left_anti"))
    if count.rows:
        more, added = measured(_verified(rest, count.rows, described, all_media))
        if added.rows:
            links, linked = measured(links.unionByName(more))
            classes = _classes(links)
    of = _classed(asking.withColumnRenamed("mark", "query"), "query", "query", classes).groupBy("class").agg(F.sum("asking").alias("n_queries"), F.min("query_id").alias("query_id"))
    found = _classed(links.groupBy("mark").agg(F.max("inliers").alias("inliers")), "image", "mark", classes).join(of, "class")
    return all_media.select("media_id", "mark").distinct().join(small(found, linked.rows), "mark").select("media_id", "n_queries", "query_id", "inliers")


def pictures(vectors: DataFrame, size: int = 96) -> DataFrame:
    """(media_id, content): a picture for each vector (vec_id, embedding), its components the weights of cosine waves.

    The test tables hold no images; like vectors give like pictures. Waves are as fine as a descriptor's patch is wide: without
    such detail all corners look alike. Null or non-finite vectors give null content.
    """

    @forgetting
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waves: dict[int, np.ndarray] = {}
        for frame in frames:
            out = []
            for value in frame["embedding"]:
                v = None if value is None else np.asarray(value, np.float64)
                if v is None or not len(v) or not np.isfinite(v).all():
                    out.append(None)
                    continue
                if len(v) not in waves:
                    side = int(np.ceil(np.sqrt(len(v))))
                    line = np.cos(np.pi * (np.arange(size) + 0.5)[None, :] / size * (3 * np.arange(side) + 2)[:, None])
                    waves[len(v)] = np.einsum("iy,jx->ijyx", line, line).reshape(side * side, size, size)[: len(v)]
                grey = np.tensordot(v, waves[len(v)], 1)
                out.append(encode_image(128 + 45 * grey / (grey.std() + 1e-9)))
            yield pd.DataFrame({"media_id": frame["vec_id"].astype("Int64"), "content": out})

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInPandas(run, "media_id long, content binary")


def edited(media: DataFrame, crop: int = 14, contrast: float = 0.8, brightness: float = 20.0) -> DataFrame:
    """(media_id, content): cropped on all sides (by different amounts) and changed in contrast and brightness."""

    @forgetting
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "content", BYTES_AT_ONCE):
            images = [decode_image(c) for c in frame["content"]]
            cut = [None if i is None else encode_image(i[crop : -(crop // 2), crop // 2 : -crop] * contrast + brightness) for i in images]
            yield frame.assign(content=cut)

    return media.mapInPandas(run, "media_id long, content binary")
