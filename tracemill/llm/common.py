"""Helpers that the operators share: word hashing, shingles, durable intermediate results."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
#: Entries a worker's word cache holds before it starts afresh.
CACHE_ENTRIES = 400_000
#: Keys longer than this are computed each time, so that a memo table is bounded in bytes too.
LONGEST_KEY = 64
#: Narrow tables (ids and numbers, some 16 to 48 bytes a row) are broadcast up to so many rows; beyond it both sides are shuffled.
MOST_BROADCAST = 500_000

_U64 = np.uint64
_MULT = _U64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the cluster's shared checkpoint folder, the one that spark.checkpoint.dir names.

    Where none is named, a local master (tests) gets a temporary folder; a cluster is refused, as its executors share no local folder.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return df.checkpoint(eager=True)


def measured(df: DataFrame, *what: Column) -> tuple[DataFrame, Row]:
    """The durable frame and aggregates over its rows, taken while it is written."""
    seen = Observation()
    kept = durable(df.observe(seen, F.count(F.lit(1)).alias("rows"), *what))
    found = seen.get
    return kept, Row(**(found or {"rows": 0}))


def small(df: DataFrame, rows: int) -> DataFrame:
    """A frame of so many (narrow) rows, to be broadcast if that is within the bound."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand Python at most `rows` documents at a time, unless the session already asks for fewer.

    A batch of long texts is held several times over (JVM, Arrow, Python), so the default of 10,000 rows
    costs an executor hundreds of megabytes per core.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class BoundedCache(dict):
    """A memo table that forgets everything when it holds `limit` entries.

    A worker process outlives its tasks, so only the table in use stays filled: the
    first miss in another one empties it.
    """

    filled: BoundedCache | None = None

    def __init__(self, compute, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(key) > LONGEST_KEY:
            return self.compute(key)
        if BoundedCache.filled is not self:
            if BoundedCache.filled is not None:
                BoundedCache.filled.clear()
            BoundedCache.filled = self
        elif len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def forgetting(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over a task's batches; afterwards the memo table is emptied and freed memory goes back to the system.

    Workers are reused and several may wait idle, so what one task leaves would count beside the next stage's needs.
    """

    @functools.wraps(run)
    def task(frames):
        try:
            yield from run(frames)
        finally:
            if BoundedCache.filled is not None:
                BoundedCache.filled.clear()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return task


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09-0x0D), with A-Z lower-cased; null counts as empty."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (wrapping arithmetic)."""
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


#: A random value for each byte, A-Z as a-z, and the bytes that part words.
_BYTE = np.random.default_rng(5).integers(0, 1 << 64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text hashed at once; a longer word is hashed alone.
_CHUNK = 1 << 19


@functools.lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    inverse = pow(int(_MULT), -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([[_U64(1)], np.full(size, x, _U64)])) for x in (_MULT, _U64(inverse)))


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words of these bytes. A word's hash is a polynomial of its bytes, taken from running sums, so all words cost a few array steps."""
    data = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _powers(max(2 * _CHUNK, len(data)))
    sums = np.zeros(len(data) + 1, _U64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U64) * _MULT), starts


def _cuts(raw: bytes) -> Iterator[bytes]:
    """A long text in parts that end between words."""
    low = 0
    while len(raw) - low > _CHUNK:
        gap = re.compile(rb"[\x20\x09-\x0D]").search(raw, low + _CHUNK // 2)
        if not gap:
            break
        yield raw[low : gap.start()]
        low = gap.end()
    yield raw[low:]


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    h = np.full(len(words) - size + 1, size, _U64)
    for k in range(size):
        h = h * _MULT + words[k : len(words) - size + 1 + k]
    return mix(h)


def hashed_texts(texts: Iterable[str | None], size: int = SHINGLE_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the 64-bit hashes of its words (as words_of has them) and of its shingles, in order.

    Fewer words than `size` make one shingle of all of them; null counts as empty.
    """

    def several(held: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        words, starts = _hashed(b"\n".join(held))
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in held)]))
        shingles = _shingles(words, size) if len(words) >= size else words[:0]
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = words[low:high]
            yield own, shingles[low : high - size + 1] if high - low >= size else _shingles(own, len(own)) if len(own) else own

    held, length = [], 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if len(raw) > _CHUNK:
            yield from several(held) if held else ()
            held, length = [], 0
            words = np.concatenate([_hashed(part)[0] for part in _cuts(raw)])
            yield words, _shingles(words, min(size, len(words))) if len(words) else words
            continue
        if length + len(raw) >= _CHUNK:
            yield from several(held) if held else ()
            held, length = [], 0
        held.append(raw)
        length += len(raw) + 1
    yield from several(held) if held else ()


def shingle_sequences(texts: Iterable[str | None]) -> list[np.ndarray]:
    return [shingles for _, shingles in hashed_texts(texts)]


def batches(frames: Iterable[pd.DataFrame], column: str, most_chars: int = 16_000_000) -> Iterator[pd.DataFrame]:
    """Split pandas batches so that no piece holds much more than `most_chars` of a text column."""
    for frame in frames:
        sizes = frame[column].str.len().fillna(0).to_numpy(dtype=np.int64, na_value=0)
        part = np.cumsum(sizes) // most_chars
        if not len(part) or part[-1] == 0:
            yield frame
        else:
            for _, piece in frame.groupby(part, sort=True):
                yield piece


def pairs_in_runs(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs i < j inside runs [start, start + count); linear in the number of pairs."""
    ends = np.repeat(starts + counts, counts)
    left = np.concatenate([np.arange(s, s + c) for s, c in zip(starts, counts, strict=True)]) if len(starts) else np.empty(0, np.int64)
    fan = ends - left - 1
    i = np.repeat(left, fan)
    offset = np.arange(len(i)) - np.repeat(np.cumsum(fan) - fan, fan)
    return i, i + 1 + offset
