"""Language identification by Bayesian evidence fusion.

For every text and language the log likelihood of its letter trigrams
(a model fitted here) is added to three other pieces of evidence: the prior of its host,
smoothed towards the host's domain and that towards the whole corpus; how likely the
declared markup language is under the language; and the same for the last label of the address. The
last three are counted by grouped aggregation over all rows, from the posteriors
of the text alone, a row's own share left out of its host's. One class, "und", stands for text unlike every
known language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import durable, forgetting

BUCKETS_LOG2 = 15
#: About so many labelled documents of each language fit the trigram model.
TRAINING_DOCUMENTS = 5_000
#: A long text counts as so many trigrams at most, so that declared evidence isn't drowned by dependent counts.
TEMPER = 60
#: Pseudo-counts of each level of the priors and of the declared evidence.
STRENGTH = 5.0
LEAST_CONFIDENCE = 0.5
#: Share of a text's trigrams that may come from anywhere (names, codes, other languages).
NOISE = 0.1
UNKNOWN = "und"
#: More languages than this are refused (the model takes 128 KB for each and is broadcast).
MOST_LANGUAGES = 2_000

_KEPT = np.full(256, 32, np.uint8)
for _range in (range(ord("a"), ord("z") + 1), range(0x80, 0x100)):
    _KEPT[list(_range)] = list(_range)


def trigram_counts(text: str | None) -> np.ndarray:
    """Bucketed byte trigrams of lower-cased letters; anything else is a gap, and gaps count once."""
    raw = _KEPT[np.frombuffer(f" {text} ".lower().encode("utf-8", "replace"), np.uint8)] if text else np.empty(0, np.uint8)
    if len(raw) < 3:
        return np.zeros(1 << BUCKETS_LOG2, np.int64)
    gap = raw == 32
    ok = ~((gap[:-2] & gap[1:-1]) | (gap[1:-1] & gap[2:]))
    a = raw.astype(np.uint32)
    key = (a[:-2] << 16 | a[1:-1] << 8 | a[2:])[ok] * np.uint32(2654435761)
    return np.bincount(key >> np.uint32(32 - BUCKETS_LOG2), minlength=1 << BUCKETS_LOG2)


@dataclass
class TrigramModel:
    languages: list[str]
    logs: np.ndarray  # buckets x languages, the last column for UNKNOWN

    def evidence(self, text: str | None) -> tuple[np.ndarray, int]:
        counts = trigram_counts(text)
        used = np.flatnonzero(counts)
        n = int(counts.sum())
        if not n:
            return np.zeros(self.logs.shape[1]), 0
        total = counts[used].astype(np.float64) @ self.logs[used].astype(np.float64)
        return total * (min(n, TEMPER) / n), n


@forgetting
def _language_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"], strict=True):
            counts = trigram_counts(text)
            sums[lang] = sums[lang] + counts if lang in sums else counts
    if sums:
        yield pd.DataFrame({"lang": list(sums), "counts": list(sums.values())})


def train_trigrams(docs: DataFrame, most: int = TRAINING_DOCUMENTS) -> TrigramModel:
    """Fit on about `most` rows of (doc_id, text, lang) for each language, chosen by a hash of the id.

    All languages are kept, those of a few rows too. No labelled row: no language but UNKNOWN.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    shares = known.groupBy("lang").agg((F.lit(float(most)) / F.count(F.lit(1))).alias("share")).limit(MOST_LANGUAGES + 1).collect()
    if len(shares) > MOST_LANGUAGES:
        raise ValueError(f"documents in more than {MOST_LANGUAGES} languages")
    shares = F.broadcast(docs.sparkSession.createDataFrame([(r.lang, r.share) for r in shares], "lang string, share double"))
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("language sample")), F.lit(1_000_000)) / 1_000_000
    parts = known.join(shares, "lang").filter(place < F.col("share")).select("lang", "text").mapInPandas(_language_counts, "lang string, counts array<long>")
    summed = (
        parts.select("lang", F.posexplode("counts").alias("bucket", "n"))
        .filter("n > 0")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )  # at most 2**BUCKETS_LOG2 rows a language
    languages = summed["lang"].unique()
    languages = sorted(languages)
    size = 1 << BUCKETS_LOG2
    logs = np.full((size, len(languages) + 1), -np.log(size), np.float32)
    for k, lang in enumerate(languages):
        own = summed[summed["lang"] == lang]
        counts = np.zeros(size)
        counts[own["bucket"].to_numpy()] = own["n"].to_numpy()
        logs[:, k] = np.log((1 - NOISE) * counts / counts.sum() + NOISE / size)
    return TrigramModel([*languages, UNKNOWN], logs)


def _softmax(scores: np.ndarray) -> np.ndarray:
    parts = np.exp(scores - scores.max(axis=1, keepdims=True))
    return parts / parts.sum(axis=1, keepdims=True)


def text_evidence(rows: DataFrame, model: TrigramModel, keys: list[str]) -> DataFrame:
    """The key columns, the text's tempered log likelihoods (scores) and posterior (post) by language, and its number of trigrams."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<scores:array<double>, post:array<double>, trigrams:long>")
    @forgetting
    def of(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in frames:
            found = [sent.value.evidence(t) for t in texts]
            scores = np.array([f[0] for f in found]).reshape(len(found), -1)
            post = _softmax(scores) if len(found) else scores
            yield pd.DataFrame({"scores": list(scores), "post": list(post), "trigrams": [f[1] for f in found]})

    found = rows.select(*keys, of("text").alias("found"))
    return found.select(*keys, "found.scores", "found.post", "found.trigrams")


def _fused(languages: list[str], base: list[float], strength: float):
    """Log posterior by language from a row's own evidence and the sums joined to it."""

    def matrix(column: pd.Series, neutral: np.ndarray) -> np.ndarray:
        return np.stack([neutral if x is None else np.asarray(x, np.float64) for x in column])

    @forgetting
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prior, zero = np.array(base), np.zeros(len(base))
        for frame in frames:
            if not len(frame):
                continue
            scores, own = matrix(frame["scores"], zero), matrix(frame["post"], zero)

            def others(level: str, above: np.ndarray) -> np.ndarray:
                """The level's shares smoothed towards the one above; the row itself is taken out. No level, no change."""
                count = frame[f"{level}_rows"].to_numpy(np.float64, na_value=0)[:, None]  # noqa: B023
                taken = own * (count > 0)  # noqa: B023
                return (matrix(frame[f"{level}_sums"], zero) - taken + strength * above) / (np.maximum(count - 1, 0) + strength)  # noqa: B023

            of_host = others("host", others("domain", prior[None, :]))
            total = scores + np.log(np.maximum(of_host, 1e-12))
            for name in ("declared_logs", "suffix_logs"):
                total = total + matrix(frame[name], zero)
            final = _softmax(total)
            best = final.argmax(axis=1)
            keep = [c for c in frame.columns if c not in _INNER]
            yield frame[keep].assign(lang=[languages[k] for k in best], confidence=final[np.arange(len(best)), best])

    return run


_INNER = {"scores", "post", "host_sums", "host_rows", "domain_sums", "domain_rows", "declared_logs", "suffix_logs"}


def fuse(evidence: DataFrame, languages: list[str], strength: float = STRENGTH) -> DataFrame:
    """Adds lang, confidence and rejected to rows with scores, post, trigrams, host, domain, suffix and declared; null evidence is neutral."""
    classes = range(len(languages))
    rows = durable(evidence)
    sums = F.array(*(F.sum(F.col("post")[k]) for k in classes))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), sums.alias("s")).first()
    base = [((x or 0.0) + 1) / (whole["n"] + len(languages)) for x in whole["s"]]
    group = lambda *keys: rows.groupBy(*(F.col(k).alias(f"of_{k}") for k in keys)).agg(F.count(F.lit(1)).alias("n"), sums.alias("s"))
    out = rows
    for name in ("host", "domain"):  # rows without one take the level above; written, so that the join can split a large host
        seen = durable(group(name).filter(F.col(f"of_{name}").isNotNull())).withColumnsRenamed({"n": f"{name}_rows", "s": f"{name}_sums"})
        out = out.join(seen, F.col(name) == F.col(f"of_{name}"), "left").drop(f"of_{name}")
    for name in ("declared", "suffix"):
        seen = group(name).filter(F.col(f"of_{name}").isNotNull())
        total = seen.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[k]) for k in classes)).alias("s")).first()
        # how likely the value is under each language, smoothed towards its share
        share = F.col("n") / F.lit(float(total["n"] or 1))
        logs = F.array(*(F.log((F.col("s")[k] + strength * share) / ((total["s"][k] or 0.0) + strength)) for k in classes))
        out = out.join(seen.select(f"of_{name}", logs.alias(f"{name}_logs")), F.col(name) == F.col(f"of_{name}"), "left").drop(f"of_{name}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name not in _INNER)
    out = out.mapInPandas(_fused(languages, base, strength), f"{schema}, lang string, confidence double")
    rejected = (F.col("lang") == UNKNOWN) | (F.col("confidence") < LEAST_CONFIDENCE) | (F.col("trigrams") == 0)
    return out.withColumn("rejected", rejected)


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, host, domain and suffix of raw pages (page_id, url, html); nulls stay null."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]+;", " ")
    named = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    labels = F.split(F.col("host"), r"\.")
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), bare.alias("text"), F.nullif(F.lower(named), F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"))
    return out.select("*", F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(0)) + 1, 3)).alias("domain"), F.element_at(labels, -1).alias("suffix"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """doc_id, text and host (the source) of documents; they declare no language and have no address."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", none.alias("declared"), F.col("source").alias("host"), F.col("source").alias("domain"), none.alias("suffix")
    )


_EVIDENCE = ["declared", "host", "domain", "suffix"]
_RESULTS = ["trigrams", "lang", "confidence", "rejected"]


def identify(rows: DataFrame, model: TrigramModel) -> DataFrame:
    """Each row's other columns with trigrams, lang, confidence and rejected in place of the text.

    rows: any keys, text, declared, host, domain, suffix. A null or empty text, or one without letters,
    has no trigrams: it gets the language that its other evidence favours and is rejected. Repeated rows
    count and return each. An empty table gives an empty one. Columns of rows that are named as a result are replaced by it;
    others keep their values whatever their names.
    """
    known = [*_EVIDENCE, *_RESULTS, "text"]
    own = {c: f"key_{n}" for n, c in enumerate(rows.columns) if c.lower() not in known}
    inner = rows.select("text", *_EVIDENCE, *(F.col(f"`{c}`").alias(k) for c, k in own.items()))  # names of our own, so that none can clash
    found = fuse(text_evidence(inner, model, inner.columns[1:]), model.languages)
    kept = [F.col(own.get(c, c.lower())).alias(c) for c in rows.columns if c in own or c.lower() in _EVIDENCE]
    return found.select(*kept, *_RESULTS)
