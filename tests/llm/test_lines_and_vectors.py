"""Line dedup, centroid clustering and vector codes against brute force, with nulls, repeated rows, ties, huge texts and clashing columns."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from tracemill.llm import integer_vectors, op11_line_dedup, op12_centroid_clustering, op13_vector_codes

SPACE, LOWER = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LINES = "doc_id long, text string, lost int, line string, row string, doc long, mark string, h long, n_lines string, lang string"


def key_of(line):
    return line.strip(SPACE).translate(LOWER)


def by_hand(rows, least=10, most=1):
    """(doc_id, n_lines, n_dropped, text) of each (doc_id, text)."""
    order = lambda d: (d is None, d or 0)
    holders = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key_of(line), set()).add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key_of(x)) < least or len(holders[key_of(x)]) <= most or d == min(holders[key_of(x)], key=order)]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def line_rows():
    rnd = random.Random(3)
    pool = ["Subscribe to our newsletter today", "  subscribe TO our newsletter today\r", "ÉCOLE Ünïcode LINE", "École ünïcode line", "école Ünïcode line", "short", "", "123456789", "1234567890", " padded with a no-break space"]
    pool += [f"line number {k} of the pool" for k in range(60)]
    rows = [(k, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 40)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "the same line twice here\nthe same line twice here"), (104, "ends with a newline here\n")]
    rows += [(None, "Subscribe to our newsletter today\nonly without an id"), (None, "only without an id\nx"), (5, "a second row of the fifth\n" + pool[0]), (5, "a second row of the fifth\nand more of it")]
    rows += [rows[7], rows[7], (200, "\n".join(f"line {k % 5000} of a long text" for k in range(60_000))), (201, "\n".join(f"LINE {k} of a long text" for k in range(0, 5000, 2)))]
    return rows


@pytest.mark.parametrize("most", [1, 3])
def test_lines_against_brute_force(spark, most):
    rows = line_rows()
    docs = spark.createDataFrame([(*r, 1, "clash", "row", 2, "m", 3, "old", "en") for r in rows], LINES).repartition(3)
    got = op11_line_dedup.dedup_lines(docs, most_documents=most)
    assert got.columns == ["doc_id", "text", "lost", "line", "row", "doc", "mark", "h", "lang", "n_lines", "n_dropped"]
    found = got.collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found), key=str) == by_hand(rows, most=most)
    assert all((r.lost, r.line, r.row, r.doc, r.mark, r.h, r.lang) == (1, "clash", "row", 2, "m", 3, "en") for r in found)


def test_line_digests_and_plan(spark):
    rows = line_rows()[:70]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = op11_line_dedup.kept_digests(docs)
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in by_hand(rows)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapIn"))
    empty = op11_line_dedup.kept_digests(docs.filter("false"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


VECTORS = "vec_id long, embedding array<double>, label int, ints string, norms long, cluster string, codes string, slot int"


def vector_rows(n=300, dims=64, seed=1):
    rnd = np.random.default_rng(seed)
    base = rnd.standard_normal((n, dims)) * 0.3
    base[n // 3 :: 7] = base[3]  # copies, ties between centroids
    base[5] = np.round(base[5] * 256) / 256
    rows = [(k, base[k].tolist(), None if k % 9 == 0 else k % 4) for k in range(n)]
    odd = [None, [], [1.0] * (dims - 4), [0.0] * dims, [None] + [1.0] * (dims - 1), [float("nan")] + [1.0] * (dims - 1), [float("-inf")] + [0.5] * (dims - 1)]
    rows += [(n + k, v, 1) for k, v in enumerate(odd)]
    return [*rows, (None, rows[2][1], 2), rows[1], (4, rows[9][1], 3)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "i", 1, "c", "d", 7) for r in rows], VECTORS).repartition(3)


def whole(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def square(a, b):
    return sum((int(x) - int(y)) ** 2 for x, y in zip(a, b, strict=True))


def rounds_by_hand(points, centres, rounds):
    for step in range(rounds + 1):
        own = [min((square(p, c), k) for k, c in enumerate(centres)) for p in points]
        if step < rounds:
            held = [[p for p, (_, k) in zip(points, own, strict=True) if k == c] for c in range(len(centres))]
            centres = [[sum(x) // len(h) for x in zip(*h, strict=True)] if h else c for h, c in zip(held, centres, strict=True)]
    return own, centres


def test_clusters_against_brute_force(spark):
    rows = vector_rows(120)
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if whole(v) and len(v) == 64]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), np.array(v, "<i4").tobytes(), v) for i, v in kept if i is not None)
    own, centres = rounds_by_hand([v for _, v in kept], [v for *_, v in order[:9]], 3)
    total = sum(d for d, _ in own)
    of = [sum(d for d, c in own if c == k) for k in range(9)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    want = sorted(((i, k, d, of[k], total, sha[k]) for (i, _), (d, k) in zip(kept, own, strict=True)), key=str)
    got = op12_centroid_clustering.clustered(frame(spark, rows), clusters=9, rounds=3)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_screening_prunes_and_keeps_ties():
    rnd = np.random.default_rng(2)
    centres = rnd.integers(-400, 400, (30, 64))
    centres[7] = centres[3]
    rows = np.concatenate([centres[rnd.integers(0, 30, 500)] + rnd.integers(-30, 30, (500, 64)), rnd.integers(-400, 400, (300, 64)), centres])
    norms = [op12_centroid_clustering.segment_norms(x, 16) for x in (rows, centres)]
    number, distance, exact = op12_centroid_clustering.nearest(rows, norms[0], centres, norms[1])
    every = ((rows[:, None] - centres) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert exact < 0.8 * every.size  # rows near a centroid are settled by bounds


@pytest.mark.parametrize("entries", [6, 256])
def test_codes_against_brute_force(spark, entries):
    rows = vector_rows(90, dims=16)
    kept = [(i, [int(np.floor(1024 * x)) for x in v], b) for i, v, b in rows if whole(v) and len(v) == 16]
    first = sorted((i, np.array(v, "<i4").tobytes(), v) for i, v, _ in kept if i is not None)[:entries]
    parts = []
    for p in range(4):
        cut = slice(4 * p, 4 * p + 4)
        parts.append(rounds_by_hand([v[cut] for _, v, _ in kept], [v[cut] for *_, v in first], 2))
    code = ["".join(f"{parts[p][0][n][1]:02x}" for p in range(4)) for n in range(len(kept))]
    error = [sum(parts[p][0][n][0] for p in range(4)) for n in range(len(kept))]
    found, books = op13_vector_codes.compress(frame(spark, rows), entries=entries, rounds=2, keep=("label",))
    want = sorted(((i, b, c, e) for (i, _, b), c, e in zip(kept, code, error, strict=True)), key=str)
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert books.tolist() == [parts[p][1] for p in range(4)]


def test_code_query_sums_by_label(spark):
    got = op13_vector_codes.codes_with_errors(frame(spark, vector_rows(60, dims=8))).collect()
    sums = {}
    by_id = {r[0]: r[2] for r in vector_rows(60, dims=8)}
    unique = [r for r in got if r.vec_id not in (None, 1, 4)]
    for r in got:
        sums.setdefault(r.label_error, 0)
        sums[r.label_error] += r.error
    assert all(k == v for k, v in sums.items())  # labels have different sums
    assert len({(by_id[r.vec_id], r.label_error) for r in unique}) == len({by_id[r.vec_id] for r in unique}) == 5


def test_exponion_reads_less_and_keeps_ties():
    rnd = np.random.default_rng(3)
    entries = rnd.integers(-50, 50, (256, 4)) * 20
    entries[200] = entries[17]
    x = np.concatenate([entries[rnd.integers(0, 256, 900)] + rnd.integers(-9, 9, (900, 4)), entries, (entries[:-1] + entries[1:]) // 2])
    every = ((x[:, None] - entries) ** 2).sum(2)
    book = op13_vector_codes.Neighbours(entries)
    for start in (every.argmin(1), rnd.integers(0, 256, len(x)), book.first_guess(x)):
        index, least, computed = book.nearest(x, start)
        assert (index == every.argmin(1)).all() and (least == every.min(1)).all()
    assert book.nearest(x[:900], every[:900].argmin(1))[2] < 0.25 * every[:900].size


def test_vectors_empty_and_refused(spark):
    none = frame(spark, vector_rows(9)).filter("false")
    assert op12_centroid_clustering.clustered(none).count() == op13_vector_codes.codes_with_errors(none).count() == 0
    odd = spark.createDataFrame([(1, [], 1), (2, None, 1), (None, [1.0] * 64, 1)], "vec_id long, embedding array<float>, label int")
    assert op12_centroid_clustering.clustered(odd).count() == op13_vector_codes.codes_with_errors(odd).count() == 0
    huge = spark.createDataFrame([(1, [1e300] * 64, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="beyond 8388608"):
        op12_centroid_clustering.clustered(huge)
    assert integer_vectors.floors(np.array([[-7], [7], [1]]), np.array([2, 2, 0]), np.array([[0], [0], [9]])).tolist() == [[-4], [3], [9]]
    assert list(itertools.islice(op12_centroid_clustering.segment_norms(np.array([[3, 4, 0, 5]]), 2)[0], 2)) == [5.0, 5.0]
