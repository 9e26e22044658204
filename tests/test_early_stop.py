"""The source that stops early: lines are counted, and what lies behind the rows wanted is never read."""

import gzip
import itertools

from tracemill.sources import early_stop as E


def text(n, kinds="abc"):
    return "code\tkind\tname\n" + "".join(f"{k}\t{kinds[k % len(kinds)]}\tname {k}\n" for k in range(n))


def test_reads_no_further_than_needed():
    seen = itertools.count()
    lines = (line for line in text(10_000).splitlines(keepends=True) if next(seen) >= 0)
    rows = list(E.wanted_rows(lines, "\t", "kind", ["a", "c"], 3, ["code"]))
    assert [(n, c, r["code"]) for n, c, r in rows] == [(2, "a", "0"), (4, "c", "2"), (5, "a", "3"), (7, "c", "5"), (8, "a", "6"), (10, "c", "8")]
    assert next(seen) == 10  # the header and nine rows, of ten thousand
    assert len(list(E.wanted_rows(text(4).splitlines(keepends=True), "\t", "kind", ["a", "z"], 3, []))) == 2


def test_files_in_order_and_broken_tails(spark, tmp_path):
    whole = gzip.compress(text(200_000).encode())
    (tmp_path / "b.tsv.gz").write_bytes(whole[: len(whole) // 2])  # reading to the end would fail
    (tmp_path / "a.tsv.gz").write_bytes(gzip.compress(b"code\tkind\tname\nx\ta\t\n\ta\tno code\ny\tb\n"))
    (tmp_path / "c.tsv").write_bytes(b"code\tkind\tname\nlast\td\t\xff\n")
    (tmp_path / "d.tsv").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    got = E.first_rows(spark, str(tmp_path), 2, "kind", ("a", "b", "c"), ("code",))
    assert sorted((r["class"], r.file, r["values"]["code"]) for r in got.collect()) == [
        ("a", "a.tsv.gz", "x"), ("a", "b.tsv.gz", "0"), ("b", "a.tsv.gz", "y"), ("b", "b.tsv.gz", "1"), ("c", "b.tsv.gz", "2"), ("c", "b.tsv.gz", "5"),
    ]
    every = E.first_rows(spark, f"file:{tmp_path}/c.tsv", 5).collect()
    assert [(r.line, r["class"], r["values"]) for r in every] == [(2, "", {"code": "last", "kind": "d", "name": "�"})]
