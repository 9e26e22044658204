"""Corpus operators against brute force, round trips and held-out accuracy, with nulls, empty tables, ties and clashing columns."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracemill.llm import bpe_transducer, op01_token_counts, op02_packing, op03_embedding_near_dedup, op04_substring_dedup, op05_ngram_jaccard_join
from tracemill.llm import common, op06_html_extraction, op07_byte_bpe, op08_language_id, op09_media_copies, op10_toxicity
from tracemill.llm.common import words_of
from tracemill.llm.components import connected_components

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
RANKS = bpe_transducer.read_ranks(BYTE_BPE)
TIKTOKEN = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sequence string, poster long, key string"


def vocabulary(seed=1, size=4000):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghijklmnoprstuvwz") for _ in range(rnd.randint(2, 9))) for _ in range(size)]


def corpus():
    """Texts with copies, near copies, shared passages, short and odd rows; extra columns clash with inner names."""
    rnd, words = random.Random(5), vocabulary()
    say = lambda n: [rnd.choice(words) for _ in range(n)]
    texts = [" ".join(say(rnd.randint(20, 200))) for _ in range(40)]
    base, passage = say(300), " ".join(say(70))
    for k in range(25):  # near copies, some below the bound
        near = list(base)
        for _ in range(k):
            near[rnd.randrange(len(near))] = rnd.choice(words)
        texts.append(" ".join(near))
    texts += [" ".join(base)] * 4
    texts += [" ".join(say(90)) + " " + passage + " " + " ".join(say(90)) for _ in range(8)]
    texts += ["", None, "one", "One", "a b c d", "A  b\tc d", "  \n", "the the the the the the the", "été " * 30, "x" * 5000]
    rows = [(k, t, "en", f"s{k % 3}", None, "clash", 1, "k") for k, t in enumerate(texts)]
    return rows + [(None, texts[0], None, None, None, None, None, None), rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def roots(ids, links):
    up = {k: k for k in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {k: find(k) for k in ids}


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(500 + k, 501 + k) for k in range(40)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame([*links, (None, 1), (7, 7)], "a long, b long")).collect()}
    want = roots({x for p in links for x in p} | {7}, links)
    assert {k: v for k, v in want.items() if k in got} == got
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}


def test_jaccard_classes(spark, docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in op05_ngram_jaccard_join.jaccard_classes(docs).collect()}
    sets = {r[0]: shingle_set(r[1]) for r in corpus() if r[0] is not None}
    similar = [
        (a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    root = roots(sets, similar)
    want = {(k, len(s), root[k]) for k, s in sets.items()} | {(None, len(sets[0]), None)}
    assert got == want
    assert op05_ngram_jaccard_join.jaccard_classes(docs.limit(0)).count() == 0


def test_passages(spark, docs):
    found = op04_substring_dedup.passages(docs).collect()
    words = {r[0]: words_of(r[1]) for r in corpus()}
    covered = {}
    for r in found:
        a, b = words[r.doc_id][r.start_word : r.end_word], words[r.other_id][r.other_start : r.other_end]
        x, y = shingle_set(b" ".join(a).decode()), shingle_set(b" ".join(b).decode())
        assert len(a) >= 50 and r.doc_id != r.other_id
        assert abs(len(x & y) / len(x | y) - r.similarity) < 1e-9 and r.similarity >= 0.8
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    first = {}
    for k in sorted(w for w in words if w is not None):  # every repeated run of 50 words is found
        for at in range(len(words[k]) - 49):
            run = tuple(words[k][at : at + 50])
            if first.setdefault(run, k) != k:
                assert len(covered.get(k, set()) & set(range(at, at + 50))) >= 45, (k, at)
    kept = {r.doc_id: r.text for r in op04_substring_dedup.remove_passages(docs, op04_substring_dedup.passages(docs)).collect()}
    assert set(kept) == {r[0] for r in corpus()}
    for k, text in kept.items():
        if k is not None and k not in covered:
            assert text == next(r[1] for r in corpus() if r[0] == k)
    assert op04_substring_dedup.passages(docs.limit(0)).count() == 0


def flagged(found, doc_id, low, high):
    """Share of a document's words from low to high that lie in a passage found."""
    covered = {w for r in found if r.doc_id == doc_id for w in range(r.start_word, r.end_word)}
    return len(covered & set(range(low, high))) / (high - low)


@pytest.mark.parametrize(("quoted", "length", "changed"), [("one", 50, 0), ("pieces", 50, 0), ("pieces", 60, 0), ("pieces", 60, 1), ("short", 60, 1), ("none", 100, 2)])
def test_passages_behind_a_quoting_document(spark, quoted, length, changed):
    """Two documents share a passage (the second with some words changed) that an earlier one holds in parts only."""
    rnd, words = random.Random(17), vocabulary()
    say = lambda n: [rnd.choice(words) for _ in range(n)]
    rows = []
    for k in range(100):
        passage = say(length)
        size = {"one": 30, "pieces": 24, "short": 15, "none": 0}[quoted]
        starts = [0] if quoted == "one" else range(0, length - 10, 10) if size else []
        parts = [w for at in starts for w in say(20) + passage[at : at + size]]
        copy = list(passage)
        for at in rnd.sample(range(length), changed):
            copy[at] = rnd.choice(words)
        rows += [(k, " ".join(parts + say(60))), (1000 + k, " ".join(say(60) + passage + say(60))), (2000 + k, " ".join(say(60) + copy + say(60)))]
    found = op04_substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    similar = [k for k in range(100) if _jaccard(rows[3 * k + 1][1].split()[60 : 60 + length], rows[3 * k + 2][1].split()[60 : 60 + length]) >= 0.8]
    caught = sum(flagged(found, 2000 + k, 60, 60 + length) >= 0.8 for k in similar)
    assert not changed or len(similar) >= 30
    assert caught >= (0.9 if changed else 1.0) * len(similar)
    assert not any(r.doc_id < 1000 for r in found)


def _jaccard(a, b):
    x, y = (shingle_set(" ".join(t)) for t in (a, b))
    return len(x & y) / len(x | y)


def test_hashed_texts(monkeypatch):
    """Equal words and shingles, and only those, have equal hashes, whatever stands around them and however texts are cut."""
    rnd, letters = random.Random(4), "aAbB \t\né日.\x1c"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.choice([0, 3, 30, 300]))) for _ in range(400)] + [None]
    whole = list(common.hashed_texts(texts))
    of_word, of_shingle = {}, {}
    for text, (words, shingles) in zip(texts, whole, strict=True):
        spoken = words_of(text)
        assert len(words) == len(spoken) and len(shingles) == (max(len(spoken) - 4, 1) if spoken else 0)
        assert all(of_word.setdefault(w, h) == h for w, h in zip(spoken, words.tolist(), strict=True))
        size = min(5, len(spoken))
        assert all(of_shingle.setdefault(tuple(spoken[k : k + size]), h) == h for k, h in enumerate(shingles.tolist()))
    assert len(set(of_word.values())) == len(of_word) and len(set(of_shingle.values())) == len(of_shingle)
    monkeypatch.setattr(common, "_CHUNK", 64)
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(whole, common.hashed_texts(texts), strict=True))


def test_long_documents_in_parts(spark, monkeypatch):
    """Windows of a long document come in parts, as if it were laid out at once."""
    rnd, words = random.Random(23), vocabulary()
    text = " ".join(rnd.choice(words) for _ in range(9000))
    levels = spark.sparkContext.broadcast(np.ones(1 << 10, np.uint8))
    frame = lambda: iter([op04_substring_dedup.pd.DataFrame({"doc_id": [1, 2], "text": [text, "a b c"]})])
    windows = lambda: {tuple(r) for f in op04_substring_dedup._windows(levels, 46, 2)(frame()) for r in f.itertuples(index=False)}
    whole = windows()
    monkeypatch.setattr(op04_substring_dedup, "_PART", 1 << 11)
    assert windows() == whole and len(whole) > 500


def test_compact_windows_by_brute_force():
    rnd = np.random.default_rng(4)
    sizes = [120, 3, 46, 80]
    owner = np.repeat(np.arange(4), sizes)
    values = rnd.integers(1 << 30, 1 << 63, len(owner), dtype=np.uint64)
    c, left, right = op04_substring_dedup.compact_windows(values, owner, op04_substring_dedup.run_minima(values, owner, 46))
    want = set()
    for d in range(4):
        place = np.flatnonzero(owner == d)
        for s in range(len(place) - 45):
            at = min(place[s : s + 46], key=lambda k: values[k])
            low = high = at
            while low > place[0] and values[low - 1] > values[at]:
                low -= 1
            while high < place[-1] and values[high + 1] > values[at]:
                high += 1
            want.add((at, low, high))
    assert set(zip(c.tolist(), left.tolist(), right.tolist(), strict=True)) == {tuple(map(int, w)) for w in want}


def test_transducer_matches_library():
    rnd, tool = random.Random(1), bpe_transducer.Transducer(RANKS, most_states=500)
    for _ in range(3000):
        word = "".join(rnd.choice("abcdeeiinth '!!0019é日\U0001f600aa") for _ in range(rnd.randint(1, 16)))
        for piece in __import__("regex").findall(public_tokenizers.PATTERN, word):
            assert list(tool.encode(piece.encode())) == TIKTOKEN.encode_ordinary(piece)


def test_utf8_machine():
    decoder = bpe_transducer.StreamDecoder(RANKS)
    single = lambda raw: np.array([RANKS[bytes([b])] for b in raw])
    for raw in (b"abc", "é日\U0001f600".encode(), b"\xff", b"\xc3", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xe0\x80\x80", b"ok\xe6\x97"):
        try:
            raw.decode()
            valid = True
        except UnicodeDecodeError:
            valid = False
        assert decoder.decode(single(raw)) == (raw, valid)


def test_byte_bpe_round_trip(docs):
    encoded = op07_byte_bpe.encode(docs, BYTE_BPE, public_tokenizers.PATTERN)
    decoded = {r.doc_id: (bytes(r.content), r.valid) for r in op07_byte_bpe.decode(encoded, BYTE_BPE, public_tokenizers.PATTERN).collect()}
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in encoded.collect()}
    for doc_id, text, *_ in corpus():
        assert ids[doc_id] == TIKTOKEN.encode_ordinary(text or "")
        assert decoded[doc_id] == ((text or "").encode(), True)


def test_packing(docs):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    rows = op02_packing.pack(docs, WORD_BPE, context=64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    pieces = {}
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append(r)
    for doc_id, text, *_ in corpus():
        whole = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted(pieces[doc_id], key=lambda r: r.start)
        copies = sum(c[0] == doc_id for c in corpus())
        got = [x for r in mine[::copies] for x in np.frombuffer(r.ids, "<u4").tolist()]
        assert got == whole and mine[0].doc_tokens == len(whole)


def test_word_ids_of_odd_texts():
    tokenizer, tool, rnd = Tokenizer.from_file(WORD_BPE), op02_packing.WordIds(WORD_BPE), random.Random(2)
    texts = ["<|endoftext|> x<|endoftext|>.", "ÀÉßµªº İI Σίσ", "é ño 日本語, x y z \x1c\x0b"]
    texts += ["".join(rnd.choice("aB'.,é Ñ\n\t1<|> s$") for _ in range(30)) for _ in range(1500)]
    for text in texts:
        assert np.frombuffer(tool.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_edits_match_recounting(monkeypatch):
    tool = op01_token_counts.counter(BYTE_BPE, public_tokenizers.PATTERN)
    rnd, letters = random.Random(3), "ab c'stre  \n1!é"
    for block in (2, 3, 256):
        monkeypatch.setattr(op01_token_counts, "BLOCK", block)
        for _ in range(400):
            text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
            tree = op01_token_counts.CountTree(text, tool)
            for _ in range(4):
                at, gone = rnd.randint(0, len(text)), rnd.choice([0, 0, 1, 3, 10])
                new = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 4, 20])))
                text = text[:at] + new + text[at + gone :]
                tree.edit(at, gone, new)
                assert tree.text() == text and tree.tokens == len(TIKTOKEN.encode_ordinary(text))
    long = op01_token_counts.CountTree("word " * 50_000, tool)
    long.edit(100_000, 3, "xyz")
    assert long.encoded < 10


def test_edits_encode_only_what_they_touch():
    """The encoder is called for the pre-tokens counted in n_reencoded and no others; the memo is off."""
    tool = op01_token_counts.Counter(BYTE_BPE, public_tokenizers.PATTERN)
    calls, count = [], tool.count.compute
    tool.counts = lambda pieces: [calls.append(p) or count(p) for p in pieces]
    rnd = random.Random(6)
    text = " ".join(vocabulary(3, 5000))
    tree = op01_token_counts.CountTree(text, tool)
    laid = []
    tree._lay_out = lambda *parts, f=tree._lay_out: laid.append(1) or f(*parts)
    calls.clear()
    for k in range(300):
        at, new = rnd.randrange(len(text)), " ".join(vocabulary(k, rnd.choice([0, 1, 30])))
        text = text[:at] + new + text[at + 4 :]
        tree.edit(at, 4, new)
    assert tree.text() == text and tree.tokens == len(TIKTOKEN.encode_ordinary(text))
    assert len(calls) == tree.encoded < 300 * 18 and len(laid) <= 2


def test_edit_counts_on_rows(spark, docs):
    edits = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit(3).alias("at"), F.lit(2).alias("remove"), F.lit(None).cast("string").alias("insert"))))
    rows = op01_token_counts.count_with_edits(docs.withColumn("edits", edits), BYTE_BPE, public_tokenizers.PATTERN).collect()
    texts = {r[0]: r[1] or "" for r in corpus()}
    assert len(rows) == len(corpus())
    for r in rows:
        text = texts[r.doc_id]
        after = text[:3] + text[5:] if r.doc_id is not None and r.doc_id % 2 == 0 else text
        assert (r.n_tokens, r.n_tokens_after) == (len(TIKTOKEN.encode_ordinary(text)), len(TIKTOKEN.encode_ordinary(after)))


def test_embedding_links(spark):
    rnd = np.random.default_rng(3)
    base = rnd.standard_normal((30, 16))
    vectors = [b + rnd.standard_normal(16) * s for b in base for s in (0, 0.05, 0.1, 0.2)] + [base[0]] * 3
    rows = [(k, [float(x) for x in v], k % 2 if k % 9 else None) for k, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [], 1), (None, [1.0] * 16, 1), (904, [1.0, None] * 8, 1), rows[4]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in op03_embedding_near_dedup.embedding_links(df, block=8).collect()}
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v, label in rows if label is not None and k is not None and k < 900}
    label = {k: x for k, _, x in rows}
    links = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.93]
    root = roots([r[0] for r in rows if r[0] is not None], links)
    count = {k: sum(k in p for p in links) for k in root}
    assert got == {(k, count[k], root[k], root[k] == k) for k in root} | {(None, 0, None, None)}
    assert op03_embedding_near_dedup.embedding_links(df.limit(0)).count() == 0
    for n in (1, 5000, 10**9):
        tables, projections = op03_embedding_near_dedup.table_plan(n, 0.93)
        assert 1 - (1 - op03_embedding_near_dedup.collision_chance(0.93) ** projections) ** tables >= 0.999


def test_embedding_links_of_repeated_ids(spark):
    """Ids that stand on rows with different vectors: other ids count once, an id never links with itself."""
    rnd = np.random.default_rng(8)
    base = rnd.standard_normal((6, 16))
    rows = []
    for k in range(120):
        v = base[rnd.integers(6)] + rnd.choice([0, 0.05, 0.2]) * rnd.standard_normal(16)
        rows.append((int(rnd.integers(40)) if k < 80 else 100 + k, [float(x) for x in v.astype(np.float32)], int(k % 2)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"node": F.lit("clash"), "row": F.lit(1), "mark": F.lit(None)})
    links = set()
    for a, u, la in rows:
        for b, v, lb in rows:
            if la == lb and a < b and np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                links.add((a, b))
    root, count = roots([r[0] for r in rows], links), {r[0]: sum(r[0] in p for p in links) for r in rows}
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in op03_embedding_near_dedup.embedding_links(df).collect()]
    assert len(got) == len(rows) and set(got) == {(k, count[k], root[k], root[k] == k) for k in root}
    three = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.01], 1), (2, [1.0, 0.02], 1)], "vec_id long, embedding array<float>, label int")
    assert {tuple(r) for r in op03_embedding_near_dedup.embedding_links(three).collect()} == {(1, 1, 1, True), (2, 1, 1, False)}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<title>x</title><h1>A</h1><p>one <b>two<br>three<p>four", "A\n\none two\nthree\n\nfour"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
        ("<table><tr><th>Name<th>Qty<tr><td>Basil leaves<td>3<tr><td>Dill<td>14</table>", "Name          Qty\nBasil leaves  3\nDill          14"),
        ("a<script>no</script><div hidden>no</div><p style='display: none'>no</p>b", "ab"),
        ("<p style=visibility:hidden>x<b style=visibility:visible>shown</b>y<i>z</i>", "shown"),
        ("<ul><li>a<li style='visibility: hidden'>b<li>c</ul><table><tr style=visibility:collapse><td>d<td style=visibility:visible>e</table>", "- a\n- c\n\ne"),
        ("<div hidden><b style=visibility:visible>no</b></div><p style='visibility:visible; visibility:hidden'>no</p>yes", "yes"),
        ("<pre>  x\n    y</pre>&amp;&lt;", "  x\n    y\n\n&<"),
        ("<div>" * 3000 + "deep", "deep"),
        ("", ""),
        (None, ""),
        ("<table>" * 30 + "<tr><td>in", "in"),
        ("<table><tr><td>" * 2000 + "in", "in"),
        ("<table><tr><td>" + "word " * 15 + "<td>b<tr><td>c<td>d", "word word word word word word word word word  b\nword word word word word word\n" + "c".ljust(46) + "d"),
    ],
)
def test_html(html, text):
    assert op06_html_extraction.html_text(html) == text


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (None, None, None), (1, "u", "<p>a")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted(map(tuple, op06_html_extraction.extract_text(pages).collect()), key=str) == [(1, "a", 1), (1, "a", 1), (None, "", 0)]


def test_language(spark):
    rnd = random.Random(8)
    tongues = {"aa": vocabulary(11, 300), "bb": ["é" + w[::-1] for w in vocabulary(12, 300)]}
    rows = [(k, " ".join(rnd.choice(tongues[lang]) for _ in range(60)), lang, f"s{k % 4}") for k, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(500, None, None, None), (501, "", "aa", "s0"), (502, "123 !!!", "bb", "s1"), (503, "日本語" * 40, None, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = op08_language_id.train_trigrams(docs)
    got = {r.doc_id: r for r in op08_language_id.identify(op08_language_id.document_evidence(docs), model).collect()}
    assert all(got[k].lang == lang and not got[k].rejected for k, _, lang, _ in rows[:120])
    assert all(got[k].rejected for k in (500, 501, 502, 503))
    pages = spark.createDataFrame([(1, "https://a.x.bb/", f'<html lang="bb"><p>{rows[1][1]}'), (2, None, None)], "page_id long, url string, html string")
    found = {r.page_id: r for r in op08_language_id.identify(op08_language_id.page_evidence(pages), model).collect()}
    assert (found[1].lang, found[1].declared, found[1].host, found[1].suffix, found[2].rejected) == ("bb", "bb", "a.x.bb", "bb", True)
    names = ["lang", "scores", "post", "trigrams", "host_rows", "of_host", "confidence", "key_0", "n.o"]  # clashes: results replace, others stay
    evidence = op08_language_id.document_evidence(docs)
    clashing = op08_language_id.identify(evidence.withColumns({n: F.lit(n) for n in names}), model)
    assert clashing.columns == ["doc_id", "declared", "host", "domain", "suffix", "scores", "post", "host_rows", "of_host", "key_0", "n.o", "trigrams", "lang", "confidence", "rejected"]
    for r in clashing.collect():
        assert (r.lang, r.rejected, r.trigrams) == (got[r.doc_id].lang, got[r.doc_id].rejected, got[r.doc_id].trigrams)
        assert all(r[n] == n for n in ("scores", "post", "host_rows", "of_host", "key_0", "n.o"))
    assert op08_language_id.identify(evidence.filter("false"), model).count() == 0
    assert op08_language_id.identify(op08_language_id.document_evidence(docs.limit(0)), model).count() == 0


def test_all_languages_are_kept(spark):
    tongues = {f"l{k}": vocabulary(100 + k, 40) for k in range(70)}
    rnd = random.Random(3)
    rows = [(k, " ".join(rnd.choice(tongues[lang]) for _ in range(40)), lang, None) for k, lang in enumerate([*tongues] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = op08_language_id.train_trigrams(docs)
    assert model.languages == [*sorted(tongues), "und"]
    got = {r.doc_id: r.lang for r in op08_language_id.identify(op08_language_id.document_evidence(docs), model).collect()}
    assert sum(got[k] == lang for k, _, lang, _ in rows) > 0.95 * len(rows)
    nothing = op08_language_id.train_trigrams(docs.limit(0))
    assert nothing.languages == ["und"]
    assert op08_language_id.identify(op08_language_id.document_evidence(docs), nothing).filter("not rejected").count() == 0


def test_evidence_by_brute_force(spark):
    """Fused posteriors as the formulas have them, row by row."""
    rnd = np.random.default_rng(2)
    hosts = ["a.x", "b.x", None, "c.y"]
    rows = []
    for k in range(40):
        host = hosts[k % 4]
        scores = rnd.standard_normal(3)
        post = np.exp(scores) / np.exp(scores).sum()
        rows.append((k, scores.tolist(), post.tolist(), 9, host, host and host[-1], ["x", "y", None][k % 3], ["p", None][k % 2]))
    names = "doc_id long, scores array<double>, post array<double>, trigrams long, host string, domain string, suffix string, declared string"
    got = {r.doc_id: r for r in op08_language_id.fuse(spark.createDataFrame(rows, names), ["u", "v", "und"]).collect()}
    post = np.array([r[2] for r in rows])
    prior = (post.sum(axis=0) + 1) / (len(rows) + 3)

    def level(k, at, above):
        same = [j for j in range(len(rows)) if j != k and rows[k][at] is not None and rows[j][at] == rows[k][at]]
        return (post[same].sum(axis=0) + 5 * above) / (len(same) + 5)

    def value(k, at):
        if rows[k][at] is None:
            return 0
        same, seen = ([j for j in range(len(rows)) if test(rows[j][at])] for test in (lambda x: x == rows[k][at], lambda x: x is not None))
        return np.log((post[same].sum(axis=0) + 5 * len(same) / len(seen)) / (post[seen].sum(axis=0) + 5))

    for k in range(len(rows)):
        total = np.array(rows[k][1]) + np.log(level(k, 4, level(k, 5, prior))) + value(k, 6) + value(k, 7)
        final = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert got[k].lang == ["u", "v", "und"][final.argmax()] and abs(got[k].confidence - final.max()) < 1e-9


def test_risk_by_brute_force():
    """One step of the fit goes down the non-negative risk: its gradient as differences show it."""
    rnd = np.random.default_rng(1)
    x = rnd.random((60, 4)) < 0.4
    positive = np.arange(60) < 20
    rows, columns = np.nonzero(x)
    weights, bias = op10_toxicity.fit_pu(rows, columns, positive, 4, 0.3, steps=400, rate=0.05)

    def risk(t):
        z = x @ t[:-1] + t[-1]
        one, zero = np.logaddexp(0, -z), np.logaddexp(0, z)
        return 0.3 * one[positive].mean() + max(0, zero[~positive].mean() - 0.3 * zero[positive].mean()) + 1e-4 * (t[:-1] ** 2).sum()

    best, here = risk(np.append(weights, bias)), np.append(weights, bias)
    assert best <= min(risk(here + step) for step in 0.3 * rnd.standard_normal((300, 5))) + 1e-3


def test_toxicity(spark):
    rnd, words = random.Random(9), vocabulary(13, 500)
    rude = ["vilething", "grimewad", "sludgeface"]
    rows, labels = [], []
    for k in range(900):
        text = [rnd.choice(words) for _ in range(60)]
        toxic = k % 8 == 0
        if toxic:
            text[rnd.randrange(60)] = rnd.choice(rude) + rnd.choice(["", "s", "ly"])
            text[rnd.randrange(60)] = rnd.choice(rude)
        rows.append((k, " ".join(text)))
        if k % 2 == 0 or k % 3 == 0:
            labels.append((k, 1, int(toxic)))
    rows += [(9000, None), (9001, ""), (None, "word")]
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in op10_toxicity.score(docs, op10_toxicity.train(docs, marked)).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert {k for k, r in got.items() if r.held_out and k is not None and k < 900} == set(held)
    right = sum(got[k].predicted == (k % 8 == 0) for k in held)
    assert right / len(held) > 0.97
    nothing = op10_toxicity.train(docs, marked.limit(0))
    assert {r.predicted for r in op10_toxicity.score(docs, nothing).collect()} == {0}
    assert op10_toxicity.clean(docs, nothing).count() == len(rows)


def wavy(rnd, size=160, waves=24):
    line = np.cos(np.pi * (np.arange(size) + 0.5)[None, :] / size * (np.arange(waves) + 2)[:, None])
    grey = line.T @ rnd.standard_normal((waves, waves)) @ line
    return 128 + 45 * grey / grey.std()


def warped(image, degrees, scale):
    height, width = image.shape
    a = np.deg2rad(degrees)
    y, x = np.mgrid[: int(height * scale), : int(width * scale)]
    y, x = (y - height * scale / 2) / scale, (x - width * scale / 2) / scale
    y, x = np.cos(a) * y - np.sin(a) * x + height / 2, np.sin(a) * y + np.cos(a) * x + width / 2
    y, x = np.clip(y, 0, height - 1.001), np.clip(x, 0, width - 1.001)
    r, c = y.astype(int), x.astype(int)
    p, q = y - r, x - c
    return image[r, c] * (1 - p) * (1 - q) + image[r, c + 1] * (1 - p) * q + image[r + 1, c] * p * (1 - q) + image[r + 1, c + 1] * p * q


def test_media(spark):
    """Edited pictures against all: every hit is right, and as many are found as when every pair is compared."""
    rnd = np.random.default_rng(1)
    pictures = [wavy(rnd) for _ in range(24)]
    edits = [
        lambda i: warped(i, 15, 1), lambda i: warped(i, 0, 0.8), lambda i: i[80:], lambda i: np.rot90(i), lambda i: i + 8 * rnd.standard_normal(i.shape),
        lambda i: warped(i, 7, 0.9), lambda i: i[30:-20, 20:-40] * 0.8 + 20, lambda i: warped(i, 0, 1.25),
    ]
    encode = op09_media_copies.encode_image
    media = [(k, encode(i)) for k, i in enumerate(pictures)] + [(500, encode(pictures[0])), (0, encode(pictures[0]))]
    media += [(200, b"P5 3"), (201, None), (202, b"P5 40 40 255\n" + bytes(1600)), (None, encode(pictures[1]))]
    asked = [(1000 + 10 * k + n, encode(edit(pictures[k]))) for k in range(24) for n, edit in enumerate(edits) if (k + n) % 3 == 0]
    schema = "media_id long, content binary"
    clash = lambda rows: spark.createDataFrame(rows, schema).withColumns({"mark": F.lit(1), "key": F.lit("x"), "query": F.lit(None)})
    got = {r.media_id: (r.n_queries, r.query_id) for r in op09_media_copies.find_copies(clash([*asked, (None, None)]), clash(media)).collect()}
    of = lambda rows: {rows[k][0]: (p, c) for k, p, c in op09_media_copies.describe_each([op09_media_copies.decode_image(x) for _, x in rows])}
    known, wanted = of([m for m in media if m[0] is not None]), of(asked)
    brute = {}
    for q, a in wanted.items():
        for m, b in known.items():
            if op09_media_copies.consensus(*a, *b) >= op09_media_copies.LEAST_INLIERS:
                brute.setdefault(m, []).append(q)
    assert all(m == 500 or q // 10 - 100 == m for m, queries in brute.items() for q in queries)
    assert sum(len(v) for m, v in brute.items() if m != 500) >= 0.95 * len(asked)
    assert {m: (len(v), min(v)) for m, v in brute.items()} == got
    assert op09_media_copies.find_copies(clash(asked).limit(0), clash(media)).count() == 0
    assert op09_media_copies.find_copies(clash(asked), clash(media).limit(0)).count() == 0


def test_a_group_of_near_copies_costs_its_members(spark, monkeypatch):
    """Near copies are compared with few queries each, not with all of their group; the classes are those of all links."""
    rnd = np.random.default_rng(9)
    encode, op = op09_media_copies.encode_image, op09_media_copies
    base, other = wavy(rnd, 150, 20), wavy(rnd, 150, 20)
    near = [base + 2 * rnd.standard_normal(base.shape) for _ in range(40)]
    media = [(k, encode(i)) for k, i in enumerate(near)] + [(100, encode(other)), (101, encode(np.hstack([base, other])))]
    asked = [(1000 + k, encode(i[14:-7, 7:-14] * 0.8 + 20)) for k, i in enumerate(near[:20])] + [(2000, encode(other[10:, 10:]))]
    compared = []
    verified = op._verified
    monkeypatch.setattr(op, "_verified", lambda pairs, rows, *more: compared.append(rows) or verified(pairs, rows, *more))
    frames = (spark.createDataFrame(x, "media_id long, content binary") for x in (asked, media))
    got = {r.media_id: (r.n_queries, r.query_id) for r in op.find_copies(*frames).collect()}
    of = lambda rows: {rows[k][0]: (p, c) for k, p, c in op.describe_each([op.decode_image(x) for _, x in rows])}
    known, wanted = of(media), of(asked)
    links = [(q, m) for q, a in wanted.items() for m, b in known.items() if op.consensus(*a, *b) >= op.LEAST_INLIERS]
    assert len(links) > 780
    part = {n: {n} for n in (*known, *wanted)}
    for q, m in links:
        if part[q] is not part[m]:
            part[q] |= part[m]
            for n in part[m]:
                part[n] = part[q]
    classes = {m: sorted(n for n in part[m] if n >= 1000) for _, m in links}
    assert got == {m: (len(v), v[0]) for m, v in classes.items()}
    assert sum(compared) < len(links) / 2


def test_small_crop_of_a_large_picture():
    """A crop of a tenth, of a picture that is described tile by tile."""
    rnd = np.random.default_rng(4)
    large = np.tile(np.zeros(1), (1500, 1500))
    for top in range(0, 1500, 150):
        for left in range(0, 1500, 150):
            large[top : top + 150, left : left + 150] = wavy(rnd, 150, 20)
    ((_, *whole),) = op09_media_copies.describe_each([large])
    ((_, *crop),) = op09_media_copies.describe_each([large[900:1375, 1000:1475]])
    assert op09_media_copies.consensus(*crop, *whole) >= 100


def test_like_vectors_give_like_pictures(spark):
    rnd = np.random.default_rng(6)
    base = rnd.standard_normal(64)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate([base, base + 0.01 * rnd.standard_normal(64), rnd.standard_normal(64)])]
    media = op09_media_copies.pictures(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    images = {r.media_id: op09_media_copies.decode_image(r.content) for r in media.collect()}
    assert np.abs(images[0] - images[1]).mean() < 3 < 20 < np.abs(images[0] - images[2]).mean()


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "ngram_jaccard_join", "substring_dedup", "packing"]
    rows = [(k, t, "en", s, None) for k, t, _, s, *_ in corpus() if k is not None and t]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").dropDuplicates(["doc_id"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    left = {r.doc_id for r in kept.collect()}
    assert set(range(40)) <= left  # clean documents stay
    assert len(left & set(range(65, 69))) == 0  # copies go
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == left
