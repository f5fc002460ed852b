"""The operators against brute force on a small fixture with odd rows."""

import random
import re
import struct
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from pathloom.llm import ann, byte_bpe, common, decontaminate, html_extract, language_id, line_dedup, ngram_join, suffix_dedup, token_counts

SF = "/root/testdata/sf0.001"
ODD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " a  b \n\n c  d\t e   f"), (10**6 + 3, "  x"), (10**6 + 4, "\x00 z  "), (10**6 + 5, "one two"), (10**6 + 6, "ONE two"), (10**6 + 7, "a" * 200_000 + " b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(ODD, "doc_id long, text string")).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r.doc_id, r.text or "") for r in docs.collect())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def test_byte_bpe(docs, rows, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    model = byte_bpe.encoder(byte_bpe.read_ranks(path), P.PATTERN)
    got = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN, block_bytes=100_000), path).collect()}
    for i, text in rows:
        want = model.encode_ordinary(text)
        assert bytes(got[i].ids) == struct.pack(f"<{len(want)}I", *want) and bytes(got[i].decoded) == text.encode() and got[i].n_tokens == len(want)
    assert byte_bpe.encode(empty, path, P.PATTERN).count() == 0


def test_token_counts(docs, rows, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    assert got == {i: len(model.encode(t)) for i, t in rows}
    assert token_counts.token_counts(empty, path).count() == 0


def jaccard_components(rows):
    """(n_shingles, component_id) of each id, from all pairs."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and (c := len(sets[a] & sets[b])) and 100 * c >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join(docs, rows, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, block_bytes=100_000).collect()}
    assert got == jaccard_components(rows)
    assert ngram_join.join(empty).count() == 0


@pytest.mark.parametrize("rounds", [1, 2, ngram_join.ROUNDS])
def test_ngram_join_pair_by_pair(spark, rounds):
    """Near copies just above and below the threshold that share most lists, and a passage that many documents hold."""
    rng = random.Random(5)
    base, passage = [f"w{i}" for i in range(80)], [f"p{i}" for i in range(40)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            text[rng.randrange(80)] = f"x{rng.randrange(8)}"
        rows.append((i, " ".join(text)))
    for i in range(120, 180):
        tail = [f"t{rng.randrange(6)}" for _ in range(rng.randrange(1, 9))]
        rows.append((i, " ".join(passage + tail)))
    rng.shuffle(rows)
    want = jaccard_components(rows)
    assert 4 < len({c for _, c in want.values()}) < 170
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), rounds=rounds, block_bytes=10_000)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == want


def test_suffix_dedup(docs, rows, empty):
    got = {r.doc_id: r for r in suffix_dedup.dedup_spans(docs, block_bytes=100_000).collect()}
    seen = {}
    for i, t in rows:
        b = t.encode()
        covered = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], i) < i:
                covered[p : p + 50] = b"\1" * 50
        spans = sum(c and (p == 0 or not covered[p - 1]) for p, c in enumerate(covered))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(b), sum(covered), spans, bytes(c for c, x in zip(b, covered, strict=True) if not x))
    assert suffix_dedup.dedup_spans(empty).count() == 0


def test_classes_of_windows_with_long_ties():
    data = np.frombuffer(b"ab" * 300 + b"abc" * 100 + b"x" * 300 + b"\0" * 100, np.uint8)
    windows = np.arange(len(data) - 100 - 50)
    number = suffix_dedup.classes(data, windows)
    text, by_text = data.tobytes(), {}
    for w, c in zip(windows, number, strict=True):
        assert by_text.setdefault(text[w : w + 50], c) == c
    assert len(set(by_text.values())) == len(by_text)


def test_line_dedup(spark):
    line = "these are ten words that stand on one line here"
    docs = spark.createDataFrame([(1, f"{line} a\n{line} b\nown"), (2, f"first\n{line} a\n{line} b"), (3, None), (4, ""), (5, f"{line} a\n{line} b\nown")], "doc_id long, text string")
    got = {r.doc_id: (r.kept_text, r.n_deleted, r.emptied) for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1] == (f"{line} a\n{line} b\nown", 0, False) and got[2] == ("first", 2, False)
    assert got[3] == (None, 0, False) and got[4] == ("", 0, False) and got[5] == ("", 3, True)


def test_line_dedup_is_that_of_all_pairs(spark):
    """Lines of many documents in crossed orders, some twice in a document, some short: every earlier holder counts."""
    rng = random.Random(7)
    pool = [" ".join([f"line{i}"] * n) for i, n in enumerate([8, 9, 10, 12, 3, 4, 5, 7, 1])]
    rows = [(i, "\n".join(rng.choice([*pool, f"own {i} {k}", ""]) for k in range(rng.randrange(1, 9)))) for i in range(150)]
    cut = {i: [(n, x, len(x.split())) for n, x in enumerate(t.split("\n")) if x and "own" not in x] for i, t in rows}
    gone = {b: {n for a in range(b) for n in line_dedup.deleted(cut[a], cut[b], 8)} for b in cut}
    first_only = {b: {n for a in {min(i for i in cut if any(y[1] == x[1] for y in cut[i])) for x in cut[b]} - {b} for n in line_dedup.deleted(cut[a], cut[b], 8)} for b in cut}
    assert gone != first_only
    got = {r.doc_id: (r.kept_text, r.n_deleted) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: ("\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]), len(gone[i])) for i, t in rows}


def test_patience():
    assert line_dedup.patience(list("abcxde"), list("abcde")) == [(0, 0), (1, 1), (2, 2), (4, 3), (5, 4)]


def test_decontaminate(spark):
    items = spark.createDataFrame([(1, "what is the name of the tall grey tower. it is called the lamp of morning."), (2, None), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "filler words here " * 50 + "what is the name of the tall grey tower. it is called the lamp of morning. " + "more words " * 50), (2, "what is the name of the game"), (3, None), (4, "")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 1)]
    assert {r.doc_id for r in decontaminate.decontaminate(docs, items).collect()} == {2, 3, 4}


def test_wand_gives_all_above_threshold():
    rng = np.random.default_rng(3)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 30, 12))) for i in range(200)]
    terms = {i: Counter(decontaminate.item_terms(t)) for i, t in items}
    frequency = Counter(t for c in terms.values() for t in c)
    index = decontaminate.Index(items, frequency, 200, 10.0)
    for i, _ in items[:40]:
        asked = set(terms[i])
        want = {k for k in range(200) if (s := sum(w for t in asked for j, w in index.postings.get(t, []) if j == k)) and s >= decontaminate.SHARE * index.own[k]}
        assert {k for k, _ in index.search(list(asked))} == want


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = common.crc("doc_id") % 4 == 2
    found = language_id.identify(docs.where(held), language_id.fit(docs.where(~held))).join(docs, "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count()
    odd = spark.createDataFrame([(1, None), (2, "12 !"), (3, "")], "doc_id long, text string")
    assert {r.lang_pred for r in language_id.identify(odd, {"a": b"x"}).collect()} == {"und"}


def test_ann(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").union(spark.createDataFrame([(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [1.0])], "vec_id long, embedding array<float>"))
    good = [(r.vec_id, np.array(r.embedding, dtype=np.float64)) for r in vectors.collect() if r.vec_id < 9000]
    got = ann.nearest(vectors, vectors.where("vec_id % 20 = 0")).collect()
    hits = total = 0
    for q, x in good:
        if q % 20 == 0:
            best = sorted(((-(y * x).sum(), i) for i, y in good if i != q))[:20]
            hits += len({i for _, i in best} & {r.vec_id for r in got if r.query_id == q})
            total += len(best)
    assert hits >= 0.9 * total


def test_html(spark):
    page = "<html><body><nav><ul><li>menu</ul></nav><div class='ad'>buy</div><article><h1>T &amp; u</h1><p>one  <b>two</b><p>three<div id=comments>no</div></article><footer>f</footer>"
    pages = spark.createDataFrame([(1, "http://h/a", page), (2, "http://h/b", page.replace("three", "four")), (3, None, None), (4, "http://h/c", "")], "page_id long, url string, html string")
    want = {1: "T & u\none two\nthree", 2: "T & u\none two\nfour", 3: "", 4: ""}
    assert {r.page_id: r.text for r in html_extract.main_text(pages).collect()} == want
    assert {r.page_id: r.text for r in html_extract.main_text(pages, broadcast_bytes=-1).collect()} == want


def test_search_over_doubles(spark):
    """Doubles aren't rounded, large ones take part; ties go to the smaller id, fewer candidates than asked come all."""
    from pathloom.llm import ann

    vectors = spark.createDataFrame([(20, [0.1, 0.2], "x"), (3, [0.3, 0.7], "x"), (2, [0.3, 0.7], "x"), (40, [1e39, 0.0], "x"), (5, [0.0, 0.0], "x"), (6, None, "x"), (7, [float("nan"), 1.0], "x")], "vec_id long, embedding array<double>, score string")
    got = [tuple(r) for r in ann.nearest(vectors, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 40, 0.1 * 1e39), (20, 2, 2, 0.1 * 0.3 + 0.2 * 0.7), (20, 3, 3, 0.1 * 0.3 + 0.2 * 0.7), (40, 1, 2, 0.3 * 1e39), (40, 2, 3, 0.3 * 1e39), (40, 3, 20, 0.1 * 1e39)]
    assert ann.nearest(vectors.where("false"), vectors).collect() == []
