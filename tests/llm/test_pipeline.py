"""Every stage of the pipeline against brute force over its own input, and run() against the stages."""

import hashlib
import re
import struct

import public_tokenizers as P
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import byte_bpe, common, language_id
from test_line_dedup import brute

SF = "/root/testdata/sf0.001"
ODD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "12 34")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def language(rows, items, dictionaries):
    made = [zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False) for d in dictionaries.values()]
    out = {}
    for i, text in rows.items():
        data, step = (text or "").lower().encode(), language_id.BLOCK_BYTES
        low, high = sorted(sum(len(c.compress(data[k : k + step])) for k in range(0, len(data), step)) for c in made)[:2]
        if any(c.isalpha() for c in text or "") and (high - low) / high >= corpus_pipeline.MIN_MARGIN:
            out[i] = text
    return out


def lines(rows, items, _):
    """All pairs, by the independent alignment of the line test."""
    kept = {i: (t, n) for i, t, n in brute(sorted(rows.items(), key=str))}
    return {i: t for i, (t, n) in kept.items() if not n or t.split()}


def copies(rows, items, _):
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := words(t)) >= 5 else {tuple(w)} - {()} for i, t in sorted(rows.items())}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and (c := len(sets[a] & sets[b])) and 100 * c >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: rows[i] for i in sets if find(i) == i}


def holds(rows, items, _):
    """Whole items only; the test sees to it that no document holds a part."""
    asked = [" ".join(words(t)) for t in items.values() if t]
    return {i: t for i, t in rows.items() if not any(f" {x} " in f" {' '.join(words(t))} " for x in asked)}


BRUTE = {"language_id": language, "line_dedup": lines, "ngram_join": copies, "decontaminate": holds}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    there = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").orderBy("item_id").first()["text"]
    # a line that stands in three documents, alone in the last; an item amid other words
    prose = docs.where("lang = 'en'").orderBy(F.desc("n_chars"), "doc_id").first()["text"].split()
    one, two, three, line = (" ".join(prose[k : k + 60]) for k in (0, 60, 120, 180))
    planted = [(10**6 + 3, f"{one}\n{line}"), (10**6 + 4, f"{two}\n{line}"), (10**6 + 5, line), (10**6 + 9, f"{three}\n{item}\n{three[:200]}")]
    odd = spark.createDataFrame(ODD + planted, "doc_id long, text string")
    docs.unionByName(odd, allowMissingColumns=True).write.parquet(f"{there}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{there}/benchmark.parquet")
    return there


def test_stages(spark, folder):
    docs = common.table(spark, folder, "documents")
    items = {r.item_id: r.text for r in common.table(spark, folder, "benchmark").collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = {r.doc_id: r.text for r in docs.collect()}
        dictionaries = language_id.fit(docs) if name == "language_id" else None
        docs = common.materialise(stage(spark, docs, folder), name)
        assert docs.columns == columns
        assert {r.doc_id: r.text for r in docs.collect()} == BRUTE[name](rows, items, dictionaries), name
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert {i - 10**6: t.split("\n")[0] for i, t in rows.items() if i >= 10**6} == {3: rows[10**6 + 3].split("\n")[0], 4: rows[10**6 + 4]}
    path = P.path(corpus_pipeline.BYTE_BPE)
    model = tiktoken.Encoding("brute", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    want = {}
    for i, text in rows.items():
        ids = model.encode_ordinary(text)
        want[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "benchmark"):
        common.table(spark, folder, t).where(F.lit(False)).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
