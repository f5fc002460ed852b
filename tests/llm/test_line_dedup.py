"""Line deduplication against all pairs, aligned by an independent patience diff."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pathloom.llm import line_dedup

KIND = "doc_id long, text string"


def rank(run):
    return len(run), -run[-1][1]


def aligned(a, b):
    """Pairs (i, j) of equal entries: same ends first, then unique common lines in the longest increasing order, in between again."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in aligned(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return aligned(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    unique = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    runs = []  # the longest run that ends at each; of several the one that ends first on the right
    for i, j in unique:
        runs.append(max((r for r in runs if r[-1][1] < j), key=rank, default=[]) + [(i, j)])
    best = max(runs, key=rank, default=[])
    out, i0, j0 = [], 0, 0
    for i, j in best + [(len(a), len(b))] if best else []:
        out += [(i0 + x, j0 + y) for x, y in aligned(a[i0:i], b[j0:j])]
        if i < len(a):
            out.append((i, j))
        i0, j0 = i + 1, j + 1
    return out


def gone_of(earlier, later, shared):
    """Places that go from ``later``: aligned runs of neighbouring lines of eight words or more."""
    left, right = ([(i, x.strip()) for i, x in enumerate(t.split("\n")) if x.strip() in shared] for t in (earlier, later))
    gone, run = set(), []
    pairs = [(left[i], right[j]) for i, j in aligned([x for _, x in left], [x for _, x in right])]
    for x, y in [*pairs, ((-9, ""), (-9, ""))]:
        if run and (x[0] != run[-1][0][0] + 1 or y[0] != run[-1][1][0] + 1):
            if sum(len(r[1].split()) for _, r in run) >= 8:
                gone |= {r[0] for _, r in run}
            run = []
        run.append((x, y))
    return gone


def brute(rows):
    out, held = [], defaultdict(set)
    for i, text in rows:
        for x in (text or "").split("\n") if i is not None else ():
            held[x.strip()].add(i)
    shared = {x for x, ids in held.items() if x and len(ids) > 1}
    for i, text in rows:
        gone = set() if i is None or text is None else set().union(*(gone_of(t, text, shared) for k, t in set(rows) if k is not None and k < i and t is not None))
        out.append((i, text if not gone else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone), len(gone)))
    return sorted(out, key=str)


def result(spark, rows, **kwargs):
    return sorted(((r.doc_id, r.kept_text, r.n_deleted) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, KIND), **kwargs).collect()), key=str)


def test_block_whose_lines_are_frequent(spark):
    """Every line of the block stands alone in an earlier document; the block itself is first held by the fourth."""
    block = ["one two three four five six", "seven eight nine ten eleven", "twelve thirteen fourteen fifteen sixteen seventeen"]
    rows = [(k + 1, f"own {k}\n{x}") for k, x in enumerate(block)] + [(i, f"text {i}\n" + "\n".join(block)) for i in range(10, 20)]
    got = result(spark, rows)
    assert got == brute(rows) and sum(n for _, _, n in got) == 27


@pytest.mark.parametrize("holders", [5, 50, 500])
def test_lines_of_many_documents(spark, holders):
    rng = random.Random(holders)
    common = ["a line that very many of the documents have got", "another one of ten words that many of them hold", "short one"]
    rows = [(i, "\n".join(rng.sample([*common, f"own words of {i}", f"and more of {i % 7} here for a line of nine"], rng.randrange(2, 5)))) for i in range(holders)]
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark):
    line = "these are ten words that stand on one line here"
    rows = [(1, f"{line}\nown of one"), (5, f"a wholly different first line of this one row\n{line}"), (5, f"{line}\nx"), (5, f"{line}\nx"), (None, line), (7, None), (8, ""), (9, f"{line}\n{line}"), (10, f" {line}\t\n\n {line} ")]
    got = result(spark, rows)
    assert got == brute(rows)
    assert (5, "a wholly different first line of this one row", 1) in got and got.count((5, "x", 1)) == 2
    assert line_dedup.dedup_lines(spark.createDataFrame([], KIND)).count() == 0


def test_clashing_names(spark):
    line = "these are ten words that stand on one line here"
    docs = spark.createDataFrame([(1, line), (2, f"{line}\nrest")], KIND)
    names = ["emptied", "kept_text", "n_lines", "n_deleted", "__gone", "__b", "doc", "no", "h", "lines", "extra"]
    rows = line_dedup.dedup_lines(docs.withColumns({n: F.lit(f"in {n}") for n in names})).orderBy("doc_id").collect()
    assert [(r.kept_text, r.n_deleted, r.emptied, r.extra, r["__gone"], r.lines) for r in rows] == [(line, 0, False, "in extra", "in __gone", "in lines"), ("rest", 1, False, "in extra", "in __gone", "in lines")]


def test_holders_are_ranked_over_ranges(spark):
    """A window with nearly all holders is cut into several ranges; places run on from one to the next."""
    held = [("hot", doc) for doc in random.Random(3).sample(range(10_000), 900)] + [(f"w{i % 7}", i) for i in range(40)]
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        rows = spark.createDataFrame(held, "w string, doc long").repartition(5)
        got = sorted((r.w, r.doc, r["rank"]) for r in line_dedup.ranked(rows).collect())
    finally:
        spark.conf.unset(setting)
    want, place = [], defaultdict(int)
    for w, doc in sorted(held):
        place[w] += 1
        want.append((w, doc, place[w]))
    assert got == want
