"""Items longer than a passage, and what lies at the ends of documents."""

from pathloom.llm import decontaminate


def found(spark, items, docs):
    items = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}


def test_item_of_500_words(spark):
    item = " ".join(f"w{i}" for i in range(500))
    docs = [(1, "other words " * 70 + item + " more of it" * 30), (2, item), (3, " ".join(item.split()[:100])), (4, "other words " * 300)]
    assert found(spark, [(1, item), (2, "a short item of some words")], docs) == {(1, 1), (2, 1)}


def test_short_items_and_the_last_trigram(spark):
    ends = " ".join(f"x{i}" for i in range(62)) + " the last three"  # 63 trigrams
    docs = [(1, "a text that names zanzibar and more"), (2, "one that has grey tower in it"), (3, "zanzibar"), (4, "grey tower"), (5, ends), (6, "grey and tower")]
    assert found(spark, [(1, "Zanzibar"), (2, "grey tower"), (3, "the last three")], docs) == {(1, 1), (3, 1), (2, 2), (4, 2), (5, 3)}


def test_blocks_that_cannot_pass_are_skipped():
    """Frequent weak terms over many blocks: few items are scored, and the result is that of scoring all."""
    import random

    rng = random.Random(4)
    items = [(i, " ".join(f"common{rng.randrange(6)}" for _ in range(9)) + f" rare{i} odd{i} own{i} {i} {i} {i}") for i in range(2000)]
    terms = {i: decontaminate.item_terms(t) for i, t in items}
    frequency = {}
    for x in terms.values():
        for t in set(x):
            frequency[t] = frequency.get(t, 0) + 1
    index = decontaminate.Index(items, frequency, 2000, 13.0)
    for i in (0, 63, 64, 777, 1999):
        asked = terms[i]
        score = {}
        for t in set(asked):
            for k, w in index.postings[t]:
                score[k] = score.get(k, 0.0) + w
        want = {k: s for k, s in score.items() if s >= decontaminate.SHARE * index.most[k]}
        got = dict(index.search(asked))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and i in got


def test_items_of_every_length(spark):
    for n in (1, 2, 3, 64, 206, 207, 2000):
        item = " ".join(f"w{i}" for i in range(n))
        assert found(spark, [(1, item), (1, "more text under the same id"), (None, item)], [(5, f"before it {item} after it"), (5, "nothing"), (None, item), (6, None), (7, "")]) == {(5, 1)}, n
    assert found(spark, [], [(1, "a b c")]) == set() and found(spark, [(1, "a b c")], []) == set()


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "other"), (None, "one two three four five")], "doc_id long, text string").selectExpr("*", "'x' as item_id", "'y' as __bad", "'z' as id")
    items = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string").selectExpr("*", "'q' as terms")
    assert sorted((str(r.doc_id), r.item_id, r["__bad"], r.id) for r in decontaminate.decontaminate(docs, items).collect()) == [("2", "x", "y", "z"), ("None", "x", "y", "z")]
