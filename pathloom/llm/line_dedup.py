"""Line deduplication by pairwise alignment.

A block can go from a document only if an earlier one holds the same lines next
to each other, so documents are paired by their windows: runs of lines of at
least ``BLOCK_WORDS`` words that are least around some line (``windows``).  A
window of at most ``RARE`` documents pairs all of them; any other first pairs
each with the smallest id that holds it.  Where a line of such a window is kept
after that, further earlier holders follow in rounds of growing size, until the
line is deleted or no earlier holder is left: the result is that of all pairs.
Documents with the same lines stand for each other, so only the first of them
is aligned.  Both documents of a pair are aligned with patience diff: lines that
are unique on both sides and stand in the same order (the longest increasing
run) are anchors, what lies between anchors is aligned in the same way, and
equal lines next to an anchor join it.  An aligned common block of at least
``BLOCK_WORDS`` words is deleted from the later document (the larger id).

Lines are compared without the white space at their ends, by 64-bit hashes;
lines without words, and lines that only one document has, match nothing, are
left out of the alignment and end a block.  Decisions are made on the input, not on what other deletions leave.  Null texts are kept as null,
empty texts as empty.  A document keeps its row when all its lines are
deleted; ``emptied`` says so.  Rows with a null id are kept as they are and
match nothing.  Rows with one id are one document: none of them is earlier than
another, equal ones fare alike, and each unequal text is aligned alone (a line's
number carries 32 bits of the hash of its text).  Extra columns of the
input stay as they are; one with the name of an added column gives way to it.
An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

RARE = 4
BLOCK_WORDS = 8
#: White space, as it is cut from the ends of lines and parts words.
WHITE = " \t\n\x0b\f\r"
#: Bits of a line's place in its text; the bits above are of the text's hash.
PLACE_BITS = 31
#: Bytes of pairs that a Python worker holds at once, in MB.
BATCH_MB = 4
ADDED = ("kept_text", "n_lines", "n_deleted", "emptied")
#: Further holders of the first round after the smallest id; each round has ``GROWTH`` times as many.
FURTHER, GROWTH = 4, 4


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, ascending on the left, that ascends on the right."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        if k == len(tails):
            tails.append(y)
            at.append(i)
        else:
            tails[k] = y
            at[k] = i
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of equal elements of two sequences, by patience diff."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a: dict = {}
        for i in range(a0, a1):
            once_a[a[i]] = -1 if a[i] in once_a else i
        once_b: dict = {}
        for i in range(b0, b1):
            once_b[b[i]] = -1 if b[i] in once_b else i
        anchors = increasing([(i, once_b[x]) for x, i in once_a.items() if i >= 0 and once_b.get(x, -1) >= 0])
        if not anchors:
            continue
        for i, j in [*anchors, (a1, b1)]:
            if a0 < i and b0 < j:
                todo.append((a0, i, b0, j))
            if i < a1:
                matched.append((i, j))
            a0, b0 = i + 1, j + 1
    return sorted(matched)


def deleted(a: list[tuple[int, int, int]], b: list[tuple[int, int, int]], words: int) -> list[int]:
    """Line numbers that go from b: a and b are (line number, hash, words) of the lines that
    occur in several documents; a block ends where a line in between is missing on either side."""
    out: list[int] = []
    run: list[tuple[int, int]] = []

    def end() -> None:
        if sum(b[j][2] for _, j in run) >= words:
            out.extend(b[j][0] for _, j in run)
        run.clear()

    for i, j in patience([x[1] for x in a], [x[1] for x in b]):
        if run and (a[i][0] != a[run[-1][0]][0] + 1 or b[j][0] != b[run[-1][1]][0] + 1):
            end()
        run.append((i, j))
    end()
    return out


def windows(no: list[int], h: list[int], size: list[int], words: int) -> list[tuple[int, int, int]]:
    """(value, first, last line number) of runs of at least so many words: from each line the shortest, and the
    longer ones that are below it without that line.  A common block with a line has one of them around it."""
    out = []
    for i in range(len(no)):
        total, j, short = 0, i, True
        while j < len(no) and no[j] - no[i] == j - i and (short or total - size[i] < words):
            total += size[j]
            if total >= words and (short or total - size[i] < words):
                out.append((hash(tuple(h[i : j + 1])), no[i], no[j]))
                short = False
            j += 1
    return out


def text_number(text: F.Column) -> F.Column:
    """What the numbers of the lines of a text have above their places."""
    return F.shiftleft(F.xxhash64(text).bitwiseAND(F.lit((1 << 32) - 1)), PLACE_BITS)


def word_count(line: F.Column) -> F.Column:
    """The words of a line without white space at its ends; only a line with other than single blanks is split."""
    odd = reduce(Column.__or__, [F.contains(line, F.lit(c)) for c in ("  ", *WHITE.replace(" ", ""))])
    blanks = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(odd, F.size(F.split(line, r"\s+"))).otherwise(blanks + 1)


def ranked(held: DataFrame) -> DataFrame:
    """(w, doc, rank): the place of each document among the holders of a window, from 1.  The holders of a frequent
    window are cut into ranges of ids, each counted and ranked by itself."""
    ranges = common.materialise(held.repartitionByRange("w", "doc").withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("w").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("w", "range").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("w", "range").orderBy("doc"))
    return ranges.join(sizes.select("w", "range", "before").hint("merge"), ["w", "range"]).select("w", "doc", (F.col("before") + own).alias("rank"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, block_words: int = BLOCK_WORDS, added: tuple[str, str, str, str] = ADDED) -> DataFrame:
    """``docs`` with its columns and the ``added`` ones: kept text, numbers of lines and of deleted lines, emptied."""
    common.bounded_batches(docs.sparkSession, BATCH_MB)
    texts = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    trimmed = F.trim("line", F.lit(WHITE))
    lines = texts.where("doc is not null and text is not null").select("doc", text_number(F.col("text")).alias("of"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line")).select("doc", (F.col("of") + F.col("place")).alias("no"), trimmed.alias("line"))
    lines = lines.where("line <> ''").select("doc", "no", F.xxhash64("line").alias("h"), word_count(F.col("line")).alias("words"))
    # a table of its own, so that both sides of the join are dealt out for it and a frequent line can be split
    several = common.materialise(lines.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("h"), "several")
    met = lines.join(several.hint("merge"), "h").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("no", "h", "words"))).alias("lines"))
    met = met.withColumn("lines", F.filter("lines", lambda x, i: (i == 0) | (x["no"] != F.get(F.col("lines"), i - 1)["no"])))  # equal rows
    by_doc = common.materialise(met.withColumn("key", F.xxhash64("lines")), "lines")
    unlike = common.materialise(by_doc.groupBy("key").agg(F.min("doc").alias("doc")).select("doc"), "unlike")

    def cut(batches):
        for pdf in batches:
            rows = []
            for doc, *of in zip(pdf["doc"], pdf["no"], pdf["h"], pdf["words"], strict=True):
                seen = set()
                for w, lo, hi in windows(*(x.tolist() for x in of), block_words):
                    rows.append((doc, w, lo, hi, w not in seen))
                    seen.add(w)
            yield pd.DataFrame(rows, columns=["doc", "w", "lo", "hi", "once"])
            del pdf, rows
            common.release()

    def of_texts(a: list, b: list) -> list[int]:
        """The lines that go from any text of the later id, each aligned with each text of the earlier one."""
        left, right = ([list(g) for _, g in groupby(x, lambda line: line[0] >> PLACE_BITS)] for x in (a, b))
        return sorted({no for y in right for x in left for no in deleted(x, y, block_words)})

    def align(batches):
        for pdf in batches:
            found = [of_texts(list(zip(*(x.tolist() for x in p[:3]), strict=True)), list(zip(*(x.tolist() for x in p[3:]), strict=True))) for p in zip(*(pdf[c] for c in sides_of), strict=True)]
            yield pd.DataFrame({"b": pdf["b"], "gone": found})[[bool(x) for x in found]]
            del pdf, found
            common.release()

    parts = ("no", "h", "words")
    sides_of = [s + c for s in ("la", "lb") for c in parts]

    def aligned(sides: DataFrame) -> DataFrame:
        return sides.select("b", *[F.col(f"{s}.{c}").alias(s + c) for s in ("la", "lb") for c in parts]).mapInPandas(align, "b long, gone array<long>")

    def of_pairs(pairs: DataFrame) -> DataFrame:
        return aligned(pairs.distinct().join(by_doc.select(F.col("doc").alias("a"), F.col("lines").alias("la")), "a").join(by_doc.select(F.col("doc").alias("b"), F.col("lines").alias("lb")), "b"))

    def together(found: DataFrame) -> DataFrame:
        return found.select("b", F.explode("gone").alias("no")).groupBy("b").agg(F.collect_set("no").alias("__gone"))

    def left(rows: DataFrame, found: DataFrame) -> DataFrame:
        """The windows that have a line which is not deleted yet."""
        rows = rows.join(together(found).withColumnRenamed("b", "doc"), "doc", "left")
        return rows.where(F.col("__gone").isNull() | (F.size(F.array_except(F.sequence("lo", "hi"), "__gone")) > 0)).drop("__gone")

    cuts = by_doc.join(unlike, "doc", "left_semi").select("doc", *[F.col(f"lines.{c}").alias(c) for c in parts]).mapInPandas(cut, "doc long, w long, lo long, hi long, once boolean")
    cuts = common.materialise(cuts, "windows")
    held = cuts.where("once").select("w", "doc")
    lists = common.materialise(held.groupBy("w").agg(F.min("doc").alias("first"), F.count("*").alias("c")).where("c > 1"), "lists")
    often = held.join(lists, "w").where("first < doc").select(F.col("first").alias("a"), F.col("doc").alias("b"))
    few = held.join(lists.where(F.col("c") <= rare), "w").select("w", "doc")
    pairs = few.select("w", F.col("doc").alias("a")).join(few.select("w", F.col("doc").alias("b")), "w").where("a < b").select("a", "b")
    copies = by_doc.join(unlike, "doc", "left_anti").select(F.col("doc").alias("b"), F.col("lines").alias("la"), F.col("lines").alias("lb"))
    found = common.materialise(of_pairs(often.union(pairs)).union(aligned(copies)), "deleted")
    kept = common.materialise(left(cuts.join(lists.where(F.col("c") > rare), "w").where("first < doc").select("doc", "w", "lo", "hi"), found), "kept")
    if not kept.isEmpty():
        ranks = common.materialise(ranked(held.join(kept.select("w").distinct(), "w", "left_semi")), "ranks")
        done, more = 1, FURTHER
        kept = kept.join(ranks, ["w", "doc"]).where(F.col("rank") > done + 1)
        while not kept.isEmpty():
            next_ones = ranks.where((F.col("rank") > done) & (F.col("rank") <= done + more)).select("w", F.col("doc").alias("a"))
            new = common.materialise(of_pairs(kept.select("w", F.col("doc").alias("b")).join(next_ones, "w").where("a < b").select("a", "b")), "deleted")
            found = found.union(new)
            done, more = done + more, more * GROWTH
            kept = common.materialise(left(kept.where(F.col("rank") > done + 1), found), "kept")
    b, all_gone = (f"__{uuid.uuid4().hex}" for _ in range(2))
    out = docs.join(together(found).withColumnsRenamed({"b": b, "__gone": all_gone}).hint("merge"), docs[id_col] == F.col(b), "left")
    split, text = F.split(docs[text_col], "\n", -1), docs[text_col]
    own = F.transform(F.filter(all_gone, lambda g: F.shiftright(g, PLACE_BITS) == F.shiftright(text_number(text), PLACE_BITS)), lambda g: g.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))
    n_gone = F.when(F.col(all_gone).isNull() | text.isNull(), 0).otherwise(F.size(own))
    kept = F.when(n_gone == 0, text).otherwise(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), own), lambda i: F.get(split, i)), "\n"))
    n = F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long")
    emptied = (n_gone > 0) & (F.regexp_replace(kept, r"\s", "") == "")
    made = [x.alias(name) for x, name in zip((kept, n, n_gone.cast("long"), emptied), added, strict=True)]
    return out.select(*[docs[c] for c in docs.columns if c not in added], *made)
