"""Language identification by compression.

Every language has a zstandard raw-content dictionary of labelled text.  A
text, in lower case, is compressed with each of them, and the language whose dictionary makes
it smallest wins.  Long texts are compressed in blocks, each with the
dictionary, and the sizes are added up: the whole text counts.  The score is
the margin to the next language, (second - best) / second.

The dictionaries are fitted on a bounded sample of labelled rows
(``SAMPLE_ROWS`` rows a language, ``DICT_BYTES`` bytes a language, taken in
the order of a hash of the id); everything else covers all rows.

Null texts and texts without a letter are ``und`` with score 0.  If only one
language is known it wins with score 1; if none is, every text is ``und``.
Ties go to the language that sorts first.  Empty tables give empty results.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Bounds of the fit: labelled rows and bytes of dictionary a language.
SAMPLE_ROWS = 300
DICT_BYTES = 32 << 10
#: Longest piece of one text that goes into a dictionary, in characters.
PIECE_CHARS = 8192
BLOCK_BYTES = 16 << 10
LEVEL = 5
UNKNOWN = "und"


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries by language, from a bounded sample of the rows with a language and a text."""
    rows = labelled.select(labelled[id_col].alias("id"), labelled[text_col].alias("text"), labelled[lang_col].alias("lang")).where("lang is not null and text is not null and length(text) > 0")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 2.0 * sample_rows / n + 10.0 / n))])
    hashed = rows.withColumn("h", F.xxhash64(F.col("id").cast("string")))
    some = hashed.where((F.col("h").cast("double") / 2.0**64 + 0.5) < share[F.col("lang")])
    first = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= sample_rows)
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in first.select("lang", "k", F.substring("text", 1, PIECE_CHARS).alias("text")).collect():
        texts.setdefault(r["lang"], []).append((r["k"], r["text"]))
    return {k: "\n".join(t for _, t in sorted(v)).lower().encode()[:dict_bytes] for k, v in sorted(texts.items())}


def compressors(dictionaries: dict[str, bytes], level: int = LEVEL) -> list[tuple[str, object]]:
    import zstandard

    made = []
    for lang, content in sorted(dictionaries.items()):
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        made.append((lang, zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)))
    return made


def predict(made: list[tuple[str, object]], text: str, block: int = BLOCK_BYTES) -> tuple[str, float]:
    data = text.lower().encode()
    parts = [data[i : i + block] for i in range(0, len(data), block)]
    sizes = [(sum(len(c.compress(p)) for p in parts), lang) for lang, c in made]
    best = min(sizes)
    if len(sizes) == 1:
        return best[1], 1.0
    second = min(s for s in sizes if s is not best)
    return best[1], (second[0] - best[0]) / second[0]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.0) -> DataFrame:
    """Per row: id, ``lang_pred``, ``score`` and ``rejected`` (no letter, or a margin under ``min_margin``)."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(dictionaries)  # DICT_BYTES a language

    def make():
        made = compressors(shared.value)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = common.as_text(batch.column(1))
            letters = pc.match_substring_regex(texts, r"\p{L}").to_pylist()
            out = [predict(made, t) if ok and made else (UNKNOWN, 0.0) for t, ok in zip(texts.to_pylist(), letters, strict=True)]
            return pa.record_batch([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["id", "lang_pred", "score"])

        return apply

    out = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(common.map_slices(make, "text"), "id long, lang_pred string, score double")
    return out.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < min_margin)).withColumnRenamed("id", id_col)


def known(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = 0.0) -> DataFrame:
    """``docs`` without the rows that are rejected: no letter, or a margin under ``min_margin``."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(dictionaries)
    at = docs.columns.index(text_col)

    def make():
        made = compressors(shared.value)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = common.as_text(batch.column(at))
            letters = pc.match_substring_regex(texts, r"\p{L}").to_pylist()
            keep = [bool(ok and made and predict(made, t)[1] >= min_margin) for t, ok in zip(texts.to_pylist(), letters, strict=True)]
            return batch.filter(pa.array(keep, pa.bool_()))

        return apply

    return docs.mapInArrow(common.map_slices(make, text_col), docs.schema)
