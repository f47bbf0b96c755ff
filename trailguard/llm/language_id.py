"""Language identification by compression.

Each language has a raw-content zstandard dictionary of its own words; a text's words (letters only, lower case) are
compressed with every dictionary, in blocks, and the language whose dictionary makes it smallest is predicted. Where the
second language is hardly larger (relative to the smaller), the text is rejected. Texts of all lengths go the same way.

Learning counts the words of all labelled rows, whole texts and every copy, by language. A dictionary has the most frequent
words of its language, of equal counts the shorter ones first, as many as `dictionary` bytes hold; the most frequent stand
last, where references to them are shortest. Prediction reads whole texts, and nothing but texts.

Null texts and texts without letters are `und` with score 0, as is everything where no row is labelled. Rows with one
doc_id are predicted each by itself. Ties go to the language that sorts first. Very long texts are compressed whole, block
by block; further columns of any name travel in a struct; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_row, blocks, save, settled, table, with_row

UNKNOWN = "und"
DICTIONARY = 96 << 10
#: Words that a task counts before it hands them on.
HELD = 400_000
#: Bytes compressed at once: the dictionary stays the larger part of what a block can refer to.
BLOCK = 4096
#: A text is rejected where the second size exceeds the smallest by less than this share.
MARGIN = 0.002
_WORD = re.compile(r"[^\W\d_]+")


def letters(text: str) -> bytes:
    """Words of letters in lower case: marks, digits and case tell nothing about the language."""
    return f" {' '.join(_WORD.findall(text.lower()))} ".encode()


def word_counts(labelled: DataFrame) -> DataFrame:
    """lang, w, n: how often each language has each word in all rows (text, lang); words as of `letters`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def counted() -> pa.RecordBatch:
            of = [lang for lang, words in held.items() for _ in words]
            out = [pa.array(of, pa.string()), pa.array([w for words in held.values() for w in words], pa.string())]
            out.append(pa.array([n for words in held.values() for n in words.values()], pa.int64()))
            held.clear()
            return pa.RecordBatch.from_arrays(out, ["lang", "w", "n"])

        for block in (block for batch in batches for block in blocks([batch])):
            for lang, text in zip(block.column(0).to_pylist(), block.column(1), strict=True):
                held[lang].update(_WORD.findall(text.as_py().lower()))
            if sum(map(len, held.values())) > HELD:
                yield counted()
        yield counted()

    found = labelled.where("lang is not null").select("lang", "text").mapInArrow(rows, "lang string, w string, n long")
    return found.groupBy("lang", "w").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, dictionary: int = DICTIONARY) -> dict[str, bytes]:
    """Dictionaries by language from rows (text, lang): at most languages x dictionary bytes of words reach the driver."""
    spark = labelled.sparkSession
    counts = save(word_counts(labelled), "words").withColumn("step", F.floor(F.log2("n") * 8).cast("int")).withColumn("bytes", F.octet_length("w") + 1)
    # the step at which a language's dictionary is full; of a word at that step, or above it, the rank decides
    left: dict[str, int] = {}
    least: dict[str, int] = {}
    for r in sorted(counts.groupBy("lang", "step").agg(F.sum("bytes").alias("bytes")).collect(), key=lambda r: -r["step"]):
        if left.setdefault(r["lang"], dictionary) > 0:
            left[r["lang"]] -= r["bytes"]
            least[r["lang"]] = r["step"]
    if not least:
        return {}
    steps = F.broadcast(spark.createDataFrame(list(least.items()), "lang string, least int"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "bytes", "w"))
    likely = counts.join(steps, "lang").where("step >= least").select("lang", "w", "n", rank.alias("rank")).where(F.col("rank") <= dictionary // 2)
    words: dict[str, list] = defaultdict(list)
    for r in sorted(likely.collect(), key=lambda r: (r["lang"], -r["rank"])):
        words[r["lang"]].append(r["w"])
    return {lang: f" {' '.join(found)} ".encode()[-dictionary:] for lang, found in words.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = 6) -> None:
        self.languages = list(dictionaries)
        self.compressors = [self._compressor(d, level) for d in dictionaries.values()]

    @staticmethod
    def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
        raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, text: bytes) -> list[int]:
        parts = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.compressors]

    def predict(self, text: bytes) -> tuple[str, float, float]:
        """Language, score (0 to 1: how surely the smallest is smallest) and margin."""
        sizes = np.array(self.sizes(text), float)
        order = np.argsort(sizes, kind="stable")
        best = sizes[order[0]]
        margin = (sizes[order[1]] - best) / best if len(sizes) > 1 else 1.0
        # an equal share at no difference; bytes count less the longer the text
        weights = np.exp(-(sizes - best) / (1 + best / 50))
        return self.languages[order[0]], float(1 / weights.sum()), float(margin)


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """row (all columns of docs), lang_pred, score, margin, rejected."""
    schema = with_row(docs, "lang_pred string", "score double", "margin double", "rejected boolean")
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)  # languages x dictionary bytes

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(model.value)
        for batch in batches:
            found = []
            for text, lettered in zip(batch.column(0).field("text"), batch.column(1).to_pylist(), strict=True):
                found.append(classifier.predict(letters(text.as_py())) if lettered and model.value else (UNKNOWN, 0.0, 0.0))
            lang, score, far = zip(*found, strict=True) if found else ((), (), ())
            out = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.float64())]
            out.append(pa.array([l == UNKNOWN or m < margin for l, m in zip(lang, far, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], schema.names)

    return docs.select(as_row(docs), has_letters(F.col("text")).alias("lettered")).mapInArrow(rows, schema)


def bucket(name: str, n: int) -> Column:
    """crc32 of the column's text, modulo n: folds that don't depend on where a row is. A null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(n)), F.lit(0))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def predicted() -> DataFrame:
        dictionaries = learn(docs.where(bucket("doc_id", 5) != 0).select("text", "lang"))
        found = identify(docs.select("doc_id", "text"), dictionaries)
        return found.select("row.doc_id", (bucket("row.doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "margin", "rejected")

    return settled("predicted", predicted)
