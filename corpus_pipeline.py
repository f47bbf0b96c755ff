"""A corpus pipeline: language ID, near-duplicates, repeated passages, benchmark passages, packing.

Every stage takes the documents that its predecessor kept and returns those it keeps, with the columns of documents; the
last returns the packed pieces. run() writes each stage's result once, as Parquet in the shared folder, and reads it back, so
a stage's lineage ends there; what a stage was made from is deleted after it. A stage of STAGES that needs scratch tables
saves its result and deletes them, so what it returns stays readable whatever else runs later.

Null and empty texts, and those without letters, go with the first stage; a null doc_id counts as the smallest; equal rows
become one in the second stage; texts may be as long as a column can hold; columns besides doc_id and text may have any
name and type, for they travel in a struct; empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailguard.llm.common import as_row, key, release, settled, shared_dir, table, written
from trailguard.llm.decontaminate import find
from trailguard.llm.language_id import identify, learn
from trailguard.llm.packing import pack
from trailguard.llm.simhash import grouped
from trailguard.llm.substring_dedup import remove_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or between two languages, go. With no labelled text every document goes."""
    found = identify(docs, learn(docs.select("text", "lang")))
    return found.where(~F.col("rejected")).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest doc_id stays; of rows with one doc_id and text, one.
    Linked are fingerprints within two bits and texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    repeated = not docs.groupBy(key().alias("d")).count().where("count > 1").isEmpty()
    if repeated:
        docs = docs.dropDuplicates(["doc_id", "text"])
    found = grouped(docs, similarity=0.8)
    gone = found.where("doc != component").select("doc", "sum")
    if repeated:  # of different texts with the smallest doc_id one stays
        least = found.where("doc = component").groupBy("component").agg(F.min("sum").alias("least"))
        gone = gone.union(found.where("doc = component").join(least, "component").where("sum != least").select("doc", "sum"))
    rows = docs.select(as_row(docs), key().alias("doc"), F.xxhash64("text").alias("sum"))
    return rows.join(gone.distinct(), ["doc", "sum"], "left_anti").select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of runs of 20 words or more are cut out; documents of which nothing is left go."""
    found = remove_repeats(docs).where("n_removed = 0 or n_removed < n_words")

    def column(c: str):
        own = F.col(f"row.`{c}`")
        if c != "n_chars":
            return own
        return F.when(F.col("n_removed") > 0, F.length("row.text").cast(docs.schema[c].dataType)).otherwise(own).alias(c)

    return found.select(*map(column, docs.columns))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go. With no benchmark text all stay."""
    return find(docs, table(spark, sf_dir, "benchmark")).where(F.size("hits") == 0).select("row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in sequences of at most 2,048: a row per piece, as of op1_packing."""
    return pack(docs, with_ids=False)


def _stage(f: Callable) -> Callable:
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return settled(f.__name__, lambda: f(spark, docs, sf_dir))

    stage.__name__, stage.__doc__ = f.__name__, f.__doc__
    return stage


_PARTS = (language, near_copies, repeated_passages, benchmark_passages, sequences)
STAGES = [(f.__name__, _stage(f)) for f in _PARTS]
#: Compression, recompression hashes and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, paths = table(spark, sf_dir, "documents"), []
    for f in _PARTS[:-1]:
        paths.append(f"{shared_dir(spark)}/trailguard/stage-{f.__name__}-{uuid.uuid4().hex}")
        docs = written(paths[-1], lambda f=f, docs=docs: f(spark, docs, sf_dir))
        release(spark, paths[:-1])  # what this stage was made from
        del paths[:-1]
    return STAGES[-1][1](spark, docs, sf_dir)
