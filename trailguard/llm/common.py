"""Tables, shared scratch tables and text blocks used by every operator of the subpackage."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null doc_id inside the operators: it sorts first, as null does, and is a key that joins.
NULL_ID = -(2**63)
#: Deletes a job's shuffle files when it ends, not when the driver happens to collect its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Scratch tables made by the caller that settles them; those of nobody stay.
_owner: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset a folder of our own."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        base = context.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="spark-trailguard-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        context.setCheckpointDir(base)
        base = context.getCheckpointDir()
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/trailguard/{name}-{uuid.uuid4().hex}"
    if (made := _owner.get()) is not None:
        made.append(path)
    return path


@contextmanager
def run_once(spark: SparkSession) -> Iterator[None]:
    """For jobs whose plans never run again: their shuffle files go as they end, so disk holds one job's at a time."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def save(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: its lineage ends there, so a lost executor costs no
    recomputation and every later use sees the same rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with run_once(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make(), saved; the scratch tables that were made for it are deleted, for what is saved doesn't need them. The saved
    table itself stays for whoever reads the result."""
    made: list[str] = []
    before = _owner.set(made)
    try:
        out = make()
    finally:
        _owner.reset(before)
    if made:
        out = save(out, name)
        release(out.sparkSession, made)
    return out


def written(path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make(), written once to path and read back; the scratch tables that were made for it are deleted."""
    made: list[str] = []
    before = _owner.set(made)
    try:
        out = make()
        spark = out.sparkSession
        with run_once(spark):
            out.write.parquet(path)
    finally:
        _owner.reset(before)
    release(spark, made)
    return spark.read.parquet(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables. Only for callers that have written all that is computed from them."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def key(name: str = "doc_id") -> Column:
    """doc_id as a key that is never null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def unkey(name: str) -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


def with_row(docs: DataFrame, *more: str) -> T.StructType:
    """The schema (row, a struct of all columns of docs, and the DDL columns `more`): what operators add can't clash with
    columns of the documents."""
    return T.StructType([T.StructField("row", docs.schema), *T.StructType.fromDDL(", ".join(more)).fields])


def as_row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def blocks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of whole rows with about `limit` bytes of text, so that memory in a task doesn't
    depend on how long the texts of a batch are. Null texts become empty."""
    for batch in batches:
        at = batch.schema.names.index(column)
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy().astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = size[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(size, before + limit, side="right")))
            part = batch.slice(first, last - first)
            text = part.column(at)  # only a block's texts are copied, not the batch's
            if text.type != pa.string():
                text = text.cast(pa.string())
            yield part.set_column(at, column, pc.fill_null(text, "") if text.null_count else text)
            first = last


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, end to end, and where each begins (one more than texts)."""
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


# ---- words and their hashes -------------------------------------------------------------------------------------
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of the two kinds of words that the operators take; bytes of other code points than ASCII are word bytes.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_SEQUENCE = np.uint64(0xD6E8FEB86659FD93)
#: Words of at most so many bytes are hashed side by side, eight bytes at a time; longer ones one by one, by BLAKE2b.
_SIDE_BY_SIDE = 64


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as far as asked for."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = int(base), pow(int(base), -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            both = []
            for b in (self.base, self.inverse):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                both.append(np.cumprod(x, dtype=np.uint64))
            self.up, self.down = both
        return self.up, self.down


_word_powers = _Powers(_SEQUENCE)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes. Every eight bytes are mixed into what came before, so no pattern of letters
    cancels out, as it does in sums of powers modulo 2^64."""
    length = end - start
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(length.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(1))
    on = np.flatnonzero(length <= _SIDE_BY_SIDE)
    at = 0
    while len(on):
        left = length[on] - at
        keep = np.uint64(2**64 - 1) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64))
        h[on] = mix((h[on] + np.uint64(at)) ^ mix(eight[start[on] + at] & keep))
        at += 8
        on = on[left > 8]
    for i in np.flatnonzero(length > _SIDE_BY_SIDE).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


class Words:
    """The words of a block of texts. start, end: bytes of each word; first: the word with which each text begins (one
    more than texts); hash: equal words have equal 64-bit values in every block, task and run."""

    def __init__(self, text: pa.Array, word_bytes: np.ndarray, lower: bool) -> None:
        data, at = raw(text)
        self.data = LOWER[data] if lower else data
        n = len(data)
        word = word_bytes[self.data]
        begins = np.zeros(n + 1, bool)
        begins[at] = True
        start, end = word.copy(), word.copy()
        start[1:] &= ~word[:-1] | begins[1:n]
        end[:-1] &= ~word[1:] | begins[1:n]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, at)
        self.hash = word_hashes(self.data, self.start, self.end)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


class Joined:
    """The words of a block, each followed by one space: the bytes of any run of words are a slice."""

    def __init__(self, words: Words) -> None:
        length = words.end - words.start
        self.end = np.cumsum(length + 1)  # after each word's space
        self.start = self.end - length - 1
        source = np.repeat(words.start - self.start, length + 1) + np.arange(self.end[-1] if len(length) else 0)
        out = np.append(words.data, np.uint8(32))[np.minimum(source, len(words.data))]
        out[self.end - 1] = 32
        self.bytes = out.tobytes()

    def digests(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """128 bits of BLAKE2b of each run of words, joined by one space, as two columns of 64."""
        view, blake2b = memoryview(self.bytes), hashlib.blake2b
        edges = zip(self.start[first].tolist(), (self.end[last - 1] - 1).tolist(), strict=True)
        return np.frombuffer(b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in edges]), "<i8").reshape(-1, 2)


class Runs:
    """Hashes of any runs of consecutive values of an array of hashes."""

    def __init__(self, values: np.ndarray) -> None:
        up, self.down = _word_powers(len(values) + 1)
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.total[1:], dtype=np.uint64)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64) * _SEQUENCE)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
