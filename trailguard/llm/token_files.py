"""Token ids as flat files: unsigned little-endian integers, 64-bit offsets and ids of documents beside them.

A data set is a folder with, for each shard, `ids-<name>.bin` (uint16, or uint32 above 65,536 ids), `offsets-<name>.bin`
(int64: where each document begins in the shard, and the end) and `docs-<name>.bin` (int64 doc_ids), and a manifest table
with a row per shard. Shards hold ascending ranges of doc_id; a shard's base, the ids before it, is a prefix sum over the
manifest. A task writes under a name of its own and the manifest names the files of tasks that succeeded, so retried or
speculative tasks leave nothing that is read.

Null texts are empty; a null doc_id sorts first (int64's smallest value in the file); rows with one doc_id stay, in an
order that their texts decide; very long texts are encoded whole, block by block; further columns don't matter; an empty table
gives a data set of no shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, blocks, key, scratch_path, shuffle_partitions, table
from .tokens import default_tokenizer, encoder

MANIFEST = "shard int, name string, docs long, ids long, width int"


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Spark itself resolves it: one without a scheme is on the default file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path of a qualified folder; a scheme that Arrow doesn't know is refused, not taken for a
    local path."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    return pafs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 1) -> list[dict]:
    """Write all documents (doc_id, text) in ascending doc_id order; returns the manifest with each shard's base."""
    path, folder = tokenizer or default_tokenizer(), qualified(docs.sparkSession, folder)
    n = shuffle_partitions(docs.sparkSession)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (fs, root) = encoder(path), _open(folder)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        files, at, count = None, 0, 0
        for block in blocks(batches):
            if files is None:
                files = [fs.open_output_stream(f"{root}/{kind}-{name}.bin") for kind in ("ids", "offsets", "docs")]
                files[1].write(np.zeros(1, "<i8").tobytes())
            coded = [enc.text(x.as_py().encode()) + end for x in block.column(1)]
            ends = at + np.cumsum([len(x) // width for x in coded])
            files[0].write(b"".join(coded))
            files[1].write(ends.astype("<i8").tobytes())
            files[2].write(block.column(0).to_numpy().astype("<i8").tobytes())
            at, count = int(ends[-1]), count + block.num_rows
        if files:
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "name": [name], "docs": [count], "ids": [at], "width": pa.array([width], pa.int32())})

    # documents that share an id are in the order of their texts' hashes, and may be dealt over several shards
    hashed = docs.select(key().alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = hashed.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    # one row per shard comes to the driver: as many as partitions, however many documents
    shards = sorted((r.asDict() for r in ordered.mapInArrow(shard, MANIFEST).collect()), key=lambda r: r["shard"])
    bases = accumulate((s["ids"] for s in shards), initial=0)
    return [s | {"base": b} for s, b in zip(shards, bases, strict=False)]


class Shard:
    """A shard of a data set in a qualified folder, memory-mapped where it is local or mounted, else read by ranges."""

    def __init__(self, folder: str, name: str, width: int) -> None:
        self.fs, self.root = _open(folder)
        self.dtype = np.dtype(f"<u{width}")
        self.files = {kind: self._file(f"{self.root}/{kind}-{name}.bin") for kind in ("ids", "offsets", "docs")}

    def _file(self, path: str):
        return pa.memory_map(path) if isinstance(self.fs, pafs.LocalFileSystem) else self.fs.open_input_file(path)

    def _read(self, kind: str, first: int, last: int, dtype) -> np.ndarray:
        size = np.dtype(dtype).itemsize
        return np.frombuffer(self.files[kind].read_at((last - first) * size, first * size), dtype)

    def doc_ids(self, first: int, last: int) -> np.ndarray:
        return self._read("docs", first, last, "<i8")

    def offsets(self, first: int, last: int) -> np.ndarray:
        """Where the documents first..last-1 begin, and where the last one ends."""
        return self._read("offsets", first, last + 1, "<i8")

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids from position first to before last of the shard."""
        return self._read("ids", first, last, self.dtype)


def read(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """A row per document from the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    folder = qualified(spark, folder)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                shard = Shard(folder, s["name"], s["width"])
                for first in range(0, s["docs"], 2000):
                    last = min(first + 2000, s["docs"])
                    at = shard.offsets(first, last)
                    crc = []
                    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                        crc.append(zlib.crc32(shard.ids(a, b).astype("<u4").tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids(first, last)), pa.array(at[:-1] + s["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.createDataFrame([(s["name"], s["docs"], s["width"], s["base"]) for s in manifest], "name string, docs long, width int, base long")
    rows = shards.repartition(max(1, len(manifest))).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    return read(spark, folder, write(table(spark, sf_dir, "documents"), folder))
