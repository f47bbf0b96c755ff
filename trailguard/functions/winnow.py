"""Winnowing: a few short grams of a text by which two texts that share a run of bytes always find each other.

Of every run of `least` bytes the k-gram with the least hash is kept, k being half the run (8 at most). A run that two texts
share has the same k-grams in both, so both keep the same one of it: joining on kept grams misses no shared run, with two
in (least - k + 2) of the rows that all grams would be. A gram is one 64-bit value, mixed but not shortened, so equal
values are equal grams; whether the run around it is long enough is seen from the bytes beside it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gram_size(least: int) -> int:
    return min(8, (least + 1) // 2)


def kept(data: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the kept grams, each value once for every place at which a run keeps it."""
    k = gram_size(least)
    if len(data) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(b) - k + 1
    g = np.zeros(n, np.uint64)
    for i in range(k):
        g = (g << np.uint64(8)) | b[i : i + n]
    # a bijection of 64 bits, so that neither common nor small bytes are always the least
    g = (g ^ (g >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    g = (g ^ (g >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    g ^= g >> np.uint64(33)
    w = least - k + 1
    at = np.unique(np.lib.stride_tricks.sliding_window_view(g, w).argmin(axis=1) + np.arange(n - w + 1))
    return at, g[at].view(np.int64)


def winnowed(rows: DataFrame, keys: list[str], data: str, least: int, beside: int = 0) -> DataFrame:
    """keys, g and, where beside isn't 0, before and after: that many bytes next to the gram. `data` is a binary column;
    rows alike in all of these are one."""
    k = gram_size(least)
    schema = T.StructType([*[rows.schema[c] for c in keys], *T.StructType.fromDDL("g long, before binary, after binary").fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, grams, before, after = [], [], [], []
            for i, x in enumerate(b.column(len(keys)).to_pylist()):
                at, g = kept(x, least) if x else ((), ())
                if not len(at):
                    continue
                sides = [(x[max(0, p - beside) : p], x[p + k : p + k + beside]) for p in at.tolist()] if beside else [(None, None)] * len(at)
                for value, (left, right) in dict.fromkeys(zip(g.tolist(), sides, strict=True)):
                    row.append(i)
                    grams.append(value)
                    before.append(left)
                    after.append(right)
            own = b.select(list(range(len(keys)))).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(grams, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary())], [f.name for f in schema.fields])

    found = rows.select(*keys, data).mapInArrow(task, schema)
    return found if beside else found.drop("before", "after")


def common(a: Column, b: Column, most: int, ends: bool) -> Column:
    """How many bytes, up to most, two binary columns have in common at their ends or beginnings."""
    part = (lambda c, i: F.substr(c, F.length(c) - i + 1, i)) if ends else (lambda c, i: F.substr(c, F.lit(1), i))
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda i: (F.length(a) >= i) & (F.length(b) >= i) & (part(a, i) == part(b, i))))
