"""Cutting the lineage of intermediate results that several later steps read."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed now and written to the checkpoint folder that the cluster shares; later plans begin at that copy, so
    they stay small and a lost executor costs no recomputation. A folder of our own only where none is set."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = context.getConf().get("spark.checkpoint.dir")
        if not base:
            base = tempfile.mkdtemp(prefix="spark-trailguard-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        context.setCheckpointDir(base)
    return df.checkpoint()
