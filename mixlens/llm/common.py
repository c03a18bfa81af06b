"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import sys
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlens.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by name; any path Spark itself can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back: a lost
    executor costs a re-read, never a recomputation with other row placement."""
    out = cut_lineage(df)
    # the finished step's shuffle files go as soon as the JVM notices they are unused
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def size_units(df: DataFrame, column: str, unit_bytes: int) -> int:
    """How many units of ``unit_bytes`` the texts of ``column`` fill (at least 1)."""
    total = df.select(F.sum(F.coalesce(F.octet_length(column), F.lit(0)) + F.lit(16)).alias("b")).first()["b"]
    return max(1, -(-int(total or 0) // unit_bytes))


def worker_state(key: str, make):
    """An object that lives as long as the Python worker: vocabularies and word
    caches are loaded once per worker, not once per task.  Kept in a module of
    its own because task code is pickled by value."""
    home = sys.modules.get("_mixlens_worker_state")
    if home is None:
        home = sys.modules["_mixlens_worker_state"] = types.ModuleType("_mixlens_worker_state")
        home.items = {}
    if key not in home.items:
        home.items[key] = make()
    return home.items[key]


def gather(pool, offsets, lengths):
    """Concatenate ``pool[o:o+l]`` for every (o, l), without a Python loop."""
    import numpy as np
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if total == 0:
        return pool[:0]
    starts = np.cumsum(lengths) - lengths
    index = np.repeat(np.asarray(offsets, dtype=np.int64) - starts, lengths)
    index += np.arange(total, dtype=np.int64)
    return pool[index]
