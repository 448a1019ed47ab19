"""Shared helpers: the folder all executors see, written tables, bounded Arrow batches."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans.tables import dropped, scratch, shared_dir, tidied, written

__all__ = ["batches", "dropped", "gathered", "only", "scratch", "shared_dir", "table", "tidied", "tidy", "written"]

BATCH_ROWS, BATCH_BYTES = 500, 2 << 20


def batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds what a Python worker and its task hold of texts at once, on both sides of Arrow; rows: more for short rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def released() -> None:
    """Gives memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def gathered(batches_, most: int = 4 << 20, every: int = 8):
    """The batches of a worker put together to about `most` bytes each, for steps that gain from more rows at once; after
    `every` of them freed memory goes back."""
    held, size, n = [], 0, 0
    for b in batches_:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size, n = [], 0, n + 1
            if n % every == 0:
                released()
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def tidy(run):
    """run for mapInArrow; at its end the worker, which stays for later tasks, gives freed memory back to the system."""

    def inner(batches_):
        try:
            yield from run(batches_)
        finally:
            released()

    return inner


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns; others, whatever their names, are left behind before any join."""
    batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in cols])
