"""Helpers shared by the operators of this subpackage: shared storage and input columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.storage import fresh_path, written


#: A fresh folder path below ``spark.checkpoint.dir``, and a table written there: it survives lost executors.
shared_dir, materialise = fresh_path, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` that gives free memory back to the system when a task ends: workers live on for other stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
        if trim is not None:
            trim(0)

    return task


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def held_out(id_column: str = "doc_id"):
    """True for rows no model may learn from: crc32(id as text) mod 3 is 1, or the id is null."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(True))
