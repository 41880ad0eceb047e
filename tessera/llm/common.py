"""What the operators of this subpackage share: sources, checkpoints and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.plans.storage import shared_dir, stored

__all__ = ["load", "saved", "shared_dir", "slices", "stored", "tidy", "tune"]

#: Rows in one Arrow batch.  Texts may be long, so the batches are kept small.
BATCH_ROWS = 512


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, read by Spark only (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of long texts has to fit into a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: it survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on from task to task and stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; before the first and after the last of them memory is given back."""
    release()
    yield from batches
    release()


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that ``column`` holds about ``max_bytes`` in each (one row at least)."""
    import pyarrow.compute as pc

    for batch in tidy(batches):
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin, held = 0, 0
        for row, size in enumerate(sizes):
            if row > begin and held + size > max_bytes:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += size
        yield batch.slice(begin)
