"""Numbering of rows without moving them to one task.

A ``row_number`` over all rows would.  Instead the rows are sorted in ranges, stored, numbered inside each partition and
shifted by the sizes of the partitions before it; only these sizes, one number for each partition, come to the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.storage import shared_dir

#: ``monotonically_increasing_id`` has the partition above and the row in the lower bits.
ROW_BITS = 33


def with_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a bigint column that counts the rows from 0 in the given order (as they come if there is none).

    Equal keys are numbered in any order, but once and for all: the numbered rows are stored.
    """
    shared_dir(df.sparkSession)
    rows = (df.orderBy(*order) if order else df).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftrightunsigned("__at", ROW_BITS)
    sizes = {r[0]: r[1] for r in rows.groupBy(part.alias("p")).count().collect()}
    # one number for every partition, empty ones too: the place in the array is the partition's number
    before = list(accumulate((sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1)), initial=0))
    moved = F.expr(f"array({', '.join(f'{n}L' for n in before)})")[part.cast("int")]
    return rows.withColumn(name, moved + F.col("__at").bitwiseAND((1 << ROW_BITS) - 1)).drop("__at")
