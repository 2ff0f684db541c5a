"""Numbers for the rows of a whole table in its order, without a window that holds them all."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_ordinal(rows: DataFrame, blocks: list[str], order: list[Column | str], name: str) -> DataFrame:
    """rows with a number from 0 by (blocks, order): rows are counted by block, and each block numbers its own from what is before
    it. A count for each block is all that the driver sees; blocks are file blocks or ranges of keys."""
    counts = sorted(tuple(r) for r in rows.groupBy(*blocks).count().collect())
    before = accumulate([0, *(c[-1] for c in counts)])
    kinds = ", ".join(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in blocks)
    begins = rows.sparkSession.createDataFrame([(*c[:-1], n) for c, n in zip(counts, before, strict=False)], f"{kinds}, _before long")
    place = F.row_number().over(Window.partitionBy(*blocks).orderBy(*order))
    return rows.join(F.broadcast(begins), blocks).withColumn(name, F.col("_before") + place - 1).drop("_before")
