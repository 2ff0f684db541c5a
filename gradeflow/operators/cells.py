"""Two tables that meet in cells: in each, a bounded side is held and the other one streams past it.

Rows of both sides are dealt to tasks by their cell and sorted by it, held rows first, so a task's memory is one cell's held rows
and a batch. A hot cell is salted: its streaming rows are dealt over ``SALTS`` places, and its held rows go to each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def meet(held: DataFrame, streamed: DataFrame, cell: str, by: Column, prepare: Callable[[list[tuple]], Any], answer: Callable[[Any, tuple], Iterator[tuple]], schema: str) -> DataFrame:
    """answer(prepare(held rows of the cell), row) for each streamed row of a cell that holds rows, with the cell as a last column.

    ``by`` spreads the streamed rows of a cell; ``prepare`` gets a cell's rows in any order, without the cell.
    """
    kinds = [(c, streamed.schema[c].dataType) for c in streamed.columns if c != cell]
    own = [c for c in held.columns if c != cell]
    nothing = [F.lit(None).cast(held.schema[c].dataType).alias(f"h_{c}") for c in own]
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    left = held.select(F.col(cell).alias("_cell"), salt, F.lit(0).alias("_side"), *(F.col(c).alias(f"h_{c}") for c in own), *(F.lit(None).cast(t).alias(f"s_{c}") for c, t in kinds))
    right = streamed.select(F.col(cell).alias("_cell"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int").alias("_salt"), F.lit(1).alias("_side"), *nothing, *(F.col(c).alias(f"s_{c}") for c, _ in kinds))
    sorted_rows = left.union(right).repartition("_cell", "_salt").sortWithinPartitions("_cell", "_salt", "_side")
    names = [x.split(" ")[0] for x in schema.split(", ")] + ["_cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, ready = None, [], None
        for batch in batches:
            columns, out = [c.to_pylist() for c in batch.columns], []
            for key, salted, side, *values in zip(*columns, strict=True):
                if (key, salted) != at:
                    at, rows, ready = (key, salted), [], None
                if side == 0:
                    rows.append(tuple(values[: len(own)]))
                elif rows or ready is not None:
                    if ready is None:
                        ready, rows = prepare(rows), []
                    out.extend((*x, key) for x in answer(ready, tuple(values[len(own) :])))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=shape)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    kind = StructType([*_parse_datatype_string(schema).fields, StructField("_cell", held.schema[cell].dataType)])
    shape = to_arrow_schema(kind)
    return sorted_rows.mapInArrow(run, kind).withColumnRenamed("_cell", cell)
