"""Whole-number vectors of a table, and their Arrow columns as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


def finite(vector: Column) -> Column:
    """True where a vector is there and all its components are finite numbers."""
    inside = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vector.isNotNull() & F.coalesce(inside, F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as long; what is beyond 64 bits stays at the limit."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def slots(rows: DataFrame, per_slot: int) -> int:
    """How many slots of about `per_slot` rows a staged table makes."""
    return max(1, -(-rows.count() // per_slot))


def slot(column: str, n: int, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(n)).cast("int")


def _lists(column: pa.ChunkedArray | pa.Array) -> pa.ListArray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def by_length(table: pa.Table, name: str) -> Iterator[tuple[int, pa.Table, np.ndarray]]:
    """(length, rows, int64 matrix) for the rows of every length of the list column `name`, which has no nulls."""
    lengths = pc.list_value_length(table.column(name))
    for d in sorted(set(lengths.unique().to_pylist()) - {None}):
        rows = table.filter(pc.equal(lengths, d))
        yield d, rows, matrix(rows.column(name), d)


def matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    lists = _lists(column)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(lists), d)
