"""Equal neighbours in a distributed sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.stage import staged

LEFT_SAME, LEFT_NEAR, RIGHT_SAME, RIGHT_NEAR, FIRST, LAST = 1, 2, 4, 8, 16, 32


def neighbours(rows: DataFrame, order: list[str], parts: int) -> DataFrame:
    """The rows that agree with a neighbour in sorted order, with `same` and `near`.

    `gram` and `seg` are long columns at the front of `order`; without seg, equal grams are the same. near: a
    neighbour has the same gram and another seg; same: one has both. Rows are range-partitioned by sampled splitters over the whole order, so that a
    frequent gram is cut like any other; the first and last row of each partition (two rows a partition)
    are compared across the boundaries. Of a run of equal gram and seg only the outer rows can be near.
    """
    names = rows.columns
    second = "seg" if "seg" in names else "gram"
    extra = [("flags", pa.int32()), ("part", pa.int32()), ("place", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, flags = TaskContext.get().partitionId(), None, FIRST

        def out(table: pa.Table, f: np.ndarray, place: int) -> Iterator[pa.RecordBatch]:
            keep = np.flatnonzero(f)
            table = table.take(pa.array(keep))
            for (name, kind), values in zip(extra, (f[keep], np.full(len(keep), part), np.full(len(keep), place))):
                table = table.append_column(name, pa.array(values.astype(np.int32), kind))
            yield from table.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            gram, seg = (table.column(n).to_numpy() for n in ("gram", second))
            near = gram[1:] == gram[:-1]
            same = near & (seg[1:] == seg[:-1])
            f = np.zeros(len(gram), np.int32)
            f[0] = flags
            f[1:] |= np.where(same, LEFT_SAME, np.where(near, LEFT_NEAR, 0)).astype(np.int32)
            f[:-1] |= np.where(same, RIGHT_SAME, np.where(near, RIGHT_NEAR, 0)).astype(np.int32)
            yield from out(table.slice(0, len(gram) - 1), f[:-1], 0)
            held, flags = table.slice(len(gram) - 1).combine_chunks(), int(f[-1])
        if held is not None:
            yield from out(held, np.array([flags | LAST], np.int32), 1)

    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.IntegerType()) for n, _ in extra)])
    kept = staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema))
    bit = lambda b: F.col("flags").bitwiseAND(b) != 0
    yes = lambda c: F.coalesce(c, F.lit(False))
    w = W.orderBy("part", "place")  # at most two rows a partition
    edges = kept.where(bit(FIRST | LAST)).withColumns(
        {"_pg": F.lag("gram").over(w), "_ps": F.lag(second).over(w), "_ng": F.lead("gram").over(w), "_ns": F.lead(second).over(w)}
    )
    left = bit(FIRST) & (F.col("_pg") == F.col("gram"))
    right = bit(LAST) & (F.col("_ng") == F.col("gram"))
    edges = edges.select(
        *names,
        (bit(LEFT_SAME | RIGHT_SAME) | yes(left & (F.col("_ps") == F.col(second))) | yes(right & (F.col("_ns") == F.col(second)))).alias("same"),
        (bit(LEFT_NEAR | RIGHT_NEAR) | yes(left & (F.col("_ps") != F.col(second))) | yes(right & (F.col("_ns") != F.col(second)))).alias("near"),
    ).where("same or near")
    inner = kept.where(~bit(FIRST | LAST)).select(*names, bit(LEFT_SAME | RIGHT_SAME).alias("same"), bit(LEFT_NEAR | RIGHT_NEAR).alias("near"))
    return inner.unionByName(edges)
