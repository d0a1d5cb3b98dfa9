"""Vector code compression: product quantization in exact whole numbers by limb-split matrix products.

Vectors are cut into equal parts; each part has a codebook, and a vector's code names the nearest entry of every
part. Nearest means exactly nearest: components are whole numbers, which are split into limbs so short that a
product of two limb matrices in float64 BLAS stays below 2**53 and loses nothing. The products of the limbs are
shifted and added in int64, distances follow from them, and the first least one wins.

The codebook is refined in rounds. A round is one pass over the staged vectors: a task adds up the components of
the parts of each entry, Spark adds up the tasks, and a table of parts x entries x components, which does not grow with the rows,
comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.stage import staged
from . import vectors as V

MANTISSA = 53
TOP = 2**63 - 1


def limb_bits(d: int) -> int:
    """Bits of a limb such that d products of two limbs add up to at most 2**53."""
    return (MANTISSA - max(0, (d - 1).bit_length())) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float matrices l0, l1, ... with x = l0 + l1 * 2**bits + ...; only the last has a sign."""
    reach, out = _reach(x), []
    while reach >> bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x, reach = x >> bits, reach >> bits
    return [*out, x.astype(np.float64)]


def _reach(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T for int64 matrices, exact wherever the result lies within 64 bits."""
    bits = limb_bits(a.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            if bits * (i + j) < 64:
                out += (x @ y.T).astype(np.int64) << np.int64(bits * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, squared distance) of the nearest row of `book` to every row of x; ties to the first.

    int64 if no distance can leave it, else Python's whole numbers.
    """
    if x.shape[1] * (_reach(x) + _reach(book)) ** 2 <= TOP:
        apart = (book * book).sum(1)[None, :] - 2 * products(x, book)
        place = apart.argmin(1)
        return place, apart[np.arange(len(x)), place] + (x * x).sum(1)
    exact, rows = book.astype(object), []
    for row in x.astype(object):
        far = ((exact - row) ** 2).sum(1).tolist()
        rows.append((far.index(min(far)), min(far)))
    return np.array([p for p, _ in rows], np.int64), np.array([e for _, e in rows], object)


def _assigned(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, components, place, distance) for every part of the vectors of a batch; `books` is part x entry x component."""
    width = books.shape[2]
    x = V.matrix(batch.column("v"), len(books) * width)
    for part, book in enumerate(books):
        own = np.ascontiguousarray(x[:, part * width : (part + 1) * width])
        yield part, own, *nearest(own, book)


def _refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: componentwise floor of the mean of the parts of each entry; unused entries stay."""
    send = rows.sparkSession.sparkContext.broadcast(books)  # parts x entries x components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = send.value
        n = np.zeros(books.shape[:2], np.int64)
        high, low = np.zeros(books.shape, np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for part, x, place, _ in _assigned(batch, books):
                n[part] += np.bincount(place, minlength=n.shape[1])
                for k in range(books.shape[2]):  # halves of 32 bits: their sums fit into a double for 2**21 rows of a batch
                    for half, into in ((x[:, k] >> 32, high), (x[:, k] & 0xFFFFFFFF, low)):
                        into[part, :, k] += np.bincount(place, half.astype(np.float64), n.shape[1]).astype(np.int64)
        part, entry = np.nonzero(n)
        every = lambda a: pa.array(np.repeat(a, books.shape[2]))
        yield pa.RecordBatch.from_arrays(
            [every(part), every(entry), pa.array(np.tile(np.arange(books.shape[2]), len(part))), every(n[part, entry]), pa.array(high[part, entry].ravel()), pa.array(low[part, entry].ravel())],
            names=["part", "entry", "k", "n", "high", "low"],
        )

    sums = rows.select("v").mapInArrow(run, "part long, entry long, k long, n long, high long, low long")
    got = sums.groupBy("part", "entry", "k").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).collect()
    out = books.copy()
    for r in got:
        out[r.part, r.entry, r.k] = ((r.high << 32) + r.low) // r.n
    return out


def whole_vectors(vectors: DataFrame, parts: int, scale: int, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """Staged vec_id, label, v of the rows that can be coded: finite components, a length that `parts` divides."""
    x = F.col(vector_column)
    fits = V.finite(x) & (F.size(x) > 0) & (F.size(x) % parts == 0)
    return staged(vectors.where(fits).select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), V.scaled(x, scale).alias("v")))


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the vectors of the least ids, ascending; of rows with equal id the least vector."""
    ids = [r.vec_id for r in rows.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    found = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()  # at most `entries` rows
    if not found:
        return None
    same = np.array([r.v for r in found if len(r.v) == len(found[0].v)], np.int64)
    return same.reshape(len(same), parts, -1).transpose(1, 0, 2).copy()


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error of every coded row, staged; the codebooks as part x entry x component).

    Components become floor(scale * x). Rows whose vector is null, empty, holds null or non-finite components, or has a length
    that `parts` does not divide or other than that of the least id take no part. Codebooks start as the parts of the `entries` least ids
    (fewer, if there are fewer) and are refined `rounds` times; then every row is coded. `code` is two hex digits a part, so
    there are at most 256 entries; `error` is the squared distance to the named entries, summed over the parts, at most 2**63 - 1. Repeated rows are coded
    like any other and count in the means; rows without id are coded but start no entry; without any id there are no rows
    and no codebooks; columns with other names are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits names 1 to 256 entries")
    rows = whole_vectors(vectors, parts, scale, id_column, vector_column, label_column)
    books = first_books(rows, parts, entries)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    schema = f"{kinds}, code string, error long"
    if books is None:
        return rows.sparkSession.createDataFrame([], schema), None
    rows = rows.where(F.size("v") == parts * books.shape[2])
    for _ in range(rounds):
        books = _refined(rows, books)
    send = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros((batch.num_rows, parts), np.uint8), 0
            for part, _, place, far in _assigned(batch, send.value):
                code[:, part] = place
                error = far.astype(object) + error if far.dtype == object or far.max(initial=0) > TOP // parts else far + error
            if isinstance(error, np.ndarray) and error.dtype == object:
                error = np.array([min(e, TOP) for e in error], np.int64)
            text = code.tobytes().hex()
            codes = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return staged(rows.select("vec_id", "label", "v").mapInArrow(run, schema)), books


def label_errors(coded: DataFrame) -> DataFrame:
    """The rows of `coded` with label_error, the sum of `error` over the rows of equal label (nulls together).

    One label may hold most rows: sums are made before the shuffle, and the few sums come back by a join that
    the planner broadcasts or splits by what they measure.
    """
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(TOP).cast("decimal(38,0)")).cast("long")
    sums = staged(coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "_label"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["_label"])).drop("_label")
