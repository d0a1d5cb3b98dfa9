"""SimHash near-duplicates: fingerprints in a grid of bit counts.

A fingerprint of 64 bits becomes SEGMENTS counts, the bits set in each stretch of two. Flipping a bit moves one
count by one, so the Manhattan distance of two count vectors is at most the Hamming distance of the fingerprints: what lies apart in the
grid need not be compared. Pairs within the radius (4) are found by a range join on that grid:

* of the three thirds of the dimensions some two have a distance of at most 2 together, for all three have at most 4;
* in these two the points meet in the cell of a point that lies at most one step from each. So every point goes to
  its own cell and to those one step away, about 33 for each choice of two thirds, and pairs meet by equal cells.

Cells are counted first, with sums before the shuffle; a bitmap of those that hold two points or more tells the tasks what to send for
comparison. Cells of up to CELL points are compared in the task that holds them; the points of larger
ones are placed again by the two halves of the open third, where the same rule holds, and what is still large is compared in
tiles. Cells and tiles hand on a spanning forest and not their pairs. Every candidate is verified on the bits
themselves. Equal fingerprints are one point, whatever the number of their documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..functions.stage import staged
from . import texthash
from .components import components

SHINGLE = 4
SEED = 42
RADIUS = 4  # the argument above rests on it
PIECE = 250_000  # bytes of a text taken at a time
SEGMENTS = 32
CELL = 128
TILE = 1024
FILTER_BITS = 1 << 26

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Stretches of about PIECE bytes that end between words."""
    at = 0
    while at < len(raw):
        gap = SPACE.search(raw, at + PIECE)
        end = gap.start() if gap else len(raw)
        yield raw[at:end]
        at = end


def fingerprint(raw: bytes) -> int:
    """64 bits of a text as a signed number: each is set if it is set in over half the hashes of its shingles."""
    ones, n, held = np.zeros(64, np.int64), 0, []
    for piece in _pieces(raw):
        words = held + piece.translate(LOWER).split()  # bytes.split() cuts at \x20 and \x09-\x0D
        held = words
        if len(words) >= SHINGLE:
            text = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            spans = zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())
            bits, count = _bits([xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in spans])
            ones, n, held = ones + bits, n + count, words[1 - SHINGLE :]
    if not n and held:
        ones, n = _bits([xxhash.xxh64_intdigest(b" ".join(held), SEED)])
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _bits(hashes: list[int]) -> tuple[np.ndarray, int]:
    flat = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(flat, axis=1, bitorder="little").sum(0, dtype=np.int64), len(hashes)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, point (the fingerprint as a signed long) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            points = [fingerprint(t.as_py() or b"") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points, pa.int64())], names=["doc_id", "point"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, point long")


def counts(points: np.ndarray) -> np.ndarray:
    """The embedding: SEGMENTS bit counts of each fingerprint."""
    width = 64 // SEGMENTS
    shifts = (np.arange(SEGMENTS) * width).astype(np.uint64)
    return np.bitwise_count((points.view(np.uint64)[:, None] >> shifts) & np.uint64((1 << width) - 1)).astype(np.int64)


def cells(count: np.ndarray, dims: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for the own cell of every row in these dimensions and all cells one step away."""
    top = 64 // SEGMENTS
    own = count[:, dims]
    weights = (top + 1) ** np.arange(len(dims), dtype=np.int64)
    base = own @ weights
    rows, out = [np.arange(len(own))], [base]
    for k, w in enumerate(weights):
        for step, room in ((1, own[:, k] < top), (-1, own[:, k] > 0)):
            at = np.flatnonzero(room)
            rows.append(at)
            out.append(base[at] + step * w)
    return np.concatenate(rows), np.concatenate(out)


def _key(*numbers: np.ndarray | int) -> np.ndarray:
    """One 64-bit key of several numbers; a chance collision only adds candidates."""
    key = np.uint64(0)
    with np.errstate(over="ignore"):
        for x in numbers:
            key = texthash.mix(np.atleast_1d(np.asarray(x, np.int64)).view(np.uint64) + key * np.uint64(3))
    return key.view(np.int64)


THIRDS = [list(range(SEGMENTS * k // 3, SEGMENTS * (k + 1) // 3)) for k in range(3)]


def _spread(cell: np.ndarray) -> np.ndarray:
    return (texthash.mix(cell.view(np.uint64)) % texthash.U(FILTER_BITS)).astype(np.int64)


def bitmap(met: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, set for every cell of `met`; some others share a bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_spread(batch.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 3).astype(np.int32)), pa.array((1 << (at & 7)).astype(np.int32))], names=["byte", "v"])

    bits = met.select("cell").mapInArrow(run, "byte int, v int").groupBy("byte").agg(F.bit_or("v").cast("int").alias("v")).toArrow()  # at most FILTER_BITS / 8 rows
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    out[bits.column(0).to_numpy()] = bits.column(1).to_numpy()
    return out


def _placed(cell: np.ndarray, rest: int, points: np.ndarray, only) -> pa.RecordBatch:
    if only is not None:
        at = _spread(cell)
        hit = (only.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        cell, points = cell[hit], points[hit]
    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(cell), rest, np.int32)), pa.array(points)], names=["cell", "rest", "point"])


def in_grid(points: DataFrame, only=None) -> DataFrame:
    """cell, rest (the third that the cell says nothing about), point; only cells in the bitmap `only` (a broadcast), if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(0).to_numpy()
            count = counts(p)
            for rest in range(3):
                row, cell = cells(count, sum(THIRDS[:rest] + THIRDS[rest + 1 :], []))
                yield _placed(_key(cell, rest), rest, p[row], only)

    return points.select("point").mapInArrow(run, "cell long, rest int, point long")


def finer(placed: DataFrame, only=None) -> DataFrame:
    """The same points in the cells of both halves of the third that their cell left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, open_third, p = (batch.column(c).to_numpy() for c in ("cell", "rest", "point"))
            count = counts(p)
            for rest in range(3):
                at = np.flatnonzero(open_third == rest)
                middle = len(THIRDS[rest]) // 2
                for half, dims in enumerate((THIRDS[rest][:middle], THIRDS[rest][middle:])):
                    row, inner = cells(count[at], dims)
                    yield _placed(_key(cell[at[row]], inner, half), rest, p[at[row]], only)

    return placed.select("cell", "rest", "point").mapInArrow(run, "cell long, rest int, point long")


def close(a: str = "u", b: str = "v"):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; numpy would count those of the absolute value of a signed number."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(points: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what chains of close points connect: a breadth-first tree of each class."""
    left, out = np.unique(points), []
    while len(left):
        found, left = [left[0]], left[1:]
        for p in found:
            if not len(left):
                break
            near = apart(left, p) <= RADIUS
            out += [(int(p), int(q)) for q in left[near]]
            found.extend(left[near])
            left = left[~near]
    return out


FEW = 8  # points of a cell whose pairs are looked at all at once


def run_links(cell: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal cells: all of a run of at most FEW points, a forest of a longer one."""
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    sizes = np.diff(np.append(starts, len(cell)))
    size = np.repeat(sizes, sizes)
    u, v = [], []
    for k in range(1, FEW):
        at = np.flatnonzero((cell[k:] == cell[:-k]) & (size[k:] <= FEW))
        at = at[apart(point[at], point[at + k]) <= RADIUS]
        u.append(point[at])
        v.append(point[at + k])
    for a, n in zip(starts[sizes > FEW], sizes[sizes > FEW]):
        tree = np.array(forest(point[a : a + n]), np.int64).reshape(-1, 2)
        u.append(tree[:, 0])
        v.append(tree[:, 1])
    return np.concatenate(u), np.concatenate(v)


def _small_cells(placed: DataFrame) -> DataFrame:
    """Links (u, v) within cells of at most CELL points, which a task reads one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, point = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            cell = np.concatenate((cell, batch.column(0).to_numpy()))
            point = np.concatenate((point, batch.column(1).to_numpy()))
            if not len(cell):
                continue
            last = int(np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))[-1])  # the last cell may go on
            u, v = run_links(cell[:last], point[:last])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
            cell, point = cell[last:], point[last:]
        u, v = run_links(cell, point)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return placed.select("cell", "point").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u long, v long")


def _tiles(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links (u, v) within large cells, from tiles of about TILE points that meet two by two."""
    n = F.ceil(F.col("n") / TILE).cast("int")
    rows = placed.join(sizes.select("cell", n.alias("tiles")), "cell").withColumn("own", F.pmod(F.xxhash64("point"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("cell", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "point")

    def run(table: pa.Table) -> pa.Table:
        links = np.array(forest(table.column("point").to_numpy()), np.int64).reshape(-1, 2)
        return pa.table({"u": links[:, 0], "v": links[:, 1]})

    return rows.groupBy("cell", "i", "j").applyInArrow(run, "u long, v long")


def links(points: DataFrame) -> DataFrame:
    """Links (u, v) between distinct points, enough to connect all that chains of close points connect."""
    spark, out = points.sparkSession, []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source, place, last = points.select("point").repartition(parts), in_grid, False  # a short row here makes about a hundred
    while True:
        met = staged(place(source).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        placed = place(source, spark.sparkContext.broadcast(bitmap(met)))
        large = staged(met.where(f"n > {CELL}"))
        out.append(_small_cells(placed.join(large, "cell", "left_anti")))
        if large.isEmpty():
            break
        rest = staged(placed.join(large.select("cell"), "cell", "left_semi"))
        if last:
            out.append(_tiles(rest, large))
            break
        source, place, last = rest, finer, True
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    A-Z are lower-cased, words are runs of other characters than ASCII white space, shingles are SHINGLE words joined by single spaces,
    repeats included (a shorter text is one shingle). A bit is set if it is set in more than half the XXH64 hashes
    (seed 42). Rows link when their fingerprints differ in at most four bits; component_id is the least doc_id that links
    reach. Texts without words (null, empty) have fingerprint zero and link like any other; repeated rows, equal texts and rows
    without doc_id link as well (a component in which no row has an id has none either); long texts are read in pieces; an empty table gives no rows;
    further columns are ignored.
    """
    named = staged(fingerprints(docs))
    points = staged(named.groupBy("point").agg(F.min("doc_id").alias("low")))
    roots = components(links(points))
    placed = points.join(roots.withColumnRenamed("node", "point"), "point", "left").select("point", "low", F.coalesce("root", "point").alias("root"))
    placed = staged(placed)
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    by_point = placed.join(least, "root").select("point", "component_id")
    text = F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint")
    return named.join(by_point, "point").select("doc_id", text, "component_id")
