"""N-gram Jaccard join as a join in a metric space.

Texts are sets of word shingles; 1 - Jaccard is a metric. Texts that share no shingle of their rarest
(1 - similarity) part cannot be within the radius (prefix rule), so a region is seeded by such a shared shingle; in
plain words, unrelated texts are at distance 1 from every pivot, and no pivot could part them. Then:

* equal sets are one point from the start;
* the pivot of a region is its most central point (the one whose shingles the others share most), and each point
  goes to the best pivot of its regions (Voronoi assignment). Points within the radius of it are linked
  to it, so they need no comparison with each other;
* by the triangle inequality a text linked to a point within the radius of the pivot is within twice the radius of the
  pivot. Points of the same regions in that window are copied to the pivot's region and compared there, in
  blocks, with the points whose distance differs by at most the radius;
* what no pivot covered goes round again with smaller regions; a region of at most `leaf` points is compared pair
  by pair, after a count of the rare shingles that a pair shares.

Every pair of points that share a region is thus compared, linked through a pivot, or ruled out by the window.
Groups of any size come down to one comparison per point with its pivot. That is enough for the classes; for the number of
links of every row (`linked_classes`) the points around a pivot are compared with each other as well, in the same blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.stage import staged
from . import texthash
from .adjacent import neighbours
from .components import components

SHINGLE = 5
LEAF = 64  # points of a region that is compared pair by pair; four times as many in each further round
TILE = 256  # points on each side of a block of comparisons
BUCKETS = 1 << 17  # of the rarity table
FILTER_BITS = 1 << 26


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each of n rows."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    rows, hashes = rows[new], hashes[new]
    cuts = np.searchsorted(rows, np.arange(1, n))
    return np.split(hashes, cuts)


def _sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The sets of the rows of a chunk at a time, with the place of its first row."""
    for c in texthash.chunks(column):
        yield c.first, list(_distinct(*texthash.shingles(texthash.words(c, ~texthash.SPACES), SHINGLE), len(c.bounds) - 1))


def _point(x: np.ndarray) -> int:
    """A 64-bit name of a set, the same for equal sets."""
    with np.errstate(over="ignore"):
        return int(texthash.mix(np.array([x.sum() * texthash.U(3) + texthash.mix(x ^ texthash.U(0x5BD1E995)).sum() + texthash.U(len(x))]))[0].view(np.int64))


def documents(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Staged (doc_id, n, point) of all rows, and how often shingles fall in each bucket of the rarity table."""
    slim = docs.select("doc_id", "text")
    kind = slim.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        names = ["doc_id", "n", "point", "bucket", "times"]
        doc_type = pa.null()
        for batch in batches:
            doc_type = batch.column(0).type
            for first, sets in _sets(batch.column(1)):
                every = np.concatenate(sets)
                seen += np.bincount((every % texthash.U(BUCKETS)).astype(np.int64), minlength=BUCKETS)
                none = pa.nulls(len(sets), pa.int64())
                points = pa.array([_point(x) if len(x) else None for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array([len(x) for x in sets], pa.int64()), points, none, none], names=names)
        if seen.any():
            at = np.flatnonzero(seen)
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), doc_type), none, none, pa.array(at), pa.array(seen[at])], names=names)

    both = staged(slim.mapInArrow(run, f"doc_id {kind}, n long, point long, bucket long, times long"))
    table = np.zeros(BUCKETS, np.int64)
    got = both.where("bucket is not null").groupBy("bucket").agg(F.sum("times").alias("times")).toArrow()  # at most BUCKETS rows
    table[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return both.where("bucket is null").select("doc_id", "n", "point"), table


def _rare_parts(docs: DataFrame, table: np.ndarray, percent: int) -> DataFrame:
    """gram (shingle), seg (point), n for the rarest n - ceil(percent * n / 100) + 1 shingles of every row."""
    send = docs.sparkSession.sparkContext.broadcast(table)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets(batch.column(0)):
                grams, points, sizes, parts = [np.zeros(0, np.int64)], [], [], []
                for x in sets:
                    n = len(x)
                    if n:
                        keep = n - -(-percent * n // 100) + 1
                        order = np.lexsort((x, send.value[(x % texthash.U(BUCKETS)).astype(np.int64)]))[:keep]
                        grams.append(x[order].view(np.int64))
                        points.append(_point(x))
                        sizes.append(n)
                        parts.append(keep)
                each = lambda values, kind: pa.array(np.repeat(np.array(values, kind), np.array(parts, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(grams)), each(points, np.int64), each(sizes, np.int32), each(parts, np.int32)], names=["gram", "seg", "n", "part_size"]
                )

    return docs.select("text").mapInArrow(run, "gram long, seg long, n int, part_size int")


def _spread(h: np.ndarray) -> np.ndarray:
    return (texthash.mix(h.view(np.uint64)) % texthash.U(FILTER_BITS)).astype(np.int64)


def _members(docs: DataFrame, wanted: DataFrame, spark) -> DataFrame:
    """Staged (point, n, items, copies) of the wanted points (columns doc_id of one row each, point, copies).

    A filter of FILTER_BITS bits over the ids goes to all tasks; it lets all wanted rows pass and some others, which
    the join drops.
    """
    ids = wanted.select(F.xxhash64("doc_id").alias("h"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_spread(batch.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 3).astype(np.int32)), pa.array((1 << (at & 7)).astype(np.int32))], names=["byte", "v"])

    set_bits = ids.mapInArrow(bits, "byte int, v int").groupBy("byte").agg(F.bit_or("v").cast("int").alias("v")).toArrow()  # at most FILTER_BITS / 8 rows
    small = np.zeros(FILTER_BITS // 8, np.uint8)
    small[set_bits.column(0).to_numpy()] = set_bits.column(1).to_numpy()
    send = spark.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _spread(batch.column(0).to_numpy())
            batch = batch.filter(pa.array((send.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for _, sets in _sets(batch.column(1)):
                items = [x.view(np.int64) for x in sets if len(x)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_point(x) for x in sets if len(x)], pa.int64()), pa.array([len(x) for x in items], pa.int32()), pa.array(items, pa.list_(pa.int64()))],
                    names=["point", "n", "items"],
                )

    found = docs.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(run, "point long, n int, items array<long>")
    found = found.join(wanted.select("point"), "point", "left_semi").dropDuplicates(["point"])
    return staged(found.join(wanted.select("point", "copies"), "point"))


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with both sizes and the size of their intersection."""
    left = sets.select(F.col("point").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    right = sets.select(F.col("point").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ia", "ib")).alias("shared"))


def _reaches(percent: int, na="na", nb="nb", shared="shared"):
    return 100 * F.col(shared) >= percent * (F.col(na) + F.col(nb) - F.col(shared))


def _tiles(core: DataFrame, other: DataFrame | None, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (u, v, n) from the points of `core` (pivot, point, far) and of `other` (also `counts`) of the same pivot.

    Both sides are cut into tiles of about TILE points; each tile meets each of the other side in a
    group of its own; without `other` the core meets itself. n = 0: a link, one for each point of `other` and tile, for
    the core is linked already. n > 0: u has links to n rows of the tile on the other side; only rows of `other` with
    `counts` enter here. Numbers instead of pairs keep the rows of a large group few.
    """
    own_pairs = other is None
    if other is None:
        other = core.withColumn("counts", F.lit(True))
    sizes = core.groupBy("pivot").agg(F.count(F.lit(1)).alias("cores")).join(other.groupBy("pivot").agg(F.count(F.lit(1)).alias("rings")), "pivot")
    tiles = sizes.select("pivot", F.ceil(F.col("cores") / TILE).cast("int").alias("ct"), F.ceil(F.col("rings") / TILE).cast("int").alias("rt"))

    def placed(points: DataFrame, own: str, other: str, is_core: bool) -> DataFrame:
        t = points.join(tiles, "pivot").withColumn("_own", F.pmod(F.xxhash64("point"), F.col(own)).cast("int"))
        t = t.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        ct, rt = ("_own", "_other") if is_core else ("_other", "_own")
        if own_pairs:
            t = t.where(F.col(ct) <= F.col(rt))
        return t.select("pivot", "point", "far", "counts", F.col(ct).alias("ct"), F.col(rt).alias("rt"), F.lit(is_core).alias("is_core"))

    both = placed(core.withColumn("counts", F.lit(True)), "ct", "rt", True).unionByName(placed(other, "rt", "ct", False))
    rows = both.join(sets.select("point", "items", "copies"), "point")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        c, r = pdf[pdf.is_core], pdf[~pdf.is_core]
        if not len(c) or not len(r):
            return pd.DataFrame({name: pd.Series(dtype="int64") for name in "uvn"})
        flat = np.concatenate([*c["items"], *r["items"]])
        sizes = np.array([len(x) for x in (*c["items"], *r["items"])])
        words, at = np.unique(flat, return_inverse=True)
        row = np.repeat(np.arange(len(sizes)), sizes)
        shared = np.zeros((len(c), len(r)), np.float32)
        for b in range(0, len(words), 8192):
            part = (at >= b) & (at < b + 8192)
            m = np.zeros((len(sizes), min(8192, len(words) - b)), np.float32)
            m[row[part], at[part] - b] = 1
            shared += m[: len(c)] @ m[len(c) :].T
        union = sizes[: len(c), None] + sizes[None, len(c) :] - shared
        window = np.abs(c["far"].to_numpy()[:, None] - r["far"].to_numpy()[None, :]) <= 1 - percent / 100 + 1e-9
        links = (100 * shared >= percent * union) & window
        u, v = c["point"].to_numpy(), r["point"].to_numpy()
        out = []
        if own_pairs:
            if c["ct"].iloc[0] == c["rt"].iloc[0]:  # a tile with itself: every pair once
                links &= u[:, None] < v[None, :]
        else:
            hit = np.flatnonzero(links.any(0))
            out.append((v[hit], u[links.argmax(0)[hit]], np.zeros(len(hit), np.int64)))
            links &= r["counts"].to_numpy(bool)[None, :]
        for points, n in ((u, links @ r["copies"].to_numpy()), (v, c["copies"].to_numpy() @ links)):
            hit = np.flatnonzero(n)
            out.append((points[hit], points[hit], n[hit]))
        return pd.DataFrame({name: np.concatenate(x).astype(np.int64) for name, x in zip("uvn", zip(*out))})

    return rows.groupBy("pivot", "ct", "rt").applyInPandas(compare, "u long, v long, n long")


def _leaf_pairs(regions: DataFrame, leaf: int, percent: int) -> DataFrame:
    """Pairs (a, b) of points that share regions of at most `leaf` points and can be similar.

    The shingles that two similar sets share outside the rare part of one of them are fewer than percent / 100 of
    its size, so the rest of their overlap lies in the rare parts. There it is the number of regions they share:
    counted in the small ones, and at most `wide`, the large ones of either point.
    """
    wide = regions.where(F.col("size") > leaf).groupBy("seg").agg(F.count(F.lit(1)).alias("wide"))
    small = regions.where(F.col("size") <= leaf).join(wide, "seg", "left").select("gram", "seg", "n", F.coalesce("wide", F.lit(0)).alias("wide"))
    left, right = (small.select("gram", *[F.col(c).alias(f"{c}_{side}") for c in ("seg", "n", "wide")]) for side in "ab")
    na, nb = F.col("n_a"), F.col("n_b")
    fits = (F.col("seg_a") < F.col("seg_b")) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))
    met = left.join(right, "gram").where(fits).groupBy("seg_a", "seg_b", "n_a", "n_b", "wide_a", "wide_b").agg(F.count(F.lit(1)).alias("common"))
    rest = F.ceil(percent * F.greatest(na, nb) / 100) - 1
    enough = F.ceil(percent * (na + nb) / (100 + percent))
    return met.where(F.col("common") + F.least("wide_a", "wide_b") + rest >= enough).select(F.col("seg_a").alias("a"), F.col("seg_b").alias("b"))


def links(docs: DataFrame, named: DataFrame, table: np.ndarray, percent: int, count: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Links (u, v) between points, enough to connect all points that a chain of similar pairs connects.

    With `count` also (point, others): rows of other points that a point is similar to, every pair counted once. A
    point that leaves is in the core of one pivot, its home. A pair is counted in the tiles of the home that
    came first (of two in one round, the lesser), if the other point is in its core or ring; a pair of a small
    region is counted on its own unless tiles count it.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = neighbours(_rare_parts(docs, table, percent), ["gram", "seg"], parts).where("near")
    regions = staged(shared.select("gram", "seg", "n", "part_size").distinct())
    sizes = regions.groupBy("gram").agg(F.count(F.lit(1)).alias("size"))
    weights = regions.join(sizes, "gram").groupBy("seg").agg((F.sum(F.log2("size")) / F.min("part_size")).alias("central"))
    regions = staged(regions.select("gram", "seg", "n").join(weights, "seg"))

    def sized(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        return staged(rows.join(counts, "gram"))

    leaf = LEAF
    current = sized(regions)
    pairs = staged(_leaf_pairs(current, leaf, percent))
    # only points that still can be similar to another need their whole sets
    asked = pairs.select(F.explode(F.array("a", "b")).alias("point")).unionByName(current.where(F.col("size") > leaf).select(F.col("seg").alias("point")))
    wanted = staged(named.groupBy("point").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).join(asked.distinct(), "point", "left_semi"))
    sets = _members(docs, wanted, spark)
    found, apart, reached, homes, counted = [], [], [], [], []

    def settle(pairs: DataFrame) -> None:
        apart.append(staged(_measured(pairs, sets).where(_reaches(percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))))
        found.append(apart[-1])

    while True:
        settle(pairs)
        large = current.where(F.col("size") > leaf)
        if large.isEmpty():
            break
        best = F.max(F.struct("central", "seg"))
        pivots = large.groupBy("gram").agg(best.alias("p"))
        choice = large.join(pivots, "gram").groupBy(F.col("seg").alias("a")).agg(F.max("p").alias("p")).select("a", F.col("p.seg").alias("b"))
        choice = staged(choice)
        near = staged(_measured(choice.where("a <> b"), sets))
        far = (1 - F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("far")
        own = near.where(_reaches(percent))
        found.append(own.select(F.col("a").alias("u"), F.col("b").alias("v")))
        chosen = choice.select(F.col("b").alias("point")).distinct()
        # a pivot that chose another pivot is in its own core only
        core = own.join(chosen.withColumnRenamed("point", "a"), "a", "left_anti").select(F.col("b").alias("pivot"), F.col("a").alias("point"), far)
        core = staged(core.unionByName(chosen.select(F.col("point").alias("pivot"), "point", F.lit(0.0).alias("far"))))
        # all that share a region with a core point, but are no core points of its pivot
        seen = large.join(core.withColumnRenamed("point", "seg"), "seg").select("gram", "pivot").distinct()
        around = large.select("gram", F.col("seg").alias("a"), "n").join(seen, "gram").select("a", F.col("pivot").alias("b")).where("a <> b").distinct()
        in_core = core.select(F.col("point").alias("a"), F.col("pivot").alias("b"))
        around = around.join(in_core, ["a", "b"], "left_anti")
        around = around.join(near.select("a", "b"), ["a", "b"], "left_anti")
        window = max(0, 2 * percent - 100)
        ring = _measured(around, sets).unionByName(near.join(in_core, ["a", "b"], "left_anti").select(*near.columns)).where(_reaches(window))
        ring = ring.select(F.col("b").alias("pivot"), F.col("a").alias("point"), far, _reaches(percent).alias("linked"))
        home = core.select("point", F.col("pivot").alias("home"))
        ring = staged(ring.join(home, "point", "left").withColumn("counts", F.coalesce(F.col("home") > F.col("pivot"), F.lit(True))).drop("home"))
        found.append(ring.where("linked").select(F.col("point").alias("u"), F.col("pivot").alias("v")))
        met = staged(_tiles(core, ring.drop("linked"), sets, percent))
        found.append(met.where("n = 0").select("u", "v"))
        if count:
            counted += [met.where("n > 0").select(F.col("u").alias("point"), "n"), staged(_tiles(core, None, sets, percent).select(F.col("u").alias("point"), "n"))]
            homes.append(home)
            reached.append(core.select("pivot", "point").unionByName(ring.where("counts").select("pivot", "point")))
        done = core.select(F.col("point").alias("seg")).distinct()
        current = sized(large.select("gram", "seg", "n", "central").join(done, "seg", "left_anti"))
        leaf *= 4
        pairs = staged(_leaf_pairs(current, leaf, percent))
    union = lambda tables: functools.reduce(DataFrame.unionByName, tables)
    if not count:
        return union(found), None
    pairs = staged(union(apart).distinct())
    if homes:
        home, reach = union(homes), union(reached)
        in_tiles = [
            pairs.join(home.withColumnRenamed("point", x), x).join(reach.select(F.col("pivot").alias("home"), F.col("point").alias(y)), ["home", y]).select("u", "v")
            for x, y in ("uv", "vu")
        ]
        pairs = pairs.join(union(in_tiles), ["u", "v"], "left_anti")
    copies = sets.select(F.col("point").alias("v"), F.col("copies").alias("n"))
    ways = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    counted.append(ways.join(copies, "v").select(F.col("u").alias("point"), "n"))
    return union(found), union(counted).groupBy("point").agg(F.sum("n").alias("others"))


def classes(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    A-Z are lower-cased, words are runs of other characters than ASCII white space, a set holds the distinct
    shingles of SHINGLE words (a shorter text is one shingle). Two rows link when their sets have Jaccard similarity of percent / 100 at
    least; component_id is the least doc_id that links reach. Rows without words (null, empty) link with
    nothing and keep their own id; repeated rows and equal texts link; an empty table gives no rows;
    further columns are ignored.
    """
    return _classes(docs, percent, False)


def linked_classes(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row (see `classes`).

    n_links is the number of other rows that link with the row itself, not only through others: equal texts and
    repeated rows count, each of them once; rows without words have none.
    """
    return _classes(docs, percent, True)


def _classes(docs: DataFrame, percent: int, count: bool) -> DataFrame:
    named, table = documents(docs)
    full = named.where("point is not null")
    connecting, others = links(docs, full, table, percent, count)
    roots = components(connecting)
    low = full.groupBy("point").agg(F.min("doc_id").alias("low"), (F.count(F.lit(1)) - 1).alias("n_links"))
    if others is not None:
        low = low.join(others, "point", "left").select("point", "low", (F.col("n_links") + F.coalesce("others", F.lit(0))).alias("n_links"))
    placed = low.join(roots.withColumnRenamed("node", "point"), "point", "left").select("point", "low", "n_links", F.coalesce("root", "point").alias("root"))
    placed = staged(placed)
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    by_point = placed.join(least, "root").select("point", "component_id", "n_links")
    out = named.join(by_point, "point", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return out if count else out.drop("n_links")
