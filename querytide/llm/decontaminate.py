"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by documents: a block holds the postings of about BLOCK bytes of whole documents. One row per block
has the sorted terms (64-bit word hashes), where each term's postings start, and the postings
themselves: word positions, rising, with a gap after each document that no match can bridge. All
postings of a document are in one block, so a search needs no shuffle, and a word that is in every document has one short
list per block. Test items come as windows of words. In each block a window's terms are ordered by the
length of their lists, the rarest term's positions are the candidates, and every further list is
intersected at the offset it must have; with `slack` above 0 a term may stand that many words off
(proximity), the rarest one as well. Windows go to the tasks in groups of WINDOWS; the index is read once for each group.

Every row of the documents has a number of its own in the index, so rows that repeat an id, or have none, stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.stage import staged
from . import texthash
from .toxicity import WORD_BYTES

WINDOW = 10
BLOCK = 400_000
WINDOWS = 50_000
GAP = 64  # more than a window with its slack on both sides
PARTITION_ROWS = 33  # bits of a row number for the row inside its partition


def index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Posting blocks of all documents: rows, ids, word counts and first positions; terms, list starts, positions.

    Row numbers hold for one run over `docs`: write the index before it is read twice.
    """
    slim = docs.select(id_column, text_column)
    kind = slim.schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << PARTITION_ROWS
        for batch in batches:
            for c in texthash.chunks(batch.column(1), BLOCK):
                w = texthash.words(c, WORD_BYTES)
                n = len(c.bounds) - 1
                ends = np.cumsum(w.counts)
                begin = ends - w.counts + np.arange(n) * GAP
                position = np.arange(len(w.hashes)) + w.row * GAP
                order = np.argsort(w.hashes, kind="stable")
                terms, starts = np.unique(w.hashes[order], return_index=True)
                ids = batch.column(0).slice(c.first, n)
                one = lambda x, kind: pa.array([x], pa.list_(kind))
                yield pa.RecordBatch.from_arrays(
                    [
                        one(np.arange(row, row + n), pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids), one(w.counts.astype(np.int32), pa.int32()),
                        one(begin, pa.int64()), one(terms.view(np.int64), pa.int64()), one(starts.astype(np.int32), pa.int32()),
                        one(position[order].astype(np.int32), pa.int32()),
                    ],
                    names=["rows", "ids", "counts", "begins", "terms", "starts", "positions"],
                )
                row += n

    schema = T.StructType([
        T.StructField("rows", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(kind)), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("begins", T.ArrayType(T.LongType())),
        T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
    ])
    return slim.mapInArrow(run, schema)


def windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """item_id and the word hashes of each run of `length` words of an item; a shorter item is one run."""
    slim = items.select("item_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for c in texthash.chunks(batch.column(1)):
                w = texthash.words(c, WORD_BYTES)
                ends = np.cumsum(w.counts)
                for i, (b, e) in enumerate(zip(ends - w.counts, ends)):
                    for at in range(b, max(b + 1, e - length + 1)) if e > b else ():
                        rows.append(c.first + i)
                        out.append(w.hashes[at : min(at + length, e)].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out, pa.list_(pa.int64()))], names=["item_id", "terms"])

    return slim.mapInArrow(run, T.StructType([slim.schema[0], T.StructField("terms", T.ArrayType(T.LongType()))]))


def search_block(terms, starts, positions, wanted: np.ndarray, lengths: np.ndarray, slack: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first position, greatest shift) of all matches in a block.

    `wanted` has a row of term hashes for each window, filled up to its length. The lists are joined in one
    array of (term number, position), so that all windows step through their terms together. Of matches of a window
    that begin at most `slack` words apart, those with a greater shift than another, or the same and a later begin, go.
    """
    none = np.zeros(0, np.int64)
    if not len(terms) or not len(wanted):
        return none, none, none
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    filled = np.arange(wanted.shape[1]) < lengths[:, None]
    there = ((terms[at] == wanted) | ~filled).all(1)
    window = np.flatnonzero(there)
    if not len(window):
        return none, none, none
    at, filled = at[window], filled[window]
    positions = positions.astype(np.int64)
    size = np.diff(np.append(starts, len(positions)))
    length_of = np.where(filled, size[at], np.iinfo(np.int64).max)
    order = np.argsort(length_of, axis=1, kind="stable")  # the rarest first
    reach = int(positions.max()) + 2 * GAP + 1
    flat = np.repeat(np.arange(len(terms)), size) * reach + positions
    rare = order[:, 0]
    first_term = at[np.arange(len(window)), rare]
    n = size[first_term]
    who = np.repeat(np.arange(len(window)), n)
    inner = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    begin = positions[starts[first_term][who] + inner] - rare[who]
    if slack:
        begin = (begin[:, None] + np.arange(-slack, slack + 1)).ravel()
        once = np.unique(np.repeat(who, 2 * slack + 1) * reach + begin + GAP)
        who, begin = once // reach, once % reach - GAP
    shift = np.zeros(len(who), np.int64)
    for step in range(wanted.shape[1]):
        col = order[who, step]
        used = filled[who, col]
        key = at[who, col] * reach + begin + col
        right = np.searchsorted(flat, key)
        near = np.abs(flat[np.minimum(right, len(flat) - 1)] - key)
        if slack:
            near = np.minimum(near, np.abs(flat[np.maximum(right - 1, 0)] - key))
        keep = ~used | (near <= slack)
        shift = np.maximum(shift, np.where(used, near, 0))[keep]
        who, begin = who[keep], begin[keep]
    if slack and len(who):
        key = who * reach + begin + GAP
        beaten = np.zeros(len(key), bool)
        for d in [*range(-slack, 0), *range(1, slack + 1)]:
            other = np.minimum(np.searchsorted(key, key + d), len(key) - 1)
            better = (shift[other] < shift) | ((shift[other] == shift) & (d < 0))
            beaten |= (key[other] == key + d) & better
        who, begin, shift = who[~beaten], begin[~beaten], shift[~beaten]
    return window[who], begin, shift


def matches(postings: DataFrame, items: DataFrame, slack: int = 0, length: int = WINDOW) -> DataFrame:
    """row, doc_id, item_id, first_word, n_words, shift: every place where a window of an item occurs.

    shift 0 is an exact phrase; up to `slack` every word of the window stands at most that far from its place, counted from
    first_word, and shift is the greatest of these distances. Of places at most `slack` apart the one with the least shift is
    given (the earlier of equal ones). first_word counts from 0 and may be down to -slack. A word may serve two places of a window.
    Items without words match nothing; repeated items count once.
    """
    if length < 1 or slack < 0 or length + 2 * slack > GAP:
        raise ValueError(f"windows with their slack on both sides have 1 to {GAP} words")
    spark = postings.sparkSession
    split = staged(windows(items, length).distinct().withColumn("part", F.xxhash64("item_id", "terms")))
    groups = max(1, -(-split.count() // WINDOWS))
    kind_doc, kind_item = postings.schema["ids"].dataType.elementType, items.schema["item_id"].dataType
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("doc_id", kind_doc), T.StructField("item_id", kind_item), T.StructField("first_word", T.LongType()),
        T.StructField("n_words", T.IntegerType()), T.StructField("shift", T.IntegerType()),
    ])
    found = None
    for g in range(groups):
        rows = split.where(F.pmod("part", F.lit(groups)) == g).toArrow()  # about WINDOWS rows
        ids = rows.column("item_id").combine_chunks()
        lists = rows.column("terms").to_pylist()
        lengths = np.array([len(x) for x in lists], np.int64)
        wanted = np.zeros((len(lists), length), np.int64)
        for i, x in enumerate(lists):
            wanted[i, : len(x)] = x
        send = spark.sparkContext.broadcast((ids, wanted.view(np.uint64), lengths))

        def run(batches: Iterator[pa.RecordBatch], send=send) -> Iterator[pa.RecordBatch]:
            ids, wanted, lengths = send.value
            for batch in batches:
                for i in range(batch.num_rows):
                    get = lambda name: batch.column(name).slice(i, 1).flatten()
                    num = lambda name: get(name).to_numpy(zero_copy_only=False)
                    w, begin, shift = search_block(num("terms").view(np.uint64), num("starts"), num("positions"), wanted, lengths, slack)
                    begins = num("begins")
                    at = np.searchsorted(begins, begin + slack, "right") - 1  # the gap keeps a match inside one document
                    yield pa.RecordBatch.from_arrays(
                        [
                            get("rows").take(pa.array(at)), get("ids").take(pa.array(at)), ids.take(pa.array(w)), pa.array(begin - begins[at]),
                            pa.array(lengths[w].astype(np.int32)), pa.array(shift.astype(np.int32)),
                        ],
                        names=["row", "doc_id", "item_id", "first_word", "n_words", "shift"],
                    )

        part = postings.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def contamination(postings: DataFrame, exact: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of the documents, by exact matches."""
    each = F.explode(F.arrays_zip("rows", "ids", "counts")).alias("d")
    rows = postings.select(each).select(F.col("d.rows").alias("row"), F.col("d.ids").alias("doc_id"), F.col("d.counts").cast("long").alias("n_words"))
    hit = F.explode(F.sequence(F.col("first_word"), F.col("first_word") + F.col("n_words") - 1))
    places = exact.select("row", hit.alias("at")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    names = F.array_sort(F.collect_list(F.col("item_id").cast("string")))
    items = exact.select("row", "item_id").distinct().groupBy("row").agg(names.alias("names"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    listed = F.coalesce("names", F.array().cast("array<string>"))
    return rows.join(places.join(items, "row"), "row", "left").select(
        "doc_id", "n_words", zero("n_hit").alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (zero("n_hit") > 0).alias("contaminated"),
    )


def nearby(docs: DataFrame, items: DataFrame, slack: int = 1) -> DataFrame:
    """doc_id, item_id, n_places, n_exact, least_shift of every row of the documents and every item that has places in it.

    Places are those of `matches`, each begin in the text once; n_exact of them are exact phrases. Null and empty texts, items without
    words and empty tables give no rows; rows that repeat an id give rows of their own; further columns are ignored.
    """
    postings = staged(index(docs))
    best = matches(postings, items, slack).groupBy("row", "doc_id", "item_id", "first_word").agg(F.min("shift").alias("shift"))
    exact = F.sum(F.when(F.col("shift") == 0, 1).otherwise(0))
    found = best.groupBy("row", "doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_places"), exact.alias("n_exact"), F.min("shift").alias("least_shift"))
    return found.drop("row")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Contamination of every row of the documents by exact windows of ten words (see `contamination`).

    Rows that repeat an id or have none are judged by their own text. Null and empty texts have no words and no hits; items without words and repeated items change nothing; an
    empty benchmark leaves every document clean; empty documents give no rows; further columns are ignored.
    """
    postings = staged(index(docs))
    exact = staged(matches(postings, items))
    return contamination(postings, exact)
