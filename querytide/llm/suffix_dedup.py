"""Suffix-array dedup: bytes that lie in a repeated string of `length` bytes.

A full suffix array has a row for every byte. Here only sampled suffixes are sorted: every window of `length`
bytes names one place in it, the start of its GRAM bytes with the least hash (leftmost of equals), so
equal windows name the same place. About one suffix in 69 is left. Each row stands for the run of windows
that name it and carries the suffix's leading bytes and fingerprints of its first GRAM bytes and of the
whole stretch that its windows cover.

1. The rows are partitioned by sampled splitters over (leading bytes, fingerprints) and sorted in
   their partition; every row is compared with its neighbours, and the first and last rows of partitions
   with those of the next. Rows with an equal stretch next to them are repeated as a whole.
2. Where only the first GRAM bytes agree with a neighbour of another stretch, the windows of the two are looked
   at one by one: they are sorted by fingerprint and compared with neighbours in the same way. A stretch that occurs
   many times sends at most its first and last occurrence into this round.

A group of any size is cut by the splitters, because the order ends in document and place. Fingerprints
are 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.stage import staged
from . import texthash
from .adjacent import neighbours

GRAM = 64
LEAD = 3  # leading bytes in the sort key, before 40 bits of fingerprint


def _key(data: np.ndarray, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Sort keys of suffixes: they order like the leading bytes, then by fingerprint."""
    out = np.zeros(len(at), np.uint64)
    for j in range(LEAD):
        out = (out << texthash.U(8)) | data[at + j].astype(np.uint64)
    out = out << texthash.U(40) | prints >> texthash.U(24)
    return (out ^ texthash.U(1 << 63)).view(np.int64)


def _sampled(c: texthash.Chunk, length: int):
    """(row, place, first window, last window, rolling hash) of the named suffixes of a chunk."""
    roll = texthash.Rolling(texthash.VALUES[c.data])
    total, width = len(c.data), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if total < length:
        return none, none, none, none, roll
    place = np.arange(total - GRAM + 1)
    keys = (roll.hash(place, place + GRAM) >> texthash.U(32) << texthash.U(32)) | place.astype(np.uint64)
    n = total - length + 1  # windows of the chunk
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    named = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & texthash.U(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(c.bounds) - 1), np.diff(c.bounds))[:n]
    whole = np.arange(n) + length <= c.bounds[row + 1]
    windows = np.flatnonzero(whole)
    if not len(windows):
        return none, none, none, none, roll
    named = named[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (named[1:] != named[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    l, r = windows[first], windows[np.append(first[1:], len(windows)) - 1]
    return row[l], named[first], l, r, roll


def _suffixes(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            for c in texthash.chunks(batch.column(1)):
                row, at, l, r, roll = _sampled(c, length)
                base = c.bounds[row]
                place = (l - base) * 256 + (r - l)  # a run has fewer than 256 windows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_key(c.data, at, roll.hash(at, at + GRAM))), pa.array(roll.hash(l, r + length).view(np.int64)),
                        pa.array(doc[c.first + row]), pa.array(place),
                    ],
                    names=["gram", "seg", "doc", "run"],
                )

    return docs.select("_doc", "text").mapInArrow(run, "gram long, seg long, doc long, run long")


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of stretches as maximal runs; touching ones are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    return starts[new], ends[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]


def _digest(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
    """Removed bytes, runs and the digest of what is left."""
    sha, at = hashlib.sha256(), 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        sha.update(data[at:s].tobytes())
        at = e
    sha.update(data[at:].tobytes())
    return int((ends - starts).sum()), len(starts), sha.hexdigest()


def _open_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Fingerprint, document and place of every window of the open runs (columns doc, text, open)."""
    for batch in batches:
        doc = batch.column("doc").to_numpy()
        for c in texthash.chunks(batch.column("text")):
            roll = texthash.Rolling(texthash.VALUES[c.data])
            n = len(c.bounds) - 1
            lists = batch.column("open").slice(c.first, n)
            run = lists.flatten().to_numpy()
            row = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
            count = (run & 255) + 1
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            l = np.repeat(run >> 8, count) + step  # noqa: E741
            row = np.repeat(row, count)
            at = l + c.bounds[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(roll.hash(at, at + length).view(np.int64)), pa.array(doc[c.first + row]), pa.array(l.astype(np.int32))], names=["gram", "doc", "l"]
            )


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeated(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A byte goes if a string of `length` bytes over it also starts anywhere else in any row. Null and empty texts
    have no bytes; repeated rows repeat each other wholly; shorter texts than `length` stay whole; an empty
    table gives no rows; further columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text").withColumn("_doc", F.xxhash64("doc_id", "text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = neighbours(_suffixes(keyed, length), ["gram", "seg", "doc", "run"], parts)
    per_doc = near.groupBy("doc").agg(F.collect_list(F.struct("run", "same", "near")).alias("runs"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in ("doc_id", "doc", "text", "starts", "ends", "open", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
            lists = batch.column("runs")
            for c in texthash.chunks(batch.column("text")):
                for i in range(len(c.bounds) - 1):
                    b, e = int(c.bounds[i]), int(c.bounds[i + 1])
                    runs = lists.slice(c.first + i, 1).flatten()
                    get = lambda n: runs.field(n).to_numpy(zero_copy_only=False)
                    none = np.zeros(0, np.int64)
                    run, same, open_ = (get("run"), get("same").astype(bool), get("near").astype(bool)) if len(runs) else (none, none.astype(bool), none.astype(bool))
                    l, r = run >> 8, (run >> 8) + (run & 255)
                    starts, ends = _merged(l[same], r[same] + length)
                    out["doc_id"].append(c.first + i)
                    out["doc"].append(c.first + i)
                    out["n_bytes"].append(e - b)
                    if open_.any():
                        found = (starts.astype(np.int32), ends.astype(np.int32), run[open_])
                        out["text"].append(c.first + i)
                        removed = (None, None, None)
                    else:
                        found, removed = (None,) * 3, _digest(c.data[b:e], starts, ends)
                        out["text"].append(None)
                    for n, x in zip(("starts", "ends", "open"), found):
                        out[n].append(x)
                    for n, x in zip(("n_removed", "n_spans", "kept_sha256"), removed):
                        out[n].append(x)
            pick = lambda n, source: batch.column(source).take(pa.array(out[n], pa.int64()))
            i32 = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pick("doc_id", "doc_id"), pick("doc", "_doc"), pick("text", "text"), pa.array(out["starts"], i32), pa.array(out["ends"], i32),
                    pa.array(out["open"], pa.list_(pa.int64())), pa.array(out["n_bytes"], pa.int64()),
                    pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string()),
                ],
                names=list(out),
            )

    joined = keyed.join(per_doc, F.col("_doc") == F.col("doc"), "left").select("doc_id", "_doc", "text", "runs")
    looked = staged(joined.mapInArrow(
        second, f"doc_id {kind}, doc long, text string, starts array<int>, ends array<int>, open array<long>, {RESULT}"
    ))
    waiting = looked.where("open is not null").select("doc", "text", "open")
    windows = waiting.mapInArrow(lambda batches: _open_windows(batches, length), "gram long, doc long, l int")
    again = neighbours(windows, ["gram", "doc", "l"], parts).where("same").groupBy("doc").agg(F.collect_set("l").alias("more"))
    pending = looked.where("open is not null").select("doc_id", "doc", "text", "starts", "ends").join(again, "doc", "left")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c in texthash.chunks(batch.column("text")):
                for i in range(len(c.bounds) - 1):
                    get = lambda n: batch.column(n).slice(c.first + i, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    more = get("more")
                    starts, ends = _merged(np.concatenate((get("starts"), more)), np.concatenate((get("ends"), more + length)))
                    rows.append((int(c.bounds[i + 1] - c.bounds[i]), *_digest(c.data[c.bounds[i] : c.bounds[i + 1]], starts, ends)))
            cols = [pa.array([r[j] for r in rows], pa.string() if j == 3 else pa.int64()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    settled = looked.where("open is null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return settled.unionByName(pending.mapInArrow(last, f"doc_id {kind}, {RESULT}"))
