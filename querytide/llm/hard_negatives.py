"""Hard-negative mining: exact scores by a residue number system, then a window of scores.

A score is the inner product of whole-number vectors. Both matrices are reduced modulo several small primes to
residues around zero; products of residue matrices run in float32 BLAS over stretches of DEPTH components, where no sum can reach
2**24, so they are exact. The Chinese remainder theorem (mixed-radix digits) puts the signed scores together
again. How many primes are needed follows from the largest numbers of a block.

Rows meet anchors in groups of (slot of rows, block of anchors): both sides are spread by hashes, a group has a bounded size
whatever the labels are, and each group hands on only the best rows of every anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.stage import staged
from . import vectors as V

SLOT_ROWS = 8192
BLOCK_ANCHORS = 2048
AT_ONCE = 128  # anchors scored together in a task
DEPTH = 64
LARGEST_PRIME = 1021  # DEPTH * ((LARGEST_PRIME - 1) / 2) ** 2 < 2 ** 24
GROUPS = 20_000  # tasks at most; they hold several groups beyond
TOP = 2**63 - 1


def primes(bound: int) -> list[int]:
    """Primes from LARGEST_PRIME down whose product exceeds `bound`."""
    out, product, p = [], 1, LARGEST_PRIME
    while product <= bound:
        if all(p % k for k in range(2, int(p**0.5) + 1)):
            out.append(p)
            product *= p
        p -= 2
        if p < 3:
            raise ValueError("vectors are too large and too long for the primes below 1024")
    return out


def _residues(x: np.ndarray, p: int) -> np.ndarray:
    half = (p - 1) // 2
    low = x % p
    return np.where(low > half, low - p, low).astype(np.float32)


def _product_modulo(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """(a @ b.T) % p as int32, in stretches of DEPTH components."""
    out = np.zeros((len(a), len(b)), np.int32)
    for k in range(0, a.shape[1], DEPTH):
        out += (_residues(a[:, k : k + DEPTH], p) @ _residues(b[:, k : k + DEPTH], p).T).astype(np.int32) % np.int32(p)
        if k:
            out %= np.int32(p)
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, exact; beyond 64 bits the numbers stay at the limit."""
    reach = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (a, b)]
    ps = primes(2 * max(1, a.shape[1]) * reach[0] * reach[1] + 1)
    digits: list[np.ndarray] = []
    for p in ps:
        rest = _product_modulo(a, b, p)
        # value of the digits so far, modulo p, by Horner's rule; all numbers stay below 2**21
        known = np.zeros_like(rest)
        for digit, q in zip(reversed(digits), reversed(ps[: len(digits)])):
            known = (known * np.int32(q) + digit) % np.int32(p)
        product = 1
        for q in ps[: len(digits)]:
            product = product * q % p
        digits.append((rest - known) % np.int32(p) * np.int32(pow(product, -1, p)) % np.int32(p))
    whole = 1
    for p in ps:
        whole *= p
    kind = np.int64 if whole < TOP else object
    out = np.zeros((len(a), len(b)), kind)
    for digit, p in zip(reversed(digits), reversed(ps)):
        out = out * p + digit.astype(kind)
    out = np.where(out > whole // 2, out - whole, out)
    return out if kind is np.int64 else np.clip(out, -TOP - 1, TOP).astype(np.int64)


def best(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest of `s`, ties to the first, in that order."""
    at = np.arange(len(s))
    if len(s) > k:
        kth = np.partition(s, len(s) - k)[len(s) - k]
        above = np.flatnonzero(s > kth)
        at = np.concatenate([above, np.flatnonzero(s == kth)[: k - len(above)]])
    return at[np.lexsort((at, ~s[at]))]  # ~s falls as s rises and cannot overflow


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole number n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


def _scored(rows: pa.Table, anchors: pa.Table):
    """(anchor as a dict without its vector, score of every row, ids, labels) per anchor; rows are in the order of their ids."""
    lists = {d: (t.drop_columns(["v"]).to_pylist(), m) for d, t, m in V.by_length(anchors, "v")} if anchors.num_rows else {}
    if not rows.num_rows or not lists:
        return
    for d, table, x in V.by_length(rows, "v"):
        if d not in lists:
            continue
        ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        order = np.argsort(ids)
        ids, labels, x = ids[order], labels[order], x[order]
        about, q = lists[d]
        for i in range(0, len(q), AT_ONCE):
            block = scores(q[i : i + AT_ONCE], x)
            for j, row in enumerate(block):
                yield about[i + j], row, ids, labels


def _met(rows: DataFrame, anchors: DataFrame, n_slots: int, n_blocks: int, work, schema: str) -> DataFrame:
    """`work` on every group of a slot of rows and a block of anchors."""
    keys = ["slot", "block"]
    tasks = min(n_slots * n_blocks, GROUPS)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("slot", V.slot("vec_id", n_slots)).withColumn("block", numbers(n_blocks)).repartition(tasks, *keys)
    right = anchors.withColumn("block", V.slot("vec_id", n_blocks, 1)).withColumn("slot", numbers(n_slots)).repartition(tasks, *keys)

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(work(rows, anchors)), schema=out)

    kinds = {"long": pa.int64(), "int": pa.int32()}
    out = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def ranked(rows: DataFrame, keys: list[str], score: str, other: str, n: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc(score), other)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the inner product with the anchor, higher is better, ties go to the
    smaller id. An anchor's positives are its best `positives` other rows of the same `label` (a whole number); for each positive
    the best `negatives` rows of another label are returned whose score lies from `low` to `high` percent of the
    positive's (none, if that is below zero). `is_anchor` is a condition on vec_id. Rows whose id, label or vector is null, or whose vector
    holds null or non-finite components, take no part. Rows with equal id count once, with the least vector (of
    these the least label). Vectors of another length than the anchor's take no part for it; empty vectors score 0. Fewer rows
    than asked for are all returned; an empty table gives no rows; further columns are ignored.
    """
    x = F.col(vector_column)
    whole = vectors.where(V.finite(x) & F.col(id_column).isNotNull() & label.isNotNull()).select(
        F.col(id_column).cast("long").alias("vec_id"), F.struct(V.scaled(x, scale).alias("v"), label.cast("long").alias("label")).alias("row"))
    rows = staged(whole.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.v"))
    anchors = staged(rows.where(is_anchor))
    n_slots, n_blocks = V.slots(rows, SLOT_ROWS), V.slots(anchors, BLOCK_ANCHORS)

    def same_label(rows: pa.Table, anchors: pa.Table):
        for a, s, ids, labels in _scored(rows, anchors):
            at = np.flatnonzero((labels == a["label"]) & (ids != a["vec_id"]))
            for i in at[best(s[at], positives)]:
                yield {"anchor_id": a["vec_id"], "positive_id": int(ids[i]), "positive_score": int(s[i])}

    found = _met(rows, anchors, n_slots, n_blocks, same_label, "anchor_id long, positive_id long, positive_score long")
    chosen = ranked(found, ["anchor_id"], "positive_score", "positive_id", positives)
    told = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # `positives` rows an anchor
    anchors = staged(anchors.join(told, "vec_id"))

    def in_window(rows: pa.Table, anchors: pa.Table):
        for a, s, ids, labels in _scored(rows, anchors):
            other = np.flatnonzero(labels != a["label"])
            own = s[other]
            for p in a["positives"]:
                least, most = window(p["positive_score"], low, high)
                at = other[(own >= least) & (own <= most)]
                for i in at[best(s[at], negatives)]:
                    yield {"anchor_id": a["vec_id"], **p, "negative_id": int(ids[i]), "negative_score": int(s[i])}

    found = _met(rows, anchors, n_slots, n_blocks, in_window, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    out = ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
