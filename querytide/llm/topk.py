"""Exact top-k inner products: a KD-tree per shard, searched best box first.

Vectors become whole numbers floor(64 * x). A shard's tree splits at medians of its widest dimension down
to leaves of LEAF vectors and keeps the tight box of each leaf. The bound of a box for a query is the
greatest product any vector in the box could have: for each dimension the better of its two sides. Leaves are
visited from the best bound down and left out once the bound is below the k-th score so far. One shard is
searched first; its k-th scores are handed to all others, which start from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.stage import staged

SCALE = 64
LEAF = 256
SHARD_ROWS = 20_000
QUERY_BLOCK = 4096
EXACT = float(2**53)


def whole_numbers(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and integer components; vectors that are null or hold null or non-finite components go.

    Rows with equal id count once, with the least of their vectors.
    """
    x = F.col(vector_column)
    good = x.isNotNull() & F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    kept = vectors.where(good & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), ints.alias("v"))
    return kept.groupBy("vec_id").agg(F.min("v").alias("v"))


class Tree:
    """Leaves of a KD-tree over the rows of `x`, in arrays."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int):
        order, todo, cuts = np.arange(len(ids)), [(0, len(ids))], []
        while todo:
            a, b = todo.pop()
            part = x[order[a:b]]
            if b - a <= leaf:
                cuts.append((a, b))
                continue
            spread = part.max(0) - part.min(0)
            half = (b - a) // 2
            split = np.argpartition(part[:, int(spread.argmax())], half)
            order[a:b] = order[a:b][split]
            todo += [(a, a + half), (a + half, b)]
        self.leaves = []
        for a, b in cuts:
            rows = order[a:b][np.argsort(ids[order[a:b]])]
            self.leaves.append((ids[rows], x[rows]))
        self.low = np.array([v.min(0) for _, v in self.leaves])
        self.high = np.array([v.max(0) for _, v in self.leaves])


def _dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products: by floats where none can reach 2**53, else by whole numbers of any size."""
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if reach < EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    products = q.astype(object) @ x.astype(object).T
    return np.clip(products, -(2**63), 2**63 - 1).astype(np.int64)


def _at_most(score) -> float:
    """A float that is not above the whole number."""
    out = float(score)
    return out if abs(out) < EXACT else np.nextafter(out, -np.inf)


def search(tree: Tree, query_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple]:
    """(query id, vec ids, scores) of the best k per query among vectors whose score reaches `bound`."""
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    best = up @ tree.high.T.astype(np.float64) + down @ tree.low.T.astype(np.float64)
    best += np.abs(best) * 1e-12 + 0.5  # sums are rounded where numbers are large; a bound may only be too high
    visits = np.argsort(-best, axis=1, kind="stable")
    top_s = [np.zeros(0, np.int64)] * len(q)
    top_i = [np.zeros(0, np.int64)] * len(q)
    kth = bound.astype(np.float64)
    going = np.arange(len(q))
    for turn in range(len(tree.leaves)):
        leaf = visits[going, turn]
        going = going[best[going, leaf] >= kth[going]]
        if not len(going):
            break
        leaf = visits[going, turn]
        by = np.argsort(leaf, kind="stable")
        for group in np.split(going[by], np.flatnonzero(np.diff(leaf[by])) + 1):
            ids, x = tree.leaves[visits[group[0], turn]]
            scores = _dot(q[group], x)
            for row, i in zip(scores, group):
                fit = (row >= kth[i]) & (ids != query_ids[i])
                if not fit.any():
                    continue
                s, v = np.concatenate((top_s[i], row[fit])), np.concatenate((top_i[i], ids[fit]))
                keep = np.lexsort((v, -s))[:k]
                top_s[i], top_i[i] = s[keep], v[keep]
                if len(keep) == k:
                    kth[i] = max(kth[i], _at_most(s[keep[-1]]))
    for i in range(len(q)):
        if len(top_s[i]):
            yield int(query_ids[i]), top_i[i], top_s[i]


def top_k(vectors: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for each query row.

    `is_query` is a condition on vec_id. Ties go to the smaller vec_id; a query with fewer than k others
    returns them all; scores beyond 64 bits stay at the limit; vectors of another length than the query's take no part for it; an empty table
    gives no rows. Queries run in blocks of QUERY_BLOCK against every shard; a block is small, so it
    goes to all tasks. The number of shards follows the number of rows.
    """
    spark = vectors.sparkSession
    slim = staged(whole_numbers(vectors, id_column, vector_column).withColumn("dims", F.size("v")))
    rows = slim.count()
    shards = max(2, -(-rows // SHARD_ROWS))
    sharded = staged(slim.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")), partition_by=["shard"])
    asked = slim.where(is_query).select("vec_id", "v", "dims")
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)))
    schema = "query_id bigint, vec_id bigint, score bigint"

    def searched(block: list, bounds: dict[int, int], part: DataFrame) -> DataFrame:
        send = spark.sparkContext.broadcast(
            (np.array([r.vec_id for r in block], np.int64), [np.array(r.v, np.int64) for r in block], bounds)
        )

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, vs, low = send.value
            out = []
            lengths = np.array([len(v) for v in vs])
            for dims, same in pdf.groupby("dims"):
                pick = np.flatnonzero(lengths == dims)
                if not len(pick):
                    continue
                tree = Tree(same["vec_id"].to_numpy(np.int64), np.array(same["v"].tolist(), np.int64).reshape(len(same), dims), LEAF)
                start = np.array([_at_most(low[i]) if i in low else -np.inf for i in ids[pick].tolist()], np.float64)
                q = np.array([vs[j] for j in pick], np.int64).reshape(len(pick), dims)
                for query, v, s in search(tree, ids[pick], q, start, k):
                    out.append(pd.DataFrame({"query_id": query, "vec_id": v, "score": s.astype(np.int64)}))
            return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})

        return part.groupBy("shard").applyInPandas(run, schema)

    found = None
    for b in range(n_blocks):
        block = asked.where(F.col("block") == b).collect()  # at most about QUERY_BLOCK rows
        first = staged(searched(block, {}, sharded.where("shard = 0")))
        full = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        bounds = {r.query_id: r.least for r in full.collect()}
        part = first.unionByName(searched(block, bounds, sharded.where("shard > 0")))
        found = part if found is None else found.unionByName(part)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
