"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its words and the first 4, 5 and 6 bytes of longer words, hashed to TERMS numbers; a term counts
once a text. The score is sigmoid(bias + sum of weights + sum over pairs of terms of the product of
their factors), so an insult next to a group's name can weigh more than both alone. The model is trained
in numpy on a bounded sample of labelled rows (`sample` rows with the least hashes of their id) and
scored over all rows where they lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stage import staged
from . import texthash

TERMS = 1 << 20
PREFIXES = (4, 5, 6)
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False  # after lower-casing: 0-9, a-z, non-ASCII
THRESHOLD = 0.3
ROUNDS = 25
BATCH = 1000
RATE = 0.05
EPS = 1e-4
L2_FACTORS = 1e-4
CHANCE = 8.0  # weights shrink by as many standard deviations of their gradient as chance alone gives; picked by three folds inside the training rows


def term_rows(c: texthash.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every word and prefix of a chunk, repeats included."""
    w = texthash.words(c, WORD_BYTES)
    rows, terms = [w.row], [w.hashes]
    for length in PREFIXES:
        long = np.flatnonzero(w.ends - w.starts > length)
        starts = w.starts[long]
        rows.append(w.row[long])
        terms.append(w.roll.hash(starts, starts + length) ^ texthash.U(length))
    return np.concatenate(rows), (np.concatenate(terms) % texthash.U(TERMS)).astype(np.int64)


@dataclass
class Model:
    bias: float
    terms: np.ndarray  # sorted term numbers that have a weight
    weights: np.ndarray
    factors: np.ndarray  # a row of factors for each term

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        place = np.full(TERMS, -1, np.int32)
        place[self.terms] = np.arange(len(self.terms))
        for c in texthash.chunks(column):
            n = len(c.bounds) - 1
            row, term = term_rows(c)
            at = place[term]
            known = at >= 0
            size = max(1, len(self.terms))
            pairs = np.unique(row[known] * size + at[known])
            row, at = pairs // size, pairs % size
            margin = np.full(n, self.bias)
            margin += np.bincount(row, self.weights[at], n)
            for f in range(self.factors.shape[1]):
                v = self.factors[at, f]
                margin += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
            out.append(1 / (1 + np.exp(-np.clip(margin, -60, 60))))
        return np.concatenate(out) if out else np.zeros(0)


def fit(row: np.ndarray, term: np.ndarray, y: np.ndarray, factors: int = 8, rounds: int = ROUNDS, seed: int = 5) -> Model:
    """`fit_lists` for pairs: `row` (rising), `term` are the distinct terms of each of the rows of `y`."""
    return fit_lists(np.searchsorted(row, np.arange(len(y) + 1)), term, y, factors, rounds, seed)


def fit_lists(
    offsets: np.ndarray, term: np.ndarray, y: np.ndarray, factors: int = 8, rounds: int = ROUNDS, seed: int = 5, rate: float = RATE, l2: float = L2_FACTORS, chance: float = CHANCE
) -> Model:
    """Adam on the log loss in batches of BATCH rows; row i of `y` has the distinct terms term[offsets[i]:offsets[i + 1]].

    Every term of 4 rows at least gets a weight and factors, whatever it says by itself: a term that is neutral alone
    may count next to another. Weights shrink towards zero together with the fit (`chance`), factors by their square (`l2`). Without rows of both labels the model is a constant.
    The terms are held once, in 32 bits; a batch takes its rows' terms times factors in single precision.
    """
    n, hits = len(y), float(y.sum())
    bias = float(np.log((hits + 0.05) / (n - hits + 1.0)))
    if not n or hits in (0.0, float(n)):
        return Model(bias, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)))
    terms = np.flatnonzero(np.bincount(term, minlength=TERMS) >= 4)
    place = np.full(TERMS, -1, np.int32)
    place[terms] = np.arange(len(terms), dtype=np.int32)
    at = place[term]
    known = at >= 0
    bounds = np.concatenate(([0], np.cumsum(known, dtype=np.int32)))[offsets]
    at = at[known]
    del known, place
    size, width = len(terms), factors + 1
    share = hits / n
    shrink = (chance * np.sqrt(np.bincount(at, minlength=size) * share * (1 - share)) / n).astype(np.float32)
    rng = np.random.default_rng(seed)
    p = np.zeros((size, width), np.float32)  # weight, factors
    p[:, 1:] = rng.normal(0, 0.01, (size, factors))
    m, s, step, work = (np.zeros_like(p) for _ in range(4))
    b, mb, sb, t = bias, 0.0, 0.0, 0
    for _ in range(rounds):
        shuffled = rng.permutation(n)
        for part in np.array_split(shuffled, -(-n // BATCH)):
            t += 1
            counts = bounds[part + 1] - bounds[part]
            ends = np.cumsum(counts)
            flat = at[np.arange(ends[-1]) + np.repeat(bounds[part] - (ends - counts), counts)]
            here = np.repeat(np.arange(len(part), dtype=np.int32), counts)
            own = p[flat]
            some = np.flatnonzero(counts)
            sums = np.zeros((len(part), width), np.float32)
            squares = np.zeros(len(part), np.float32)
            if len(some):
                starts = (ends - counts)[some]
                sums[some] = np.add.reduceat(own, starts, axis=0)
                squares[some] = np.add.reduceat(np.einsum("ij,ij->i", own[:, 1:], own[:, 1:]), starts)
            margin = b + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares)
            error = ((1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -60, 60))) - y[part]) / len(part)).astype(np.float32)
            sums[:, 0] = 1.0
            own[:, 0] = 0.0
            np.subtract(sums[here], own, out=own)
            own *= error[here][:, None]
            for k in range(width):
                step[:, k] = np.bincount(flat, own[:, k], size)
            del own, here, flat
            np.multiply(p[:, 1:], l2, out=work[:, 1:])
            step[:, 1:] += work[:, 1:]
            m += np.multiply(np.subtract(step, m, out=work), 0.1, out=work)
            np.multiply(step, step, out=step)
            s += np.multiply(np.subtract(step, s, out=work), 0.01, out=work)
            np.sqrt(np.divide(s, 1 - 0.99**t, out=work), out=work)
            work += EPS
            np.divide(rate, work, out=work)
            np.multiply(m, 1 / (1 - 0.9**t), out=step)
            step *= work
            p -= step
            least = work[:, 0] * shrink
            p[:, 0] -= np.clip(p[:, 0], -least, least)
            gb = float(error.sum())
            mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
            b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.99**t)) + EPS)
    return Model(b, terms, p[:, 0].astype(np.float64), p[:, 1:])


def fold(id_column: str, of: int, which: int) -> Column:
    """True for rows whose crc32(id as text) mod `of` is `which`; false for null ids."""
    number = F.crc32(F.col(id_column).cast("string").cast("binary")) % of
    return F.coalesce(number == which, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, sample: int) -> DataFrame:
    """doc_id, text, y (0 or 1) of at most `sample` labelled documents outside the held-out fold."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def train(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = 16000) -> Model:
    """Fit on labels.toxic of documents outside the fold; nothing but the text enters."""
    rows = labelled_sample(docs, labels, "toxic", held_out, sample)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for c in texthash.chunks(batch.column(1)):
                row, term = term_rows(c)
                pairs = np.unique(row * TERMS + term)
                cuts = np.searchsorted(pairs // TERMS, np.arange(1, len(c.bounds) - 1))
                got += [x.astype(np.int32) for x in np.split(pairs % TERMS, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.list_(pa.int32()))], names=["doc_id", "y", "terms"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = staged(rows.select("doc_id", "text", "y").mapInArrow(terms, f"doc_id {kind}, y double, terms array<int>"))
    got = made.orderBy("doc_id").select("y", "terms").toArrow()  # at most `sample` rows
    lengths = pc.list_value_length(got.column("terms")).to_numpy().astype(np.int64) if got.num_rows else np.zeros(0, np.int64)
    parts = [c.flatten().to_numpy() for c in got.column("terms").chunks] or [np.zeros(0, np.int32)]
    y, flat = got.column("y").to_numpy(), parts[0] if len(parts) == 1 else np.concatenate(parts)
    del got, parts
    return fit_lists(np.concatenate(([0], np.cumsum(lengths))), flat, y)


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """The rows of `docs`, all columns kept, with the score of the whole text (null: empty)."""
    send = docs.sparkSession.sparkContext.broadcast(model)  # at most TERMS terms
    fields = [f for f in docs.schema if f.name != out]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = send.value.scores(batch.column(names.index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, out])

    from pyspark.sql import types as T

    return docs.select(*names).mapInArrow(run, T.StructType([*fields, T.StructField(out, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 16000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Labels of fold crc32(doc_id) mod 4 = 2 are never used. Null and empty texts score the bias, which is low
    unless most labels are 1; repeated rows score alike; without labels of both kinds all scores are one
    constant; an empty table gives no rows; further columns are ignored.
    """
    held_out = fold("doc_id", 4, 2)
    model = train(docs, labels, held_out, sample)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
