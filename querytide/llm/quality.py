"""Quality: attention-based multiple-instance learning over the passages of a text.

A document is a bag of passages of PASSAGE words. Each passage is encoded by FEATURES numbers about
its characters, words and repeats; a hidden layer, a gated attention (tanh times sigmoid) and a weighted
sum over the passages give the document's score. Labels belong to documents, so attention learns which passages
decide. Trained in numpy on a bounded sample of labelled rows, scored where the rows lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import texthash
from .toxicity import THRESHOLD, fold, labelled_sample

PASSAGE = 64
KINDS = 12


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, 11)  # controls
    kind[0x21:0x7F] = 10  # other signs
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-", b"!?", b"|", b"#$%&*@^~", b"\n", b" \t\r\v\f")):
        kind[list(chars)] = k
    kind[0x80:] = 9
    return kind


BYTE_KIND = _byte_kinds()
FEATURES = KINDS + 6


def passages(c: texthash.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(row, features) of the passages of a chunk; a row without words has none."""
    w = texthash.words(c, ~texthash.SPACES)
    total = len(w.starts)
    if not total:
        return np.zeros(0, np.int64), np.zeros((0, FEATURES))
    first = np.concatenate(([0], np.cumsum(w.counts)))
    place = np.arange(total) - first[w.row]
    begin = np.flatnonzero(place % PASSAGE == 0)
    row = w.row[begin]
    n = np.diff(np.append(begin, total)).astype(float)
    start = w.starts[begin]
    stop = np.append(start[1:], len(c.data))
    stop = np.minimum(stop, c.bounds[row + 1])
    kinds = BYTE_KIND[c.data]
    x = np.zeros((len(begin), FEATURES))
    size = np.maximum(stop - start, 1).astype(float)
    for k in range(KINDS):
        upto = np.concatenate(([0], np.cumsum(kinds == k)))
        x[:, k] = (upto[stop] - upto[start]) / size
    group = np.repeat(np.arange(len(begin)), n.astype(int))
    order = np.lexsort((w.hashes, group))
    new = np.ones(total, bool)
    new[1:] = (w.hashes[order][1:] != w.hashes[order][:-1]) | (group[order][1:] != group[order][:-1])
    x[:, KINDS] = np.bincount(group[order], new, len(begin)) / n  # different words
    same = np.zeros(total)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.row[1:] == w.row[:-1])
    x[:, KINDS + 1] = np.bincount(group, same, len(begin)) / n  # the word before again
    x[:, KINDS + 2] = np.bincount(group, w.ends - w.starts, len(begin)) / n / 10
    last = BYTE_KIND[c.data[w.ends - 1]]
    x[:, KINDS + 3] = np.bincount(group, (last == 4) | (last == 6) | (last == 5), len(begin)) / n  # words ending in loud signs
    x[:, KINDS + 4] = np.minimum(n, PASSAGE) / PASSAGE
    lone = (w.ends - w.starts == 1) & ((last == 5) | (last == 10) | (last == 6))
    x[:, KINDS + 5] = np.bincount(group, lone, len(begin)) / n  # signs standing alone
    return row, x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    base: float  # margin of a bag without passages

    def forward(self, row: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, dict]:
        """Margins of n bags; `row` is sorted."""
        p = self.p
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["e"] + p["eb"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        a = np.exp(np.clip((t * g) @ p["a"], -30, 30))
        weight = a / np.bincount(row, a, n)[row] if len(row) else a
        bag = np.stack([np.bincount(row, weight * h[:, j], n) for j in range(h.shape[1])], 1)
        filled = np.bincount(row, minlength=n) > 0
        margin = np.where(filled, bag @ p["c"] + p["cb"][0], self.base)
        return margin, {"z": z, "h": h, "t": t, "g": g, "weight": weight, "bag": bag, "filled": filled}

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        for c in texthash.chunks(column):
            row, x = passages(c)
            out.append(_sigmoid(self.forward(row, x, len(c.bounds) - 1)[0]))
        return np.concatenate(out) if out else np.zeros(0)


def fit(row: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int = 12, gate: int = 8, rounds: int = 300, seed: int = 5) -> Model:
    """Adam on the log loss over all bags. Without labels of both kinds the model is a constant."""
    n, hits = len(y), float(y.sum())
    base = float(np.log((hits + 1) / (n - hits + 1)))
    rng = np.random.default_rng(seed)
    p = {
        "e": rng.normal(0, 0.4, (FEATURES, hidden)), "eb": np.zeros(hidden), "v": rng.normal(0, 0.4, (hidden, gate)),
        "u": rng.normal(0, 0.4, (hidden, gate)), "a": rng.normal(0, 0.4, gate), "c": np.zeros(hidden), "cb": np.array([base]),
    }
    if not len(row) or hits in (0.0, float(n)):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), p, base)
    model = Model(x.mean(0), np.maximum(x.std(0), 1e-3), p, base)
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for t in range(1, rounds + 1):
        margin, f = model.forward(row, x, n)
        error = np.where(f["filled"], (_sigmoid(margin) - y) / n, 0)
        h, weight = f["h"], f["weight"]
        to_bag = error[row][:, None] * p["c"]
        along = (to_bag * h).sum(1)
        to_a = weight * (along - np.bincount(row, weight * along, n)[row])
        to_tg = to_a[:, None] * p["a"]
        to_t, to_g = to_tg * f["g"] * (1 - f["t"] ** 2), to_tg * f["t"] * f["g"] * (1 - f["g"])
        to_h = (weight[:, None] * to_bag + to_t @ p["v"].T + to_g @ p["u"].T) * (1 - h**2)
        g = {
            "e": f["z"].T @ to_h, "eb": to_h.sum(0), "v": h.T @ to_t, "u": h.T @ to_g,
            "a": ((f["t"] * f["g"]) * to_a[:, None]).sum(0), "c": f["bag"].T @ error, "cb": np.array([error.sum()]),
        }
        for k in p:
            grad = g[k] + 1e-5 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            s[k] = 0.99 * s[k] + 0.01 * grad**2
            p[k] -= 0.03 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = 6000) -> Model:
    """Fit on labels.quality of documents outside the fold; nothing but the text enters."""
    rows = labelled_sample(docs, labels, "quality", held_out, sample)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for c in texthash.chunks(batch.column(1)):
                row, x = passages(c)
                cuts = np.searchsorted(row, np.arange(1, len(c.bounds) - 1))
                got += [part.astype(np.float32).ravel() for part in np.split(x, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.list_(pa.float32()))], names=["doc_id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.select("doc_id", "text", "y").mapInArrow(encode, f"doc_id {kind}, y double, x array<float>").orderBy("doc_id").toArrow()
    lists = got.column("x").combine_chunks()
    y = got.column("y").to_numpy()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False) // FEATURES if len(lists) else np.zeros(0, int)
    x = lists.flatten().to_numpy().astype(float).reshape(-1, FEATURES)
    return fit(np.repeat(np.arange(len(y)), lengths), x, y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of the whole text (null: empty)."""
    send = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(send.value.scores(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(run, T.StructType([slim.schema[0], T.StructField("score", T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Labels of fold crc32(doc_id) mod 5 = 0 are never used. Texts without words (null, empty) score the share
    of label 1 in the sample; repeated rows score alike; without labels of both kinds all scores are
    one constant; an empty table gives no rows; further columns are ignored.
    """
    held_out = fold("doc_id", 5, 0)
    scored = score(docs, train(docs, labels, held_out, sample))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
