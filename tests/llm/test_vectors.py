"""Vector codes and hard negatives against brute force in Python's whole numbers."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from querytide.llm import hard_negatives, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int"


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale=256):
    return [math.floor(scale * x) for x in v]


def random_matrix(rng, n, d, bits):
    return rng.integers(-(2**bits), 2**bits, (n, d))


def test_products_of_limbs_are_exact():
    rng = np.random.default_rng(1)
    for bits, other, d in ((8, 8, 4), (24, 24, 4), (29, 29, 8), (30, 30, 4), (40, 22, 1), (26, 26, 700)):
        a, b = random_matrix(rng, 20, d, bits), random_matrix(rng, 15, d, other)
        want = a.astype(object) @ b.astype(object).T
        assert (vector_codes.products(a, b).astype(object) == want).all()
        assert d * 4 ** vector_codes.limb_bits(d) <= 2**53
    assert len(vector_codes.limbs(np.array([[2**40]]), 25)) == 2


def test_scores_by_residues_are_exact():
    rng = np.random.default_rng(2)
    for bits, d in ((8, 64), (20, 3), (25, 200), (28, 64), (31, 2), (8, 1)):
        a, b = random_matrix(rng, 9, d, bits), random_matrix(rng, 11, d, bits)
        want = np.clip(a.astype(object) @ b.astype(object).T, -(2**63), 2**63 - 1)
        assert (hard_negatives.scores(a, b).astype(object) == want).all()
    big = np.full((1, 8), 2**62)
    assert hard_negatives.scores(big, -big).tolist() == [[-(2**63)]]
    assert hard_negatives.scores(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).tolist() == [[0] * 3] * 2
    edge = np.full((1, 64), 510)  # the largest residues a stretch can meet
    assert hard_negatives.scores(edge, -edge).tolist() == [[-64 * 510 * 510]]


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, whole(v), y) for i, v, y in rows if good(v) and v and len(v) % parts == 0]
    firsts = {}
    for i, v, _ in kept:
        if i is not None:
            firsts[i] = min(firsts.get(i, v), v)
    ids = sorted(firsts)[:entries]
    d = len(firsts[ids[0]])
    kept = [r for r in kept if len(r[1]) == d]
    w = d // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    books = [[cut(firsts[i])[p] for i in ids if len(firsts[i]) == d] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    near = lambda x, book: min((far(x, y), e) for e, y in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, v, _ in kept:
                of.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(of[e]) for c in zip(*of[e])] if e in of else y for e, y in enumerate(books[p])]
    out = []
    for i, v, y in kept:
        best = [near(cut(v)[p], books[p]) for p in range(parts)]
        out.append((i, y, "".join(f"{e:02x}" for _, e in best), min(sum(f for f, _ in best), 2**63 - 1)))
    total = {}
    for _, y, _, e in out:
        total[y] = total.get(y, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    return sorted((repr((i, c, e, min(total[y], 2**63 - 1))) for i, y, c, e in out)), sha


def hard_vectors(seed, n=300, d=8, spread=1.0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=d) * spread], int(i % 4) if i % 11 else None) for i in range(n)]
    rows += [(n + i, [0.25] * d, 1) for i in range(150)]  # one frequent vector and label
    rows += [(2000, None, 1), (2001, [1.0, None] * (d // 2), 1), (2002, [float("nan")] * d, 1), (2003, [float("-inf")] * d, 1), (2004, [], 2), (2100, [1.0] * 3, 2),
             (2005, [2.0] * (2 * d), 2), (0, rows[0][1], 0), (5, rows[6][1], 3), (None, [0.5] * d, 2)]
    return rows


def test_codes_equal_brute_force(spark):
    for seed, spread, entries in ((1, 1.0, 64), (2, 0.01, 16), (3, 3e6, 64), (4, 1e15, 5)):
        rows = hard_vectors(seed, spread=spread)
        df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as v", "'x' as code", "2 as _label").repartition(5)
        coded, books = vector_codes.compress(df, parts=4, entries=entries, rounds=2)
        got = sorted(repr((r.vec_id, r.code, r.error, r.label_error)) for r in vector_codes.label_errors(coded).collect())
        want, sha = brute_codes(rows, 4, entries, 2)
        assert got == want
        assert vector_codes.digest(books) == sha


def test_codes_of_few_and_none(spark):
    few = spark.createDataFrame([(7, [1.0, 2.0], None), (9, [1.0, 3.0], None)], VECTORS)
    coded, books = vector_codes.compress(few, parts=2, entries=64)
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.label_errors(coded).collect()) == [(7, "0000", 0, 0), (9, "0001", 0, 0)]
    assert books.shape == (2, 2, 1)
    coded, books = vector_codes.compress(few.where("vec_id < 0"), parts=2)
    assert books is None and vector_codes.label_errors(coded).collect() == []


def brute_negatives(rows, positives=5, negatives=10):
    kept = {}
    for i, v, y in rows:
        if i is not None and y is not None and good(v):
            kept[i] = min(kept.get(i, (whole(v), y)), (whole(v), y))
    kept = {i: (v, (y + 1) % 10 if i % 7 == 0 else y) for i, (v, y) in kept.items()}
    out = []
    for a, (v, y) in kept.items():
        if a % 100:
            continue
        s = sorted((-sum(p * q for p, q in zip(v, w)), i, z) for i, (w, z) in kept.items() if i != a and len(w) == len(v))
        for ps, p, _ in [x for x in s if x[2] == y][:positives]:
            fit = [(n, i) for n, i, z in s if z != y and 30 * -ps <= 100 * -n <= 90 * -ps][:negatives]
            out += [(a, p, k, i, -ps, -n) for k, (n, i) in enumerate(fit, 1)]
    return sorted(out)


def changed_label():
    own = F.col("label").cast("long")
    return F.when(F.col("vec_id") % 7 == 0, (own + 1) % 10).otherwise(own)


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SLOT_ROWS", 100)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 2)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 2)
    for seed, spread in ((5, 1.0), (6, 1e5)):
        rows = hard_vectors(seed, n=500, spread=spread)
        df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as slot", "2 as block", "3 as v", "4 as rank")
        got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, changed_label()).collect()
        assert got and sorted(tuple(r) for r in got) == brute_negatives(rows)


def test_negatives_with_ties_and_zero_scores(spark):
    rows = [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (3, [0.5, 9.0], 2), (4, [0.95, 0.0], 2), (5, [0.0, 1.0], 1), (6, [0.0, 2.0], 3), (8, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, F.col("label")).collect())
    assert got == [(100, 1, 1, 2, 65536, 32768), (100, 1, 2, 3, 65536, 32768), (100, 5, 1, 6, 0, 0)]  # nothing fits a positive below zero
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0, F.col("label")).collect() == []
    assert hard_negatives.mine(df, F.col("vec_id") < 0, F.col("label")).collect() == []
