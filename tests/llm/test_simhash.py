"""SimHash classes against brute force over all pairs."""

import collections

import numpy as np
import xxhash
from pyspark.sql import functions as F

from querytide.llm import simhash

from .shared import SCHEMA, documents, hard_texts, plain_words, sentence


def plain_fingerprint(text):
    w = plain_words(text)
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, prints):
    """Classes by union of all pairs, with the least id of each."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, row in enumerate(rows):
        ids[find(i)].append(row[0])
    return collections.Counter((row[0], f"{p:016x}", min((d for d in ids[find(i)] if d is not None), default=None)) for i, (row, p) in enumerate(zip(rows, prints)))


def near_rows():
    out = []
    for k in range(40):
        words = sentence(k % 6, 120).split()
        for place in range(k % 4):
            words[17 * place + k] = f"x{k}"
        out.append((100 + k, " ".join(words), "en", "s", 0))
    return out


def test_classes_equal_brute_force(spark):
    rows = hard_texts() + near_rows() + [(None, None, None, None, 0), (None, "again no id", None, None, 0)]
    got = simhash.classes(documents(spark, rows, extra=["point", "cell", "fingerprint", "u", "v"])).collect()
    want = brute(rows, [plain_fingerprint(r[1]) for r in rows])
    assert collections.Counter(tuple(r) for r in got) == want
    assert len({r.component_id for r in got}) < len(rows) - 10


def test_equals_the_engines_own_hash(spark):
    texts = spark.createDataFrame([("one two three",), ("漢字 é",)], "text string").select("text", F.xxhash64("text").alias("h")).collect()
    for r in texts:
        assert simhash.fingerprint(r.text.encode()) == r.h


def test_long_texts_in_pieces(monkeypatch):
    text = sentence(9, 3000) + "  \n\t " + "y" * 500 + " \x0b end"
    whole = simhash.fingerprint(text.encode())
    assert whole & (2**64 - 1) == plain_fingerprint(text)
    for piece in (1, 7, 64, 1000):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text.encode()) == whole
        assert simhash.fingerprint(b" a  B \n") & (2**64 - 1) == plain_fingerprint("a b")


def test_counts_bound_the_distance():
    rng = np.random.default_rng(0)
    a = rng.integers(-(2**63), 2**63 - 1, 200)
    b = a ^ (np.int64(1) << rng.integers(0, 63, 200)) ^ (np.int64(1) << rng.integers(0, 63, 200))
    assert (np.abs(simhash.counts(a) - simhash.counts(b)).sum(1) <= simhash.apart(a, b)).all()
    assert simhash.apart(np.array([-1]), np.array([0])).tolist() == [64]


def ball(seed, n, flips, centres):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, centres).astype(np.uint64)
    out = base[rng.integers(0, centres, n)]
    for _ in range(flips):
        out = out ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(out).view(np.int64)


def classes_of(points, links):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    for u, v in links:
        root[find(u)] = find(v)
    classes = collections.defaultdict(set)
    for p in points:
        classes[find(p)].add(p)
    return {frozenset(c) for c in classes.values()}


def test_links_of_dense_groups_at_every_level(spark, monkeypatch):
    for cell, tile, seed, flips in ((128, 1024, 1, 3), (8, 16, 2, 3), (3, 5, 3, 6)):
        monkeypatch.setattr(simhash, "CELL", cell)
        monkeypatch.setattr(simhash, "TILE", tile)
        points = ball(seed, 500, flips, 3).tolist()
        found = [tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in points], "point long")).collect()]
        assert all((u ^ v).bit_count() <= 4 for u, v in ((u & (2**64 - 1), v & (2**64 - 1)) for u, v in found))
        every = [(p, q) for i, p in enumerate(points) for q in points[:i] if ((p ^ q) & (2**64 - 1)).bit_count() <= 4]
        assert classes_of(points, found) == classes_of(points, every)


def test_links_of_runs(monkeypatch):
    rng = np.random.default_rng(7)
    cell = np.sort(rng.integers(0, 60, 400))
    point = np.array([int(p) for p in rng.choice(ball(5, 900, 4, 2), 400, replace=False)], np.int64)
    every = [(int(point[i]), int(point[j])) for i in range(400) for j in range(i) if cell[i] == cell[j] and int(point[i] ^ point[j]) & (2**64 - 1) in bits_of(4)]
    for few in (2, 8, 400):
        monkeypatch.setattr(simhash, "FEW", few)
        found = [(int(u), int(v)) for u, v in zip(*simhash.run_links(cell, point))]
        assert set(map(frozenset, found)) <= set(map(frozenset, every))
        for c in range(60):
            own = point[cell == c].tolist()
            inside = lambda links: [x for x in links if x[0] in own and x[1] in own]
            assert classes_of(own, inside(found)) == classes_of(own, inside(every))


class bits_of:
    def __init__(self, most):
        self.most = most

    def __contains__(self, x):
        return x.bit_count() <= self.most


def test_unlike_points_of_one_cell(spark, monkeypatch):
    """Points whose first halves agree and whose others differ: the finer grid parts them without a pair."""
    monkeypatch.setattr(simhash, "CELL", 16)
    rng = np.random.default_rng(4)
    points = [int(x) for x in np.unique((rng.integers(0, 2**31, 3000) << 32) | 12345)]
    df = spark.createDataFrame([(p,) for p in points], "point long")
    found = [tuple(r) for r in simhash.links(df).collect()]
    a = np.array(points)
    every = [(points[i], points[j]) for i in range(len(a)) for j in np.flatnonzero(simhash.apart(a[:i], a[i]) <= 4)]
    assert classes_of(points, found) == classes_of(points, every)


def test_empty_table(spark):
    assert simhash.classes(spark.createDataFrame([], SCHEMA)).collect() == []
