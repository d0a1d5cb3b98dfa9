"""Benchmark decontamination and exact top-k against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest

from querytide.llm import decontaminate, topk

from .shared import LOWER, SCHEMA, documents, hard_texts, sentence

ITEMS = "item_id long, text string, terms string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items):
    out = collections.Counter()
    for d, text, *_ in rows:
        w, hit, names = words(text), set(), set()
        for item, t, *_ in items:
            b = words(t)
            for i in range(max(1, len(b) - 9) if b else 0):
                win = b[i : i + 10]
                for j in range(len(w) - len(win) + 1):
                    if w[j : j + len(win)] == win:
                        hit.update(range(j, j + len(win)))
                        names.add(str(item))
        out[(d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))] += 1
    return out


def test_contamination_equals_brute_force(spark):
    base = sentence(1, 60).split()
    items = [(2, " ".join(base[5:25]), ""), (10, "one", ""), (3, "漢字 IDIOT", ""), (4, None, ""), (5, "...", ""), (6, " ".join(base[50:60] + ["zzz"]), ""), (7, "a a a", ""), (10, "one", "")]
    rows = hard_texts() + [(20, "w1 " + " ".join(base[5:14]), "", "", 0), (21, "on", "", "", 0), (22, "e", "", "", 0)]
    got = decontaminate.decontaminate(documents(spark, rows, extra=["ids", "hit"]), spark.createDataFrame(items, ITEMS)).collect()
    assert collections.Counter(tuple(r) for r in got) == brute(rows, items)


def test_blocks_and_groups_of_any_size_agree(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 500)
    monkeypatch.setattr(decontaminate, "WINDOWS", 3)
    rows = hard_texts()
    items = [(1, sentence(1, 30), ""), (2, sentence(3, 25), "")]
    got = decontaminate.decontaminate(documents(spark, rows), spark.createDataFrame(items, ITEMS)).collect()
    assert collections.Counter(tuple(r) for r in got) == brute(rows, items)


def test_rows_that_share_an_id_or_have_none_stay_apart(spark):
    dirty = "so " + sentence(1, 12)
    rows = [(None, dirty, "", "", 0), (None, sentence(2, 12), "", "", 0), (None, None, "", "", 0), (1, sentence(2, 12), "", "", 0), (1, dirty, "", "", 0), (1, dirty, "", "", 0)]
    items = [(5, sentence(1, 12), "")]
    got = decontaminate.decontaminate(documents(spark, rows), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r.doc_id or 0, r.n_hit) for r in got) == [(0, 0), (0, 0), (0, 12), (1, 0), (1, 12), (1, 12)]
    assert collections.Counter(tuple(r) for r in got) == brute(rows, items)


def brute_places(w, win, slack):
    """{begin: shift} of a window in words, neighbours with a better match left out."""
    fits = {}
    for begin in range(-slack, len(w)):
        off = [min((abs(p - begin - i) for p, x in enumerate(w) if x == word), default=slack + 1) for i, word in enumerate(win)]
        if max(off) <= slack:
            fits[begin] = max(off)
    return {b: s for b, s in fits.items() if not any(0 < abs(o - b) <= slack and (t, o) < (s, b) for o, t in fits.items())}


def brute_nearby(rows, items, slack):
    out = collections.Counter()
    for d, text, *_ in rows:
        w = words(text)
        for item in {i for i, *_ in items}:
            best = {}
            for _, t, *_ in (x for x in items if x[0] == item):
                b = words(t)
                for i in range(max(1, len(b) - 9) if b else 0):
                    for begin, shift in brute_places(w, b[i : i + 10], slack).items():
                        best[begin] = min(shift, best.get(begin, shift))
            if best:
                out[(d, item, len(best), sum(s == 0 for s in best.values()), min(best.values()))] += 1
    return out


def test_proximity_by_hand(spark):
    """Words that change places at the start, in the middle and at the end of a text."""
    rows = [(1, "b a c", "", "", 0), (2, "z z b a c", "", "", 0), (3, "a c b", "", "", 0), (4, "c b a", "", "", 0), (5, "a b c", "", "", 0), (6, "a x b c", "", "", 0)]
    got = decontaminate.nearby(documents(spark, rows), spark.createDataFrame([(7, "a b c", "")], ITEMS), 1).collect()
    assert {r.doc_id: (r.n_places, r.n_exact, r.least_shift) for r in got} == {1: (1, 0, 1), 2: (1, 0, 1), 3: (1, 0, 1), 5: (1, 1, 0), 6: (1, 0, 1)}


def test_proximity_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 300)
    monkeypatch.setattr(decontaminate, "WINDOWS", 7)
    rng = np.random.default_rng(5)
    text = lambda n, k: " ".join(chr(97 + x) for x in rng.integers(0, k, n))
    rows = [(i % 50 or None, text(int(rng.integers(0, 40)), 4), "", "", 0) for i in range(80)] + [(90, None, "", "", 0), (91, "", "", "", 0)]
    base = sentence(1, 40).split()
    for i in range(10):  # long windows with words moved
        moved = list(base)
        a = int(rng.integers(0, 38))
        moved[a], moved[a + 1] = moved[a + 1], moved[a]
        rows.append((100 + i, " ".join(moved[: 25 + i]), "", "", 0))
    items = [(i, text(int(rng.integers(1, 7)), 4), "") for i in range(12)] + [(50, sentence(1, 14), ""), (50, sentence(1, 14), ""), (51, None, ""), (52, "a a", "")]
    given = spark.createDataFrame(items, ITEMS)
    for slack in (0, 1, 3):
        got = decontaminate.nearby(documents(spark, rows, extra=["row", "shift"]), given, slack).collect()
        assert collections.Counter(tuple(r) for r in got) == brute_nearby(rows, items, slack)


def test_windows_that_could_bridge_documents_are_refused(spark):
    with pytest.raises(ValueError):
        decontaminate.matches(decontaminate.index(documents(spark)), spark.createDataFrame([], ITEMS), slack=28)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.decontaminate(spark.createDataFrame([], SCHEMA), none).collect() == []
    assert not any(r.contaminated for r in decontaminate.decontaminate(documents(spark), none).collect())


def brute_top(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            w = [int(np.floor(64 * float(x))) for x in v]
            good[i] = min(good.get(i, w), w)
    out = []
    for q, v in good.items():
        if q % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), c) for c, w in good.items() if c != q and len(w) == len(v)))[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 16)
    monkeypatch.setattr(topk, "SHARD_ROWS", 200)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(1)]) for i in range(700)]
    rows += [(700 + i, [0.5] * 8) for i in range(200)]  # one frequent vector
    rows += [(1000, None), (1001, [1.0, None] * 4), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (0, rows[0][1]), (1040, []), (1060, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as shard")
    from pyspark.sql import functions as F

    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows, 20)


def test_top_k_of_few_and_none(spark):
    from pyspark.sql import functions as F

    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 8192), (0, 2, 2, 8192)]
    assert topk.top_k(few.limit(0), F.col("vec_id") % 20 == 0).collect() == []
