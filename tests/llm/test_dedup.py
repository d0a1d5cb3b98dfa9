"""Joins and dedup against brute force: shingle links, lines, repeated bytes."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from querytide.llm import jaccard_join, line_dedup, suffix_dedup
from querytide.llm.components import components

from .shared import SCHEMA, documents, hard_texts, plain_words, sentence


def varied(seed: int, groups: int = 6, size: int = 40) -> list[tuple]:
    """Groups of copies with one to eight edits of a base, and texts with a common passage."""
    rng, rows = random.Random(seed), []
    passage = sentence(99, 70)
    for g in range(groups):
        base = sentence(100 + g, rng.randrange(30, 120)).split()
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            text = " ".join(words)
            if rng.random() < 0.3:
                text += "\n" + passage + rng.choice(["", " end", " of it"])
            rows.append((rng.randrange(10**6), text, "en", "src1", 0))
    return rows


def shingles(text, k=5):
    w = plain_words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_classes(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, len(s), least[find(i)] if s and find(i) in least else d) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = varied(seed)
    got = jaccard_join.classes(documents(spark, rows, extra=["n", "point", "component_id"])).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_classes(rows)


def test_ring_points_meet_core_points(spark, monkeypatch):
    """Small leaves and tiles, so that pivots, windows and tiles all take part."""
    monkeypatch.setattr(jaccard_join, "LEAF", 2)
    monkeypatch.setattr(jaccard_join, "TILE", 4)
    base = sentence(5, 100).split()
    rows = [(k, " ".join(base[: 100 - k] + [f"x{k}_{i}" for i in range(k)]), "en", "s", 0) for k in range(0, 60, 2)]  # a chain of links
    got = jaccard_join.classes(documents(spark, rows)).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_classes(rows)


def test_classes_of_hard_rows(spark):
    got = jaccard_join.classes(documents(spark)).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_classes(hard_texts())
    assert jaccard_join.classes(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_links(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    near = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
    return collections.Counter((d, len(s), sum(near(s, t) for j, (_, t) in enumerate(sets) if i != j)) for i, (d, s) in enumerate(sets))


def chain(n):
    base = sentence(5, 100).split()
    return [(k, " ".join(base[: 100 - k] + [f"x{k}_{i}" for i in range(k)]), "en", "s", 0) for k in range(0, n, 2)]


@pytest.mark.parametrize(
    "rows, leaf, tile",
    [(varied(1), 64, 256), (varied(6, groups=2, size=100) + varied(1, groups=1), 8, 16), (chain(60) * 2, 2, 4), (hard_texts(), 2, 4)],
    ids=["groups", "large", "chain", "hard"],
)
def test_links_equal_brute_force(spark, monkeypatch, rows, leaf, tile):
    """Every link of every row, whether it was found by leaves, around one pivot or between two."""
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    got = jaccard_join.linked_classes(documents(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.n_links) for r in got) == brute_links(rows)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_classes(rows)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 160)}}


def brute_lines(rows):
    sets = []
    for d, text, *_ in rows:
        if d is not None and text:
            for i, line in enumerate(text.split("\n")):
                s = shingles(line.lower())
                if s:
                    sets.append(((d, i), s))
    return {p for p, s in sets if any(q < p and 100 * len(s & t) >= 80 * len(s | t) for q, t in sets)}


@pytest.mark.parametrize("rows", [varied(3, groups=3, size=25), hard_texts()], ids=["groups", "hard"])
def test_lines_equal_brute_force(spark, rows):
    gone = brute_lines(rows)
    out = line_dedup.deduplicated(documents(spark, rows, extra=["gone", "seg", "n_lines"]))
    got = out.collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for d, text, *_ in rows:
        if d is None or not text:
            want[(d, text)] += 1
        else:
            parts = text.split("\n")
            left = [x for i, x in enumerate(parts) if (d, i) not in gone]
            want[(d, "\n".join(left))] += 1
    assert collections.Counter((r.doc_id, r.text) for r in got) == want


def test_line_dedup_is_native_and_takes_empty_tables(spark):
    assert line_dedup.deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []
    plan = line_dedup.deduplicated(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lines_of_different_texts_that_share_an_id(spark):
    """Both texts of id 1 have a line 0; the sets that later lines are compared with are those of their own text."""
    near = lambda k: sentence(k, 80).replace(sentence(k, 80).split()[40], "changed")
    rows = [(1, sentence(k, 80), "en", "s", 0) for k in (21, 22, 23, 24)] + [(k, near(k), "en", "s", 0) for k in (21, 22, 23, 24)]
    got = line_dedup.deduplicated(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0)] * 4 + [(k, 1) for k in (21, 22, 23, 24)]


def test_tokens_of_all_lines_are_exploded_and_joined_once(spark, monkeypatch):
    """Places and sizes come with the shared tokens, not from a second join of all tokens; shingles are counted without functions over arrays."""
    plans, write = {}, line_dedup.staged

    def noted(df):
        plans[tuple(df.columns)] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df)

    monkeypatch.setattr(line_dedup, "staged", noted)
    line_dedup.removed_lines(documents(spark)).collect()
    assert [sum("Join Left" in x for x in plan.split("\n")) for names, plan in plans.items() if {"at", "token"} <= set(names) and "s0" not in names] == [1]
    counted = line_dedup._rarity(line_dedup.lines(documents(spark)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in counted and "array_distinct" not in counted


def test_tokens_of_all_lines_are_shuffled_once(spark, monkeypatch):
    """Shared tokens are found and listed behind one shuffle, whatever their number; a common line is posted at its first place only."""
    plans, write = {}, line_dedup.staged

    def noted(df):
        plans[tuple(df.columns)] = df._jdf.queryExecution().sparkPlan().toString()
        return write(df)

    rows = [(k, sentence(5, 30), "en", "s", 0) for k in range(70)] + [(100, sentence(5, 30) + " more", "en", "s", 0), (101, sentence(6, 30), "en", "s", 0)]
    monkeypatch.setattr(line_dedup, "COPIES", 3)
    monkeypatch.setattr(line_dedup, "staged", noted)
    got = {r.doc_id: r.gone for r in line_dedup.removed_lines(documents(spark, rows)).collect()}
    assert got == {k: [0] for k in [*range(1, 70), 100]}
    plan = plans[("seg", "n", "at", "token")]
    assert plan.count("Generate posexplode") == 1 and "Window" in plan
    items = line_dedup._tokenised(line_dedup.lines(documents(spark, rows)))
    marked = items.selectExpr("doc_id", "line_no", "size(items) n", "xxhash64(sort_array(items)) seg", "items prefix")
    firsts = marked.groupBy("seg").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("rows"))
    assert line_dedup._without_copies(marked, firsts).count() == 3


def test_whole_sets_are_kept_for_pairs_only(spark, monkeypatch):
    """Lines that share a rare token, but pass no filter as a pair, are not written with their sets."""
    kept, posted, write = [], [], line_dedup.staged

    def noted(df):
        out = write(df)
        kept.extend(out.select("items").collect() if "items" in df.columns else [])
        posted.extend(out.select("seg").collect() if {"seg", "at", "token", "s0"} <= set(df.columns) else [])
        return out

    blocks = [sentence(300 + k, 15) for k in range(40)]
    near = sentence(5, 60)
    rows = [(k, f"{blocks[k]} {blocks[(k + 1) % 40]}", "en", "s", 0) for k in range(40)]
    rows += [(100, near, "en", "s", 0), (101, near.rsplit(" ", 1)[0] + " changed", "en", "s", 0)]
    monkeypatch.setattr(line_dedup, "staged", noted)
    got = {r.doc_id: r.gone for r in line_dedup.removed_lines(documents(spark, rows)).collect()}
    assert got == {101: [0]}
    assert len({r.seg for r in posted}) > 2
    assert len(kept) == 2


def brute_bytes(rows, length):
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    seen = collections.Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = collections.Counter()
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out[(d, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("rows", [varied(4, groups=4, size=20), hard_texts(), [(1, "ab" * 400, "", "", 0), (2, "x" + "ab" * 150 + "y", "", "", 0), (3, "z" * 199, "", "", 0), (4, "z" * 200, "", "", 0)]], ids=["groups", "hard", "periodic"])
def test_repeated_bytes_equal_brute_force(spark, rows):
    got = suffix_dedup.repeated(documents(spark, rows, extra=["doc", "runs"])).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_bytes(rows, 200)


def test_repeated_bytes_of_an_empty_table(spark):
    assert suffix_dedup.repeated(spark.createDataFrame([], SCHEMA)).collect() == []
