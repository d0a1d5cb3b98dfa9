"""Toxicity and quality: held-out accuracy, hard rows, and an interaction that linear weights miss."""

import re
import zlib

import numpy as np
import pytest

from querytide.llm import quality, queries, toxicity

from .shared import SCHEMA, documents

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name, label, least", [("op4_toxicity", "toxic", 0.8), ("op7_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    got = queries.QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    out = got[got.held_out]
    right = out[out[label] == 1].predicted.mean()
    wrong = out[out[label] == 0].predicted.mean()
    assert right > least and wrong < 0.03, (right, wrong)


@pytest.mark.parametrize("operator, fold, left", [(toxicity.toxicity, 4, 2), (quality.quality, 5, 0)])
def test_hard_rows(spark, operator, fold, left):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 0, 0), (4, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    docs = documents(spark, extra=["score", "predicted"])
    got = operator(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == left) for r in got if r.doc_id is not None)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert operator(spark.createDataFrame([], SCHEMA), labels).collect() == []
    assert len({r.score for r in operator(docs, labels.limit(0)).collect()}) == 1


def test_labels_of_the_fold_do_not_matter(spark):
    docs = documents(spark, [(i, ("idiot " if i % 3 == 0 else "calm ") + f"word{i}", "en", "s", 0) for i in range(60)])
    rows = [(i, 0, int(i % 3 == 0)) for i in range(60)]
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in rows]
    one, two = ({r.doc_id: r.score for r in toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (rows, flipped))
    assert one == two


def plain_terms(text):
    """Words and their first bytes, hashed one by one with the library's string hash."""
    from querytide.llm import texthash

    out = set()
    for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))):
        for k in [None, *toxicity.PREFIXES]:
            if k is None or len(w) > k:
                part = np.frombuffer(w[:k], np.uint8)
                h = texthash.Rolling(texthash.VALUES[part]).hash(np.array([0]), np.array([len(part)]))[0]
                out.add(int((h ^ texthash.U(k) if k else h) % texthash.U(toxicity.TERMS)))
    return out


def test_scores_equal_a_plain_loop(spark):
    """Every score is the sigmoid of bias, weights and the products of all pairs of terms."""
    rows = [(i, ("Idiot you " if i % 3 == 0 else "calm they ") + f"word{i % 7} anotherlongword{i % 5}", "en", "s", 0) for i in range(80)]
    docs = documents(spark, rows + [(900, None, None, None, 0), (901, "", "", "", 0), (902, "IDIOT idiot calm " * 300, "", "", 0)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, toxicity.fold("doc_id", 4, 2))
    place = {int(t): k for k, t in enumerate(model.terms)}
    assert len(place) > 10
    for r in toxicity.score(docs, model).collect():
        at = [place[t] for t in plain_terms(r.text) if t in place]
        margin = model.bias + sum(model.weights[k] for k in at)
        margin += sum(float(model.factors[j] @ model.factors[k]) for i, j in enumerate(at) for k in at[:i])
        assert abs(r.score - 1 / (1 + np.exp(-margin))) < 1e-5, r.doc_id


def plain_passages(text):
    """The numbers of every passage, word by word."""
    data = (text or "").encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    words = [data[a:b].lower() for a, b in spans]
    kind = lambda b: int(quality.BYTE_KIND[b])
    out = []
    for at in range(0, len(spans), quality.PASSAGE):
        here = range(at, min(at + quality.PASSAGE, len(spans)))
        stop = spans[here[-1] + 1][0] if here[-1] + 1 < len(spans) else len(data)
        part, n = data[spans[at][0] : stop], len(here)
        last = [kind(data[spans[i][1] - 1]) for i in here]
        shares = [sum(kind(b) == k for b in part) / len(part) for k in range(quality.KINDS)]
        out.append(shares + [
            len({words[i] for i in here}) / n, sum(i > 0 and words[i] == words[i - 1] for i in here) / n, sum(len(words[i]) for i in here) / n / 10,
            sum(k in (4, 5, 6) for k in last) / n, n / quality.PASSAGE, sum(len(words[i]) == 1 and k in (5, 6, 10) for i, k in zip(here, last)) / n,
        ])
    return out


def plain_attention(model, text):
    """Score of one document: passages one by one, weights by exp, then one weighted mean."""
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    p, hidden, raw = model.p, [], []
    for x in plain_passages(text):
        h = np.tanh((np.array(x) - model.mean) / model.scale @ p["e"] + p["eb"])
        hidden.append(h)
        raw.append(np.exp(float(np.tanh(h @ p["v"]) * sigmoid(h @ p["u"]) @ p["a"])))
    if not hidden:
        return sigmoid(model.base)
    bag = sum(w * h for w, h in zip(raw, hidden)) / sum(raw)
    return sigmoid(float(bag @ p["c"]) + p["cb"][0])


def test_quality_scores_equal_a_plain_loop(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(documents(spark).select("doc_id", "text"))
    model = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"), quality.fold("doc_id", 5, 0))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(r.text)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and len({round(r.score, 6) for r in got}) > 50
    for r in got:
        assert any(abs(r.score - plain_attention(model, t)) < 1e-6 for t in texts[r.doc_id]), r.doc_id


def test_lists_and_pairs_fit_alike():
    rng = np.random.default_rng(2)
    lists = [np.unique(rng.integers(0, 30, rng.integers(0, 9))) for _ in range(300)]
    y = np.array([float(3 in x and 7 in x) for x in lists])
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    one = toxicity.fit_lists(offsets, np.concatenate(lists).astype(np.int32), y)
    two = toxicity.fit(np.repeat(np.arange(300), np.diff(offsets)), np.concatenate(lists), y)
    assert one.bias == two.bias and (one.weights == two.weights).all() and (one.factors == two.factors).all()


def test_pairs_of_neutral_terms_are_learned():
    """Exclusive or: neither term says anything by itself."""
    a, b = (x.ravel() for x in np.meshgrid(np.repeat([0, 1], 40), np.repeat([0, 1], 40)))
    row = np.concatenate([np.flatnonzero(a), np.flatnonzero(b)])
    term = np.repeat([5, 6], len(row) // 2)
    y = (a != b).astype(float)
    assert y[a == 1].mean() == y[b == 1].mean() == y.mean() == 0.5
    order = np.argsort(row, kind="stable")
    m = toxicity.fit(row[order], term[order], y)
    assert m.terms.tolist() == [5, 6]
    x = lambda *t: m.bias + m.weights[list(t)].sum() + (float(m.factors[0] @ m.factors[1]) if len(t) == 2 else 0)
    assert min(x(0), x(1)) > 0 > max(m.bias, x(0, 1))


def test_gradients_of_the_attention_model():
    rng = np.random.default_rng(1)
    row = np.repeat(np.arange(30), 3)
    x = rng.normal(size=(90, quality.FEATURES))
    y = (np.maximum.reduceat(x[:, 0], np.arange(0, 90, 3)) > 0.8).astype(float)  # one passage decides
    m = quality.fit(row, x, y, rounds=400)
    assert ((m.forward(row, x, 30)[0] > 0) == (y == 1)).mean() > 0.9
