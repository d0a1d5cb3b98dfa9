"""The pipeline's stages against what they must keep and drop."""

import collections

import duckdb
import numpy as np

import corpus_pipeline as pipeline
from querytide.functions.stage import staged
from querytide.llm import queries, toxicity

from .shared import SCHEMA, documents, plain_words, sentence
from .test_dedup import brute_classes, brute_lines, shingles
from .test_models import plain_terms
from .test_search import brute

SF = "/root/testdata/sf0.001"


def plain_clean(spark, docs, rows):
    """Rows whose score, summed over all pairs of terms one text at a time, is below the threshold."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels, toxicity.fold("doc_id", 4, 2))
    place = {int(t): k for k, t in enumerate(model.terms)}
    kept = []
    for r in rows:
        at = [place[t] for t in plain_terms(r[1]) if t in place]
        products = model.factors[at].astype(float) @ model.factors[at].astype(float).T
        margin = model.bias + model.weights[at].sum() + sum(products[i, :i].sum() for i in range(len(at)))
        if 1 / (1 + np.exp(-margin)) < toxicity.THRESHOLD:
            kept.append(r)
    return kept


def plain_lines(rows):
    gone, kept = brute_lines(rows), []
    for d, text, lang, source, n in rows:
        lines = (text or "").split("\n")
        left = [x for i, x in enumerate(lines) if (d, i) not in gone]
        if len(left) == len(lines):
            kept.append((d, text, lang, source, n))
        elif plain_words("\n".join(left)):
            kept.append((d, "\n".join(left), lang, source, len("\n".join(left))))
    return kept


def plain_mix(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    out = con.execute(queries.mixing_sql())
    return [c[0] for c in out.description], out.fetchall()


def test_stages_on_the_driver_tables_equal_brute_force(spark):
    docs = staged(spark.read.parquet(f"{SF}/documents.parquet").select(*pipeline.COLUMNS))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    lost = {}
    for name, stage in pipeline.STAGES[:-1]:
        rows = [tuple(r) for r in docs.collect()]
        if name == "toxicity":
            want = plain_clean(spark, docs, rows)
        elif name == "line dedup":
            want = plain_lines(rows)
        elif name == "n-gram Jaccard join":
            least = {d for d, _, root in brute_classes(rows) if d == root}
            want = [r for r in rows if r[0] in least]
        else:
            dirty = {d for d, _, hits, *_ in brute(rows, items) if hits}
            want = [r for r in rows if r[0] not in dirty]
        docs = staged(stage(spark, docs, SF))
        assert docs.columns == pipeline.COLUMNS
        assert collections.Counter(tuple(r) for r in docs.collect()) == collections.Counter(want), name
        lost[name] = len(rows) - len(want)
    assert sum(n > 0 for n in lost.values()) >= 2, lost
    rows = [tuple(r) for r in docs.collect()]
    names, mix = plain_mix(rows)
    copies = collections.Counter((m["doc_id"], m["epoch"], m["n_tokens"]) for m in (dict(zip(names, r)) for r in mix))
    got = pipeline.mixed(spark, docs, SF).collect()
    assert collections.Counter((r.doc_id, r.epoch, r.n_tokens) for r in got) == copies and copies
    assert {tuple(r)[: len(pipeline.COLUMNS)] for r in got} <= set(rows)


def test_one_document_of_each_group_stays(spark):
    base = sentence(1, 80)
    near = base.replace(base.split()[40], "changed")
    assert 100 * len(shingles(base) & shingles(near)) >= 80 * len(shingles(base) | shingles(near))
    rows = [(5, base, "en", "s", 1), (3, near, "en", "s", 1), (9, sentence(2, 50), "en", "s", 1), (9, sentence(2, 50), "en", "s", 1), (7, "", "en", "s", 0), (8, None, "en", "s", 0)]
    got = pipeline.one_of_each_group(spark, documents(spark, rows, extra=["n_shingles"]), SF).collect()
    assert sorted(r.doc_id for r in got) == [3, 7, 8, 9]


def test_groups_of_rows_that_share_an_id_or_have_none(spark):
    """A row goes for its own text: not for that of another row of its id, and not because it has no id."""
    a, b, c, d = (sentence(k, 80) for k in range(11, 15))
    near = a.replace(a.split()[40], "changed")
    rows = [(None, a, "en", "s", 1), (4, near, "en", "s", 1), (None, b, "en", "s", 1), (None, b, "fr", "t", 1), (4, c, "en", "s", 1), (6, c, "en", "s", 1), (6, d, "en", "s", 1), (None, None, "en", "s", 0), (None, "", "en", "s", 0), (None, None, "en", "s", 0)]
    got = pipeline.one_of_each_group(spark, documents(spark, rows, extra=["_key", "component_id"]), SF).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(4, near), (0, b), (4, c), (6, d), (0, ""), (0, ""), (0, "")])


def test_lines_and_counts_of_characters(spark):
    line = sentence(1, 20)
    rows = [(1, line, "en", "s", len(line)), (2, line, "en", "s", len(line)), (3, line + "\nown words here", "en", "s", 1), (4, "", "en", "s", 0), (5, None, "en", "s", 0)]
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.without_repeated_lines(spark, documents(spark, rows), SF).collect()}
    assert got == {1: (line, len(line)), 3: ("own words here", 14), 4: ("", 0), 5: (None, 0)}


def test_benchmark_passages_go_and_clean_documents_stay(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(1, "before " + item + " after", "en", "s", 1), (2, "clean words only", "en", "s", 1), (3, None, "en", "s", 0)]
    rows += [(None, item, "en", "s", 1), (None, "no words of it", "en", "s", 1), (None, None, "en", "s", 0), (4, item, "en", "s", 1), (4, "a clean text of the same id", "en", "s", 1)]
    got = pipeline.without_benchmark(spark, documents(spark, rows, extra=["_key", "row"]), SF).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (0, "no words of it"), (2, "clean words only"), (3, ""), (4, "a clean text of the same id")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, SF))
    assert docs.count() == 0
