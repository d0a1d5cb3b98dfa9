from pyspark.sql import functions as F

from querytide.llm import mixing, queries

from .shared import SCHEMA, documents


def budgets(spark, leaves, plan):
    df = spark.createDataFrame(leaves, "_m_domain string, _m_lang string, _m_source string, _tokens long")
    return {(r._m_domain, r._m_lang, r._m_source): r._give for r in mixing.budgets(df, plan).collect()}


def test_shortage_goes_to_siblings_before_ancestors(spark):
    plan = mixing.Plan(domain_weights={"web": 1, "books": 1}, budget=(1, 2), epochs=1)
    leaves = [("web", "en", "short", 10), ("web", "en", "long", 500), ("web", "de", "x", 90), ("books", "en", "y", 600)]
    got = budgets(spark, leaves, plan)  # 1,200 tokens, budget 600: 300 a domain
    assert got[("web", "en", "short")] == 10
    assert got[("web", "de", "x")] == 90  # its share is 150, all it has goes
    assert got[("web", "en", "long")] == 200  # 210 for English, 10 of them short
    assert got[("books", "en", "y")] == 300


def test_a_short_domain_is_made_up_by_the_other(spark):
    plan = mixing.Plan(domain_weights={"web": 9, "books": 1}, budget=(1, 1), epochs=1)
    assert budgets(spark, [("web", "en", "a", 10), ("books", "en", "b", 90)], plan) == {("web", "en", "a"): 10, ("books", "en", "b"): 90}


def test_epochs_and_prefix(spark):
    plan = mixing.Plan(domain_weights={"web": 1, "books": 0 + 1}, budget=(1, 1), epochs=3)
    rows = [(i, "t " * 5, "en", "src0" if i < 4 else "src1", 0) for i in range(40)]
    docs = documents(spark, rows, extra=["_b", "_full"]).drop("_b", "_full").withColumn("epoch", F.lit(9))
    got = mixing.mix(docs, queries.source_domain(), plan).collect()
    web = [r for r in got if r.source == "src0"]
    assert len(web) == 12 and {r.epoch for r in web} == {1, 2, 3}  # 20 tokens, three times
    assert sum(r.n_tokens for r in got) <= 200 and sum(r.n_tokens for r in got) > 190
    again = mixing.mix(docs.repartition(5), queries.source_domain(), plan).collect()
    assert sorted((r.doc_id, r.epoch) for r in got) == sorted((r.doc_id, r.epoch) for r in again)


def test_hard_rows(spark):
    got = mixing.mix(documents(spark, extra=["n_tokens"]), queries.source_domain(), mixing.Plan(budget=(1, 1), epochs=1)).collect()
    copies = {}
    for r in got:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies[3] == 2 and copies[10] == 1 and copies[7] == 1 and copies[8] == 1
    assert mixing.mix(spark.createDataFrame([], SCHEMA), queries.source_domain(), mixing.Plan()).collect() == []
