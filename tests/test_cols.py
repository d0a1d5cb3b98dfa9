import pytest
from pyspark.sql import functions as F

from querytide.functions import cols


@pytest.mark.parametrize("own,top,floor,want", [
    (40, 10, 3, "ahead"), (10, 40, 3, "behind"), (30, 20, 3, "even"), (20, 10, 3, "ahead"), (10, 20, 3, "behind"),
    (2.9, 2.9, 3, "none"), (3, 0, 3, "ahead"), (2, 2, 3, "none"), (0, 0, 10, "none"), (0, 0, 0, "behind"),
])
def test_two_to_one_rule(spark, own, top, floor, want):
    row = spark.range(1).select(cols.two_x(F.lit(own), F.lit(top), floor).alias("x")).first()
    assert row.x == want


def test_numbers_from_text(spark):
    texts = ["74000", "1,200", " 3.5 ", "1e3", "-2", "true", "n/a", "", None, "1_000", ".5", "12."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r.plain, r.commas) for r in df.select(cols.num("t").alias("plain"), cols.num("t", True).alias("commas")).collect()]
    assert got == [(74000, 74000), (0, 1200), (3.5, 3.5), (1000, 1000), (-2, -2), (0, 0), (0, 0), (0, 0), (0, 0), (1000, 1000), (0.5, 0.5), (12, 12)]


def test_cluster_letters(spark):
    idx = [0, 25, 26, 51, 52, 701, 702, 727, 728]
    df = spark.createDataFrame([(k,) for k in idx], "k int").select(cols.cluster_letter("k").alias("x"))
    assert [r.x for r in df.collect()] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "AAZ", "ABA"]


def test_dominant_intent_ties_and_zero(spark):
    rows = [(1.0, 1.0, 0.0, 0.0), (0.0, 2.0, 2.0, 2.0), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 9.0)]
    df = spark.createDataFrame(rows, "i double, n double, c double, t double")
    assert [r.x for r in df.select(cols.dominant_intent().alias("x")).collect()] == ["i", "n", "", "t"]
    assert [r.x for r in df.select(cols.intent_weight().alias("x")).collect()] == pytest.approx([0.1, 0.5, 0.0, 1.0])


def test_keys(spark):
    row = spark.range(1).select(cols.norm_kw(F.lit(" A\tb  C")).alias("a"), cols.ns(F.lit(" A\tb C")).alias("b"), cols.norm(F.lit("  A\t b C ")).alias("c")).first()
    assert (row.a, row.b, row.c) == ("abc", "a\tbc", "a b c")


def test_circular_distance(spark):
    row = spark.range(1).select(cols.circular_distance(F.lit(12), F.lit(1)).alias("a"), cols.circular_distance(F.lit(3), F.lit(9)).alias("b")).first()
    assert (row.a, row.b) == (1, 6)
