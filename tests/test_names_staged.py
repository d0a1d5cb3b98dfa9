from querytide.operators import names


def test_first_places_read_staged_places(spark):
    """The result scans tables of places and readings; it does not search the texts once for each branch."""
    texts = spark.createDataFrame([("a", "red ring redring"), ("a", "old rod")], "run_id string, text string")
    wanted = spark.createDataFrame([("a", "item", "ring", False), ("a", "brand", "red", True)], "run_id string, kind string, core string, bound boolean")
    known = spark.createDataFrame([("a", "red")], "run_id string, token string")
    got = names.first_places(texts, wanted, known)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "regexp_extract" not in plan
    assert sorted(map(tuple, got.select("text", "kind", "at", "size").collect())) == [("red ring redring", "brand", 1, 3), ("red ring redring", "item", 5, 4)]
