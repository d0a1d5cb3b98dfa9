from datetime import datetime

import pytest

from checks.domain import Domain


@pytest.fixture
def folder(spark, tmp_path):
    """Three orders; the second has equal prices, the third is there twice with one customer and has a line without a price."""
    day = datetime(1998, 3, 2)

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")

    put("customer", [(1, "BUILDING"), (2, None)], "c_custkey long, c_mktsegment string")
    put("part", [(1, "red ring", "Brand#1", "PROMO"), (2, "old rod", "Brand#2", None), (3, "new gear", None, "STANDARD")], "p_partkey long, p_name string, p_brand string, p_type string")
    put("orders", [(10, 1, day, "1-URGENT"), (11, 1, day, "2-HIGH"), (12, 2, day, "2-HIGH"), (12, 2, day, "2-HIGH"), (13, 9, day, "2-HIGH")],
        "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string")
    lines = [(10, 1, 1, 5.0), (10, 2, 2, 9.0), (10, 2, 3, 9.0), (11, 2, 1, 4.0), (11, 1, 2, 4.0), (12, 3, 1, 7.0), (12, 1, 2, None), (None, 1, 1, 1.0), (13, 1, 1, 1.0), (10, 99, 4, 90.0)]
    put("lineitem", [(o, p, n, 1, 1.0, x, 0.1, "O", day) for o, p, n, x in lines],
        "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_linestatus string, l_shipdate timestamp")
    return str(tmp_path)


def test_lines_keep_every_row_and_the_lead_of_their_order(spark, folder):
    rows = Domain(spark, folder).lines.select("run_id", "keyword", "related", "lead", "leads", "custkey", "l_orderkey").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([
        ("building", "brand#1 red ring", "brand#1 red ring promo", "brand#2 old rod", False, None, None),
        ("building", "brand#2 old rod", "brand#2 old rod", None, True, 1, 10),
        ("building", "brand#2 old rod", "brand#2 old rod", None, False, None, None),
        ("building", "brand#2 old rod", "brand#2 old rod", "brand#1 red ring", False, None, None),
        ("building", "brand#1 red ring", "brand#1 red ring promo", None, True, 1, 11),
        (None, "new gear", "new gear standard", "brand#1 red ring", False, None, None),
        (None, "new gear", "new gear standard", "brand#1 red ring", False, None, None),
        (None, "brand#1 red ring", "brand#1 red ring promo", None, True, 2, 12),
        (None, "brand#1 red ring", "brand#1 red ring promo", None, False, None, None)], key=str)


def test_edges_and_journeys_of_the_leads(spark, folder):
    dom = Domain(spark, folder)
    assert sorted(map(tuple, dom.edges.collect()), key=str) == [
        ("building", "brand#1 red ring", "brand#2 old rod"), (None, "brand#1 red ring", "new gear")]
    assert {(r.run_id, r.path_id): r.seq for r in dom.journeys.collect()} == {
        ("building", 1): ["brand#2 old rod", "brand#1 red ring"], (None, 2): ["brand#1 red ring"]}


def test_tables_of_the_lines_join_the_tables_once(spark, folder):
    """Metrics, edges and journeys scan the staged lines instead of joining lineitem again."""
    dom = Domain(spark, folder)
    for table in (dom.metrics_of("related"), dom.monthly_of("keyword"), dom.raw_journeys):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "o_orderkey" not in plan and "p_partkey" not in plan and "stage-" in str(dom.stage("lines", None).inputFiles())
