"""Each report put together from driver tables gives all its fact tables."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from checks import family_brand as fb, family_clusters as fc, family_demand as fd, family_insight as fi, family_journeys as fj, family_season as fs
from checks.domain import Domain
from querytide.plans import reports
from querytide.sources import exports

SF = "/root/testdata/sf0.001"


def filled(facts, may_be_empty=()):
    for name, df in facts.items():
        n = df.count()
        assert n > 0 or name in may_be_empty, name


def test_query_cluster_journey_and_total_reports(spark, tmp_path):
    d = Domain(spark, SF)
    query = reports.query_report(d.query, d.monthly, d.members)
    filled(query)
    cluster = reports.cluster_report(d.communities, d.edges, d.metrics, fc.cluster_groups(d), fc.flows(d))
    filled(cluster)
    hubs = d.metrics.select("run_id", "keyword")
    journey = reports.journey_report(d.journeys, d.metrics, fj.picks(d.journeys), hubs)
    filled(journey)
    x = fi.Insight(d)
    total = reports.total_report(query, cluster, journey, d.journeys, x.pq, x.pc, d.each_run(fi.FLOW_PAIRS, "a string, b string"))
    filled(total, ("mismatch", "matrix_gaps"))
    exports.write_facts({"clusters": cluster["clusters"]}, str(tmp_path / "facts"))
    assert spark.read.parquet(str(tmp_path / "facts" / "clusters")).count() == cluster["clusters"].count()


def test_demand_and_season_reports(spark):
    d = Domain(spark, SF)
    filled(reports.demand_report(d.monthly, fd.bundles(d)), ("steps", "sum_check"))
    first = {r.run_id: r.k for r in d.monthly.groupBy("run_id").agg(F.max_by("keyword", "total").alias("k")).collect()}  # seeds that are there at this size
    setup = [(run, first[run], *rest) for run, _, *rest in fs.SETUP]
    filled(reports.season_report(d.monthly, spark.createDataFrame(setup, "run_id string, seed string, rel string, exc string, min_total double, skip array<string>"), fs.themes_of(d)), ("co_spikes", "trends", "theme_odd"))


def test_brand_report(spark):
    b = fb.Brands(Domain(spark, SF))
    facts = reports.brand_report(b.categories, b.lists, b.volumes, b.names, b.excludes, b.journeys, b.dom.journeys, b.facets.select("run_id", "category", "facet"), b.facet_journeys, b.setup)
    filled(facts, ("conflicts", "keep_and_take", "mismatch", "outside"))
    assert facts["judged"].where(F.col("status").isNull()).count() == 0


def test_entry_points_load_without_a_session_and_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql();"
            "assert set(o) <= set(q) and len(q) > 170; print(len(q))")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
