"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs to a sink that discards rows. Tables shared by several queries (metrics, journeys,
graph nodes, series) are written once by the first query that needs them, which pays for them.
"""

import json
import os
import sys
import time

HEADLINES = """
A1_read_keyword_info A7_cluster_nodes A12_multi_seed_quota A16_enrichment_batches
B4_opportunity_score B8_top_opportunities B11_query_group_rollup
C5_cluster_rollup C6_enrich_selection C7_context_selection C9_cluster_group_rollup
D2_journey_nodes D3_rank_journeys D6_flow_tree
E1_finder_master_join E7_hub_divergence E14_value_leak E18_corridor_bridges E21_backlog_buckets
F1_align_months F3_series_stats F7_detect_notation_shift F9_bundle_rollup F11_market_verdict F17_internal_composition
F21_number_grounding_audit
G5_source_index G7_brand_candidates G12_closeness_evidence G22_intent_bundle_parts
H4_seasonal_index H5_season_phases H7_theme_rollup H10_monthly_season_keywords
I1_brand_match I6_share_of_search I10_journey_axis I19_facet_summary
""".split()


def main():
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from checks.registry import all_checks
    from checks.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the session before the clock
    checks = all_checks()
    seconds, families = {}, {}
    for name in names:
        start = time.time()
        checks[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        families[name[0]] = round(families.get(name[0], 0) + seconds[name], 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "families": families, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
