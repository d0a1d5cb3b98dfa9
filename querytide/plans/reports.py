"""The operators put together: for each report, the input tables and the fact tables they give.

Inputs are keyed by run_id, so one call serves many seeds and markets. Tables that several facts
read are staged once. Labels that people or models choose (groups, picks, themes, bundles) are
ordinary input tables.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions.stage import staged
from ..operators import brand, classify, clusters, demand, insight, journeys, opportunity, season

Facts = dict[str, DataFrame]


def query_report(records: DataFrame, monthly: DataFrame, members: DataFrame) -> Facts:
    scored = staged(opportunity.scored(records))
    context = staged(opportunity.context_rows(records))
    return {
        "queries": scored, "kpis": opportunity.kpis(records), "funnel": opportunity.intent_funnel(records),
        "top": opportunity.top_opportunities(scored), "trend": opportunity.top_trend_series(scored, monthly),
        "context": context, "summary": opportunity.context_summary(records),
        "groups": opportunity.group_rollup(members, context), "group_intents": opportunity.group_intent_share(members, context),
    }


def cluster_report(communities: DataFrame, edges: DataFrame, metrics: DataFrame, groups: DataFrame, flows: DataFrame) -> Facts:
    nodes = staged(clusters.cluster_nodes_table(communities, edges, metrics))
    context = staged(clusters.context_selection(nodes))
    return {
        "nodes": nodes, "context": context, "clusters": clusters.cluster_rollup(nodes), "enrich": clusters.enrich_selection(nodes),
        "summary": clusters.context_summary(nodes, edges, communities), "groups": clusters.group_rollup(groups, nodes, context),
        "flows": clusters.cluster_flows(flows, nodes, context),
    }


def journey_report(paths: DataFrame, metrics: DataFrame, picked_paths: DataFrame, picked_hubs: DataFrame) -> Facts:
    edges = staged(journeys.journey_edges(paths))
    nodes = staged(journeys.journey_nodes(paths, edges, metrics))
    ranked = staged(journeys.rank_journeys(paths, nodes))
    return {
        "edges": edges, "nodes": nodes, "journeys": ranked, "hubs": journeys.branch_hubs(nodes),
        "downstream": journeys.downstream_list(edges, nodes), "tree": journeys.flow_tree(ranked, nodes),
        "summary": journeys.context_summary(paths, edges, nodes), "cards": journeys.journey_cards(picked_paths, nodes),
        "hub_cards": journeys.hub_cards(picked_hubs, nodes, edges),
    }


def total_report(query: Facts, cluster: Facts, journey: Facts, paths: DataFrame, query_personas: DataFrame, cluster_personas: DataFrame,
                 flow_pairs: DataFrame) -> Facts:
    """Cross-finder facts over the three reports; personas are (run_id, group_id, gpos, relation, keyword)."""
    master = staged(insight.finder_master(
        query["context"], journey["nodes"], cluster["context"], cluster["nodes"], query_personas, cluster_personas))
    stages = staged(insight.journey_stage(master, paths))
    cells = staged(insight.persona_stage_matrix(cluster_personas, stages))
    gaps = staged(insight.gap_buckets(master))
    divergent = staged(insight.hub_divergence(master))
    concentration = insight.downstream_concentration(journey["downstream"], master)
    leaks = staged(insight.value_leak(master, concentration, query_personas.where(F.col("relation") == "alternative")))
    bridges = staged(insight.bridge_keyword(
        insight.corridor_bridges(master, journey["edges"], flow_pairs), master, cluster["nodes"].where("is_hub")))
    items = staged(insight.priority_score(master, leaks, gaps))
    buckets = staged(insight.bucketed(items))
    shown, safe = insight.backlog(buckets), insight.safe_points(leaks)
    return {
        "master": master, "coverage": insight.coverage_pct(master, cluster_personas), "combos": insight.coverage_combos(master), "gaps": gaps,
        "mismatch": insight.volume_mismatch(master), "hub_divergence": divergent, "stages": stages, "matrix": cells,
        "matrix_gaps": insight.matrix_gap_cells(cells), "persona_leak": insight.persona_leak(cells), "slope": insight.intent_slope(cells),
        "leaks": leaks, "safe": safe, "brand_defense": insight.brand_defense(leaks), "bridges": bridges, "backlog": shown,
        "breakdown": insight.backlog_breakdown(shown, items, divergent, bridges), "shortlists": insight.shortlists(divergent, leaks, safe),
    }


def demand_report(monthly: DataFrame, bundles: DataFrame) -> Facts:
    """Four-year facts of a plan: bundles (run_id, bundle_id, bord, role market|peer|part, broad, ord, keyword)."""
    series = staged(demand.align_months(monthly))
    named = bundles.where("broad = 0").select("run_id", "bundle_id", "ord", "keyword")
    members = staged(demand.bundle_members(named, series))
    roles = bundles.select("run_id", "bundle_id", "bord", "role").distinct()
    rows = staged(demand.bundle_rollup(members).join(roles, ["run_id", "bundle_id"]))
    market, parts = rows.where("role = 'market'"), rows.where("role = 'part'")
    peers = staged(demand.peer_scale_filter(rows.where("role = 'peer'"), market))
    kept = peers.where(~F.col("small"))
    verdict = staged(demand.market_verdict(kept, market))
    intervals = staged(demand.part_intervals(parts))
    every = demand.bundle_rollup(demand.bundle_members(bundles.select("run_id", "bundle_id", "ord", "keyword"), series))
    return {
        "series": series, "members": members, "bundles": rows, "dropped": demand.dropped_no_data(named, series), "peers": demand.relative_growth(peers, verdict),
        "verdict": verdict, "leave_one_out": demand.leave_one_out(kept, verdict), "cover": demand.representative_cover(rows, every),
        "steps": demand.single_engine_step(series), "spikes": demand.spikes(rows, ["run_id", "bundle_id"], "own"),
        "shifts": demand.notation_shifts(members, rows), "jumps": demand.level_jumps(members, rows), "intervals": intervals,
        "composition": demand.composition_summary(parts, intervals), "drivers": demand.drivers(rows, members),
        "badges": demand.interval_badges(rows, demand.new_per_interval(members)), "sum_check": demand.sum_check(rows, members),
    }


def season_report(monthly: DataFrame, setup: DataFrame, themes: DataFrame) -> Facts:
    """Season facts of many runs, each with its own seed, filters and themes (see operators.season)."""
    spec = staged(season.season_spec(setup, themes))
    filtered = season.relevance_filter(demand.align_months(monthly), spec)
    rows = staged(season.with_index(season.classified(filtered, spec)))
    groups = staged(season.theme_rollup(rows))
    keywords = staged(season.monthly_keywords(rows, spec))
    pool = staged(season.change_pool(rows))
    return {
        "status": filtered.select("run_id", "keyword", "status", "total4"), "queries": season.with_phases(rows), "themes": groups,
        "theme_top": season.theme_top(rows), "theme_odd": season.theme_odd(rows, groups), "theme_order": season.theme_order(groups, season.next_month()),
        "monthly": keywords, "calendar": season.season_calendar(keywords), "signals": season.signal_lists(rows), "seed": season.seed_series(filtered, spec),
        "untagged": season.untagged_review(rows, spec), "trends": season.trend_pool(pool), "co_spikes": season.co_spike_months(pool),
        "quarter": season.quarter_direction(pool),
    }


def brand_report(categories: DataFrame, lists: DataFrame, volumes: DataFrame, names: DataFrame, excludes: DataFrame, paths: DataFrame,
                 brand_paths: DataFrame, facets: DataFrame, facet_paths: DataFrame, setup: DataFrame) -> Facts:
    """Share of search and journeys per category (paths carry category, facet_paths also facet and seed); set-up as in operators.brand."""
    setup = staged(setup)
    nodes = paths.select("run_id", F.explode("seq").alias("query")).unionByName(facet_paths.select("run_id", F.explode("seq").alias("query")))
    hits = staged(brand.brand_hits(lists.select("run_id", "query").unionByName(nodes), names, excludes))
    shares = staged(brand.share_of_search(lists, hits, volumes))
    verdicts = staged(brand.naming_verdict(brand.name_ratio(categories, lists, hits, shares, volumes), shares, setup))
    key = ["run_id", "category"]
    index = staged(brand.journey_brand_index(paths, hits, key, "category"))
    axes = brand.journey_axis(index, key, setup, paths)
    modifiers = brand.category_modifiers(lists, setup)
    mine = brand.with_setup(hits, setup, "own_brand").where(brand.is_own()).select("run_id", "query")
    evidence = brand.category_evidence(categories, brand_paths, mine, lists, modifiers, verdicts)
    judged = staged(categories.join(verdicts.drop("own_queries"), key).join(evidence, key).join(axes.drop("branded"), key, "left").withColumn(
        "status", brand.status()))
    facet_key = [*key, "facet"]
    walked = brand.journey_axis(brand.journey_brand_index(facet_paths, hits, facet_key, "seed"), facet_key, setup, facet_paths)
    deep = staged(brand.facet_summary(brand.facet_metrics(facets, volumes, setup).join(walked, facet_key, "left")))
    rivals = staged(brand.competitors(shares, setup))
    matrix = brand.brand_matrix(shares)
    return {
        "shares": shares, "judged": judged, "index": index, "facets": deep, "facet_highlights": brand.facet_highlights(deep), "rivals": rivals,
        "matrix": matrix, "columns": brand.matrix_columns(shares, setup), "outside": brand.outside_top(matrix, brand.brand_columns(shares, setup), setup), "ratio": brand.position_ratio(judged),
        "demand": brand.demand_by_status(judged), "keep_and_take": brand.keep_and_take(judged), "mismatch": brand.facet_mismatch(judged, deep),
        "recurring": brand.recurring_rivals(judged, rivals), "groups": brand.group_status_mix(judged), "conflicts": brand.naming_journey_conflict(judged),
        "watch": brand.watch_span(rivals, setup), "priority": brand.presence_priority(judged), "deep_candidates": brand.deep_candidates(judged),
        "unmeasured": brand.unmeasured_list(judged, deep),
    }


def classification_report(index: DataFrame, nodes: DataFrame, seeds: DataFrame, terms: DataFrame, dictionary: DataFrame) -> Facts:
    """Candidates and checks for many runs at once, each with its own market, seed and names (see operators.classify).

    index: classify.source_index; nodes: run_id, query of the seed's own graph. The related queries of a run are those of a source intent:*.
    """
    spec = staged(classify.run_spec(seeds, terms))
    parsed = staged(classify.parse(index, spec, terms, dictionary))
    brands = staged(classify.brand_candidates(parsed))
    synonyms = staged(classify.synonym_candidates(parsed, brands, spec))
    peers = staged(classify.sibling_candidates(parsed, nodes, brands, spec))
    pool = staged(classify.name_pool(parsed, brands, synonyms, peers, terms, spec))
    own = parsed.where((F.col("item_at") > 0) & F.exists("srcs", lambda s: s.startswith("intent:")))
    modes = classify.composition(own, spec)
    items = terms.where("role = 'item'").select("run_id", "name")
    shares = classify.head_token_share(index, items)
    gate = classify.broad_gate(shares, spec)
    return {
        "parsed": parsed, "targets": classify.target_queries(parsed, spec), "brands": brands, "synonyms": synonyms,
        "expressions": classify.intent_expressions(parsed), "products": classify.product_candidates(parsed, brands), "peers": peers,
        "closeness": classify.closeness(peers, parsed, spec), "topics": classify.topic_candidates(parsed, brands),
        "spellings": classify.peer_spellings(peers.select("run_id", "name").unionByName(brands.select("run_id", "name")).distinct(), pool),
        "latin": classify.latin_pool(pool, spec), "modes": modes, "gate": gate, "fit": classify.seed_fit(own, gate, modes, spec),
        "lines": classify.product_lines(parsed, terms, "cluster"), "bundles": classify.intent_parts(parsed, terms, spec),
    }
