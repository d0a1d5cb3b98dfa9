from pyspark.sql import functions as F

from querytide.operators import journeys as op

from .domain import Domain
from .family_opportunity import dominant
from .sqlkit import check, piece


def parts(dom):
    """journeys, edges, nodes, ranked journeys"""
    journeys = dom.journeys
    edges = dom.stage("journey edges", lambda: op.journey_edges(journeys))
    nodes = dom.stage("journey nodes", lambda: op.journey_nodes(journeys, edges, dom.metrics))
    return journeys, edges, nodes, op.rank_journeys(journeys, nodes)


def with_parts(f):
    return lambda s, d: f(*parts(Domain(s, d)))


piece("q_jedges", """
SELECT run_id, src, dst, count(*) AS weight, min(path_id*1000+pos) AS seen FROM (
  SELECT run_id, path_id, pos, node AS src, lead(node) OVER (PARTITION BY run_id, path_id ORDER BY pos) AS dst FROM q_steps)
WHERE dst IS NOT NULL GROUP BY ALL""")
piece("q_jnodes", f"""
SELECT *, {dominant()} AS primary_intent FROM (
  SELECT run_id, node AS keyword, count(DISTINCT path_id) AS path_count, min(path_id*1000+pos) AS seen FROM q_steps GROUP BY ALL)
LEFT JOIN (SELECT run_id, src AS keyword, count(*) AS out_degree, sum(weight)::bigint AS out_weight FROM q_jedges GROUP BY ALL) o USING (run_id, keyword)
LEFT JOIN (SELECT run_id, dst AS keyword, count(*) AS in_degree FROM q_jedges GROUP BY ALL) d USING (run_id, keyword)
JOIN (SELECT run_id, keyword, volume_avg, volume_trend, i, n, c, t FROM q_metrics) USING (run_id, keyword)""")
piece("q_jnodes0", "SELECT * REPLACE (coalesce(out_degree,0) AS out_degree, coalesce(out_weight,0) AS out_weight, coalesce(in_degree,0) AS in_degree) FROM q_jnodes")
piece("q_jranked", """
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY total_volume DESC, hops DESC, path_id) AS rn FROM (
  SELECT run_id, path_id, list(node ORDER BY pos) AS seq, sum(volume_avg) AS total_volume, count(*)::int AS hops
  FROM q_steps s JOIN q_metrics m ON m.run_id=s.run_id AND m.keyword=s.node GROUP BY ALL)""".replace(
    "SELECT run_id, path_id, list", "SELECT s.run_id, path_id, list"))
piece("q_jdown", """
SELECT run_id, src, dst, weight, volume_avg, pos FROM (
  SELECT e.*, volume_avg, row_number() OVER (PARTITION BY e.run_id, src ORDER BY volume_avg DESC, e.seen) AS pos
  FROM q_jedges e JOIN q_metrics m ON m.run_id=e.run_id AND m.keyword=e.dst) WHERE pos<=6""")
piece("q_jhubs", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY out_degree DESC, volume_avg DESC, path_count DESC, seen) AS pos
  FROM q_jnodes0 WHERE out_degree>=2) WHERE pos<=40""")
check("D1_journey_edges", with_parts(lambda j, e, n, r: e.drop("seen")), "SELECT run_id, src, dst, weight FROM q_jedges")
NODE_COLS = "run_id, keyword, path_count, out_degree, in_degree, out_weight, volume_avg, volume_trend, i, n, c, t, primary_intent"
check("D2_journey_nodes", with_parts(lambda j, e, n, r: n.drop("seen")), f"SELECT {NODE_COLS} FROM q_jnodes0")
check("D3_rank_journeys", with_parts(lambda j, e, n, r: r.select("run_id", "path_id", "total_volume", "hops", F.array_join("seq", ">").alias("seq"))),
      "SELECT run_id, path_id, total_volume, hops, array_to_string(seq, '>') AS seq FROM q_jranked")
check("D4_branch_hubs", with_parts(lambda j, e, n, r: op.branch_hubs(n).select("run_id", "pos", "keyword", "out_degree", "volume_avg", "path_count")),
      "SELECT run_id, pos::int AS pos, keyword, out_degree, volume_avg, path_count FROM q_jhubs")
check("D5_downstream_list", with_parts(lambda j, e, n, r: op.downstream_list(e, n)),
      "SELECT run_id, src, dst, weight, volume_avg, pos::int AS pos FROM q_jdown")

piece("q_prefixes", """
SELECT p.*, volume_avg, primary_intent FROM (
  SELECT run_id, array_to_string(seq[1:d], '>') AS prefix, CASE WHEN d=1 THEN '' ELSE array_to_string(seq[1:d-1], '>') END AS parent,
    d AS depth, seq[d] AS keyword, count(*) AS count, min(rn) AS first
  FROM (SELECT * FROM q_jranked WHERE rn<=24), (SELECT unnest([1,2,3,4]) AS d) WHERE d<=hops GROUP BY ALL) p
JOIN q_jnodes0 n ON n.run_id=p.run_id AND n.keyword=p.keyword""")
for _d in range(1, 5):
    _under = "" if _d == 1 else f"AND EXISTS (FROM q_level{_d - 1} u WHERE u.run_id=p.run_id AND u.prefix=p.parent)"
    piece(f"q_level{_d}", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, parent ORDER BY volume_avg DESC, count DESC, first) AS pos
  FROM q_prefixes p WHERE depth={_d} {_under}) WHERE pos<={5 if _d == 1 else 4}""")
check("D6_flow_tree", with_parts(lambda j, e, n, r: op.flow_tree(r, n).withColumn("prefix", F.array_join("prefix", ">")).drop("parent")),
      " UNION ALL ".join(f"SELECT run_id, prefix, depth, pos::int AS pos, keyword, count, volume_avg, primary_intent FROM q_level{d}" for d in range(1, 5)))
check("D7_journey_context_summary", with_parts(lambda j, e, n, r: op.context_summary(j, e, n)), f"""
SELECT run_id, node_count, path_count, edge_count, hub_count, total_volume, primary_intent FROM (
  SELECT run_id, count(*) AS node_count, count(*) FILTER (out_degree>=2) AS hub_count, sum(volume_avg) AS total_volume,
    {dominant('sum(i)', 'sum(n)', 'sum(c)', 'sum(t)')} AS primary_intent FROM q_jnodes0 GROUP BY 1)
JOIN (SELECT run_id, count(*) AS path_count FROM q_journeys GROUP BY 1) USING (run_id)
JOIN (SELECT run_id, count(*) AS edge_count FROM q_jedges GROUP BY 1) USING (run_id)""")


def picks(j):
    """Every journey as a picked one; the flow label follows its length, one node is made up."""
    k = F.size("seq") % 4
    flow = F.when(k == 0, " Conversion").when(k == 1, "comparison").when(k == 2, "risk").otherwise("detour")
    return j.select("run_id", F.col("path_id").alias("pick_id"), flow.alias("flow_type"),
                    F.concat("seq", F.array(F.lit("made up"))).alias("seq"), F.col("seq").alias("evidence"))


def _cards(j, e, n, r):
    out = op.journey_cards(picks(j), n)
    return out.select("run_id", "pick_id", "flow_type", "flow_order", "volume", "hops",
                      F.array_join("nodes", ">").alias("nodes"), F.array_join("evidence", "|").alias("evidence"))


check("D8_journey_group_facts", with_parts(_cards), """
SELECT run_id, pick_id, flow_type, CASE flow_type WHEN 'conversion' THEN 0 WHEN 'risk' THEN 2 ELSE 1 END AS flow_order, volume, hops, nodes, evidence FROM (
  SELECT s.run_id, path_id AS pick_id, CASE count(*)%4 WHEN 0 THEN 'conversion' WHEN 2 THEN 'risk' ELSE 'comparison' END AS flow_type,
    sum(volume_avg) AS volume, count(*) AS hops, string_agg(node, '>' ORDER BY pos) AS nodes, string_agg(node, '|' ORDER BY k) FILTER (k<=8) AS evidence
  FROM (SELECT s.*, volume_avg, row_number() OVER (PARTITION BY s.run_id, path_id ORDER BY volume_avg DESC, pos) AS k
    FROM q_steps s JOIN q_metrics m ON m.run_id=s.run_id AND m.keyword=s.node) s GROUP BY ALL) WHERE hops>=2""")


def _hub_cards(j, e, n, r):
    named = op.branch_hubs(n).select("run_id", "keyword")
    named = named.unionByName(named.select("run_id", F.lit("made up").alias("keyword")).distinct())
    return op.hub_cards(named, n, e).withColumn("downstream", F.array_join("downstream", "|"))


check("D9_journey_hub_facts", with_parts(_hub_cards), """
SELECT h.run_id, keyword, h.volume_avg, out_degree, downstream FROM q_jhubs h LEFT JOIN (
  SELECT run_id, src, string_agg(dst, '|' ORDER BY pos) AS downstream FROM q_jdown GROUP BY ALL) d ON d.run_id=h.run_id AND d.src=h.keyword""")
