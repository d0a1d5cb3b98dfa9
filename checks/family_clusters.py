from pyspark.sql import functions as F

from querytide.operators import clusters as op

from .domain import Domain
from .sqlkit import check, piece

ENRICH, CONTEXT, FLOOR = 120, 100, 6  # caps that bite at every scale


def nodes(dom):
    return dom.stage("cluster nodes", lambda: op.cluster_nodes_table(dom.communities, dom.edges, dom.metrics))


def selection(dom):
    return op.enrich_selection(nodes(dom), ENRICH, FLOOR)


def context(dom):
    return dom.stage("cluster context", lambda: op.context_selection(nodes(dom), CONTEXT, FLOOR))


def on_nodes(f):
    return lambda s, d: f(nodes(Domain(s, d)))


piece("q_assign", """
SELECT *, chr(65+cidx) AS letter FROM (
  SELECT run_id, keyword, ord, (dense_rank() OVER (PARTITION BY run_id ORDER BY cluster_id::int)-1)::int AS cidx FROM q_communities)""")
piece("q_degree", """
SELECT run_id, keyword, count(*) AS degree FROM (SELECT run_id, a AS keyword FROM q_edges UNION ALL SELECT run_id, b FROM q_edges) GROUP BY ALL""")
piece("q_outpairs", """
SELECT DISTINCT e.run_id, e.keyword, x.letter, y.letter AS other FROM (
  SELECT run_id, a AS keyword, b AS o FROM q_edges UNION ALL SELECT run_id, b, a FROM q_edges) e
JOIN q_assign x ON x.run_id=e.run_id AND x.keyword=e.keyword JOIN q_assign y ON y.run_id=e.run_id AND y.keyword=e.o
WHERE x.letter <> y.letter""")
piece("q_cnodes", """
SELECT *, row_number() OVER (PARTITION BY run_id, letter ORDER BY degree DESC, volume_avg DESC, ord) = 1 AS is_hub FROM (
  SELECT a.*, volume_avg, i, n, c, t, coalesce(degree, 0) AS degree, coalesce(outs, 0) AS outs, coalesce(outgoing, '') AS outgoing
  FROM q_assign a JOIN q_metrics USING (run_id, keyword) LEFT JOIN q_degree USING (run_id, keyword)
  LEFT JOIN (SELECT run_id, keyword, count(*) AS outs, string_agg(other, '|' ORDER BY other) AS outgoing FROM q_outpairs GROUP BY ALL)
  USING (run_id, keyword))""")
piece("q_cout", """
SELECT run_id, letter, string_agg(other, '|' ORDER BY other) AS outgoing FROM (SELECT DISTINCT run_id, letter, other FROM q_outpairs) GROUP BY ALL""")
piece("q_selection", f"""
SELECT run_id, keyword, letter, degree, row_number() OVER (PARTITION BY run_id ORDER BY degree DESC, cidx, ord) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN depth<={FLOOR} THEN 0 ELSE 1 END,
    CASE WHEN depth<={FLOOR} THEN depth END, CASE WHEN depth<={FLOOR} THEN best END, grank) AS k FROM (
    SELECT *, min(grank) OVER (PARTITION BY run_id, letter) AS best FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id, letter ORDER BY degree DESC, cidx, ord) AS depth,
        row_number() OVER (PARTITION BY run_id ORDER BY degree DESC, cidx, ord) AS grank FROM q_cnodes))) WHERE k<={ENRICH}""")
piece("q_ccontext", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY tier, volume_avg DESC, cidx, ord) AS p FROM (
  SELECT n.*, CASE WHEN is_hub THEN 0 WHEN k<={FLOOR}-1 THEN 1 ELSE 2 END AS tier, known FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, letter, is_hub ORDER BY volume_avg DESC, cidx, ord) AS k,
      count(*) FILTER (volume_avg>0) OVER (PARTITION BY run_id) AS known FROM q_cnodes) n))
WHERE p <= least({CONTEXT}, CASE WHEN known>0 THEN known ELSE {CONTEXT} END)""")

check("C1_cluster_assignment", lambda s, d: op.assignment(Domain(s, d).communities).select("run_id", "keyword", "letter"),
      "SELECT run_id, keyword, letter FROM q_assign")
check("C2_edge_degree", lambda s, d: op.edge_degree(Domain(s, d).edges), "SELECT * FROM q_degree")


def _outgoing(s, d):
    dom = Domain(s, d)
    pairs = op.outgoing_pairs(dom.edges, op.assignment(dom.communities))
    return pairs.groupBy("run_id", "keyword").agg(F.array_join(F.array_sort(F.collect_set("other")), "|").alias("outgoing"))


check("C3_outgoing_clusters", _outgoing, "SELECT run_id, keyword, outgoing FROM q_cnodes WHERE outs>0")
check("C4_cluster_hub", on_nodes(lambda n: n.where("is_hub").select("run_id", "letter", "keyword", "degree", "volume_avg")),
      "SELECT run_id, letter, keyword, degree, volume_avg FROM q_cnodes WHERE is_hub")
check("C5_cluster_rollup", on_nodes(lambda n: op.cluster_rollup(n).withColumn("outgoing", F.array_join("outgoing", "|"))), """
SELECT run_id, letter, count(*) AS keyword_count, sum(volume_avg) AS volume, max(keyword) FILTER (is_hub) AS hub, any_value(o.outgoing) AS outgoing
FROM q_cnodes n LEFT JOIN q_cout o USING (run_id, letter) GROUP BY ALL""")
check("C6_enrich_selection", lambda s, d: selection(Domain(s, d)),
      "SELECT run_id, pos::int AS pos, keyword, letter, degree FROM q_selection")
check("C7_context_selection", lambda s, d: context(Domain(s, d)).select("run_id", "keyword", "letter", "volume_avg", "is_hub", "tier"),
      "SELECT run_id, keyword, letter, volume_avg, is_hub, tier FROM q_ccontext")


def _summary(s, d):
    dom = Domain(s, d)
    return op.context_summary(nodes(dom), dom.edges, dom.communities)


check("C8_cluster_context_summary", _summary, """
SELECT run_id, keyword_count, total_volume, cluster_count, edge_count FROM (
  SELECT run_id, count(*) AS keyword_count, sum(volume_avg) AS total_volume, count(DISTINCT letter) AS cluster_count FROM q_cnodes GROUP BY 1)
JOIN (SELECT run_id, count(*) AS edge_count FROM q_edges GROUP BY 1) USING (run_id)""")

# Labels that come from outside: three groups, one with an unknown cluster, one wholly unknown; three flows.
GROUPS = [("g0", ["A", "B"]), ("g1", ["C", "ZZ", "E", "D"]), ("g2", ["H", "F", "G"]), ("g3", ["ZZ"])]
FLOWS = [("f0", "A", ["A", "C", "B"]), ("f1", "D", ["D", "ZZ", "E"]), ("f2", "B", ["B", "ZZ"]), ("f3", "ZZ", ["E", "F"])]


def cluster_groups(dom):
    rows = [(g, k, letter) for g, letters in GROUPS for k, letter in enumerate(letters)]
    return dom.each_run(rows, "group_id string, gpos int, letter string")


def flows(dom):
    """The hub of a flow is the hub keyword of the named cluster."""
    named = dom.each_run([(f, h, ">".join(p)) for f, h, p in FLOWS], "flow_id string, letter string, path string").withColumn(
        "path", F.split("path", ">"))
    hubs = nodes(dom).where("is_hub").select("run_id", "letter", F.col("keyword").alias("hub"))
    return named.join(hubs, ["run_id", "letter"], "left").select("run_id", "flow_id", F.coalesce("hub", F.lit("")).alias("hub"), "path")


piece("q_cgroups", "SELECT * FROM (SELECT DISTINCT run_id FROM q_communities), (VALUES " + ",".join(
    f"('{g}',{k},'{x}')" for g, xs in GROUPS for k, x in enumerate(xs)) + ") v(group_id, gpos, letter)")
piece("q_cgmembers", """
SELECT g.run_id, g.group_id, x.keyword, x.volume_avg, x.cidx, x.ord FROM (SELECT DISTINCT run_id, group_id, letter FROM q_cgroups) g
JOIN q_ccontext x ON x.run_id=g.run_id AND x.letter=g.letter""")


def _cluster_groups(s, d):
    dom = Domain(s, d)
    out = op.group_rollup(cluster_groups(dom), nodes(dom), context(dom))
    return out.select("run_id", "group_id", "volume", "member_count", "cluster_count",
                      *[F.array_join(c, "|").alias(c) for c in ("evidence", "known_hubs", "hub_table")])


check("C9_cluster_group_rollup", _cluster_groups, """
SELECT * FROM (SELECT run_id, group_id, sum(volume_avg) AS volume, count(*) AS member_count,
  string_agg(keyword, '|' ORDER BY k) FILTER (k<=8) AS evidence FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, group_id ORDER BY volume_avg DESC, cidx, ord) AS k FROM q_cgmembers) GROUP BY ALL)
JOIN (SELECT g.run_id, g.group_id, count(*) AS cluster_count, coalesce(string_agg(n.keyword, '|' ORDER BY gpos) FILTER (x.keyword IS NOT NULL), '') AS known_hubs,
  coalesce(string_agg(n.keyword, '|' ORDER BY gpos) FILTER (x.keyword IS NOT NULL), string_agg(n.keyword, '|' ORDER BY gpos)) AS hub_table
  FROM q_cgroups g JOIN q_cnodes n ON n.run_id=g.run_id AND n.letter=g.letter AND is_hub
  LEFT JOIN q_ccontext x ON x.run_id=n.run_id AND x.keyword=n.keyword GROUP BY ALL) USING (run_id, group_id)""")


def _flows(s, d):
    dom = Domain(s, d)
    out = op.cluster_flows(flows(dom), nodes(dom), context(dom))
    return out.select("run_id", "flow_id", "hub", "hub_volume", "connectivity",
                      F.array_join(F.transform("steps", lambda x: F.concat_ws(":", x["letter"], x["hub"])), "|").alias("steps"))


piece("q_flows", "SELECT r.run_id, flow_id, coalesce(keyword, '') AS hub, path FROM (SELECT DISTINCT run_id FROM q_communities) r, (VALUES " + ",".join(
    f"('{f}','{h}',{p!r})" for f, h, p in FLOWS) + ") v(flow_id, letter, path) LEFT JOIN q_cnodes n ON n.run_id=r.run_id AND n.letter=v.letter AND is_hub")
check("C10_cluster_flows", _flows, """
SELECT s.*, x.volume_avg AS hub_volume, coalesce(outs, 0)::int AS connectivity FROM (
  SELECT f.run_id, flow_id, hub, string_agg(n.letter || ':' || n.keyword, '|' ORDER BY step) AS steps, count(*) AS k FROM (
    SELECT run_id, flow_id, hub, unnest(path) AS letter, generate_subscripts(path, 1) AS step FROM q_flows) f
  JOIN q_cnodes n ON n.run_id=f.run_id AND n.letter=f.letter AND is_hub GROUP BY ALL) s
LEFT JOIN q_ccontext x ON x.run_id=s.run_id AND x.keyword=s.hub WHERE s.k>=2""".replace("SELECT s.*,", "SELECT s.run_id, flow_id, s.hub, steps,"))
