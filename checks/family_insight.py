from pyspark.sql import functions as F

from querytide.functions import rank
from querytide.operators import clusters, insight as op, journeys, opportunity

from . import family_clusters as fc, family_journeys as fj
from .domain import Domain
from .sqlkit import R, check, piece

FLOW_PAIRS = [("A", "C"), ("C", "B"), ("D", "E"), ("E", "F")]


class Insight:
    """The inputs of this family for one domain, each table built once."""

    def __init__(self, dom):
        self.dom = dom
        self.journeys, self.edges, self.path, _ = fj.parts(dom)
        self.cnodes, self.ccontext = fc.nodes(dom), fc.context(dom)
        self.groups = dom.groups.withColumnRenamed("gord", "gpos")
        q = dom.stage("query", lambda: opportunity.context_rows(dom.query))
        self.query = q
        self.pq = dom.members.join(q.select("run_id", "keyword"), ["run_id", "keyword"], "left_semi").join(
            F.broadcast(self.groups), "group_id")
        self.pc = clusters.group_members(fc.cluster_groups(dom), self.cnodes, self.ccontext).withColumn(
            "gpos", F.substring("group_id", 2, 1).cast("int"))

    @property
    def master(self):
        return self.dom.stage("master", lambda: op.finder_master(
            self.query, self.path, self.ccontext, self.cnodes, self.pq, self.pc))

    @property
    def stages(self):
        return self.dom.stage("stages", lambda: op.journey_stage(self.master, self.journeys))

    @property
    def cells(self):
        return self.dom.stage("cells", lambda: op.persona_stage_matrix(self.pc, self.stages))

    @property
    def divergent(self):
        return self.dom.stage("divergent", lambda: op.hub_divergence(self.master))

    @property
    def conc(self):
        return op.downstream_concentration(journeys.downstream_list(self.edges, self.path), self.master)

    @property
    def leaks(self):
        return self.dom.stage("leaks", lambda: op.value_leak(
            self.master, self.conc, self.pq.where(F.col("relation") == "alternative")))

    @property
    def gaps(self):
        return self.dom.stage("gaps", lambda: op.gap_buckets(self.master))

    @property
    def bridges(self):
        pairs = self.dom.each_run(FLOW_PAIRS, "a string, b string")
        return self.dom.stage("bridges", lambda: op.corridor_bridges(self.master, self.edges, pairs))

    @property
    def bridge_kw(self):
        return op.bridge_keyword(self.bridges, self.master, self.cnodes.where("is_hub"))

    @property
    def items(self):
        return self.dom.stage("items", lambda: op.priority_score(self.master, self.leaks, self.gaps))

    @property
    def buckets(self):
        return self.dom.stage("buckets", lambda: op.bucketed(self.items))

    @property
    def safe(self):
        return op.safe_points(self.leaks)


def on(f):
    return lambda s, d: f(Insight(Domain(s, d)))


def mm(x, lo, hi):
    return f"CASE WHEN {hi}>{lo} THEN least(greatest(({x}-{lo})/({hi}-{lo}),0.0),1.0) WHEN {hi}>0 THEN 1.0 ELSE 0.0 END"


def mmw(x):
    return mm(x, f"min({x}) OVER (PARTITION BY run_id)", f"max({x}) OVER (PARTITION BY run_id)")


piece("q_q1000", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY volume_avg DESC, ord) AS pos FROM q_query) WHERE pos<=1000")
piece("q_pq", "SELECT m.run_id, m.keyword, g.* FROM q_members m SEMI JOIN q_q1000 USING (run_id, keyword) JOIN q_groups g ON g.group_id=m.group_id")
piece("q_pc", "SELECT *, substr(group_id,2,1)::int AS gpos FROM q_cgmembers")
piece("q_keys", "SELECT run_id, keyword FROM q_q1000 UNION SELECT run_id, keyword FROM q_jnodes0 UNION SELECT run_id, keyword FROM q_cnodes")


def pick(x):
    return f"coalesce(CASE WHEN q.keyword IS NOT NULL THEN q.{x} WHEN p.keyword IS NOT NULL THEN p.{x} WHEN l.keyword IS NOT NULL THEN l.{x} END, 0.0) AS {x}"


piece("q_master", f"""
SELECT *, CASE WHEN i+n+c+t>0 THEN (0.2*i + 0.0*n + 0.5*c + 1.0*t)/(i+n+c+t) ELSE 0.0 END AS m,
  CASE WHEN greatest(i,n,c,t)<=0 THEN '' WHEN i=greatest(i,n,c,t) THEN 'i' WHEN n=greatest(i,n,c,t) THEN 'n' WHEN c=greatest(i,n,c,t) THEN 'c' ELSE 't' END AS dominant
FROM (SELECT k.run_id, k.keyword, q.keyword IS NOT NULL AS q_present, p.keyword IS NOT NULL AS p_present, a.keyword IS NOT NULL AS c_present,
  coalesce(q.volume_avg,0) AS q_vol, coalesce(p.volume_avg,0) AS p_vol, coalesce(l.volume_avg,0) AS c_vol,
  coalesce(nullif(q.volume_avg,0), nullif(p.volume_avg,0), nullif(l.volume_avg,0), 0) AS volume,
  (q.keyword IS NOT NULL OR p.keyword IS NOT NULL OR l.keyword IS NOT NULL) AS has_intents, {pick('i')}, {pick('n')}, {pick('c')}, {pick('t')},
  CASE WHEN q.keyword IS NOT NULL THEN q.volume_trend WHEN p.keyword IS NOT NULL THEN p.volume_trend ELSE 0.0 END AS trend,
  coalesce(p.out_degree,0) AS out_degree, coalesce(p.in_degree,0) AS in_degree, coalesce(p.path_count,0) AS path_count,
  coalesce(a.letter,'') AS cluster, coalesce(l.is_hub,false) AS is_hub, coalesce(l.outs,0) AS outs,
  coalesce(x.group_id, y.group_id, '') AS persona
FROM q_keys k LEFT JOIN q_q1000 q ON q.run_id=k.run_id AND q.keyword=k.keyword
LEFT JOIN q_jnodes0 p ON p.run_id=k.run_id AND p.keyword=k.keyword
LEFT JOIN q_cnodes a ON a.run_id=k.run_id AND a.keyword=k.keyword
LEFT JOIN q_ccontext l ON l.run_id=k.run_id AND l.keyword=k.keyword
LEFT JOIN (SELECT run_id, keyword, arg_min(group_id, gpos) AS group_id FROM q_pc GROUP BY ALL) x ON x.run_id=k.run_id AND x.keyword=k.keyword
LEFT JOIN (SELECT run_id, keyword, arg_min(group_id, gord) AS group_id FROM q_pq GROUP BY ALL) y ON y.run_id=k.run_id AND y.keyword=k.keyword)""")
MASTER = "run_id, keyword, q_present, p_present, c_present, q_vol, p_vol, c_vol, volume, has_intents, i, n, c, t, trend, out_degree, in_degree, path_count, cluster, is_hub, persona, dominant"
check("E1_finder_master_join", on(lambda x: x.master.select(
    *MASTER.split(", "), F.size("outgoing").cast("long").alias("outs"), F.round("m", 9).alias("m"))),
    f"SELECT {MASTER}, outs, round(m, 9) AS m FROM q_master")
check("E2_coverage_combos", on(lambda x: op.coverage_combos(x.master)), """
SELECT run_id, (CASE WHEN q_present THEN 'Q' ELSE '' END) || (CASE WHEN p_present THEN 'P' ELSE '' END) || (CASE WHEN c_present THEN 'C' ELSE '' END) AS combo,
  count(*) AS count, sum(volume) AS volume FROM q_master GROUP BY ALL""")
piece("q_gaps", """
SELECT *, row_number() OVER (PARTITION BY run_id, bucket ORDER BY volume DESC, keyword) AS pos FROM (
  SELECT run_id, 'q_not_p' AS bucket, keyword, volume, m, trend, cluster FROM q_master WHERE q_present AND NOT p_present UNION ALL
  SELECT run_id, 'q_not_c', keyword, volume, m, trend, cluster FROM q_master WHERE q_present AND NOT c_present UNION ALL
  SELECT run_id, 'struct_not_q', keyword, volume, m, trend, cluster FROM q_master WHERE (p_present OR c_present) AND NOT q_present)""")
check("E3_gap_buckets", on(lambda x: x.gaps.withColumn("m", F.round("m", 9))), "SELECT * REPLACE (round(m,9) AS m) FROM q_gaps")


def _mismatch(x):
    """Sources that disagree: the cluster answer is read with the yearly average rounded down to tens."""
    m = x.master.withColumn("c_vol", F.floor(F.col("c_vol") / 50) * 50.0)
    return op.volume_mismatch(m)


check("E4_volume_mismatch", on(_mismatch), f"""
SELECT run_id, keyword, q_vol, p_vol, c_vol, {R('(hi-lo)/hi', 3)} AS spread FROM (
  SELECT *, greatest(q_vol,p_vol,c_vol) AS hi, least(coalesce(nullif(q_vol,0),1e18), coalesce(nullif(p_vol,0),1e18), coalesce(nullif(c_vol,0),1e18)) AS lo,
    (q_vol>0)::int + (p_vol>0)::int + (c_vol>0)::int AS k FROM (SELECT * REPLACE (floor(c_vol/50)*50.0 AS c_vol) FROM q_master))
WHERE k>=2 AND (hi-lo)/hi > 0.10""")
COV = "sum(volume) AS total, sum(CASE WHEN q_present AND p_present AND c_present THEN volume ELSE 0.0 END) AS covered"
piece("q_coverage", f"""
SELECT *, coalesce({R('100.0*covered/nullif(total,0)', 1)}, 0.0) AS coverage_pct FROM (
  SELECT run_id, '' AS group_id, {COV} FROM q_master GROUP BY ALL UNION ALL
  SELECT m.run_id, group_id, {COV} FROM q_pc p JOIN q_master m USING (run_id, keyword) GROUP BY ALL)""")
check("E5_coverage_pct", on(lambda x: op.coverage_pct(x.master, x.pc)), "SELECT * FROM q_coverage")


def pctrank(v, where, part="run_id"):
    lt = f"(rank() OVER (PARTITION BY {part}, {where} ORDER BY {v})-1)"
    le = f"(count(*) OVER (PARTITION BY {part}, {where} ORDER BY {v} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
    size = f"count(*) OVER (PARTITION BY {part}, {where})"
    return f"CASE WHEN NOT ({where}) THEN NULL WHEN {size}=1 THEN 1.0 ELSE ({lt}+{le})/2/{size} END"


check("E6_pct_rank_mid", on(lambda x: rank.pct_rank_mid(x.path.select("run_id", "keyword", "out_degree"), ["run_id"], {"pct": "out_degree"}).withColumn(
    "pct", F.round("pct", 9))), f"SELECT run_id, keyword, out_degree, round({pctrank('out_degree', 'true')}, 9) AS pct FROM q_jnodes0")
piece("q_ranked", f"""
SELECT *, {R(pctrank('out_degree', 'p_present'), 4)} AS journey_rank, {R(pctrank('(is_hub::int+outs)', 'c_present'), 4)} AS connectivity_rank,
  {R(pctrank('(q_vol*m)', 'q_present'), 4)} AS demand_rank FROM q_master""")
piece("q_divergent", f"""
SELECT run_id, keyword, journey_rank, connectivity_rank, demand_rank,
  {R('greatest(journey_rank,connectivity_rank,demand_rank)-least(journey_rank,connectivity_rank,demand_rank)', 4)} AS dispersion,
  CASE WHEN k=3 AND hi=3 THEN 'TRIPLE_ANCHOR' WHEN hi=1 THEN 'BIASED' WHEN hi>=1 AND low<>'' THEN 'HALF' ELSE 'MIXED' END AS type,
  CASE WHEN absent<>'' THEN absent ELSE low END AS missing_axis, volume, is_hub, out_degree
FROM (SELECT *, p_present::int+c_present::int+q_present::int AS k,
  coalesce((journey_rank>=0.66)::int,0)+coalesce((connectivity_rank>=0.66)::int,0)+coalesce((demand_rank>=0.66)::int,0) AS hi,
  CASE WHEN journey_rank<0.4 THEN 'journey' WHEN connectivity_rank<0.4 THEN 'connectivity' WHEN demand_rank<0.4 THEN 'demand' ELSE '' END AS low,
  CASE WHEN NOT p_present THEN 'journey' WHEN NOT c_present THEN 'connectivity' WHEN NOT q_present THEN 'demand' ELSE '' END AS absent FROM q_ranked)
WHERE k>=2""")
check("E7_hub_divergence", on(lambda x: x.divergent), "SELECT * FROM q_divergent")
piece("q_stages", """
SELECT m.*, CASE WHEN place<0.34 THEN 'entry' WHEN place<0.67 THEN 'mid' WHEN place IS NOT NULL THEN 'exit'
  WHEN dominant IN ('i','n') THEN 'entry' WHEN dominant='t' THEN 'exit' ELSE 'mid' END AS stage
FROM q_master m LEFT JOIN (SELECT s.run_id, node AS keyword, avg(pos/(hops-1)) AS place FROM q_steps s JOIN q_jranked USING (run_id, path_id) WHERE hops>=2 GROUP BY ALL) USING (run_id, keyword)""")
check("E8_journey_stage", on(lambda x: x.stages.select("run_id", "keyword", "stage")), "SELECT run_id, keyword, stage FROM q_stages")
piece("q_cellrows", """
SELECT p.group_id, s.*, CASE dominant WHEN 'i' THEN 'guide' WHEN 'n' THEN 'brand' WHEN 'c' THEN 'compare' WHEN 't' THEN 'product' END AS format
FROM q_pc p JOIN q_stages s USING (run_id, keyword)""")
piece("q_cells", """
SELECT run_id, group_id, stage, coalesce(volume,0.0) AS volume, coalesce(mv/nullif(volume,0),0.0) AS avg_m, top_keywords, format_mix FROM
  (SELECT * FROM (SELECT DISTINCT run_id, group_id FROM q_pc), (SELECT unnest(['entry','mid','exit']) AS stage))
LEFT JOIN (SELECT run_id, group_id, stage, sum(volume) AS volume, sum(m*volume) AS mv, string_agg(keyword,'|' ORDER BY k) FILTER (k<=5) AS top_keywords
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, group_id, stage ORDER BY volume DESC, keyword) AS k FROM q_cellrows) GROUP BY ALL) USING (run_id, group_id, stage)
LEFT JOIN (SELECT run_id, group_id, stage, string_agg(format || ':' || n, '|' ORDER BY n DESC, format) AS format_mix FROM (
  SELECT run_id, group_id, stage, format, count(*) AS n FROM q_cellrows WHERE format IS NOT NULL GROUP BY ALL) GROUP BY ALL) USING (run_id, group_id, stage)""")
check("E9_persona_stage_matrix", on(lambda x: x.cells.select(
    "run_id", "group_id", "stage", "volume", F.round("avg_m", 8).alias("avg_m"), F.array_join("top_keywords", "|").alias("top_keywords"),
    F.array_join(F.transform("format_mix", lambda f: F.concat_ws(":", f["format"], f["count"].cast("string"))), "|").alias("format_mix"))),
    "SELECT * REPLACE (round(avg_m, 8) AS avg_m) FROM q_cells")
piece("q_bystage", "SELECT run_id, group_id, " + ", ".join(
    f"max({c}) FILTER (stage='{s}') AS {s}_{c}" for s in op.STAGES for c in ("volume", "avg_m")) + " FROM q_cells GROUP BY ALL")


def _sparse(cells):
    """The matrix with the middle stage of one group emptied, so that a gap exists."""
    drop = (F.col("group_id") == "g1") & (F.col("stage") == "mid")
    return cells.withColumn("volume", F.when(drop, 0.0).otherwise(F.col("volume")))


check("E10_matrix_gap_cells", on(lambda x: op.matrix_gap_cells(_sparse(x.cells))), """
SELECT * FROM (SELECT run_id, group_id, stage, greatest(coalesce(lag(v) OVER w, 0), coalesce(lead(v) OVER w, 0)) AS severity, v FROM (
  SELECT *, CASE WHEN group_id='g1' AND stage='mid' THEN 0.0 ELSE volume END AS v FROM q_cells)
  WINDOW w AS (PARTITION BY run_id, group_id ORDER BY CASE stage WHEN 'entry' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END))
WHERE v=0 AND severity>0""".replace("SELECT * FROM (SELECT run_id", "SELECT run_id, group_id, stage, severity FROM (SELECT run_id", 1))
check("E11_persona_leak", on(lambda x: op.persona_leak(x.cells)), f"""
SELECT run_id, group_id, CASE WHEN e-m>=m-x THEN 'entry' ELSE 'mid' END AS leakiest, {R('greatest(e-m, m-x, 0.0)', 4)} AS dropoff,
  {R('e', 4)} AS entry_share, {R('m', 4)} AS mid_share, {R('x', 4)} AS exit_share FROM (
  SELECT run_id, group_id, entry_volume/s AS e, mid_volume/s AS m, exit_volume/s AS x FROM (
    SELECT *, coalesce(nullif(entry_volume+mid_volume+exit_volume,0),1.0) AS s FROM q_bystage))""")
check("E12_intent_slope", on(lambda x: op.intent_slope(x.cells)), f"""
SELECT run_id, group_id, {R('entry_avg_m', 4)} AS entry_m, {R('mid_avg_m', 4)} AS mid_m, {R('exit_avg_m', 4)} AS exit_m,
  {R('exit_avg_m-entry_avg_m', 4)} AS slope FROM q_bystage""")
check("E13_min_max_norm", on(lambda x: rank.with_min_max(x.master.select("run_id", "keyword", "volume"), ["run_id"], "volume", "norm").withColumn(
    "norm", F.round("norm", 9))), f"SELECT run_id, keyword, volume, round({mmw('volume')}, 9) AS norm FROM q_master")
piece("q_conc", f"""
SELECT d.run_id, d.src AS keyword, {R('sum(m.volume*m.volume)/(sum(m.volume)*sum(m.volume))', 3)} AS concentration
FROM q_jdown d JOIN q_master m ON m.run_id=d.run_id AND m.keyword=d.dst WHERE m.volume>0 GROUP BY ALL""")
piece("q_leaks", f"""
SELECT run_id, keyword, {R('m', 4)} AS opp, volume, {R('lfn', 4)} AS leak_factor, {R(mmw('raw'), 4)} AS leak_score,
  CASE WHEN dominant IN ('t','c') AND out_degree=0 AND path_count>=2 THEN 'deadend' ELSE 'leak' END AS type,
  out_degree, in_degree, path_count, concentration, persona, is_brand, trend
FROM (SELECT *, m*volume*lfn AS raw FROM (SELECT *, {mmw('lf')} AS lfn FROM (SELECT *, out_degree/(in_degree+1) AS lf FROM q_master
  WHERE p_present AND q_present AND has_intents)))
LEFT JOIN q_conc USING (run_id, keyword)
LEFT JOIN (SELECT DISTINCT run_id, keyword, true AS b FROM q_pq WHERE relation='alternative') USING (run_id, keyword)""".replace(
    "persona, is_brand", "persona, coalesce(b, false) AS is_brand"))
check("E14_value_leak", on(lambda x: x.leaks), "SELECT * FROM q_leaks")
check("E15_downstream_concentration", on(lambda x: x.conc), "SELECT * FROM q_conc")
piece("q_safe", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY opp DESC, volume DESC, leak_score DESC, keyword) AS pos FROM (
  SELECT *, median(opp) OVER (PARTITION BY run_id) AS med FROM q_leaks) WHERE opp>=med AND leak_factor<=0.34 AND in_degree>=1) WHERE pos<=8""")
check("E16_safe_points", on(lambda x: x.safe), "SELECT run_id, pos::int AS pos, keyword, opp, volume, leak_factor, in_degree, persona FROM q_safe")
check("E17_brand_defense", on(lambda x: op.brand_defense(x.leaks)), "SELECT run_id, keyword, opp, volume, leak_score FROM q_leaks WHERE is_brand")
piece("q_clinks", "SELECT p.run_id, p.keyword, p.letter, p.other FROM q_outpairs p SEMI JOIN q_ccontext c ON c.run_id=p.run_id AND c.keyword=p.keyword")
piece("q_bridges0", """
SELECT DISTINCT run_id, least(a,b) AS x, greatest(a,b) AS y FROM (SELECT run_id, letter AS a, other AS b FROM q_clinks UNION ALL
  SELECT run_id, a, b FROM (SELECT DISTINCT run_id FROM q_communities), (VALUES """ + ",".join(f"('{a}','{b}')" for a, b in FLOW_PAIRS) + ") v(a,b))")
piece("q_moves", """
SELECT run_id, least(cs,cd) AS x, greatest(cs,cd) AS y, sum(CASE WHEN cs<cd THEN weight ELSE 0 END)::bigint AS xy, sum(CASE WHEN cs>cd THEN weight ELSE 0 END)::bigint AS yx FROM (
  SELECT e.run_id, weight, s.letter AS cs, d.letter AS cd FROM q_jedges e JOIN q_cnodes s ON s.run_id=e.run_id AND s.keyword=e.src
  JOIN q_cnodes d ON d.run_id=e.run_id AND d.keyword=e.dst) WHERE cs<>cd GROUP BY ALL""")
piece("q_cm", "SELECT run_id, cluster, coalesce(sum(m*volume)/nullif(sum(volume),0),0.0) AS cm FROM q_master WHERE has_intents AND c_present GROUP BY ALL")
piece("q_bridges", f"""
SELECT *, CASE WHEN total=0 THEN 'false_adjacency' WHEN total<2 THEN 'inconclusive' WHEN intent_delta<0 THEN 'substitute_leak'
  WHEN directionality>=0.34 THEN 'corridor' ELSE 'inconclusive' END AS verdict
FROM (SELECT b.run_id, b."from", b."to", fwd, rev, total, coalesce({R('(fwd-rev)/nullif(total,0)', 4)}, 0.0) AS directionality,
  {R(mm('total', 'min(total) OVER (PARTITION BY b.run_id)', 'max(total) OVER (PARTITION BY b.run_id)'), 4)} AS strength,
  {R('coalesce(t.cm,0.0)-coalesce(f.cm,0.0)', 4)} AS intent_delta
  FROM (SELECT run_id, CASE WHEN yx>xy THEN y ELSE x END AS "from", CASE WHEN yx>xy THEN x ELSE y END AS "to", greatest(xy,yx) AS fwd, least(xy,yx) AS rev, xy+yx AS total
    FROM (SELECT run_id, x, y, coalesce(xy,0) AS xy, coalesce(yx,0) AS yx FROM q_bridges0 LEFT JOIN q_moves USING (run_id, x, y))) b
  LEFT JOIN q_cm f ON f.run_id=b.run_id AND f.cluster=b."from" LEFT JOIN q_cm t ON t.run_id=b.run_id AND t.cluster=b."to")""")
check("E18_corridor_bridges", on(lambda x: x.bridges), "SELECT * FROM q_bridges")
piece("q_bridgekw", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, "from", "to" ORDER BY tier, vol DESC, keyword) AS k FROM (
  SELECT b.run_id, "from", "to", fwd, rev, verdict, CASE WHEN n.keyword=h.keyword THEN 0 ELSE 2 END + side AS tier, m.volume AS vol, n.keyword
  FROM (SELECT *, 0 AS side, "from" AS here, "to" AS there FROM q_bridges UNION ALL SELECT *, 1, "to", "from" FROM q_bridges) b
  JOIN q_clinks n ON n.run_id=b.run_id AND n.letter=here AND n.other=there JOIN q_master m ON m.run_id=n.run_id AND m.keyword=n.keyword
  LEFT JOIN q_cnodes h ON h.run_id=b.run_id AND h.letter=here AND h.is_hub
  UNION ALL SELECT b.run_id, "from", "to", fwd, rev, verdict, 4 + (h.letter="to")::int, 0.0, h.keyword FROM q_bridges b
  JOIN q_cnodes h ON h.run_id=b.run_id AND h.is_hub AND h.letter IN ("from","to"))) WHERE k=1""")
check("E19_bridge_keyword", on(lambda x: x.bridge_kw.select("run_id", "from", "to", "fwd", "rev", "verdict", "bridge_keyword")),
      'SELECT run_id, "from", "to", fwd, rev, verdict, keyword AS bridge_keyword FROM q_bridgekw')
piece("q_items", f"""
SELECT *, {R(mmw('raw_score'), 4)} AS score FROM (SELECT *, num_norm/(structure+0.2) AS raw_score FROM (SELECT *, {mmw('num')} AS num_norm FROM (
  SELECT *, volume*m*(1.0+greatest(0.0,momentum))*(1.0+leak+CASE WHEN in_gap THEN 0.5 ELSE 0.0 END) AS num FROM (
    SELECT x.*, CASE WHEN q_present OR p_present THEN greatest(-1.0, least(1.0, x.trend/30.0)) ELSE 0.0 END AS momentum,
      coalesce(leak_score,0.0) AS leak, g.keyword IS NOT NULL AS in_gap, l.keyword IS NOT NULL AS in_leak, coalesce(is_brand,false) AS is_brand
    FROM (SELECT *, 0.6*({mmw('j')}) + 0.4*({mmw('cc')}) AS structure FROM (SELECT *, path_count*(1+out_degree) AS j, is_hub::int+outs AS cc FROM q_master)) x
    LEFT JOIN q_leaks l ON l.run_id=x.run_id AND l.keyword=x.keyword
    LEFT JOIN (SELECT DISTINCT run_id, keyword FROM q_gaps) g ON g.run_id=x.run_id AND g.keyword=x.keyword WHERE x.volume>0))))""")
ITEM = "run_id, keyword, volume, is_hub, persona, score, in_gap, in_leak, is_brand"
check("E20_priority_score", on(lambda x: x.items.select(*ITEM.split(", "), *[F.round(c, 8).alias(c) for c in ("structure", "momentum", "num_norm")])),
      f"SELECT {ITEM}, round(structure,8) AS structure, round(momentum,8) AS momentum, round(num_norm,8) AS num_norm FROM q_items")
piece("q_buckets", f"""
SELECT *, CASE strand WHEN 'quickwin' THEN 'now' WHEN 'build' THEN 'next' ELSE 'later' END AS bucket FROM (
  SELECT *, CASE WHEN structure<0.05 AND m>0 THEN 'orphan' WHEN momentum>0.2 AND NOT is_hub AND trend>0 THEN 'preempt'
    WHEN tier='high' AND momentum>=0 AND num_norm>=med THEN 'quickwin' WHEN tier IN ('high','mid') AND (num_norm>=med OR score>=0.5) THEN 'build'
    WHEN tier='low' THEN 'orphan' ELSE 'build' END AS strand
  FROM (SELECT *, CASE WHEN r>=0.66 THEN 'high' WHEN r>=0.33 THEN 'mid' ELSE 'low' END AS tier FROM (
    SELECT *, {pctrank('structure', 'true')} AS r, median(num_norm) OVER (PARTITION BY run_id) AS med FROM q_items)))""")
piece("q_backlog", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, bucket ORDER BY score DESC, keyword) AS rank FROM q_buckets) WHERE rank<=5""")
check("E21_backlog_buckets", on(lambda x: op.backlog(x.buckets).select("run_id", "bucket", "rank", "keyword", "strand", "tier", "score")),
      "SELECT run_id, bucket, rank::int AS rank, keyword, strand, tier, score FROM q_backlog")
check("E22_backlog_breakdown", on(lambda x: op.backlog_breakdown(op.backlog(x.buckets), x.items, x.divergent, x.bridge_kw).withColumn(
    "signals", F.array_join("signals", "|"))), f"""
SELECT b.run_id, bucket, rank::int AS rank, b.keyword, strand, CASE WHEN persona='' THEN b.keyword ELSE persona END AS target, score,
  {R(mm('b.volume', 'lo', 'hi'), 4)} AS volume_share, {R('m', 4)} AS intent_share, {R('greatest(0.0, momentum)', 4)} AS momentum_share,
  {R('structure/1.0', 4)} AS structure_share, {R('leak', 4)} AS leak_share,
  concat_ws('|', CASE WHEN is_brand THEN 'brand-defense' END, CASE WHEN k.keyword IS NOT NULL THEN 'corridor-bridge' END,
    CASE WHEN in_gap THEN 'coverage-gap' END, CASE WHEN d.keyword IS NOT NULL THEN 'hub-divergence' END,
    CASE WHEN trend>0 THEN 'momentum' END, CASE WHEN in_leak THEN 'value-leak' END) AS signals
FROM q_backlog b JOIN (SELECT run_id, min(volume) AS lo, max(volume) AS hi FROM q_items GROUP BY 1) s USING (run_id)
LEFT JOIN (SELECT DISTINCT run_id, keyword FROM q_bridgekw) k ON k.run_id=b.run_id AND k.keyword=b.keyword
LEFT JOIN q_divergent d ON d.run_id=b.run_id AND d.keyword=b.keyword""")


def counts(x):
    parts = [df.groupBy("run_id").agg(F.count("*").alias("size")).withColumn("finder", F.lit(n))
             for n, df in (("query", x.query), ("path", x.path), ("cluster", x.cnodes))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _kpis(x):
    facts = x.pq.groupBy("run_id", "group_id").agg(F.count("*").alias("member_count"))
    paths = op.path_recap(x.path, journeys.branch_hubs(x.path, 1))
    clusters_of = op.cluster_recap(x.cnodes, fc.cluster_groups(x.dom))
    return op.total_kpis(x.leaks, x.buckets, op.coverage_pct(x.master, x.pc), counts(x)).join(
        op.recap(facts, x.groups), "run_id").join(paths, "run_id", "left").join(clusters_of, "run_id", "left")


check("E23_total_kpis_and_recap", on(_kpis), """
SELECT c.run_id, coverage_pct, recoverable, orphans, coverage_complete, core_groups, largest_group, top_hub, hub_count, cluster_count, top_cluster_group FROM q_coverage c
JOIN (SELECT run_id, sum(CASE WHEN leak_score>=0.5 THEN volume ELSE 0.0 END) AS recoverable FROM q_leaks GROUP BY 1) USING (run_id)
JOIN (SELECT run_id, count(*) FILTER (strand='orphan') AS orphans FROM q_buckets GROUP BY 1) USING (run_id)
JOIN (SELECT run_id, max(k)<1000 AS coverage_complete FROM (SELECT run_id, count(*) AS k FROM q_q1000 GROUP BY 1 UNION ALL
  SELECT run_id, count(*) FROM q_jnodes0 GROUP BY 1 UNION ALL SELECT run_id, count(*) FROM q_cnodes GROUP BY 1) GROUP BY 1) USING (run_id)
JOIN (SELECT run_id, count(*) FILTER (relation='core') AS core_groups, arg_min(group_id, gord - 100*k) AS largest_group FROM (
  SELECT run_id, group_id, relation, gord, count(*) AS k FROM q_pq GROUP BY ALL) GROUP BY 1) USING (run_id)
JOIN (SELECT run_id, keyword AS top_hub FROM q_jhubs WHERE pos=1) USING (run_id)
JOIN (SELECT run_id, count(*) FILTER (out_degree>=2) AS hub_count FROM q_jnodes0 GROUP BY 1) USING (run_id)
JOIN (SELECT run_id, count(DISTINCT letter) AS cluster_count FROM q_cnodes GROUP BY 1) USING (run_id)
JOIN (SELECT run_id, arg_min(group_id, (-k, group_id)) AS top_cluster_group FROM (SELECT run_id, group_id, count(*) AS k FROM q_cgroups GROUP BY ALL) GROUP BY 1) USING (run_id) WHERE group_id=''""")
check("E24_insight_shortlists", on(lambda x: op.shortlists(x.divergent, x.leaks, x.safe)), """
WITH rows AS (
  SELECT run_id, 'leak' AS list, pos, keyword, CASE WHEN leak_score>=0.5 THEN 'urgent' WHEN leak_score>=0.12 THEN 'mid' ELSE 'low' END AS badge, leak_score AS value, CASE WHEN out_degree>=4 THEN 'spread' ELSE 'branch' END AS shape, 0 AS o
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY leak_score DESC, keyword) AS pos FROM q_leaks WHERE leak_score>0.01 AND out_degree<>0) WHERE pos<=4
  UNION ALL SELECT run_id, 'deadend', pos, keyword, 'deadend', opp, 'deadend', 1 FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY volume DESC, leak_score DESC, keyword) AS pos FROM q_leaks WHERE out_degree=0) WHERE pos<=2
  UNION ALL SELECT run_id, 'safe', p, keyword, 'safe', opp, '', 2 FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY opp DESC, pos) AS p FROM q_safe) WHERE p<=3)
SELECT run_id, 'hub' AS list, pos::int AS pos, keyword, type AS badge, dispersion AS value, '' AS shape FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN type='TRIPLE_ANCHOR' THEN 0 ELSE 1 END, dispersion DESC, volume DESC, keyword) AS pos FROM q_divergent) WHERE pos<=8
UNION ALL SELECT run_id, list, pos::int, keyword, badge, value, shape FROM (SELECT *, row_number() OVER (PARTITION BY run_id, keyword ORDER BY o, pos) AS k FROM rows) WHERE k=1""")
