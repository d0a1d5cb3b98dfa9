from pyspark.sql import functions as F

from querytide.operators import opportunity as op, records

from .domain import Domain
from .sqlkit import R, check, piece

W = "(0.2*i + 0.5*c + t)"
TOT = "(i+n+c+t)"


def dominant(i="i", n="n", c="c", t="t", zero="''"):
    g = f"greatest({i},{n},{c},{t})"
    return f"CASE WHEN {g}<=0 THEN {zero} WHEN {i}={g} THEN 'i' WHEN {n}={g} THEN 'n' WHEN {c}={g} THEN 'c' ELSE 't' END"


piece("q_scored", f"""
SELECT q.*, {dominant()} AS primary_intent, m,
  CASE WHEN volume_avg>0 THEN least(log10(volume_avg+1)/max_log, 1.0) ELSE 0.0 END AS volume_norm,
  {R("(CASE WHEN volume_avg>0 THEN least(log10(volume_avg+1)/max_log,1.0) ELSE 0.0 END)*(1.0-least(greatest(competition_index/100.0,0.0),1.0))*(0.5+0.5*m)", 4)} AS score,
  CASE WHEN volume_avg>=mv AND competition_index<mc THEN 'priority' WHEN volume_avg>=mv THEN 'competitive'
    WHEN competition_index<mc THEN 'niche' ELSE 'low' END AS quadrant
FROM (SELECT *, CASE WHEN {TOT}>0 THEN (0.2*i + 0.0*n + 0.5*c + 1.0*t)/{TOT} ELSE 0.0 END AS m FROM q_query) q
JOIN (SELECT run_id, coalesce(log10(max(volume_avg) FILTER (volume_avg>0)+1), 1.0) AS max_log,
  median(volume_avg) AS mv, median(competition_index) AS mc FROM q_query GROUP BY run_id) s USING (run_id)""")
piece("q_context", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY volume_avg DESC, ord) AS pos FROM q_query) WHERE pos<=150""")
CUT = 150  # rows kept by the context in these checks, so that the cut bites at every scale


def scored_cols(*names):
    def run(spark, d):
        return op.scored(Domain(spark, d).query).select("run_id", "keyword", *names)

    return run, "SELECT run_id, keyword, " + ", ".join(names) + " FROM q_scored"


check("B1_primary_intent", *scored_cols("primary_intent"))


def _zero_intents(spark, d):
    """Every third keyword has intents that are all zero, every third has none."""
    gone = F.col("ord") % 3 < 2
    rows = Domain(spark, d).query.withColumns({k: F.when(gone, 0.0).otherwise(F.col(k)) for k in "inct"})
    return op.scored(rows.withColumn("has_intents", F.col("ord") % 3 != 1)).select("run_id", "keyword", "primary_intent")


check("B1_zero_intents", _zero_intents,
      f"SELECT run_id, keyword, CASE ord%3 WHEN 0 THEN 'i' WHEN 1 THEN '' ELSE {dominant(zero=chr(39) + 'i' + chr(39))} END AS primary_intent FROM q_query")
check("B2_intent_weight", lambda s, d: op.scored(Domain(s, d).query).select(
    "run_id", "keyword", F.round("m", 9).alias("m")), "SELECT run_id, keyword, round(m, 9) AS m FROM q_scored")
check("B3_volume_norm", lambda s, d: op.scored(Domain(s, d).query).select(
    "run_id", "keyword", F.round("volume_norm", 9).alias("volume_norm")),
    "SELECT run_id, keyword, round(volume_norm, 9) AS volume_norm FROM q_scored")
check("B4_opportunity_score", *scored_cols("score"))
check("B5_opportunity_quadrant", *scored_cols("quadrant"))
check("B6_intent_funnel", lambda s, d: op.intent_funnel(Domain(s, d).query), " UNION ALL ".join(
    f"SELECT run_id, '{k}' AS intent, {R(f'100*sum({k})/coalesce(nullif(sum(i)+sum(n)+sum(c)+sum(t),0),1.0)', 1)} AS pct FROM q_query GROUP BY run_id"
    for k in "inct"))
check("B7_query_kpis", lambda s, d: op.kpis(Domain(s, d).query), f"""
SELECT run_id, count(*) AS query_count, sum(volume_avg) AS total_volume, {R('sum(volume_avg)/count(*)', 0)} AS avg_volume,
  coalesce({R('avg(nullif(cpc,0))', 2)}, 0.0) AS avg_cpc, {dominant('sum(i)', 'sum(n)', 'sum(c)', 'sum(t)')} AS primary_intent
FROM q_query GROUP BY run_id""")
TOPQ = "(SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, ord) AS rn FROM q_scored)"
check("B8_top_opportunities", lambda s, d: op.top_opportunities(op.scored(Domain(s, d).query)).select(
    "run_id", "rn", "keyword", "score", "quadrant", "primary_intent", "volume_avg"),
    f"SELECT run_id, rn::int AS rn, keyword, score, quadrant, primary_intent, volume_avg FROM {TOPQ} WHERE rn<=20")


def _trend(s, d):
    dom = Domain(s, d)
    return op.top_trend_series(op.scored(dom.query), dom.monthly)


check("B9_top5_trend_series", _trend, f"""
SELECT a.run_id, rn::int AS rn, a.keyword, idx, label, value FROM (
  SELECT m.run_id, rn, m.keyword, (row_number() OVER (PARTITION BY m.run_id, m.keyword ORDER BY month)-1)::int AS idx, total AS value
  FROM q_monthly m JOIN {TOPQ} t ON m.run_id=t.run_id AND m.keyword=t.keyword AND rn<=5) a
LEFT JOIN (SELECT run_id, month AS label, (row_number() OVER (PARTITION BY run_id ORDER BY month)-1)::int AS idx FROM q_monthly
  WHERE (run_id, keyword) IN (SELECT (run_id, keyword) FROM (SELECT run_id, keyword, row_number() OVER (PARTITION BY run_id ORDER BY ord) AS k FROM q_scored) WHERE k=1)) l
USING (run_id, idx)""")


def _context(s, d):
    q = Domain(s, d).query
    kept = op.context_rows(q, CUT).groupBy("run_id").agg(F.count("*").alias("kept"), F.sum("volume_avg").alias("kept_volume"))
    return op.context_summary(q).join(kept, "run_id")


check("B10_query_context", _context, f"""
SELECT run_id, keyword_count, total_volume, primary_intent, kept, kept_volume FROM (
  SELECT run_id, count(*) AS keyword_count, sum(volume_avg) AS total_volume,
    {dominant('sum(i)', 'sum(n)', 'sum(c)', 'sum(t)')} AS primary_intent FROM q_query GROUP BY run_id)
JOIN (SELECT run_id, count(*) AS kept, sum(volume_avg) AS kept_volume FROM q_context GROUP BY run_id) USING (run_id)""")


def seed_records(dom):
    return records.dedupe_seed_records(dom.seed_lists.join(dom.query.drop("ord"), ["run_id", "keyword"]))


piece("q_seed_records", """
SELECT * FROM (SELECT s.run_id, s.keyword, seed_ord, rank, volume_avg,
  row_number() OVER (PARTITION BY s.run_id, s.keyword ORDER BY seed_ord, rank) AS k
  FROM q_seed_lists s JOIN q_query q USING (run_id, keyword)) WHERE k=1""")


def _seed_counts(s, d):
    dom = Domain(s, d)
    kept = op.context_rows(seed_records(dom).withColumn("ord", F.col("rank")), CUT)
    return op.seed_counts(kept, dom.seed_lists.select("run_id", "seed_ord").distinct())


check("B10_seed_counts", _seed_counts, """
SELECT run_id, seed_ord, coalesce(kept, 0) AS kept FROM (SELECT DISTINCT run_id, seed_ord FROM q_seed_lists) LEFT JOIN (
  SELECT run_id, seed_ord, count(*) AS kept FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY volume_avg DESC, rank) AS pos FROM q_seed_records)
  WHERE pos<=150 GROUP BY ALL) USING (run_id, seed_ord)""")
piece("q_known", "SELECT m.group_id, m.ord AS member_ord, c.* FROM q_members m JOIN q_context c USING (run_id, keyword)")
piece("q_group_rollup", """
SELECT run_id, group_id, sum(volume_avg) AS volume, count(*) AS member_count,
  string_agg(keyword, '|' ORDER BY k) FILTER (k<=8) AS evidence
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, group_id ORDER BY volume_avg DESC, member_ord) AS k FROM q_known)
GROUP BY ALL""")


def context(dom):
    return op.context_rows(dom.query, CUT)


def _rollup(s, d):
    dom = Domain(s, d)
    return op.group_rollup(dom.members, context(dom)).withColumn("evidence", F.array_join("evidence", "|"))


check("B11_query_group_rollup", _rollup, "SELECT * FROM q_group_rollup")


def _share(s, d):
    dom = Domain(s, d)
    return op.group_intent_share(dom.members, context(dom))


V = "coalesce(nullif(volume_avg,0),1.0)"
check("B12_group_intent_share", _share, f"""
SELECT run_id, group_id, coalesce(CASE {dominant()} WHEN 'i' THEN 'informational' WHEN 'n' THEN 'navigational'
  WHEN 'c' THEN 'commercial' WHEN 't' THEN 'transactional' END, '') AS stage,
  CASE WHEN {TOT}>0 THEN {R(f'100*greatest(i,n,c,t)/nullif({TOT},0)', 0)} END AS share
FROM (SELECT run_id, group_id, sum(i*{V}) AS i, sum(n*{V}) AS n, sum(c*{V}) AS c, sum(t*{V}) AS t FROM q_known GROUP BY ALL)""")


def _factors(s, d):
    dom = Domain(s, d)
    factors = dom.metrics.select("run_id", F.split("keyword", " ")[1].alias("factor"), "keyword")
    return op.evidence_filter(factors, context(dom)).select("run_id", "factor", "keyword")


check("B13_evidence_filter", _factors,
      "SELECT run_id, split_part(keyword,' ',2) AS factor, keyword FROM q_metrics SEMI JOIN q_context USING (run_id, keyword)")
