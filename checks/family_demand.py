from pyspark.sql import functions as F

from querytide.operators import demand as op

from .domain import ADJECTIVES, NOUNS, Domain, _index, sql_index
from .sqlkit import R, check, piece

TARGET = "ring"
VARIANTS = {"automobile": ["ring", "rings", "small ring"], "building": ["plate", "red plate", "blueplate"], "household": ["Gear", "new gear"], "machinery": ["bolt"]}
BANNED = ["thanedble", "reaux", "onesen", "Nicht"]


def series(dom):
    return dom.stage("series", lambda: op.align_months(dom.monthly)).withColumn("own", F.zip_with("nv", "gg", lambda a, b: a + b))


def bundles(dom):
    """A plan per run: target and market over one noun, seven peers, eight parts; long brands only in the broad lists."""
    w = F.split("keyword", " ")
    ring = w[2] == TARGET
    broad = (F.length(w[0]) > 7).cast("int")

    def row(cond, name, bord, role, b, kw, o):
        return F.when(cond, F.struct(name.alias("bundle_id"), bord.cast("int").alias("bord"), F.lit(role).alias("role"),
                                     b.cast("int").alias("broad"), kw.alias("keyword"), o.alias("ord")))

    kw, o = F.col("keyword"), F.col("ord")
    rows = F.array_compact(F.array(
        row(ring, F.lit("target"), F.lit(0), "target", F.lit(0), kw, o),
        row(ring, F.lit("target"), F.lit(0), "target", F.lit(0), F.replace(kw, F.lit(" "), F.lit("")), o + 1000000),
        row(ring, F.lit("market"), F.lit(1), "market", broad, kw, o),
        row(~ring, F.concat(F.lit("peer:"), w[2]), _index(NOUNS, w[2]) + 2, "peer", broad, kw, o),
        row(ring, F.concat(F.lit("part:"), w[1]), _index(ADJECTIVES, w[1]) + 10, "part", F.lit(0), kw, o)))
    return dom.metrics.select("run_id", F.explode(rows).alias("b")).select("run_id", "b.*")


def roles(dom):
    return bundles(dom).select("run_id", "bundle_id", "bord", "role").distinct()


def members(dom):
    return dom.stage("bundle members", lambda: op.bundle_members(
        bundles(dom).where("broad = 0").select("run_id", "bundle_id", "ord", "keyword"), series(dom)))


def rows(dom):
    return dom.stage("bundle rows", lambda: op.bundle_rollup(members(dom)).join(roles(dom), ["run_id", "bundle_id"]))


def role(dom, name):
    return rows(dom).where(F.col("role") == name)


def kept(dom):
    return dom.stage("peers", lambda: op.peer_scale_filter(role(dom, "peer"), role(dom, "market")))


def verdicts(dom):
    return dom.stage("verdicts", lambda: op.market_verdict(kept(dom).where(~F.col("small")), role(dom, "market")))


def on(f):
    return lambda s, d: f(Domain(s, d))


piece("q_gridmonths", """
SELECT run_id, month, (row_number() OVER (PARTITION BY run_id ORDER BY month)-1)::int AS idx FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY month DESC) AS k, count(*) OVER (PARTITION BY run_id) AS n FROM (
    SELECT DISTINCT run_id, month FROM q_monthly)) WHERE k <= least(48, n) // 12 * 12""")
piece("q_grid", """
SELECT k.run_id, k.keyword, g.idx, g.month, coalesce(nv,0.0) AS nv, coalesce(gg,0.0) AS gg, coalesce(total,0.0) AS total
FROM (SELECT DISTINCT run_id, keyword FROM q_monthly) k JOIN q_gridmonths g ON g.run_id=k.run_id
LEFT JOIN q_monthly m ON m.run_id=k.run_id AND m.keyword=k.keyword AND m.month=g.month""")
piece("q_bk", f"""
WITH base AS (SELECT run_id, keyword, ord, split_part(keyword,' ',1) AS brand, split_part(keyword,' ',2) AS adj, split_part(keyword,' ',3) AS noun FROM q_metrics)
SELECT run_id, 'target' AS bundle_id, 0 AS bord, 'target' AS role, 0 AS broad, keyword, ord FROM base WHERE noun='{TARGET}' UNION ALL
SELECT run_id, 'target', 0, 'target', 0, replace(keyword,' ',''), ord+1000000 FROM base WHERE noun='{TARGET}' UNION ALL
SELECT run_id, 'market', 1, 'market', (length(brand)>7)::int, keyword, ord FROM base WHERE noun='{TARGET}' UNION ALL
SELECT run_id, 'peer:' || noun, {sql_index(NOUNS, 'noun')}+2, 'peer', (length(brand)>7)::int, keyword, ord FROM base WHERE noun<>'{TARGET}' UNION ALL
SELECT run_id, 'part:' || adj, {sql_index(ADJECTIVES, 'adj')}+10, 'part', 0, keyword, ord FROM base WHERE noun='{TARGET}'""")


def members_sql(broad):
    return f"""
SELECT b.run_id, bundle_id, ord, b.keyword, idx, month, CASE WHEN same_as IS NULL THEN nv+gg ELSE nv END AS v, same_as
FROM (SELECT *, CASE WHEN gsum>0 AND first_ord<ord THEN first_kw END AS same_as FROM (
  SELECT *, min(ord) OVER w AS first_ord, first(keyword) OVER (PARTITION BY run_id, bundle_id, vec ORDER BY ord) AS first_kw FROM (
    SELECT d.run_id, d.bundle_id, d.ord, d.keyword, vec, gsum FROM (
      SELECT x.run_id, x.bundle_id, min(x.ord) AS ord, m.keyword FROM q_bk x JOIN (SELECT run_id, keyword, replace(keyword,' ','') AS key FROM q_metrics) m
        ON m.run_id=x.run_id AND m.key=replace(x.keyword,' ','') WHERE {broad} GROUP BY ALL) d
    JOIN (SELECT run_id, keyword, list(gg ORDER BY idx) AS vec, sum(gg) AS gsum, sum(total) AS tsum FROM q_grid GROUP BY ALL) g
      ON g.run_id=d.run_id AND g.keyword=d.keyword WHERE tsum>=12)
  WINDOW w AS (PARTITION BY run_id, bundle_id, vec))) b
JOIN q_grid g ON g.run_id=b.run_id AND g.keyword=b.keyword"""


piece("q_bm", members_sql("broad=0"))
piece("q_bmall", members_sql("true"))


def stats_sql(src, keys):
    t = ", ".join(f"sum(v) FILTER (idx//12={k}) AS t{k}" for k in range(4))
    arrow = " || ".join(f"(CASE WHEN t{k}>t{k - 1} THEN '↑' WHEN t{k}<t{k - 1} THEN '↓' ELSE '→' END)" for k in (1, 2, 3))
    return f"""
SELECT {keys}, t0, t1, t2, t3, floor(t3/12+0.5) AS avg, CASE WHEN NOT is_new AND t0>0 THEN t3/t0-1 END AS gt,
  CASE WHEN NOT yoy_new AND t2>0 THEN t3/t2-1 END AS yoy, yoy_new, {arrow} AS dir, is_new, CASE WHEN is_new THEN firstm END AS since, peak_month, peak_value, firsti
FROM (SELECT *, (t3>0 AND coalesce(firsti>=3,false) AND (t0=0 OR t0<t3*0.10)) AS is_new, (t3>0 AND coalesce(firsti>=24,false)) AS yoy_new FROM (
  SELECT {keys}, {t}, min(idx) FILTER (v>0) AS firsti, arg_min(month, idx) FILTER (v>0) AS firstm, arg_max(month, v*1000-idx) AS peak_month, max(v) AS peak_value
  FROM {src} GROUP BY ALL))"""


piece("q_own", "SELECT run_id, keyword, idx, month, nv+gg AS v, nv, gg FROM q_grid")
piece("q_kstats", stats_sql("q_own", "run_id, keyword"))
piece("q_bs", "SELECT run_id, bundle_id, idx, month, sum(v) AS v, count(*) AS n FROM q_bm GROUP BY ALL")
piece("q_rows", f"""
SELECT s.*, n, bord, role FROM ({stats_sql('q_bs', 'run_id, bundle_id')}) s
JOIN (SELECT DISTINCT run_id, bundle_id, n FROM q_bs) USING (run_id, bundle_id) JOIN (SELECT DISTINCT run_id, bundle_id, bord, role FROM q_bk) USING (run_id, bundle_id)""")
piece("q_mstats", stats_sql("q_bm", "run_id, bundle_id, ord, keyword"))


def totals():
    return [F.get("t", F.lit(k)).alias(f"t{k}") for k in range(4)]



STAT = ["avg", "gt", "yoy", "yoy_new", "dir", "is_new", "since", "peak_month", "peak_value"]

check("F1_align_months", on(lambda m: op.grid_rows(series(m))), "SELECT * FROM q_grid")
check("F2_interval_totals", on(lambda m: series(m).select("run_id", "keyword", F.posexplode(F.arrays_zip(
    op.blocks(F.col("own")).alias("t"), op.interval_labels().alias("label"))).alias("k", "c")).select(
    "run_id", "keyword", "k", F.col("c.t").alias("t"), F.col("c.label").alias("label"))), """
SELECT run_id, keyword, idx//12 AS k, sum(v) AS t, replace(substr(min(month),3),'-','.') || '-' || replace(substr(max(month),3),'-','.') AS label
FROM q_own GROUP BY ALL""")
check("F3_series_stats", on(lambda m: op.with_stats(series(m), "own").select("run_id", "keyword", *totals(), *STAT)),
      "SELECT run_id, keyword, t0, t1, t2, t3, " + ", ".join(STAT) + " FROM q_kstats")
check("F4_monthly_yoy", on(lambda m: series(m).select("run_id", "keyword", F.posexplode(op.monthly_yoy()).alias("k", "yoy")).where("yoy is not null")), """
SELECT run_id, keyword, (idx-12)::int AS k, v/b-1 AS yoy FROM (SELECT *, lag(v,12) OVER (PARTITION BY run_id, keyword ORDER BY idx) AS b FROM q_own) WHERE b>=30""")


def wide(dom):
    """Series of whole brands: wide enough for the detectors at every scale."""
    m = dom.monthly.withColumn("keyword", F.split("keyword", " ")[0]).groupBy("run_id", "keyword", "month").agg(
        *[F.sum(c).alias(c) for c in ("nv", "gg", "total")])
    return dom.stage("brand series", lambda: op.align_months(m)).withColumn("own", F.zip_with("nv", "gg", lambda a, b: a + b))


piece("q_wide", "SELECT run_id, split_part(keyword,' ',1) AS keyword, idx, month, sum(nv) AS nv, sum(gg) AS gg, sum(nv+gg) AS v FROM q_grid GROUP BY ALL")
W = "(PARTITION BY run_id, keyword ORDER BY idx ROWS BETWEEN {} AND {})"
PRE, POST, HOLD = W.format("3 PRECEDING", "1 PRECEDING"), W.format("CURRENT ROW", "2 FOLLOWING"), W.format("3 FOLLOWING", "6 FOLLOWING")


def step_sql(a, b, engine, o):
    return f"""
SELECT run_id, keyword, '{engine}' AS engine, {o} AS o, arg_min(month, idx) AS month, arg_min(pre, idx) AS before, arg_min({a}, idx) AS after, arg_min(chg, idx) AS chg, any_value(osum) AS osum
FROM (SELECT *, {b}/greatest(bpre,1)-1 AS chg FROM (SELECT *, sum({a}) OVER {PRE}/3 AS pre, sum({a}) OVER {POST}/3 AS post, sum({a}) OVER {HOLD}/4 AS hold, sum({b}) OVER {PRE}/3 AS bpre,
  sum({b}) OVER (PARTITION BY run_id, keyword) AS osum, count(*) OVER (PARTITION BY run_id, keyword) AS n FROM q_wide))
WHERE idx BETWEEN 3 AND n-7 AND pre>=100 AND {a}>=2.5*pre AND post>=2.5*pre AND hold>=2.0*pre AND abs(chg)<0.5 GROUP BY ALL"""


check("F5_detect_single_engine_step", on(lambda m: op.single_engine_step(wide(m))), f"""
SELECT run_id, keyword, engine, month, {R('before', 0)} AS before, {R('after', 0)} AS after, {R('chg', 3)} AS other_change FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, keyword ORDER BY o) AS k FROM ({step_sql('gg', 'nv', 'gg', 0)} UNION ALL {step_sql('nv', 'gg', 'nv', 1)})) WHERE k=1 AND osum>=12""")
check("F6_detect_spike", on(lambda m: op.spikes(wide(m), ["run_id", "keyword"], "own")), f"""
SELECT run_id, keyword, arg_min(month, idx) AS month, {R('arg_min(v, idx)', 0)} AS value, {R('arg_min(base, idx)', 0)} AS base FROM (
  SELECT *, list_median(ctx) AS base FROM (SELECT *, list(v) OVER {W.format('3 PRECEDING', '1 PRECEDING')} || list(v) OVER {W.format('1 FOLLOWING', '3 FOLLOWING')} AS ctx,
    min(v) OVER {W.format('1 FOLLOWING', '2 FOLLOWING')} AS back, count(*) OVER (PARTITION BY run_id, keyword) AS n FROM q_wide))
WHERE idx BETWEEN 3 AND n-2 AND base>0 AND v>=base*3.0 AND back<=base*1.5 GROUP BY ALL""")
BW = W.replace("keyword", "bundle_id")
MW = W.replace("keyword", "bundle_id, keyword")


def bw(lo, hi):
    return BW.format(lo, hi)


piece("q_cells7", f"""
SELECT b.*, avg, sum(v) OVER {MW.format('3 PRECEDING', '1 PRECEDING')}/3 AS p, sum(v) OVER {MW.format('CURRENT ROW', '2 FOLLOWING')}/3 AS q
FROM q_bm b JOIN (SELECT run_id, bundle_id, keyword, avg FROM q_mstats) USING (run_id, bundle_id, keyword)""")
piece("q_events", """
SELECT * FROM (SELECT *, abs(gain/loss-1) AS fit, row_number() OVER (PARTITION BY run_id, bundle_id, "from", "to" ORDER BY idx) AS k FROM (
  SELECT a.run_id, a.bundle_id, a.idx, a.month, a.keyword AS "from", b.keyword AS "to", a.avg AS fa, a.ord AS fo, b.avg AS ta, b.ord AS too,
    a.p AS pa, a.q AS qa, b.p AS pb, b.q AS qb, a.p-a.q AS loss, b.q-b.p AS gain
  FROM q_cells7 a JOIN q_cells7 b USING (run_id, bundle_id, idx) JOIN (SELECT run_id, bundle_id, greatest(100.0, 0.05*sum(v)/count(*)) AS floor, count(*) AS n FROM q_bs GROUP BY ALL) f USING (run_id, bundle_id)
  WHERE a.keyword<>b.keyword AND idx BETWEEN 3 AND n-3 AND a.p>=floor AND a.q<0.5*a.p AND b.q>1.5*greatest(b.p,1) AND b.q-b.p BETWEEN 0.6*(a.p-a.q) AND 1.6*(a.p-a.q))) WHERE k=1""")
EV = "ORDER BY fit, fa DESC, fo, ta DESC, too"
piece("q_best7", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, bundle_id {EV}) AS r FROM q_events) WHERE r=1")
piece("q_second7", f"""
SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.run_id, e.bundle_id {EV.replace('fit', 'e.fit').replace('fa', 'e.fa', 1).replace('fo', 'e.fo').replace('ta DESC', 'e.ta DESC').replace('too', 'e.too')}) AS r
FROM q_events e JOIN q_best7 b ON b.run_id=e.run_id AND b.bundle_id=e.bundle_id
WHERE e."from" NOT IN (b."from", b."to") AND e."to" NOT IN (b."from", b."to")) WHERE r=1""")
SHIFT = f"""month, "from", "to", {R('pa', 0)} AS from_before, {R('qa', 0)} AS from_after, {R('pb', 0)} AS to_before, {R('qb', 0)} AS to_after"""
check("F7_detect_notation_shift", on(lambda m: op.notation_shifts(members(m), rows(m))),
      f"SELECT run_id, bundle_id, 1 AS pick, {SHIFT} FROM q_best7 UNION ALL SELECT run_id, bundle_id, 2, {SHIFT} FROM q_second7")
check("F8_detect_level_jump", on(lambda m: op.level_jumps(members(m), rows(m))), f"""
SELECT run_id, bundle_id, month, keyword, {R('pre', 0)} AS before, {R('post', 0)} AS after, {R('share', 3)} AS share, {R('prior', 3)} AS prior FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, bundle_id ORDER BY share DESC, ord) AS k FROM (
    SELECT c.run_id, c.bundle_id, j.month, c.keyword, c.ord, pre, post, (c.q-c.p)/(post-pre) AS share, c.p/pre AS prior FROM q_cells7 c JOIN (
      SELECT run_id, bundle_id, min(idx) AS idx, arg_min(month, idx) AS month, arg_min(pre, idx) AS pre, arg_min(post, idx) AS post FROM (
        SELECT *, sum(v) OVER {bw('3 PRECEDING', '1 PRECEDING')}/3 AS pre, sum(v) OVER {bw('CURRENT ROW', '2 FOLLOWING')}/3 AS post,
          sum(v) OVER {bw('3 FOLLOWING', '6 FOLLOWING')}/4 AS hold, count(*) OVER (PARTITION BY run_id, bundle_id) AS months FROM q_bs)
      WHERE n>=2 AND idx BETWEEN 3 AND months-7 AND pre>=100 AND post>=1.8*pre AND hold>=1.5*pre GROUP BY ALL) j USING (run_id, bundle_id, idx)))
WHERE k=1 AND share>=0.7 AND share-prior>=0.3""")
check("F9_bundle_rollup", on(lambda m: rows(m).select("run_id", "bundle_id", "n", *totals(), *STAT)),
      "SELECT run_id, bundle_id, n, t0, t1, t2, t3, " + ", ".join(STAT) + " FROM q_rows")
check("F9_duplicate_engine", on(lambda m: members(m).where("same_as is not null").select("run_id", "bundle_id", "keyword", "same_as")),
      "SELECT DISTINCT run_id, bundle_id, keyword, same_as FROM q_bm WHERE same_as IS NOT NULL")
check("F10_drop_no_data", on(lambda m: op.dropped_no_data(bundles(m).select("run_id", "bundle_id", "ord", "keyword"), series(m))), """
SELECT x.run_id, bundle_id, ord, x.keyword, 'nodata' AS reason FROM q_bk x LEFT JOIN (
  SELECT run_id, replace(keyword,' ','') AS key, sum(total) AS s FROM q_grid GROUP BY ALL) g ON g.run_id=x.run_id AND g.key=replace(x.keyword,' ','')
WHERE coalesce(s,0)<12""")
piece("q_peers", """
SELECT *, row_number() OVER (PARTITION BY run_id, small ORDER BY avg DESC, bord) AS pos FROM (
  SELECT r.*, (tt>0 AND t3<0.05*tt) AS small FROM q_rows r JOIN (SELECT run_id, t3 AS tt FROM q_rows WHERE role='market') USING (run_id) WHERE role='peer')""")


def verdict_sql(diff, n, target):
    return f"CASE WHEN {target} IS NULL OR {n}<3 THEN 'hold' WHEN abs({diff})<0.15 THEN 'same' WHEN {diff}<0 THEN 'weak' ELSE 'strong' END"


piece("q_verdicts", f"""
SELECT run_id, target_gt, CASE WHEN verdict<>'hold' THEN base END AS baseline, CASE WHEN verdict<>'hold' THEN target_gt-base END AS diff, peers, verdict, ups, downs
FROM (SELECT *, {verdict_sql('target_gt-base', 'peers', 'target_gt')} AS verdict FROM (
  SELECT run_id, gt AS target_gt FROM q_rows WHERE role='market') LEFT JOIN (
  SELECT run_id, median(gt) AS base, count(gt) AS peers, count(*) FILTER (gt>0) AS ups, count(*) FILTER (gt<0) AS downs FROM q_peers WHERE NOT small AND pos<=10 GROUP BY 1) USING (run_id))""")
check("F11_market_verdict", on(verdicts), "SELECT * FROM q_verdicts")
check("F12_leave_one_out", on(lambda m: op.leave_one_out(kept(m).where(~F.col("small")), verdicts(m))), f"""
SELECT run_id, bundle_id, verdict, w AS verdict_without, verdict<>w AS flips FROM (
  SELECT a.run_id, a.bundle_id, verdict, {verdict_sql('target_gt-median(b.gt)', 'count(*)', 'target_gt')} AS w
  FROM q_peers a JOIN q_peers b ON a.run_id=b.run_id AND a.bundle_id<>b.bundle_id JOIN q_verdicts v ON v.run_id=a.run_id
  WHERE NOT a.small AND NOT b.small AND a.pos<=10 AND b.pos<=10 AND a.gt IS NOT NULL AND b.gt IS NOT NULL AND verdict<>'hold' AND peers>3
  GROUP BY a.run_id, a.bundle_id, verdict, target_gt)""")


def _peers(m):
    out = op.relative_growth(kept(m), verdicts(m))
    return out.select("run_id", "bundle_id", "pos", "small", "avg", "gt", "rel")


check("F13_peer_scale_filter", on(_peers), """
SELECT run_id, bundle_id, CASE WHEN small THEN 0 ELSE pos::int END AS pos, small, avg, gt, gt-baseline AS rel FROM q_peers JOIN q_verdicts USING (run_id) WHERE small OR pos<=10""")


def _cover(m):
    every = op.bundle_members(bundles(m).select("run_id", "bundle_id", "ord", "keyword"), series(m))
    return op.representative_cover(rows(m).where("role in ('market', 'peer')"), op.bundle_rollup(every))


check("F14_representative_cover", on(_cover), """
SELECT run_id, bundle_id, least(1.0, t3/broad) AS cover, cover_n, least(1.0, t3/broad)<0.90 AS cover_low FROM q_rows JOIN (
  SELECT run_id, bundle_id, sum(v) FILTER (idx>=36) AS broad, count(DISTINCT keyword) AS cover_n FROM q_bmall GROUP BY ALL) USING (run_id, bundle_id)
WHERE broad>0 AND role IN ('market','peer')""")
check("F15_flow_type", on(lambda m: rows(m).select("run_id", "bundle_id", "dir", op.flow_type().alias("flow"))), """
SELECT run_id, bundle_id, dir, CASE WHEN dir='↑↑↑' THEN 'rising' WHEN dir='↓↓↓' THEN 'falling' WHEN dir LIKE '%↑' AND contains(dir,'↓') THEN 'fall_then_rise'
  WHEN dir LIKE '%↓' AND contains(dir,'↑') THEN 'rise_then_fall' ELSE 'flat' END AS flow FROM q_rows""")
def spellings_of(m):
    rows = [(run, k, n) for run, names in VARIANTS.items() for k, n in enumerate(names)]
    return m.spark.createDataFrame(rows, "run_id string, ord int, name string")


def one_spelling(run):
    names = [n.replace(" ", "").lower() for n in VARIANTS[run]]
    out = "replace(keyword,' ','')"
    for n in sorted(set(names[1:]), key=lambda x: (-len(x), x)):
        out = f"replace({out},'{n}','{names[0]}')"
    return f"WHEN '{run}' THEN {out}"


check("F16_merge_spellings_top", on(lambda m: op.merged_top_queries(members(m), spellings_of(m))), f"""
SELECT run_id, bundle_id, pos::int AS pos, keyword, spellings, last, CASE WHEN prev>0 THEN last/prev-1 END AS yoy FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, bundle_id ORDER BY last DESC, seen_avg DESC, seen_ord) AS pos FROM (
    SELECT run_id, bundle_id, key, sum(t3) AS last, sum(t2) AS prev, count(*) AS spellings, max(avg) AS seen_avg,
      min(ord) FILTER (r=1) AS seen_ord, max(keyword) FILTER (r2=1) AS keyword FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id, bundle_id, key ORDER BY avg DESC, ord) AS r,
        row_number() OVER (PARTITION BY run_id, bundle_id, key ORDER BY t3 DESC, avg DESC, ord) AS r2 FROM (
        SELECT *, CASE run_id {' '.join(map(one_spelling, VARIANTS))} ELSE replace(keyword,' ','') END AS key FROM q_mstats)) GROUP BY ALL)) WHERE pos<=5""")
piece("q_parts", """
SELECT p.*, row_number() OVER (PARTITION BY run_id, k ORDER BY value DESC, avg DESC, bord) AS rank, value/nullif(sum(value) OVER (PARTITION BY run_id, k),0) AS share FROM (
  SELECT run_id, bundle_id, bord, avg, unnest([0,1,2,3]) AS k, unnest([t0,t1,t2,t3]) AS value FROM q_rows WHERE role='part') p""")


def part_rows(m):
    return op.part_intervals(role(m, "part"))


def new_counts(m):
    return op.new_per_interval(members(m))


piece("q_newk", """
SELECT run_id, bundle_id, (g.idx//12)::bigint AS k, count(*) AS new_queries FROM q_mstats s JOIN q_gridmonths g ON g.run_id=s.run_id AND g.month=s.since WHERE is_new GROUP BY ALL""".replace("SELECT run_id", "SELECT s.run_id"))
check("F17_internal_composition", on(lambda m: part_rows(m).join(new_counts(m), ["run_id", "bundle_id", "k"], "left").select(
    "run_id", "bundle_id", F.col("k").cast("int").alias("k"), "value", "share", F.col("rank").cast("long").alias("rank"), F.coalesce("new_queries", F.lit(0)).alias("new_queries"))), """
SELECT run_id, bundle_id, k, value, share, rank, coalesce(new_queries,0) AS new_queries FROM q_parts LEFT JOIN q_newk USING (run_id, bundle_id, k)""")
check("F17_composition_summary", on(lambda m: op.composition_summary(role(m, "part"), part_rows(m)).withColumn(
    "conc_from", F.round("conc_from", 9)).withColumn("conc_to", F.round("conc_to", 9))), """
SELECT run_id, round(conc_from,9) AS conc_from, round(conc_to,9) AS conc_to, ups, downs, CASE WHEN ups>0 THEN g END AS top_grower, CASE WHEN downs>0 THEN d END AS top_dropper FROM (
  SELECT run_id, sum(share) FILTER (k=0 AND rank<=2) AS conc_from, sum(share) FILTER (k=3 AND rank<=2) AS conc_to FROM q_parts GROUP BY 1)
LEFT JOIN (SELECT run_id, count(*) FILTER (gt>0) AS ups, count(*) FILTER (gt<0) AS downs, max(bundle_id) FILTER (rg=1) AS g, max(bundle_id) FILTER (rd=1) AS d FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY gt DESC, avg DESC, bord) AS rg, row_number() OVER (PARTITION BY run_id ORDER BY gt, avg DESC, bord) AS rd
  FROM q_rows WHERE role='part' AND gt IS NOT NULL) GROUP BY 1) USING (run_id)""")


def _subs(m):
    """The market members of each part as its sub-bundles would be: part rows against the sum of parts."""
    parts = role(m, "part")
    return op.sub_bundle_shares(parts, op.combined_row(parts, [F.lit("all")])).select("run_id", "bundle_id", "share")


check("F17_sub_bundles", on(_subs), """
SELECT run_id, bundle_id, t3/nullif(sum(t3) OVER (PARTITION BY run_id),0) AS share FROM q_rows WHERE role='part'""")


def _validated(m):
    plan = bundles(m).withColumn("verify", F.col("ord") > 1000000)
    rel = m.query.select("run_id", "keyword")
    clu = m.edges.select("run_id", F.col("a").alias("keyword"))
    return op.validated_keywords(plan, rel, clu)


check("F18_validate_plan_keywords", on(lambda m: _validated(m).groupBy("run_id", "bundle_id", "status", "src").agg(F.count("*").alias("n"))), """
SELECT run_id, bundle_id, CASE WHEN ord>1000000 THEN 'verify' WHEN src IS NOT NULL THEN 'kept' ELSE 'notfound' END AS status, src, count(*) AS n FROM (
  SELECT b.*, CASE WHEN c.key IS NOT NULL THEN 'cluster' WHEN r.key IS NOT NULL THEN 'intent' END AS src FROM q_bk b
  LEFT JOIN (SELECT DISTINCT run_id, replace(a,' ','') AS key FROM q_edges) c ON c.run_id=b.run_id AND c.key=replace(b.keyword,' ','')
  LEFT JOIN (SELECT DISTINCT run_id, replace(keyword,' ','') AS key FROM q_query) r ON r.run_id=b.run_id AND r.key=replace(b.keyword,' ','')) GROUP BY ALL""")
check("F18_bundle_source", on(lambda m: op.bundle_source(_validated(m))), """
SELECT run_id, bundle_id, count(*) AS kept, CASE WHEN bool_or(c) THEN 'cluster' ELSE 'intent' END AS src FROM (
  SELECT b.*, replace(b.keyword,' ','') IN (SELECT replace(a,' ','') FROM q_edges e WHERE e.run_id=b.run_id) AS c,
    replace(b.keyword,' ','') IN (SELECT replace(keyword,' ','') FROM q_query e WHERE e.run_id=b.run_id) AS r FROM q_bk b)
WHERE ord>1000000 OR c OR r GROUP BY ALL""")


def _sum_check(m):
    """One part is tampered with, so that exactly its check must fail, and the total with it."""
    part = role(m, "part").select("run_id", "bundle_id", "own", "t")
    total = op.combined_row(role(m, "part"), [F.lit("all")]).select("run_id", "own")
    bad = F.col("bundle_id") == "part:old"
    part = part.withColumn("own", F.when(bad, F.transform("own", lambda v: v + 1)).otherwise(F.col("own")))
    return op.sum_check(part, members(m), total).withColumn("violations", F.array_join("violations", "|"))


check("F19_sum_check", on(_sum_check), """
SELECT run_id, bundle_id, 'months|intervals' AS violations FROM q_rows WHERE bundle_id='part:old'
UNION ALL SELECT DISTINCT run_id, 'total', 'total' FROM q_rows WHERE bundle_id='part:old'""")


def _kpis(m):
    mem = members(m).where("bundle_id = 'market'")
    return op.demand_kpis(role(m, "market"), mem, verdicts(m), part_rows(m))


check("F20_demand_kpis", on(_kpis), """
SELECT run_id, verdict, diff, gt, avg, yoy, up_months::int AS up_months, lead_query, v/nullif(t3,0) AS lead_share, top_part, top_part_share
FROM (SELECT * FROM q_rows WHERE role='market') r JOIN (SELECT run_id, verdict, diff FROM q_verdicts) USING (run_id)
JOIN (SELECT run_id, count(*) FILTER (idx>=36 AND b>=30 AND v/b-1>0) AS up_months FROM (
  SELECT *, lag(v,12) OVER (PARTITION BY run_id ORDER BY idx) AS b FROM q_bs WHERE bundle_id='market') GROUP BY 1) USING (run_id)
LEFT JOIN (SELECT run_id, keyword AS lead_query, t3 AS v FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t3 DESC, avg DESC, ord) AS k
  FROM q_mstats WHERE bundle_id='market') WHERE k=1) USING (run_id)
LEFT JOIN (SELECT run_id, bundle_id AS top_part, share AS top_part_share FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY avg DESC, bord) AS z
  FROM q_parts WHERE k=3) WHERE z=1) USING (run_id)""")
TAG = r"<[^>]*>"


def texts(dom):
    return dom.table("documents").select("lang", "doc_id", "text")


def _grounding(s, d):
    dom = Domain(s, d)
    facts = dom.table("pages").select(F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.regexp_replace("html", TAG, " ").alias("text"))
    return op.number_grounding(texts(dom), facts, ["lang"], "doc_id")


def numbers_sql(src, keys, text):
    return f"""SELECT DISTINCT {keys}, regexp_replace(replace(replace(replace(t,'−','-'),',',''),' ',''), '{op.COUNT_UNIT}', '') AS number FROM (
  SELECT {keys}, trim(unnest(regexp_extract_all({text}, '{op.NUMBER}'))) AS t FROM {src})
  WHERE try_cast(regexp_replace(t,'[^\\d.]','','g') AS double) IS NOT NULL AND NOT (NOT regexp_matches(t, '{op.VALUE_UNIT}')
    AND (try_cast(regexp_replace(t,'[^\\d.]','','g') AS double)<=12 OR try_cast(regexp_replace(t,'[^\\d.]','','g') AS double) BETWEEN 1990 AND 2100))"""


check("F21_number_grounding_audit", _grounding, f"""
WITH facts AS (SELECT regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, regexp_replace(html, '{TAG}', ' ', 'g') AS text FROM pages),
known AS ({numbers_sql('facts', 'lang', 'text')}), said AS ({numbers_sql('documents', 'lang, doc_id', 'text')})
SELECT * FROM said s WHERE NOT EXISTS (FROM known k WHERE k.lang=s.lang AND (k.number=s.number OR ltrim(k.number,'+')=s.number))""")
check("F21_word_audit", on(lambda m: op.word_audit(texts(m), BANNED, ["lang"], "doc_id")), f"""
SELECT lang, doc_id, word FROM documents, (SELECT unnest({BANNED!r}) AS word) WHERE contains(text, word)""")


def _display(m):
    r = rows(m).where("role in ('peer', 'market')")
    both = op.combined_row(r, [F.lit("all")]).withColumn("bundle_id", F.lit("all"))
    rates = op.interval_rates(r.select("run_id", "bundle_id", "t").unionByName(both.select("run_id", "bundle_id", "t")))
    d = op.drivers(rows(m), members(m))
    return rates.join(d, ["run_id", "bundle_id"], "left").select(
        "run_id", "bundle_id", *[F.get("rates", F.lit(k)).alias(f"r{k}") for k in range(3)], "overall", "keyword", "delta")


check("F22_row_aggregates_for_display", on(_display), """
SELECT run_id, bundle_id, t1/nullif(t0,0)-1 AS r0, t2/nullif(t1,0)-1 AS r1, t3/nullif(t2,0)-1 AS r2, t3/nullif(t0,0)-1 AS overall, keyword, delta FROM (
  SELECT run_id, bundle_id, t0, t1, t2, t3 FROM q_rows WHERE role IN ('peer','market') UNION ALL
  SELECT run_id, 'all', sum(t0), sum(t1), sum(t2), sum(t3) FROM q_rows WHERE role IN ('peer','market') GROUP BY 1)
LEFT JOIN (SELECT run_id, bundle_id, keyword, delta FROM (SELECT m.run_id, m.bundle_id, m.keyword, m.t3-m.t0 AS delta, row_number() OVER (PARTITION BY m.run_id, m.bundle_id
  ORDER BY CASE WHEN (m.t3-m.t0>=0)=(r.t3-r.t0>=0) THEN 0 ELSE 1 END, abs(m.t3-m.t0) DESC, m.avg DESC, m.ord) AS k
  FROM q_mstats m JOIN q_rows r ON r.run_id=m.run_id AND r.bundle_id=m.bundle_id) WHERE k=1) USING (run_id, bundle_id)""")
check("F22_top_and_other", on(lambda m: op.top_and_other(part_rows(m), role(m, "part"))), """
SELECT run_id, CASE WHEN z<=6 THEN bundle_id ELSE 'other' END AS line, k, sum(value) AS value FROM q_parts JOIN (
  SELECT run_id, bundle_id, row_number() OVER (PARTITION BY run_id ORDER BY avg DESC, bord) AS z FROM q_rows WHERE role='part') USING (run_id, bundle_id) GROUP BY ALL""")
check("F23_new_in_interval", on(lambda m: op.interval_badges(rows(m), new_counts(m))), """
SELECT run_id, bundle_id, k, value, (coalesce(k=k0,false) OR (k>0 AND prev=0)) AND value>0 AS new_badge, CASE WHEN coalesce(k=k0,false) THEN 0 ELSE coalesce(new_queries,0) END AS new_queries FROM (
  SELECT *, lag(value) OVER (PARTITION BY run_id, bundle_id ORDER BY k) AS prev FROM (
    SELECT run_id, bundle_id, CASE WHEN is_new THEN firsti//12 END AS k0, unnest([0,1,2,3]) AS k, unnest([t0,t1,t2,t3]) AS value FROM q_rows))
LEFT JOIN q_newk USING (run_id, bundle_id, k)""")
