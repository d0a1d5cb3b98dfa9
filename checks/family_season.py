from pyspark.sql import functions as F

from querytide.operators import season as op

from . import family_demand as fd
from .domain import ADJECTIVES, Domain, _index, sql_index
from .family_records import nodes, with_pos
from .sqlkit import R, check, piece
from querytide.operators import records

# Every run has its own seed, filters, floor, skipped names and themes: run, seed, rel, exc, min_total, skip.
SETUP = [
    ("automobile", "ring", "(ring|rod|GEAR|bolt)", "(cold|brand#1 )", 600.0, None),
    ("building", "plate", "(plate|gizmo|widget|anvil)", None, 300.0, ["Brand#2 redplate", "plate"]),
    ("furniture", "gear", None, "(OLD|brand#25 )", 600.0, []),
    ("household", "Brand#8 smallring", "ring|gear|ROD", "hot", 600.0, None),
    ("machinery", "bolt", ".", None, None, None),
]
THEMES = {
    "automobile": [("blue", "blue"), ("warm", "hot|red"), ("red", "RED"), ("size", "small|large"), ("nine", "brand#9 ")],
    "building": [("size", "small|large"), ("new", " NEW "), ("two", "brand#2")],
    "furniture": [],
    "household": [("blue", "blue"), ("red", "RED"), ("cold", "cold")],
    "machinery": [("warm", "hot|red"), ("rest", ".")],
}


def spec(dom):
    setup = dom.spark.createDataFrame(SETUP, "run_id string, seed string, rel string, exc string, min_total double, skip array<string>")
    return dom.stage("season spec", lambda: op.season_spec(setup, themes_of(dom)))


def themes_of(dom):
    rows = [(run, k, name, p) for run, rules in THEMES.items() for k, (name, p) in enumerate(rules)]
    return dom.spark.createDataFrame(rows, "run_id string, tord int, theme string, pattern string")


def filtered(dom):
    return op.relevance_filter(fd.series(dom), spec(dom))


def rows(dom):
    return dom.stage("season rows", lambda: op.classified(filtered(dom), spec(dom)))


def indexed(dom):
    return dom.stage("season indexed", lambda: op.with_index(rows(dom)))


def themes(dom):
    return dom.stage("season themes", lambda: op.theme_rollup(rows(dom)))


def monthly(dom):
    return dom.stage("season monthly", lambda: op.monthly_keywords(indexed(dom), spec(dom)))


def pool(dom):
    return op.change_pool(rows(dom))


def on(f):
    return lambda s, d: f(Domain(s, d))


def text(x):
    return "NULL" if x is None else f"'{x}'"


piece("q_setup", "SELECT * FROM (VALUES " + ", ".join(
    f"('{run}', '{seed.lower()}', {text(rel)}, {text(exc)}, {1000.0 if floor is None else floor}, [{', '.join(text(n.replace(' ', '').lower()) for n in ([seed] if skip is None else skip))}]::varchar[])"
    for run, seed, rel, exc, floor, skip in SETUP) + ") v(run_id, seed, rel, exc, floor, skip)")
piece("q_filtered", """
SELECT run_id, keyword, total4, CASE WHEN NOT (coalesce(regexp_matches(keyword, '(?i)' || rel), true) AND NOT coalesce(regexp_matches(keyword, '(?i)' || exc), false)) THEN 'off'
  WHEN total4<floor THEN 'low' ELSE 'kept' END AS status FROM (SELECT run_id, keyword, sum(v) AS total4 FROM q_own GROUP BY ALL) JOIN q_setup USING (run_id) WHERE total4>0""")
THEME_CASE = "CASE " + " ".join(f"WHEN run_id='{run}' AND regexp_matches(keyword, '(?i){p}') THEN '{n}'" for run, rules in THEMES.items() for n, p in rules) + " END"
piece("q_season", f"""
SELECT *, {THEME_CASE} AS theme, CASE WHEN regexp_matches(keyword, '{op.YEAR_TOKEN}') THEN NULL WHEN first>=24 AND e4>=600 AND e4>e3 THEN 'new'
  WHEN e3>0 AND e4>=1200 AND e4/nullif(e3,0)>=2 THEN 'surge' END AS signal, CASE WHEN p3>0 THEN n3/p3-1 END AS yoy3
FROM (SELECT run_id, keyword, total4, sum(v) FILTER (idx BETWEEN 24 AND 35) AS e3, sum(v) FILTER (idx>=36) AS e4, sum(v) FILTER (idx>=24) AS e34,
  min(idx) FILTER (v>0) AS first, arg_min(month, idx) FILTER (v>0) AS first_month, sum(v) FILTER (idx>=45) AS n3, sum(v) FILTER (idx BETWEEN 33 AND 35) AS p3,
  sum(v) FILTER (idx BETWEEN 42 AND 44) AS q0
  FROM q_own JOIN q_filtered f USING (run_id, keyword) WHERE status='kept' GROUP BY ALL)""")
check("H1_relevance_filter", on(lambda m: filtered(m).select("run_id", "keyword", "status", "total4")), "SELECT run_id, keyword, status, total4 FROM q_filtered")
check("H2_new_surge_class", on(lambda m: rows(m).select("run_id", "keyword", "e3", "e4", "first", "signal", "yoy3")),
      "SELECT run_id, keyword, e3, e4, first::bigint AS first, signal, yoy3 FROM q_season")
check("H3_theme_tag", on(lambda m: rows(m).select("run_id", "keyword", "theme")), "SELECT run_id, keyword, theme FROM q_season")


def shapes(src, keys):
    return f"""
SELECT {keys}, idx//12 AS blk, substr(month,6,2)::int AS cal, idx, v, v/mu AS x FROM (
  SELECT *, sum(v) OVER (PARTITION BY {keys}, idx//12)/12 AS mu FROM {src}) WHERE mu>0"""


def index_sql(shape, keys):
    return f"SELECT {keys}, cal, {R('median(x)', 3)} AS ix FROM {shape} GROUP BY ALL"


def peak_sql(index, shape, keys):
    return f"""
SELECT p.*, years, hits FROM (SELECT {keys}, arg_max(cal, ix*100000-cal) AS peak, max(ix) AS top FROM {index} GROUP BY ALL) p
JOIN (SELECT {keys}, count(*) AS years FROM (SELECT DISTINCT {keys}, blk FROM {shape}) GROUP BY ALL) USING ({keys})
JOIN (SELECT {keys}, count(*) FILTER (yp=pk) AS hits FROM (SELECT {keys}, blk, arg_max(cal, x*100000-idx) AS yp FROM {shape} GROUP BY ALL)
  JOIN (SELECT {keys}, arg_max(cal, ix*100000-cal) AS pk FROM {index} GROUP BY ALL) USING ({keys}) GROUP BY ALL) USING ({keys})"""


K = "run_id, keyword"
G = 'run_id, "group"'
piece("q_kshape", shapes("(SELECT o.* FROM q_own o SEMI JOIN q_season USING (run_id, keyword))", K))
piece("q_kindex", index_sql("q_kshape", K))
piece("q_kpeak", peak_sql("q_kindex", "q_kshape", K))
piece("q_kyp", f"SELECT {K}, blk, arg_max(cal, x*100000-idx) AS yp FROM q_kshape GROUP BY ALL")
piece("q_themed", """SELECT *, 'all' AS "group" FROM q_season UNION ALL SELECT *, theme FROM q_season WHERE theme IS NOT NULL""")
piece("q_tser", f"""SELECT t.run_id, "group", idx, month, sum(v) AS v FROM q_themed t JOIN q_own o ON o.run_id=t.run_id AND o.keyword=t.keyword GROUP BY ALL""")
piece("q_tshape", shapes("q_tser", G))
piece("q_tindex", index_sql("q_tshape", G))
piece("q_tpeak", peak_sql("q_tindex", "q_tshape", G))


def phases_sql(index, keys):
    on = " AND ".join(f"b.{k.strip()}=a.{k.strip()}" for k in keys.split(","))
    ak = ", ".join("a." + k.strip() for k in keys.split(","))
    return f"""
WITH ix AS (SELECT *, greatest(ix, 0.01) AS v, max(greatest(ix,0.01)) OVER (PARTITION BY {keys}) AS mx, min(greatest(ix,0.01)) OVER (PARTITION BY {keys}) AS mn FROM {index}),
c AS (SELECT *, CASE WHEN v>=1+0.7*(mx-1) THEN 'peak' WHEN v<0.9 THEN 'off' ELSE '' END AS c FROM ix),
near AS (SELECT {ak}, a.cal, arg_min(b.c, (b.cal-a.cal+11)%12) FILTER (b.c<>'') AS f, min((b.cal-a.cal+11)%12+1) FILTER (b.c<>'') AS fd,
  arg_min(b.c, (a.cal-b.cal+11)%12) FILTER (b.c<>'') AS bk, max(b.v) FILTER ((b.cal-a.cal+12)%12 IN (1,11)) AS side FROM c a JOIN c b ON {on} GROUP BY ALL),
p AS (SELECT c.*, CASE WHEN c<>'' THEN c WHEN f='off' AND v>=side AND v>=1.1 THEN 'rebound' WHEN f='off' AND fd<=2 THEN 'leaving'
  WHEN bk='off' AND f='peak' THEN 'rising' ELSE 'hold' END AS p FROM c JOIN near USING ({keys}, cal)),
n2 AS (SELECT {ak}, a.cal, arg_min(b.p, (b.cal-a.cal+11)%12) FILTER (b.p<>'off') AS nxt, min((b.cal-a.cal+11)%12+1) FILTER (b.p<>'off') AS ah,
  min((a.cal-b.cal+11)%12+1) FILTER (b.p<>'off') AS bh FROM p a JOIN p b ON {on} GROUP BY ALL)
SELECT p.*, CASE WHEN mx/mn<1.4 THEN 'all-year' WHEN p='off' AND nxt IN ('rising','peak') AND ah<=least(2, ah+bh-2) THEN 'prepare' ELSE p END AS phase FROM p JOIN n2 USING ({keys}, cal)"""


piece("q_kphases", phases_sql("q_kindex", K))
piece("q_tphases", phases_sql("q_tindex", G))
check("H4_seasonal_index", on(lambda m: indexed(m).select("run_id", "keyword", F.posexplode("index").alias("k", "index")).select(
    "run_id", "keyword", (F.col("k") + 1).alias("cal"), "index")), 'SELECT run_id, keyword, cal, ix AS "index" FROM q_kindex')
check("H5_season_phases", on(lambda m: op.with_phases(indexed(m)).select("run_id", "keyword", F.posexplode("phases").alias("k", "phase")).select(
    "run_id", "keyword", (F.col("k") + 1).alias("cal"), "phase")), "SELECT run_id, keyword, cal, phase FROM q_kphases")
check("H6_year_peaks", on(lambda m: indexed(m).select("run_id", "keyword", "peak", "years", "hits", F.array_join("year_peaks", ",").alias("year_peaks"))), """
SELECT run_id, keyword, peak, years::int AS years, hits::int AS hits, year_peaks FROM q_kpeak JOIN (
  SELECT run_id, keyword, string_agg(yp::varchar, ',' ORDER BY blk) AS year_peaks FROM q_kyp GROUP BY ALL) USING (run_id, keyword)""")
piece("q_themes", f"""
SELECT t.*, n3, p3, peak, {R('e4/nullif(e3,0)-1', 4)} AS yoy12, {R('n3/nullif(p3,0)-1', 4)} AS yoy3 FROM (
  SELECT run_id, "group", count(*) AS size, count(signal) AS signals, sum(e3) AS e3, sum(e4) AS e4, sum(n3) AS n3, sum(p3) AS p3 FROM q_themed GROUP BY ALL) t
JOIN q_tpeak USING (run_id, "group")""".replace("t.*, n3, p3, peak", "t.*, peak"))
check("H7_theme_rollup", on(lambda m: themes(m).select(
    "run_id", "group", "size", "signals", "e3", "e4", "yoy12", "yoy3", "peak", F.array_join("phases", ",").alias("phases"))), """
SELECT run_id, "group", size, signals, e3, e4, yoy12, yoy3, peak, phases FROM q_themes
JOIN (SELECT run_id, "group", string_agg(phase, ',' ORDER BY cal) AS phases FROM q_tphases GROUP BY ALL) USING (run_id, "group")""")
piece("q_ttop", """
SELECT *, row_number() OVER (PARTITION BY run_id, "group" ORDER BY total4 DESC, keyword) AS pos FROM q_themed""")
check("H8_theme_top", on(lambda m: op.theme_top(rows(m)).select("run_id", "group", "pos", "keyword", "e4")),
      """SELECT run_id, "group", pos::int AS pos, keyword, e4 FROM q_ttop WHERE pos<=10""")


def _odd(m):
    """The bar of 3000 searches is met at every scale by reading the series times ten."""
    big = indexed(m).withColumn("e4", F.col("e4") * 10)
    return op.theme_odd(big, themes(m))


check("H8_theme_odd", on(_odd), f"""
SELECT run_id, "group", pos::int AS pos, keyword, e4, peak, theme_peak, hits::int AS hits, years::int AS years FROM (
  SELECT t.run_id, t."group", t.keyword, t.e4*10 AS e4, k.peak, p.peak AS theme_peak, hits, years, row_number() OVER (PARTITION BY t.run_id, t."group" ORDER BY total4 DESC, t.keyword) AS pos
  FROM q_ttop t JOIN q_kpeak k ON k.run_id=t.run_id AND k.keyword=t.keyword JOIN (SELECT run_id, "group", peak FROM q_tpeak) p ON p.run_id=t.run_id AND p."group"=t."group"
  WHERE t.pos>10 AND t.e4*10>=3000 AND years>=2 AND least((k.peak-p.peak+12)%12,(p.peak-k.peak+12)%12)>=2 AND hits>=CASE WHEN years>=4 THEN 3 ELSE years END AND {R('top', 2)}>=1.4) WHERE pos<=3""")
check("H9_theme_off_and_order", on(lambda m: op.theme_order(themes(m), op.next_month())), """
SELECT run_id, "group", off, phase AS phase_now, (list_position(['prepare','rising','peak','rebound','hold','leaving','off','all-year'], phase)-1)::int AS phase_order, ((peak-now+12)%12)::int AS months_to_peak, e4 FROM (
  SELECT t.run_id, t."group", t.peak, t.e4, now, (p.top-b.ix>=0.15 AND least((t.peak-bp.peak+12)%12,(bp.peak-t.peak+12)%12)>=2) AS off
  FROM q_themes t JOIN q_tpeak p ON p.run_id=t.run_id AND p."group"=t."group" JOIN q_tpeak bp ON bp.run_id=t.run_id AND bp."group"='all'
  JOIN q_tindex b ON b.run_id=t.run_id AND b."group"='all' AND b.cal=t.peak JOIN (SELECT run_id, substr(max(month),6,2)::int%12+1 AS now FROM q_gridmonths GROUP BY 1) n ON n.run_id=t.run_id
  WHERE t."group"<>'all') x JOIN (SELECT run_id, "group", cal, phase FROM q_tphases) ph USING (run_id, "group") WHERE ph.cal=x.now""")
piece("q_monthkw", f"""
SELECT run_id, keyword, theme, month, hits, years, span_from, span_to, {R('ix', 2)} AS "index", volume FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, keyword ORDER BY hits DESC, ix DESC, a) AS k FROM (
    SELECT s.run_id, s.keyword, theme, a, years, CASE WHEN ib.ix>ia.ix THEN b ELSE a END AS month, greatest(ia.ix, ib.ix) AS ix,
      count(*) FILTER (yp IN (a,b)) AS hits, coalesce(max(a) FILTER (yp=a), max(b)) AS span_from, coalesce(max(b) FILTER (yp=b), max(a)) AS span_to
    FROM q_season s JOIN q_kpeak USING (run_id, keyword) JOIN q_kyp y USING (run_id, keyword), (SELECT unnest(range(1,13))::int AS a, (unnest(range(1,13))%12+1)::int AS b) w
    JOIN q_kindex ia ON ia.cal=a JOIN q_kindex ib ON ib.cal=b
    WHERE ia.run_id=s.run_id AND ia.keyword=s.keyword AND ib.run_id=s.run_id AND ib.keyword=s.keyword AND e34>=500 AND years>=2 GROUP BY ALL)
  WHERE hits>=CASE WHEN years>=4 THEN 3 ELSE years END AND ix>=1.4)
JOIN (SELECT run_id, keyword, substr(month,6,2)::int AS month, coalesce({R('avg(v) FILTER (v>0)', 0)}, 0.0) AS volume FROM q_own GROUP BY ALL) USING (run_id, keyword, month)
JOIN q_setup USING (run_id) WHERE k=1 AND NOT list_contains(skip, replace(keyword,' ',''))""")
check("H10_monthly_season_keywords", on(monthly), """
SELECT run_id, keyword, theme, month, hits::int AS hits, years::int AS years, span_from, span_to, "index", volume FROM q_monthkw""")
check("H11_signal_lists", on(lambda m: op.signal_lists(rows(m))), """
SELECT run_id, keyword, signal, first_month, e3, e4, yoy3, theme, CASE WHEN signal='new' THEN e4 ELSE e4-e3 END AS sort_value FROM q_season WHERE signal IS NOT NULL""")
check("H12_untagged_review", on(lambda m: op.untagged_review(rows(m), spec(m))), f"""
SELECT run_id, untagged, {R('u/coalesce(nullif(a,0),1.0)', 4)} AS untagged_share, core, {R('c/coalesce(nullif(a,0),1.0)', 4)} AS core_share,
  {R('c/coalesce(nullif(a,0),1.0)', 4)}>0.1 OR core/n>0.2 AS warn FROM (
  SELECT run_id, count(*) AS n, sum(e4) AS a, count(*) FILTER (theme IS NULL) AS untagged, coalesce(sum(e4) FILTER (theme IS NULL),0.0) AS u,
    count(*) FILTER (theme IS NULL AND rest<>'') AS core, coalesce(sum(e4) FILTER (theme IS NULL AND rest<>''),0.0) AS c
  FROM (SELECT *, trim(CASE WHEN rel IS NULL THEN replace(lower(keyword),seed,' ') ELSE regexp_replace(replace(lower(keyword),seed,' '), '(?i)' || rel, ' ', 'g') END) AS rest FROM q_season JOIN q_setup USING (run_id)) GROUP BY 1)""")
piece("q_pool", "SELECT *, CASE WHEN e4>e3 THEN 'up' ELSE 'down' END AS side FROM q_season WHERE e4<>e3")
check("H13_theme_up_down", on(lambda m: pool(m).select("run_id", "keyword", "theme", "side", "e3", "e4")), "SELECT run_id, keyword, theme, side, e3, e4 FROM q_pool")
TREND = 400


def trends(m):
    return op.trend_pool(pool(m), TREND)


piece("q_trends", f"""
SELECT * FROM (SELECT *, greatest(e3,e4) AS size, CASE WHEN e3<=greatest(e3,e4)*0.02 AND e4>0 THEN 'new' WHEN e3>0 AND e4/nullif(e3,0)>=1.5 THEN 'growing'
  WHEN e3>0 AND e4/nullif(e3,0)<=0.5 THEN 'falling' END AS branch FROM q_pool) WHERE size>={TREND} AND branch IS NOT NULL""")
check("H14_trend_pool", on(lambda m: trends(m).select("run_id", "keyword", "branch", "size")), "SELECT run_id, keyword, branch, size FROM q_trends")


SPIKY = 0.95


def _spikes(m):
    """Brand series with their highest months blown up, so that months jump at every scale."""
    w = fd.wide(m).withColumn("theme", F.when(F.length("keyword") > 7, "long").otherwise("short"))
    w = w.withColumn("own", F.transform("own", lambda v: F.when(v >= SPIKY * F.array_max("own"), v * 10).otherwise(v)))
    return op.co_spike_months(w, 2, 0.5)


check("H15_co_spike_months", on(_spikes), """
SELECT run_id, month, queries::bigint AS queries, theme, top/queries AS share FROM (
  SELECT run_id, month, sum(k) AS queries, max(k) AS top, arg_min(theme, -k*10 + CASE WHEN theme='long' THEN 0 ELSE 1 END) AS theme FROM (
    SELECT run_id, month, CASE WHEN length(keyword)>7 THEN 'long' ELSE 'short' END AS theme, count(*) AS k FROM (
      SELECT *, (list_sort(list(v) OVER (PARTITION BY run_id, keyword)))[13] AS med FROM (
        SELECT run_id, keyword, idx, month, CASE WHEN v>=0.95*max(v) OVER (PARTITION BY run_id, keyword) THEN v*10 ELSE v END AS v FROM q_wide) WHERE idx>=24) WHERE med>=50 AND v>=4*med GROUP BY ALL) GROUP BY ALL)
WHERE queries>=2 AND top>=0.5*queries""")
piece("q_quarter", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, list ORDER BY abs(gain) DESC, keyword) AS pos FROM (
  SELECT run_id, keyword, theme, p3 AS y0, q0, n3 AS q1, n3-q0 AS gain, unnest(CASE WHEN n3>q0 THEN CASE WHEN p3>=10 AND n3>p3 THEN ['up_qoq','up_both'] ELSE ['up_qoq'] END
    WHEN n3<q0 THEN CASE WHEN p3>=10 AND n3<p3 THEN ['down_qoq','down_both'] ELSE ['down_qoq'] END ELSE [] END) AS list FROM q_pool WHERE q0>=10)) WHERE pos<=20""")
check("H16_quarter_direction", on(lambda m: op.quarter_direction(pool(m))), "SELECT * REPLACE (pos::int AS pos) FROM q_quarter")
check("H17_season_calendar", on(lambda m: op.season_calendar(monthly(m))), "SELECT run_id, coalesce(theme,'(none)') AS theme, count(*) AS keywords, " + ", ".join(
    f"count(*) FILTER (month={k}) AS m{k}" for k in range(1, 13)) + " FROM q_monthkw GROUP BY ALL")


def _meta(m):
    listed = records.tagged_candidates(with_pos(m.query), nodes(m))
    return op.collection_meta(listed, fd.series(m), filtered(m), rows(m))


check("H18_collection_meta", on(_meta), """
SELECT r.run_id, queried, from_related, from_cluster, returned, kept, off, low, cluster_kept, cluster_signals FROM (
  SELECT run_id, count(*) AS queried, count(*) FILTER (q) AS from_related, count(*) FILTER (NOT q) AS from_cluster FROM q_src GROUP BY 1) r
JOIN (SELECT run_id, count(DISTINCT keyword) AS returned FROM q_monthly GROUP BY 1) USING (run_id)
JOIN (SELECT run_id, count(*) FILTER (status='kept') AS kept, count(*) FILTER (status='off') AS off, count(*) FILTER (status='low') AS low FROM q_filtered GROUP BY 1) USING (run_id)
JOIN (SELECT run_id, count(*) FILTER (NOT q) AS cluster_kept, count(signal) FILTER (NOT q) AS cluster_signals FROM q_season LEFT JOIN q_src USING (run_id, keyword) GROUP BY 1) USING (run_id)""")
piece("q_src", """
SELECT run_id, keyword, keyword IN (SELECT keyword FROM q_query q WHERE q.run_id=a.run_id) AS q FROM (SELECT run_id, keyword FROM q_nodes UNION SELECT run_id, keyword FROM q_query) a""")


check("H18_seed_series", on(lambda m: op.seed_series(filtered(m).withColumn("keyword", F.regexp_replace("keyword", "^brand#8 cold ", "")), spec(m))), """
SELECT run_id, idx, month, v AS volume FROM (SELECT * REPLACE (regexp_replace(keyword, '^brand#8 cold ', '') AS keyword) FROM q_own SEMI JOIN q_filtered USING (run_id, keyword)) JOIN q_setup USING (run_id)
WHERE replace(keyword,' ','')=replace(seed,' ','')""")


def _chosen(m):
    """Trends picked from outside: one per adjective, members in input order."""
    w = F.split("keyword", " ")
    return m.metrics.select("run_id", w[1].alias("trend"), _index(ADJECTIVES, w[1]).alias("trend_ord"), "ord", "keyword")


check("H19_trend_members", on(lambda m: op.trend_members(_chosen(m), trends(m))), f"""
SELECT run_id, trend, trend_ord::int AS trend_ord, pos::int AS pos, keyword, side, members, largest, e3, e4 FROM (
  SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY largest DESC, trend_ord) AS k FROM (
    SELECT *, count(*) OVER (PARTITION BY run_id, trend) AS members, max(size) OVER (PARTITION BY run_id, trend) AS largest,
      row_number() OVER (PARTITION BY run_id, trend ORDER BY ord) AS pos FROM (
      SELECT *, first(side) OVER (PARTITION BY run_id, trend ORDER BY ord) AS lead FROM (
        SELECT m.run_id, split_part(m.keyword,' ',2) AS trend, {sql_index(ADJECTIVES, "split_part(m.keyword,' ',2)")} AS trend_ord, ord, m.keyword,
          CASE WHEN branch='falling' THEN 'down' ELSE 'up' END AS side, size, e3, e4 FROM q_metrics m JOIN q_trends t ON t.run_id=m.run_id AND t.keyword=m.keyword))
    WHERE side=lead) WHERE members>=2) WHERE k<=5 AND pos<=10""")
