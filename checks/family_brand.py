from pyspark.sql import functions as F

from querytide.functions import cols
from querytide.operators import brand as op

from .domain import NOUNS, Domain, _index, sql_index
from .sqlkit import R, check, piece

SETUP = [  # run, own brand, own words, watched brands
    ("automobile", "brand#2", ["brand#2"], ["brand#3", "brand#14"]), ("building", "brand#5", ["Brand#5", "blue"], ["brand#1"]), ("furniture", "brand#7", ["brand#7", "old"], ["brand#2", "brand#4", "brand#14"]),
    ("household", "brand#1", [], []), ("machinery", None, ["small"], ["brand#9"]),
]
NAMES = [(f"brand#{k}", f"brand#{k}") for k in [*range(1, 10), 14]] + [("brand#2", "b2 co"), ("brand#5", "blue"), ("brand#7", "Old")]
EXCLUDES = [("brand#2", f"brand#2{k}") for k in range(6)]
CATS = [("anvil", "g1", False, "selling"), ("bolt", "g1", False, "partly"), ("gear", "g1", True, "selling"),
        ("gizmo", "g2", False, "not_sold"), ("plate", "g2", False, ""), ("ring", "g2", True, "selling"),
        ("rod", "g3", True, "selling"), ("widget", "g3", False, "unverified"), ("small ring", "g3", False, "selling")]
LISTED = [(c, b) for c, *_ in CATS for b in ("brand#1", "brand#9", "brand#20")] + [("ring", "brand#14")]


TURNS = ["behind", "even", "ahead", "none"]


class Brands:
    def __init__(self, dom):
        self.dom = dom

    def each_run(self, rows, schema):
        return self.dom.each_run(rows, schema)

    @property
    def setup(self):
        return self.dom.stage("brand setup", lambda: self.dom.spark.createDataFrame(SETUP, "run_id string, own_brand string, own_words array<string>, watch array<string>"))

    @property
    def names(self):
        return self.each_run(NAMES, "brand string, name string")

    @property
    def excludes(self):
        return self.each_run(EXCLUDES, "brand string, text string")

    @property
    def categories(self):
        rows = [(c, k, g, d, p) for k, (c, g, d, p) in enumerate(CATS)]
        return self.each_run(rows, "category string, cord int, `group` string, deep boolean, presence string")

    @property
    def listed(self):
        return self.each_run(LISTED, "category string, brand string")

    @property
    def lists(self):
        """Related list of a category: the keywords that end with its term."""
        w = F.split("keyword", " ")
        names = F.array_compact(F.array(w[2], F.when((w[1] == "small") & (w[2] == "ring"), F.lit("small ring"))))
        return self.dom.stage("brand lists", lambda: self.dom.metrics.select(
            "run_id", F.explode(names).alias("category"), F.col("ord").alias("rank"), F.col("keyword").alias("query")))

    @property
    def volumes(self):
        """Keyword volumes; facets summed over brands (one spelt without space, one not listed); terms at a multiple of their sum."""
        w = F.split("keyword", " ")
        v = F.sum("volume_total").alias("volume")
        m = self.dom.metrics
        facets = m.where(w[1] != "cold").groupBy("run_id", F.concat(w[1], F.when(w[1] == "red", "").otherwise(" "), w[2]).alias("keyword"))
        terms = m.groupBy("run_id", w[2].alias("keyword")).agg(v).withColumn("volume", F.col("volume") * 3 * _index(NOUNS, F.col("keyword")))
        return self.dom.stage("brand volumes", lambda: m.select("run_id", "keyword", F.col("volume_total").alias("volume")).unionByName(
            facets.agg(v)).unionByName(terms))

    @property
    def hits(self):
        return self.dom.stage("brand hits", lambda: op.brand_hits(
            self.dom.metrics.select("run_id", F.col("keyword").alias("query")), self.names, self.excludes))

    @property
    def mods(self):
        return self.dom.stage("modifiers", lambda: op.category_modifiers(self.lists, self.setup))

    @property
    def shares(self):
        return self.dom.stage("shares", lambda: op.share_of_search(self.lists, self.hits, self.volumes))

    @property
    def ratios(self):
        return op.name_ratio(self.categories, self.lists, self.hits, self.shares, self.volumes)

    @property
    def verdicts(self):
        return self.dom.stage("brand verdicts", lambda: op.naming_verdict(self.ratios, self.shares, self.setup))

    @property
    def journeys(self):
        """Journeys of a category: those whose first node is of it, the term put in second place."""
        noun = F.split(F.get("seq", F.lit(0)), " ")
        seq = F.concat(F.slice("seq", 1, 1), F.array(F.col("category")), F.slice("seq", 2, 100000))
        return self.dom.journeys.withColumn("category", noun[2]).withColumn("facet", noun[1]).withColumn("tail", F.col("seq")).withColumn("seq", seq)

    @property
    def facet_journeys(self):
        seed = F.concat_ws(" ", "facet", "category")
        deep = [c for c, _, d, _ in CATS if d]
        return self.journeys.where(F.col("category").isin(deep)).withColumn("seed", seed).withColumn(
            "seq", F.concat(F.slice("tail", 1, 1), F.array(seed), F.slice("tail", 2, 100000)))

    @property
    def index(self):
        return self.dom.stage("brand index", lambda: op.journey_brand_index(self.journeys, self.hits, ["run_id", "category"], "category"))

    @property
    def axes(self):
        return op.journey_axis(self.index, ["run_id", "category"], self.setup, self.journeys)

    @property
    def facet_index(self):
        return op.journey_brand_index(self.facet_journeys, self.hits, ["run_id", "category", "facet"], "seed")

    @property
    def facet_axes(self):
        return op.journey_axis(self.facet_index, ["run_id", "category", "facet"], self.setup, self.facet_journeys)

    @property
    def facets(self):
        w = F.split("keyword", " ")
        cat = self.dom.metrics.select("run_id", w[2].alias("category"), w[1].alias("facet")).distinct()
        return self.dom.stage("facets", lambda: op.facet_metrics(cat, self.volumes, self.setup))

    @property
    def deep_facets(self):
        deep = [c for c, _, d, _ in CATS if d]
        return self.dom.stage("deep facets", lambda: self.facets.where(F.col("category").isin(deep)).join(
            self.facet_axes, ["run_id", "category", "facet"], "left"))

    @property
    def evidence(self):
        own = op.with_setup(self.hits, self.setup, "own_brand").where(op.is_own()).select("run_id", "query")
        mine = self.dom.journeys.withColumn("query", F.get("seq", F.lit(0))).join(own, ["run_id", "query"], "left_semi")
        return op.category_evidence(self.categories, mine, own, self.lists, self.mods, self.verdicts)

    @property
    def judged(self):
        key = ["run_id", "category"]
        return self.dom.stage("judged", lambda: self.categories.join(self.verdicts.drop("own_queries"), key).join(
            self.evidence, key).join(self.axes.drop("branded"), key, "left").withColumn("status", op.status()))

    @property
    def mixed(self):
        """Judged categories with the naming verdict read by category order, so that every status occurs."""
        turn = F.element_at(F.array(*[F.lit(v) for v in TURNS]), F.col("cord") % 4 + 1)
        return self.judged.withColumn("verdict", turn).withColumn("status", op.status())

    @property
    def rivals(self):
        return op.competitors(self.shares, self.setup)


def on(f):
    return lambda s, d: f(Brands(Domain(s, d)))


def values(rows):
    return "(VALUES " + ",".join("(" + ",".join("NULL" if x is None else repr(x) if not isinstance(x, bool) else str(x).lower() for x in r) + ")" for r in rows) + ")"


piece("q_set", "SELECT * FROM (VALUES " + ", ".join(f"('{r}', {repr(o) if o else 'NULL'}, {w}::VARCHAR[], {x}::VARCHAR[])" for r, o, w, x in SETUP) + ") v(run_id, own_brand, own_words, watch)")
MINE = "(FROM q_set z WHERE z.run_id={0}.run_id AND z.own_brand={0}.brand)"
HOLDS = "len(list_filter(own_words, lambda w: contains({}, lower(w))))>0"
piece("q_runs", "SELECT DISTINCT run_id FROM q_metrics")
piece("q_names", f"SELECT * FROM {values(NAMES)} v(brand, name)")
piece("q_cats", f"""SELECT * FROM q_runs, {values([(c, k, g, d, p) for k, (c, g, d, p) in enumerate(CATS)])} v(category, cord, "group", deep, presence)""")
piece("q_hits", f"""
SELECT DISTINCT run_id, keyword AS query, brand FROM (SELECT run_id, keyword, split_part(keyword,' ',1) AS a, split_part(keyword,' ',2) AS b, split_part(keyword,' ',3) AS c FROM q_metrics),
  (SELECT brand, replace(lower(name),' ','') AS n FROM q_names)
WHERE (starts_with(a||b||c, n) OR starts_with(b||c, n) OR starts_with(c, n))
  AND NOT EXISTS (FROM {values(EXCLUDES)} x(xb, xt) WHERE xb=brand AND contains(a||b||c, xt))""")
piece("q_lists", """
SELECT run_id, split_part(keyword,' ',3) AS category, ord AS rank, keyword AS query FROM q_metrics UNION ALL
SELECT run_id, 'small ring', ord, keyword FROM q_metrics WHERE keyword LIKE '% small ring'""")
piece("q_volumes", f"""
SELECT run_id, keyword, volume_total AS volume FROM q_metrics UNION ALL
SELECT run_id, split_part(keyword,' ',2) || CASE WHEN split_part(keyword,' ',2)='red' THEN '' ELSE ' ' END || split_part(keyword,' ',3), sum(volume_total) FROM q_metrics
  WHERE split_part(keyword,' ',2)<>'cold' GROUP BY ALL UNION ALL
SELECT run_id, split_part(keyword,' ',3), sum(volume_total)*3*{sql_index(NOUNS, "split_part(keyword,' ',3)")} FROM q_metrics GROUP BY run_id, split_part(keyword,' ',3)""")
piece("q_vns", "SELECT run_id, replace(keyword,' ','') AS key, max(volume) AS volume FROM q_volumes GROUP BY ALL")
piece("q_mods", f"""
SELECT run_id, category, rank, query, trim(left(query, length(query)-length(category))) AS modifier, {HOLDS.format("left(query, length(query)-length(category))")} AS own FROM q_lists JOIN q_set USING (run_id)""")
check("I1_brand_match", on(lambda b: b.hits), "SELECT * FROM q_hits")
check("I2_category_modifiers", on(lambda b: op.unique_modifiers(b.mods)),
      "SELECT run_id, category, modifier, min(rank) AS rank, bool_or(own) AS own FROM q_mods GROUP BY ALL")


def _candidates(b):
    seq = F.concat(F.array(F.col("category")), F.col("tail"))
    return op.journey_candidates(b.journeys.withColumn("seq", seq), b.setup, b.listed)


piece("q_cj", """
SELECT run_id, path_id, split_part(any_value(node) FILTER (pos=0),' ',3) AS category, split_part(any_value(node) FILTER (pos=0),' ',2) AS facet FROM q_steps GROUP BY ALL""")
check("I3_journey_candidates", on(_candidates), f"""
SELECT run_id, category, node, n, pos::int AS pos, EXISTS (FROM {values(LISTED)} l(c, b) WHERE c=category AND contains(node, b)) AS known FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, category ORDER BY n DESC, node) AS pos FROM (
    SELECT s.run_id, category, node, count(*) AS n FROM q_steps s JOIN q_cj USING (run_id, path_id) JOIN q_set USING (run_id) WHERE pos<=2 AND NOT contains(replace(node,' ',''), category) AND NOT {HOLDS.format("node")} GROUP BY ALL))
WHERE pos<=22""")
piece("q_asked", """
SELECT run_id, query, cord, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id, query ORDER BY cord, rank) AS k FROM (
  SELECT run_id, cord, category AS query, 0::bigint AS rank FROM q_cats UNION ALL
  SELECT l.run_id, cord, query, rank FROM q_lists l JOIN q_cats USING (run_id, category) SEMI JOIN q_hits h ON h.run_id=l.run_id AND h.query=l.query)) WHERE k=1""")


def asked(b):
    return op.brand_query_list(b.categories, b.lists, b.hits)


check("I4_brand_query_list", on(asked), "SELECT * FROM q_asked")
check("I5_volume_lookup", on(lambda b: op.volume_lookup(b.facets.select("run_id", F.col("facet_query").alias("query")), b.volumes)), """
SELECT f.run_id, query, coalesce(v.volume, n.volume) AS volume FROM (
  SELECT DISTINCT run_id, split_part(keyword,' ',2) || ' ' || split_part(keyword,' ',3) AS query FROM q_metrics) f
LEFT JOIN q_volumes v ON v.run_id=f.run_id AND v.keyword=query LEFT JOIN q_vns n ON n.run_id=f.run_id AND n.key=replace(query,' ','')""")
piece("q_shares", f"""
SELECT *, {R('volume/sum(volume) OVER (PARTITION BY run_id, category)*100', 1)} AS share FROM (
  SELECT l.run_id, l.category, h.brand, sum(volume_total) AS volume, count(*) AS queries, arg_max(l.query, (volume_total, l.query)) AS top_query
  FROM q_lists l JOIN q_hits h ON h.run_id=l.run_id AND h.query=l.query JOIN q_metrics m ON m.run_id=l.run_id AND m.keyword=l.query GROUP BY ALL) WHERE volume>0""")
check("I6_share_of_search", on(lambda b: b.shares), "SELECT * FROM q_shares")
piece("q_ratios", f"""
SELECT *, coalesce({R('branded/nullif(branded+term_volume,0)*100', 1)}, 0.0) AS name_ratio FROM (
  SELECT c.run_id, c.category, coalesce(v.volume, n.volume, 0) AS term_volume, coalesce(branded,0) AS branded, coalesce(branded_queries,0) AS branded_queries FROM q_cats c
  LEFT JOIN q_volumes v ON v.run_id=c.run_id AND v.keyword=c.category LEFT JOIN q_vns n ON n.run_id=c.run_id AND n.key=replace(c.category,' ','')
  LEFT JOIN (SELECT run_id, category, sum(volume_total) AS branded, count(*) AS branded_queries FROM (SELECT DISTINCT l.run_id, l.category, l.query, volume_total FROM q_lists l
    JOIN q_hits h ON h.run_id=l.run_id AND h.query=l.query JOIN q_metrics m ON m.run_id=l.run_id AND m.keyword=l.query
    JOIN q_shares s ON s.run_id=l.run_id AND s.category=l.category AND s.brand=h.brand) GROUP BY ALL) x ON x.run_id=c.run_id AND x.category=c.category)""")
check("I6_name_ratio", on(lambda b: b.ratios), "SELECT * FROM q_ratios")


def two_x(o, t, floor):
    return f"CASE WHEN {o}<{floor} AND {t}<{floor} THEN 'none' WHEN {t}>=2*{o} THEN 'behind' WHEN {o}>=2*{t} THEN 'ahead' ELSE 'even' END"


check("I7_two_x_axis", on(lambda b: b.shares.select("run_id", "category", "brand", cols.two_x("volume", "queries", 100).alias("axis"))),
      f"SELECT run_id, category, brand, {two_x('volume', 'queries', 100)} AS axis FROM q_shares")
piece("q_rivals", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, category ORDER BY volume DESC, brand) AS pos FROM q_shares s WHERE NOT EXISTS {MINE.format("s")}) WHERE pos<=8""")
piece("q_naming", f"""
SELECT *, CASE WHEN branded<1000 OR name_ratio<10 THEN 'none' ELSE {two_x('coalesce(own_share,0)', 'coalesce(top_share,0)', 0)} END AS verdict FROM q_ratios
LEFT JOIN (SELECT run_id, category, volume AS own_volume, share AS own_share, queries AS own_queries FROM q_shares s WHERE EXISTS {MINE.format("s")}) USING (run_id, category)
LEFT JOIN (SELECT run_id, category, brand AS top_brand, share AS top_share FROM q_rivals WHERE pos=1) USING (run_id, category)""")
check("I8_naming_verdict", on(lambda b: b.verdicts.withColumn("own_queries", F.coalesce("own_queries", F.lit(0)))),
      "SELECT * REPLACE (coalesce(own_queries,0) AS own_queries) FROM q_naming")


def index_sql(keys, extra):
    return f"""
SELECT s.run_id, {keys}, brand, count(DISTINCT node) AS n, min(CASE WHEN pos=0 THEN -1 ELSE pos END)::int AS step FROM (
  SELECT s.run_id, {keys}, node, pos FROM q_steps s JOIN q_cj USING (run_id, path_id) {extra}) s JOIN q_hits h ON h.run_id=s.run_id AND h.query=s.node GROUP BY ALL"""


DEEP = "WHERE category IN (" + ",".join(f"'{c}'" for c, _, d, _ in CATS if d) + ")"
piece("q_bindex", index_sql("category", ""))
piece("q_findex", index_sql("category, facet", DEEP))


def axis_sql(index, keys, every):
    k = f"run_id, {keys}"
    return f"""
SELECT *, {two_x('own_n', 'top_n', 3)} AS axis FROM (SELECT {k}, coalesce(own_n,0) AS own_n, own_step, "top", coalesce(top_n,0) AS top_n, top_step, coalesce(branded,0) AS branded FROM ({every})
LEFT JOIN (SELECT {k}, sum(n)::bigint AS branded FROM {index} GROUP BY ALL) USING ({k})
LEFT JOIN (SELECT {k}, n AS own_n, step AS own_step FROM {index} s WHERE EXISTS {MINE.format("s")}) USING ({k})
LEFT JOIN (SELECT {k}, brand AS "top", n AS top_n, step AS top_step FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY n DESC, CASE WHEN step>0 THEN step ELSE 99 END, brand) AS z
  FROM {index} s WHERE NOT EXISTS {MINE.format("s")}) WHERE z=1) USING ({k}))"""


piece("q_axes", axis_sql("q_bindex", "category", "SELECT DISTINCT run_id, category FROM q_cj"))
piece("q_faxes", axis_sql("q_findex", "category, facet", f"SELECT DISTINCT run_id, category, facet FROM q_cj {DEEP}"))
STEPS0 = ["own_step", "top_step"]


def plain(df):
    for c in STEPS0:
        df = df.withColumn(c, F.coalesce(c, F.lit(0)))
    return df


check("I9_journey_brand_index", on(lambda b: b.index), "SELECT * FROM q_bindex")
check("I10_journey_axis", on(lambda b: plain(b.axes)), "SELECT * REPLACE (coalesce(own_step,0) AS own_step, coalesce(top_step,0) AS top_step) FROM q_axes")
piece("q_facets", f"""
SELECT *, {R('own_volume/nullif(facet_volume,0)*100', 1)} AS rate FROM (
  SELECT f.run_id, category, facet, facet || ' ' || category AS facet_query, n.volume AS facet_volume, o.volume AS own_volume FROM (
    SELECT DISTINCT run_id, split_part(keyword,' ',2) AS facet, split_part(keyword,' ',3) AS category FROM q_metrics) f
  LEFT JOIN q_vns n ON n.run_id=f.run_id AND n.key=facet||category LEFT JOIN q_vns o ON o.run_id=f.run_id AND o.key=(SELECT own_brand FROM q_set z WHERE z.run_id=f.run_id)||facet||category)""")
check("I11_facet_metrics", on(lambda b: b.facets), "SELECT * FROM q_facets")
check("I12_facet_deep_axis", on(lambda b: plain(b.facet_axes)), "SELECT * REPLACE (coalesce(own_step,0) AS own_step, coalesce(top_step,0) AS top_step) FROM q_faxes")
piece("q_evidence", f"""
SELECT c.run_id, c.category, coalesce(own_queries,0) AS own_queries, coalesce(path_mentions,0) AS path_mentions, coalesce(query_mentions,0) AS query_mentions,
  coalesce(listed,0) AS listed, coalesce(modifiers,0) AS modifiers, listed IS NOT NULL AS queried FROM q_cats c
LEFT JOIN (SELECT run_id, category, own_queries FROM q_naming) USING (run_id, category)
LEFT JOIN (SELECT c.run_id, c.category, count(*) AS path_mentions FROM q_cats c JOIN (SELECT s.run_id, string_agg(node, ' > ' ORDER BY pos) AS p, any_value(node) FILTER (pos=0) AS f FROM q_steps s GROUP BY s.run_id, path_id) j
  ON j.run_id=c.run_id AND contains(p, c.category) SEMI JOIN (SELECT run_id AS r, query FROM q_hits s WHERE EXISTS {MINE.format("s")}) h ON h.r=j.run_id AND h.query=f GROUP BY ALL) USING (run_id, category)
LEFT JOIN (SELECT c.run_id, c.category, count(*) AS query_mentions FROM q_cats c JOIN q_hits h ON h.run_id=c.run_id AND contains(query, c.category) WHERE EXISTS {MINE.format("h")} GROUP BY ALL) USING (run_id, category)
LEFT JOIN (SELECT run_id, category, count(*) AS listed FROM q_lists GROUP BY ALL) USING (run_id, category)
LEFT JOIN (SELECT run_id, category, count(*) AS modifiers FROM q_mods GROUP BY ALL) USING (run_id, category)""")
check("I13_category_evidence", on(lambda b: b.evidence), "SELECT * FROM q_evidence")
piece("q_judged", """
SELECT *, CASE verdict WHEN 'ahead' THEN 'owned' WHEN 'even' THEN 'contested' WHEN 'behind' THEN 'trailing' ELSE CASE WHEN axis='ahead' THEN 'emerging' ELSE 'unclaimed' END END AS status
FROM q_cats JOIN (SELECT * EXCLUDE (own_queries) FROM q_naming) USING (run_id, category) JOIN q_evidence USING (run_id, category)
LEFT JOIN (SELECT * EXCLUDE (branded) FROM q_axes) USING (run_id, category)""")
piece("q_mixed", """
SELECT * REPLACE (CASE v WHEN 'ahead' THEN 'owned' WHEN 'even' THEN 'contested' WHEN 'behind' THEN 'trailing' ELSE CASE WHEN axis='ahead' THEN 'emerging' ELSE 'unclaimed' END END AS status) FROM (
  SELECT *, ['behind','even','ahead','none'][cord%4+1] AS v FROM q_judged)""")
check("I14_deep_candidates", on(lambda b: op.deep_candidates(b.judged).withColumn("priority", F.coalesce("priority", F.lit(-1)))), """
SELECT a.run_id, a.category, a.verdict, a.modifiers, a.term_volume, a.modifiers>=30 AS possible,
  CASE WHEN a.modifiers>=30 THEN list_position(['even','behind','none','ahead'], a.verdict)-1 ELSE -1 END::int AS priority,
  CASE WHEN a.modifiers<30 AND b.modifiers>=30 THEN b.category END AS broader
FROM q_judged a LEFT JOIN q_judged b ON b.run_id=a.run_id AND b.category='ring' AND a.category='small ring'""")


def _audit(b):
    """A ghost category without a list, mixed limits, and the volumes of one adjective missing."""
    ghost = b.categories.select("run_id", "category").unionByName(b.categories.select("run_id", F.lit("ghost").alias("category")).distinct())
    limits = b.each_run([("related", 1000), ("related", 500), ("journeys", 200)], "source string, `limit` int")
    watched = b.each_run([("ring", 1), ("sundial", 1)], "category string, k int")
    known = b.volumes.where(~F.contains("keyword", F.lit("hot")))
    facets = b.facets.where(F.col("category").isin([c for c, _, d, _ in CATS if d]))
    return op.run_coverage_audit(ghost, b.lists, b.journeys, b.judged, asked(b), known, facets, b.facet_journeys, limits, watched)


check("I15_run_coverage_audit", on(_audit), f"""
SELECT run_id, 'related list missing' AS finding, 'ghost' AS detail FROM q_runs UNION ALL
SELECT run_id, 'journeys missing', category FROM q_naming n WHERE verdict='none' AND NOT EXISTS (FROM q_cj j WHERE j.run_id=n.run_id AND j.category=n.category) UNION ALL
SELECT DISTINCT run_id, 'journeys not needed', category FROM q_cj j WHERE NOT EXISTS (FROM q_naming n WHERE n.run_id=j.run_id AND n.category=j.category AND verdict='none') UNION ALL
SELECT run_id, 'limits differ', 'related' FROM q_runs UNION ALL
SELECT run_id, 'limit too low', 'journeys' FROM q_runs UNION ALL SELECT run_id, 'watched category missing', 'sundial' FROM q_runs UNION ALL
SELECT run_id, 'volume coverage', floor(c)::int::varchar FROM (SELECT a.run_id, count(*) FILTER (v.keyword IS NOT NULL)/count(*)*100 AS c FROM q_asked a
  LEFT JOIN (SELECT DISTINCT run_id, keyword FROM q_volumes WHERE NOT contains(keyword,'hot')) v ON v.run_id=a.run_id AND v.keyword=a.query GROUP BY 1) WHERE c<95 UNION ALL
SELECT run_id, 'facet journeys missing', facet_query FROM q_facets f {DEEP} AND NOT EXISTS (FROM q_cj j WHERE j.run_id=f.run_id AND j.category=f.category AND j.facet=f.facet)""")
check("I16_emerging_upgrade", on(lambda b: b.judged.select("run_id", "category", "verdict", "axis", "status")), "SELECT run_id, category, verdict, axis, status FROM q_judged")
piece("q_bcols", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY watch DESC, volume DESC, brand) AS pos FROM (
  SELECT run_id, brand, count(*) AS categories, sum(volume) AS volume, coalesce(bool_or(list_contains(watch, brand)), false) AS watch FROM q_rivals JOIN q_set USING (run_id) GROUP BY run_id, brand) WHERE watch OR categories>=2) WHERE watch OR pos<=3""")
check("I17_brand_matrix", on(lambda b: op.brand_matrix(b.shares).select("run_id", "category", "brand", "volume", "share", "rank")),
      "SELECT run_id, category, brand, volume, share, (rank() OVER (PARTITION BY run_id, category ORDER BY volume DESC))::int AS rank FROM q_shares")


def columns(b):
    return op.brand_columns(b.shares, b.setup, 2)


check("I17_brand_columns", on(columns), "SELECT * REPLACE (pos::int AS pos) FROM q_bcols")
check("I17_matrix_columns", on(lambda b: op.matrix_columns(b.shares, b.setup, 3)), """
WITH t AS (SELECT run_id, brand, count(*) AS categories, sum(volume) AS volume FROM q_shares GROUP BY ALL)
SELECT run_id, brand, categories, volume, pos, pos<=3 AS shown FROM (
  SELECT run_id, brand, categories, volume, row_number() OVER (PARTITION BY run_id ORDER BY categories DESC, volume DESC, brand) AS pos FROM t LEFT JOIN q_set USING (run_id) WHERE brand IS DISTINCT FROM own_brand
  UNION ALL SELECT s.run_id, own_brand, coalesce(categories,0), coalesce(volume,0.0), 0 FROM q_set s LEFT JOIN t ON t.run_id=s.run_id AND t.brand=own_brand WHERE own_brand IS NOT NULL)""")
check("I17_outside_top", on(lambda b: op.outside_top(op.brand_matrix(b.shares), columns(b), b.setup)), f"""
SELECT run_id, category, brand, rank::int AS rank, volume FROM (SELECT *, rank() OVER (PARTITION BY run_id, category ORDER BY volume DESC) AS rank FROM q_shares) m
WHERE rank<=2 AND NOT EXISTS {MINE.format("m")} AND NOT EXISTS (FROM q_bcols c WHERE c.run_id=m.run_id AND c.brand=m.brand)""")
check("I18_position_ratio", on(lambda b: op.position_ratio(b.judged)), """
SELECT run_id, category, status, CASE WHEN own_share IS NOT NULL THEN CASE WHEN top_share>0 THEN own_share/top_share ELSE 8.0 END
  WHEN axis IS NOT NULL THEN (own_n+1)/(top_n+1) ELSE 1.0 END AS ratio FROM q_judged""")
check("I18_demand_by_status", on(lambda b: op.demand_by_status(b.mixed)), "SELECT run_id, status, count(*) AS categories, sum(term_volume) AS volume FROM q_mixed GROUP BY ALL")
piece("q_fsum", f"""
SELECT *, facet_volume/nullif(sum(facet_volume) OVER (PARTITION BY run_id, category),0) AS share, CASE WHEN own_volume>0 THEN 'named' WHEN own_n>0 OR top_n>0 THEN 'walked' ELSE 'absent' END AS bucket,
  NOT coalesce(own_volume>0,false) AND NOT (coalesce(own_n,0)>0 OR coalesce(top_n,0)>0) AS open FROM (SELECT * FROM q_facets {DEEP}) LEFT JOIN q_faxes USING (run_id, category, facet)""")


def fsum(b):
    return op.facet_summary(b.deep_facets)


check("I19_facet_summary", on(lambda b: fsum(b).select("run_id", "category", "facet", "facet_volume", "share", "bucket", "open", "axis", "top")),
      'SELECT run_id, category, facet, facet_volume, share, bucket, open, axis, "top" FROM q_fsum')
check("I19_facet_highlights", on(lambda b: op.facet_highlights(fsum(b))), """
SELECT run_id, category, coalesce(sum(facet_volume) FILTER (bucket='named'),0.0) AS named_volume, coalesce(sum(facet_volume) FILTER (bucket='walked'),0.0) AS walked_volume,
  coalesce(sum(facet_volume) FILTER (bucket='absent'),0.0) AS absent_volume, count(*) FILTER (axis='ahead') AS ahead,
  (list(facet ORDER BY coalesce(facet_volume,0) DESC, facet) FILTER (axis='behind'))[1] AS worst_facet, count(*) FILTER (open) AS open_facets FROM q_fsum GROUP BY ALL""")
check("I20_keep_and_take_lists", on(lambda b: op.keep_and_take(b.mixed)), """
SELECT run_id, category, status, term_volume, 'keep' AS list FROM q_mixed WHERE status IN ('owned','emerging') UNION ALL
SELECT run_id, category, status, term_volume, 'take' FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY term_volume DESC, cord) AS k FROM (
  SELECT j.*, mid FROM q_mixed j JOIN (SELECT run_id, (list(term_volume ORDER BY term_volume))[count(*)//2+1] AS mid FROM q_mixed GROUP BY 1) USING (run_id)) WHERE status='trailing' AND term_volume>=mid) WHERE k<=5""")
FST = "CASE axis WHEN 'ahead' THEN 'owned' WHEN 'even' THEN 'contested' WHEN 'behind' THEN 'trailing' END"
check("I21_facet_category_mismatch", on(lambda b: op.facet_mismatch(b.judged, b.deep_facets)), f"""
SELECT run_id, category, owned, contested, "trailing", status FROM (
  SELECT run_id, category, count(*) FILTER (s='owned') AS owned, count(*) FILTER (s='contested') AS contested, count(*) FILTER (s='trailing') AS "trailing",
    count(DISTINCT s) AS k, min(s) AS one FROM (SELECT *, {FST} AS s FROM q_fsum) WHERE s IS NOT NULL GROUP BY ALL) JOIN (SELECT run_id, category, status FROM q_judged) USING (run_id, category)
WHERE k>1 OR one<>status""")
check("I22_recurring_rivals", on(lambda b: op.recurring_rivals(b.judged, b.rivals)), """
SELECT run_id, brand, leads, appearances, demand, pos::int AS pos FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY leads DESC, demand DESC, brand) AS pos FROM (
  SELECT r.run_id, brand, count(*) FILTER (pos=1) AS leads, count(*) AS appearances, sum(j.term_volume) AS demand FROM q_rivals r JOIN q_judged j ON j.run_id=r.run_id AND j.category=r.category GROUP BY ALL)
  WHERE leads>=2) WHERE pos<=6""")
check("I23_group_status_mix", on(lambda b: op.group_status_mix(b.mixed)), """
SELECT run_id, "group", """ + ", ".join(f"count(*) FILTER (status='{s}') AS \"{s}\"" for s in ("owned", "emerging", "contested", "trailing", "unclaimed")) + """,
  sum(term_volume) AS demand FROM q_mixed GROUP BY ALL""")
check("I24_naming_journey_conflict", on(lambda b: op.naming_journey_conflict(b.mixed)), f"""
SELECT run_id, category, pos::int AS pos, status, s AS journey_status, term_volume FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY term_volume DESC, cord) AS pos FROM (
  SELECT *, {FST} AS s FROM q_mixed) WHERE status IN ('owned','contested','trailing') AND s IS NOT NULL AND s<>status) WHERE pos<=8""")
check("I25_watch_brand_span", on(lambda b: op.watch_span(b.rivals, b.setup)), """
SELECT run_id, brand, categories, category AS biggest, volume, share FROM (SELECT *, count(*) OVER (PARTITION BY run_id, brand) AS categories,
  row_number() OVER (PARTITION BY run_id, brand ORDER BY volume DESC, category) AS k FROM q_rivals JOIN q_set USING (run_id) WHERE list_contains(watch, brand) AND volume>0) WHERE k=1""")
check("I26_presence_priority", on(lambda b: op.presence_priority(b.mixed)), """
SELECT * FROM (SELECT run_id, CASE WHEN presence='selling' THEN CASE status WHEN 'trailing' THEN 1 WHEN 'contested' THEN 2 WHEN 'unclaimed' THEN 4 ELSE 3 END
  WHEN presence='partly' THEN 5 WHEN presence IN ('not_sold','unverified') THEN 6 END AS priority, category, term_volume, status FROM q_mixed) WHERE priority IS NOT NULL""")
check("I27_unmeasured_list", on(lambda b: op.unmeasured_list(b.judged, b.deep_facets)), """
SELECT run_id, category, 'own_share' AS reason FROM q_judged WHERE own_share IS NULL UNION ALL
SELECT run_id, category, 'facet_journeys' FROM q_judged j WHERE deep AND NOT EXISTS (FROM q_fsum f WHERE f.run_id=j.run_id AND f.category=j.category AND axis IS NOT NULL) UNION ALL
SELECT run_id, category, 'thin' FROM q_judged WHERE modifiers<30 AND NOT deep UNION ALL
SELECT run_id, category, 'no_evidence' FROM q_judged WHERE own_queries=0 AND path_mentions=0""")
check("I28_brand_detail_rows", on(lambda b: op.brand_detail_rows(b.categories, b.listed, b.shares, b.lists, b.index, b.setup).withColumn(
    "top_rank", F.coalesce("top_rank", F.lit(0)))), f"""
WITH r AS (SELECT run_id, category, brand, min(o) AS o FROM (SELECT run_id, category, own_brand AS brand, 0 AS o FROM q_cats JOIN q_set USING (run_id) WHERE own_brand IS NOT NULL UNION ALL SELECT run_id, category, brand, pos FROM q_rivals
  UNION ALL SELECT run_id, c, b, 100 FROM q_runs, {values(LISTED)} l(c, b)) GROUP BY ALL)
SELECT *, coalesce({R('volume/nullif(sum(volume) OVER (PARTITION BY run_id, category),0)*100', 1)}, 0.0) AS table_share FROM (
  SELECT r.run_id, r.category, r.brand, CASE WHEN o<100 THEN s.volume END AS volume, CASE WHEN o<100 THEN s.share END AS share, coalesce(queries,0) AS queries,
    coalesce(l.rank,0) AS top_rank, coalesce(n,0) AS journey_queries FROM r LEFT JOIN q_shares s ON s.run_id=r.run_id AND s.category=r.category AND s.brand=r.brand
  LEFT JOIN q_lists l ON l.run_id=r.run_id AND l.category=r.category AND l.query=s.top_query
  LEFT JOIN q_bindex b ON b.run_id=r.run_id AND b.category=r.category AND b.brand=r.brand)""")
