from pyspark.sql import functions as F

from querytide.functions import cols
from querytide.functions.stage import folder
from querytide.operators import records as op
from querytide.sources import readers

from .domain import Domain
from .sqlkit import check, piece

# ---- A1 A2: the raw answers are built from the tables, a bounded batch per text, one envelope shape per batch number
BATCH = 100


def info_rows(dom):
    return dom.metrics.select(
        "run_id", "ord", F.floor(F.col("ord") / BATCH).alias("batch"), "keyword",
        F.struct(F.col("volume_avg").cast("string").alias("volume_avg"), "volume_total", "volume_trend", "cpc",
                 "competition", "competition_index").alias("ads_metrics"),
        F.struct("i", "n", "c", "t").alias("intents"),
    )


def raw_answers(dom):
    plain = F.struct("keyword", "ads_metrics", "intents")
    rows = info_rows(dom).groupBy("run_id", "batch").agg(
        F.to_json(F.collect_list(plain)).alias("flat"),
        F.to_json(F.collect_list(F.struct(plain.alias("_source")))).alias("wrapped"))
    k = F.col("batch") % 7
    half = F.floor(F.length("flat") / 2).cast("int")

    def block(text):
        return F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text")))

    text = (
        F.when(k == 0, F.col("flat"))
        .when(k == 1, F.concat(F.lit('{"data":'), "flat", F.lit("}")))
        .when(k == 2, F.concat(F.lit('{"data":{"results":'), "flat", F.lit("}}")))
        .when(k == 3, F.concat(F.lit('{"result":{"hits":{"hits":'), "wrapped", F.lit("}}}")))
        .when(k == 4, F.concat(F.lit('{"hits":{"hits":'), "wrapped", F.lit("}}")))
        .when(k == 5, F.concat(F.lit('{"results":'), "flat", F.lit("}")))
        .otherwise(F.concat(F.lit("["), block(F.substr("flat", F.lit(1), half)), F.lit(","),
                            block(F.substr("flat", half + 1)), F.lit("]")))
    )
    return rows.select("run_id", "batch", text.alias("value"))


METRIC_COLS = "keyword, volume_avg, volume_total, volume_trend, cpc, competition, competition_index, i, n, c, t"
check("A1_read_keyword_info", lambda s, d: readers.keyword_info(raw_answers(Domain(s, d))).select(
    "run_id", *[c.strip() for c in METRIC_COLS.split(",")]), f"SELECT run_id, {METRIC_COLS} FROM q_metrics")


BROKEN = [("", "empty"), ('{"data": [', "not JSON"), ('{"note": "later"}', "no list of records"), ('[{"keyword": ""}, 7]', "no keyword")]


def answers_on_disk(dom):
    """The answers as files, one a folder run_id=.../batch=..., next to four that cannot be used."""
    def write():
        path = folder(dom.spark)
        good = raw_answers(dom).select("run_id", F.col("batch").cast("int").alias("batch"), "value")
        bad = dom.each_run([(-1 - k, text) for k, (text, _) in enumerate(BROKEN)], "batch int, value string")
        good.unionByName(bad.select("run_id", "batch", "value")).write.partitionBy("run_id", "batch").text(path)
        return dom.spark.createDataFrame([(path,)], "path string")

    path = dom.stage("answers on disk", write).first()[0]
    return readers.answer_files(dom.spark, path)


check("A1_answer_files", lambda s, d: readers.keyword_info(answers_on_disk(Domain(s, d))).select(
    "run_id", *[c.strip() for c in METRIC_COLS.split(",")], "has_intents"), f"SELECT run_id, {METRIC_COLS}, true AS has_intents FROM q_metrics")
check("A1_rejected_files", lambda s, d: readers.rejected(answers_on_disk(Domain(s, d))).select("run_id", "batch", "reason"),
      "SELECT run_id, batch::int AS batch, reason FROM (SELECT DISTINCT run_id FROM q_metrics), (VALUES " + ", ".join(f"({-1 - k}, '{why}')" for k, (_, why) in enumerate(BROKEN)) + ") v(batch, reason)")


PLACES = ["$", "$.data", "$.data.results", "$.result.hits.hits", "$.hits.hits", "$.results"]


def _unwrapped(s, d):
    """Records of every answer, whatever its shape: text blocks are joined, all others stay as they are."""
    rows = readers.unwrap_content_blocks(readers.parsed(raw_answers(Domain(s, d))))
    found = F.coalesce(*[F.expr(f"size(try_variant_get(doc, '{p}', 'array<variant>'))") for p in PLACES])
    return rows.select("run_id", "batch", found.alias("records"))


check("A2_unwrap_content_blocks", _unwrapped, f"""
SELECT run_id, floor(ord/{BATCH})::bigint AS batch, count(*)::int AS records FROM q_metrics GROUP BY ALL""")


def _num(s, d):
    t = Domain(s, d).table("lineitem")
    text = F.concat_ws("", F.col("l_returnflag"), F.col("l_quantity").cast("int").cast("string"))
    text = F.when(F.col("l_linenumber") % 3 == 0, text).when(
        F.col("l_linenumber") % 3 == 1, F.concat(F.col("l_partkey").cast("string"), F.lit(",000"))).otherwise(
        F.col("l_quantity").cast("int").cast("string"))
    return t.groupBy("l_linenumber").agg(
        F.sum(cols.num(text)).alias("plain"), F.sum(cols.num(text, strip_commas=True)).alias("commas"))


check("A3_num", _num, """
SELECT l_linenumber, sum(coalesce(try_cast(x AS double), 0)) AS plain,
  sum(coalesce(try_cast(replace(x, ',', '') AS double), 0)) AS commas
FROM (SELECT l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_returnflag || l_quantity::int WHEN 1 THEN l_partkey || ',000'
  ELSE l_quantity::int::varchar END AS x FROM lineitem) GROUP BY 1""")
check("A4_keys", lambda s, d: Domain(s, d).table("conversations").groupBy("role").agg(
    F.count_distinct(cols.norm_kw("text")).alias("norm_kw"), F.count_distinct(cols.ns("text")).alias("ns"),
    F.sum(F.length(cols.norm("text"))).alias("norm_chars")), r"""
SELECT role, count(DISTINCT lower(regexp_replace(text, '\s+', '', 'g'))) AS norm_kw,
  count(DISTINCT lower(replace(text, ' ', ''))) AS ns,
  sum(length(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))))::bigint AS norm_chars FROM conversations GROUP BY 1""")


def _monthly(s, d):
    """Even part numbers arrive without engine columns; a total is left out where nv is 0."""
    dom = Domain(s, d)
    m = dom.monthly.join(dom.metrics.select("run_id", "keyword", "ord"), ["run_id", "keyword"])
    split = F.col("ord") % 2 == 1
    cell = F.struct(
        "month", F.when(split, F.col("nv").cast("string")).alias("nv"), F.when(split, F.col("gg").cast("string")).alias("gg"),
        F.when(~split | (F.col("nv") > 0), F.col("total").cast("string")).alias("total"))
    info = m.groupBy("run_id", "keyword").agg(F.collect_list(cell).alias("monthly_volume"))
    return op.monthly_volume(info)


check("A5_read_monthly_volume", _monthly, """
SELECT run_id, keyword, (row_number() OVER (PARTITION BY run_id, keyword ORDER BY month)-1)::int AS idx, month,
  CASE WHEN ord%2=1 THEN nv ELSE 0.0 END AS nv, CASE WHEN ord%2=1 THEN gg ELSE total END AS gg, total
FROM q_monthly JOIN (SELECT run_id, keyword, ord FROM q_metrics) USING (run_id, keyword)""")


def _graph(s, d):
    """One answer per run and brand; the members of a brand in a run are bounded by its parts."""
    dom = Domain(s, d)
    comm = dom.communities.groupBy("run_id", F.split("keyword", " ")[0].alias("brand"), "cluster_id").agg(
        op.ordered_list([F.col("ord")], F.col("keyword")).alias("kws"))
    comm = comm.groupBy("run_id", "brand").agg(F.map_from_entries(F.collect_list(F.struct("cluster_id", "kws"))).alias("m"))
    raw = comm.select("run_id", "brand", F.to_json(F.struct(F.struct(
        F.col("m").alias("communities"), F.array(F.array("run_id", "brand"), F.array("run_id")).alias("rels")).alias("data"))).alias("value"))
    communities, rels = readers.cluster_graph(raw)
    a = communities.select("run_id", "brand", "cluster_id", "ord", "keyword")
    b = rels.select("run_id", "brand", F.lit("rel").alias("cluster_id"), "ord", F.concat_ws("|", "a", "b").alias("keyword"))
    return a.unionByName(b)


check("A6_read_cluster_graph", _graph, """
SELECT run_id, split_part(keyword,' ',1) AS brand, cluster_id,
  row_number() OVER (PARTITION BY run_id, split_part(keyword,' ',1), cluster_id ORDER BY ord)-1 AS ord, keyword FROM q_communities
UNION ALL SELECT DISTINCT run_id, split_part(keyword,' ',1), 'rel', 0, run_id || '|' || split_part(keyword,' ',1) FROM q_communities""")


def nodes(dom):
    return dom.stage("node list", lambda: op.cluster_nodes(dom.edges.withColumn("ord", F.concat_ws("|", "a", "b")), dom.communities))


piece("q_nodes", """
SELECT run_id, keyword, row_number() OVER (PARTITION BY run_id ORDER BY part, id, e, o, side) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, keyword ORDER BY part, id, e, o, side) AS k FROM (
    SELECT run_id, a AS keyword, 0 AS part, 0 AS id, a || '|' || b AS e, 0 AS o, 0 AS side FROM q_edges
    UNION ALL SELECT run_id, b, 0, 0, a || '|' || b, 0, 1 FROM q_edges
    UNION ALL SELECT run_id, keyword, 1, cluster_id::int, '', ord, 0 FROM q_communities)) WHERE k=1""")
check("A7_cluster_nodes", lambda s, d: nodes(Domain(s, d)), "SELECT run_id, pos, keyword FROM q_nodes")
check("A8_read_paths", lambda s, d: Domain(s, d).journeys.select("run_id", "path_id", F.array_join("seq", ">").alias("seq")),
      "SELECT run_id, path_id, array_to_string(seq, '>') AS seq FROM q_journeys")


def _related(s, d):
    m = Domain(s, d).metrics_of("related")
    lists = m.groupBy("run_id", F.floor(F.col("ord") / BATCH).alias("file_ord")).agg(
        op.ordered_list([-F.col("volume_total"), F.col("keyword")], F.col("keyword")).alias("queries"))
    return op.related_queries(lists)


check("A9_read_related_queries", _related, f"""
SELECT run_id, floor(ord/{BATCH})::bigint AS file_ord, keyword AS query,
  row_number() OVER (PARTITION BY run_id, floor(ord/{BATCH}) ORDER BY volume_total DESC, keyword) AS rank FROM q_related_metrics""")


def chunks(dom):
    return dom.seed_lists.select("run_id", "keyword", F.col("seed_ord").alias("file_ord"), F.col("rank").alias("row_ord"))


check("A10_merge_first_wins", lambda s, d: op.merge_first_wins(chunks(Domain(s, d)), normalised=True), """
SELECT run_id, keyword, seed_ord AS file_ord, rank AS row_ord FROM (SELECT *, row_number() OVER (
  PARTITION BY run_id, lower(replace(keyword,' ','')) ORDER BY seed_ord, rank) AS k FROM q_seed_lists) WHERE k=1""")
check("A11_dedupe_seed_records", lambda s, d: op.dedupe_seed_records(Domain(s, d).seed_lists), """
SELECT run_id, seed_ord, rank, keyword FROM (SELECT *, row_number() OVER (PARTITION BY run_id, keyword ORDER BY seed_ord, rank) AS k
FROM q_seed_lists) WHERE k=1""")

CAP = 60
prev = "SELECT run_id, keyword, -1 AS took FROM q_seed_lists WHERE false"
piece("q_pick0", prev)
for _s in range(8):
    piece(f"q_pick{_s + 1}", f"""
SELECT * FROM q_pick{_s} UNION ALL SELECT run_id, keyword, {_s} FROM (
  SELECT run_id, keyword, row_number() OVER (PARTITION BY run_id ORDER BY rank) AS k FROM q_seed_lists s
  WHERE seed_ord={_s} AND NOT EXISTS (FROM q_pick{_s} p WHERE p.run_id=s.run_id AND p.keyword=s.keyword)) x
JOIN (SELECT run_id, greatest({CAP}//count(DISTINCT seed_ord), 1) AS quota FROM q_seed_lists GROUP BY 1) USING (run_id) WHERE k<=quota"""
          .replace("SELECT run_id, keyword, " + str(_s) + " FROM (", "SELECT x.run_id, keyword, " + str(_s) + " FROM ("))
check("A12_multi_seed_quota", lambda s, d: op.multi_seed_quota(Domain(s, d).seed_lists, CAP), f"""
SELECT * FROM (SELECT run_id, keyword, seed_ord, fill, row_number() OVER (PARTITION BY run_id ORDER BY fill, seed_ord, rank)::int AS pos FROM (
  SELECT s.run_id, s.keyword, coalesce(took, s.seed_ord) AS seed_ord, (took IS NULL)::int AS fill, rank,
    row_number() OVER (PARTITION BY s.run_id, s.keyword ORDER BY s.seed_ord) AS k
  FROM q_seed_lists s LEFT JOIN q_pick8 p USING (run_id, keyword) WHERE took IS NULL OR took = s.seed_ord) WHERE k=1) WHERE pos<={CAP}""")


def with_pos(df):
    return df.withColumn("pos", F.col("ord"))


piece("q_journey_list", """
SELECT run_id, keyword, row_number() OVER (PARTITION BY run_id ORDER BY path_id, pos) AS pos FROM (
  SELECT *, node AS keyword, row_number() OVER (PARTITION BY run_id, node ORDER BY path_id, pos) AS k FROM q_steps) WHERE k=1""")
check("A17_journey_node_list", lambda s, d: op.journey_node_list(Domain(s, d).journeys, 500),
      "SELECT run_id, pos::int AS pos, keyword FROM q_journey_list WHERE pos<=500")


def _union(s, d):
    from .family_clusters import selection

    dom = Domain(s, d)
    return op.finder_union(with_pos(dom.query), op.journey_node_list(dom.journeys, 500), selection(dom), 700)


check("A13_finder_union", _union, """
SELECT * FROM (SELECT run_id, keyword, source_ord, ord, row_number() OVER (PARTITION BY run_id ORDER BY source_ord, ord)::int AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, keyword ORDER BY source_ord, ord) AS k FROM (
    SELECT run_id, keyword, 0 AS source_ord, ord FROM q_query UNION ALL
    SELECT run_id, keyword, 1, pos FROM q_journey_list WHERE pos<=500 UNION ALL
    SELECT run_id, keyword, 2, pos FROM q_selection)) WHERE k=1) WHERE pos<=700""")
check("A14_split_back_per_finder", lambda s, d: (lambda dom: op.split_back(dom.metrics, dom.query).select(
    "run_id", "keyword", "volume_avg"))(Domain(s, d)), "SELECT run_id, keyword, volume_avg FROM q_query")
check("A15_tagged_candidate_list", lambda s, d: (lambda dom: op.tagged_candidates(with_pos(dom.query), nodes(dom)).select(
    "run_id", "keyword", "src", "pos"))(Domain(s, d)), """
SELECT run_id, keyword, 'rel' AS src, ord AS pos FROM q_query UNION ALL
SELECT run_id, keyword, 'clu', pos FROM q_nodes ANTI JOIN q_query USING (run_id, keyword)""")
check("A16_enrichment_batches", lambda s, d: (lambda dom: op.enrichment_batches(nodes(dom), dom.query, 100))(Domain(s, d)), """
SELECT run_id, keyword, (row_number() OVER (PARTITION BY run_id ORDER BY pos)-1)//100 AS batch_no
FROM q_nodes ANTI JOIN q_query USING (run_id, keyword)""")


def _audit(s, d):
    dom = Domain(s, d)
    want = dom.metrics.groupBy("run_id").agg(F.count("*").alias("expected"))
    return op.record_count_audit(dom.query, want, ["run_id"])


check("A18_record_count_audit", _audit, """
SELECT run_id, expected, found, CASE WHEN found=0 THEN 'empty' WHEN found<expected THEN 'short' WHEN found>expected THEN 'mismatch' ELSE 'ok' END AS verdict
FROM (SELECT run_id, count(*) AS expected, count(*) FILTER (volume_avg>=20) AS found FROM q_metrics GROUP BY 1)""")
