from pyspark.sql import functions as F

from querytide.functions.stage import folder
from querytide.operators import journeys, records
from querytide.sources import exports as op

from . import family_clusters as fc, family_demand as fd, family_journeys as fj, family_opportunity as fo
from .domain import Domain
from .sqlkit import check, piece

LABELS = {"i": "Info", "n": "Site", "c": "Compare", "t": "Buy"}
check("A19_query_context_export", lambda s, d: op.query_context(fo.context(Domain(s, d))),
      "SELECT run_id, pos::int AS pos, keyword, volume_avg, i, n, c, t, volume_trend AS trend FROM q_context")


def _read_back(s, d):
    """The context as CSV with an empty, a missing and a quoted field in every second row, read again."""
    dom = Domain(s, d)
    odd = F.when(F.col("pos") % 2 == 0, F.concat(F.lit(' "a", '), "keyword", F.lit("\nb "))).when(F.col("pos") % 3 == 0, "")
    table = op.query_context(fo.context(dom)).withColumn("odd", odd)
    path = folder(s)
    op.write_csv(table, path, ["run_id"])
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    back = op.read_csv(s, path, types)
    return back.withColumn("odd", F.coalesce("odd", F.lit("null")))


def _facts_again(s, d):
    """Facts of all runs, then one run of them written again with other numbers: the others stay."""
    table = op.query_context(fo.context(Domain(s, d))).select("run_id", "keyword", "volume_avg")
    path = folder(s)
    op.write_facts({"context": table}, path)
    op.write_facts({"context": table.where("run_id = 'building'").withColumn("volume_avg", -F.col("volume_avg"))}, path, replace=True)
    return s.read.schema(table.schema).parquet(f"{path}/context").select("run_id", "keyword", "volume_avg")


check("A19_csv_read_back", _read_back, """
SELECT run_id, pos::int AS pos, keyword, volume_avg, i, n, c, t, volume_trend AS trend,
  CASE WHEN pos%2=0 THEN ' "a", ' || keyword || chr(10) || 'b ' WHEN pos%3=0 THEN '' ELSE 'null' END AS odd FROM q_context""")
check("A19_facts_replaced", _facts_again, "SELECT run_id, keyword, CASE WHEN run_id='building' THEN -volume_avg ELSE volume_avg END AS volume_avg FROM q_context")
check("A20_cluster_context_export", lambda s, d: op.cluster_context(fc.context(Domain(s, d)), LABELS), """
SELECT run_id, keyword AS n, volume_avg::bigint AS v, letter AS c, CASE WHEN is_hub THEN 'TRUE' ELSE 'FALSE' END AS h, outgoing AS o,
  CASE WHEN greatest(i,n,c,t)<=0 THEN '' WHEN i=greatest(i,n,c,t) THEN 'Info' WHEN n=greatest(i,n,c,t) THEN 'Site' WHEN c=greatest(i,n,c,t) THEN 'Compare' ELSE 'Buy' END AS i FROM q_ccontext x"""
      .replace("greatest(i,n,c,t)", "greatest(x.i,x.n,x.c,x.t)").replace("WHEN i=", "WHEN x.i=").replace("WHEN n=", "WHEN x.n=").replace("WHEN c=", "WHEN x.c="))
check("A21_journey_paths_export", fj.with_parts(lambda j, e, n, r: op.journey_paths(r)),
      "SELECT run_id, rn::int AS pos, array_to_string(seq, ' → ') AS chain, total_volume FROM q_jranked WHERE rn<=60")
check("A21_journey_hubs_export", fj.with_parts(lambda j, e, n, r: op.journey_hubs(n, e)), """
SELECT h.run_id, pos::int AS pos, keyword AS name, volume_avg, out_degree, path_count, downstream FROM q_jhubs h LEFT JOIN (
  SELECT run_id, src, string_agg(dst, ' | ' ORDER BY pos) AS downstream FROM q_jdown GROUP BY ALL) d ON d.run_id=h.run_id AND d.src=h.keyword""")
piece("q_jtop", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY volume_avg DESC, seen)-1 AS id FROM q_jnodes0) WHERE id<100")
check("A21_journey_context_export", fj.with_parts(lambda j, e, n, r: op.journey_node_table(n, e, 100)), """
SELECT t.run_id, t.id::int AS id, t.keyword AS name, t.volume_avg, t.volume_trend, concat_ws('|', CASE WHEN i>0 THEN 'i' END, CASE WHEN n>0 THEN 'n' END, CASE WHEN c>0 THEN 'c' END, CASE WHEN t.t>0 THEN 't' END) AS intent,
  out_degree, path_count, coalesce(outgoing, '') AS outgoing FROM q_jtop t LEFT JOIN (
  SELECT e.run_id, src, string_agg(d.id::varchar, ',' ORDER BY e.seen) AS outgoing FROM q_jedges e JOIN q_jtop d ON d.run_id=e.run_id AND d.keyword=e.dst GROUP BY ALL) o ON o.run_id=t.run_id AND o.src=t.keyword""")


def _shown(j, e, n, r):
    """The seed, the nodes of the shown journeys, the hubs, their next nodes, then the tree."""
    seed = j.select("run_id", F.lit("search").alias("keyword"), F.lit(0).alias("pos")).distinct()
    top = op.journey_paths(r, 10).select("run_id", "pos", F.posexplode(F.split("chain", " → ")).alias("k", "keyword"))
    hubs = journeys.branch_hubs(n, 10)
    down = journeys.downstream_list(e, n).join(hubs.select("run_id", F.col("keyword").alias("src"), F.col("pos").alias("hp")), ["run_id", "src"])
    return records.report_keywords([
        seed, top.select("run_id", "keyword", (F.col("pos") * 1000 + F.col("k")).alias("pos")), hubs.select("run_id", "keyword", "pos"),
        down.select("run_id", F.col("dst").alias("keyword"), (F.col("hp") * 100 + F.col("pos")).alias("pos"))])


check("A22_report_keywords", fj.with_parts(_shown), """
SELECT run_id, keyword, part, pos::bigint AS pos FROM (SELECT *, row_number() OVER (PARTITION BY run_id, keyword ORDER BY part, pos) AS z FROM (
  SELECT DISTINCT run_id, 'search' AS keyword, 0 AS part, 0 AS pos FROM q_journeys UNION ALL
  SELECT run_id, unnest(seq), 1, rn*1000 + generate_subscripts(seq, 1) - 1 FROM q_jranked WHERE rn<=10 UNION ALL
  SELECT run_id, keyword, 2, pos FROM q_jhubs WHERE pos<=10 UNION ALL
  SELECT d.run_id, d.dst, 3, h.pos*100 + d.pos FROM q_jdown d JOIN q_jhubs h ON h.run_id=d.run_id AND h.keyword=d.src WHERE h.pos<=10)) WHERE z=1""")
check("A23_plan_query_list", lambda s, d: records.plan_query_list(fd.bundles(Domain(s, d)).withColumnRenamed("bord", "bundle_ord")).select(
    "run_id", "keyword", "bundle_ord", "broad", "ord"), """
SELECT run_id, keyword, bord::int AS bundle_ord, broad::int AS broad, ord FROM (SELECT *, row_number() OVER (PARTITION BY run_id, keyword ORDER BY bord, broad, ord) AS z FROM q_bk) WHERE z=1""")
