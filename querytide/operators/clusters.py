"""Co-search clusters: assignment, degree, hubs, selections under a cap, group and flow facts."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import cols, rank
from .records import RUN, community_order, ordered_list

ENRICH_TOP = 2000
CONTEXT_TOP = 2000
FLOOR = 6
EVIDENCE_TOP = 8


def cluster_letters(communities: DataFrame) -> DataFrame:
    """Ordered communities with their letter. Letters name at most 18,278 communities of a run."""
    ids = communities.select("run_id", "cluster_id").distinct()
    at = F.dense_rank().over(W.partitionBy("run_id").orderBy(*community_order())) - 1
    return ids.withColumn("cidx", at).withColumn("letter", cols.cluster_letter("cidx"))


def assignment(communities: DataFrame) -> DataFrame:
    """Each keyword belongs to the first community that lists it."""
    placed = communities.join(cluster_letters(communities), ["run_id", "cluster_id"])
    return rank.first_wins(
        placed.select("run_id", "keyword", "letter", "cidx", "ord"), ["run_id", "keyword"], [F.col("cidx"), F.col("ord")])


def edge_degree(edges: DataFrame) -> DataFrame:
    """Every edge adds one to both ends; repeated edges count again."""
    ends = edges.select("run_id", F.explode(F.array("a", "b")).alias("keyword"))
    return ends.groupBy("run_id", "keyword").agg(F.count(F.lit(1)).alias("degree"))


def outgoing_pairs(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """Distinct (keyword, other cluster) over edges that cross clusters."""
    side = assigned.select("run_id", F.col("keyword").alias("a"), F.col("letter").alias("la"))
    other = assigned.select("run_id", F.col("keyword").alias("b"), F.col("letter").alias("lb"))
    crossing = edges.select("run_id", "a", "b").join(side, ["run_id", "a"]).join(other, ["run_id", "b"]).where(F.col("la") != F.col("lb"))
    both = F.explode(F.array(
        F.struct(F.col("a").alias("keyword"), F.col("la").alias("letter"), F.col("lb").alias("other")),
        F.struct(F.col("b").alias("keyword"), F.col("lb").alias("letter"), F.col("la").alias("other"))))
    return crossing.select("run_id", both.alias("e")).select("run_id", "e.*").distinct()


def cluster_nodes_table(communities: DataFrame, edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """Assigned keywords with volume, intents, degree, outgoing clusters and hub flag."""
    assigned = assignment(communities)
    out = outgoing_pairs(edges, assigned).groupBy("run_id", "keyword").agg(F.array_sort(F.collect_set("other")).alias("outgoing"))
    facts = metrics.select("run_id", "keyword", "volume_avg", *cols.INTENTS)
    nodes = (
        assigned.join(facts, ["run_id", "keyword"], "left")
        .join(edge_degree(edges), ["run_id", "keyword"], "left")
        .join(out, ["run_id", "keyword"], "left")
    )
    zero = F.lit(0.0)
    nodes = nodes.select(
        "run_id", "keyword", "letter", "cidx", "ord",
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("volume_avg", *cols.INTENTS)],
        F.coalesce("degree", F.lit(0)).alias("degree"),
        F.coalesce("outgoing", F.array().cast("array<string>")).alias("outgoing"))
    hub = cluster_hub(nodes).select("run_id", "letter", F.col("keyword").alias("_hub"))
    return nodes.join(hub, ["run_id", "letter"]).withColumn("is_hub", F.col("keyword") == F.col("_hub")).drop("_hub").select(
        *nodes.columns, "is_hub")


def cluster_hub(nodes: DataFrame) -> DataFrame:
    """Most connected member of each cluster, then the largest, then the first."""
    return rank.first_wins(
        nodes.select("run_id", "letter", "keyword", "degree", "volume_avg", "ord"),
        ["run_id", "letter"], [-F.col("degree"), -F.col("volume_avg"), F.col("ord")])


def outgoing_clusters(nodes: DataFrame) -> DataFrame:
    """Per cluster the union of its members' outgoing clusters."""
    pairs = nodes.select("run_id", "letter", F.explode("outgoing").alias("other")).distinct()
    return pairs.groupBy("run_id", "letter").agg(F.array_sort(F.collect_set("other")).alias("outgoing"))


def cluster_rollup(nodes: DataFrame) -> DataFrame:
    facts = nodes.groupBy("run_id", "letter").agg(
        F.count(F.lit(1)).alias("keyword_count"), cols.half_up(F.sum("volume_avg"), 0).alias("volume"))
    hubs = nodes.where("is_hub").select("run_id", "letter", F.col("keyword").alias("hub"))
    return facts.join(hubs, ["run_id", "letter"]).join(outgoing_clusters(nodes), ["run_id", "letter"], "left")


def enrich_selection(nodes: DataFrame, top: int = ENRICH_TOP, floor: int = FLOOR) -> DataFrame:
    """Keywords to enrich: the best `floor` of every cluster round by round, then by degree.

    Depth-major order makes the rounds one sort key; a cluster comes when its best member does.
    """
    order = [-F.col("degree"), F.col("cidx"), F.col("ord")]
    slim = nodes.select("run_id", "keyword", "letter", "degree", "cidx", "ord")
    firm = rank.top_n(slim, ["run_id", "letter"], order, max(1, floor), "depth")
    best = slim.groupBy("run_id", "letter").agg(F.min(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])).alias("best"))
    firm = firm.join(best, ["run_id", "letter"]).select(*slim.columns, F.lit(0).alias("tier"), "depth", "best")
    rest = slim.join(firm.select("run_id", "keyword"), ["run_id", "keyword"], "left_anti").select(
        *slim.columns, F.lit(1).alias("tier"), F.lit(0).alias("depth"),
        F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]).alias("best"))
    picked = rank.top_n(firm.unionByName(rest), RUN, [F.col("tier"), F.col("depth"), F.col("best"), *order], top)
    return rank.top_n(picked, RUN, order, top, "pos").select("run_id", "pos", "keyword", "letter", "degree")


def context_selection(nodes: DataFrame, top: int = CONTEXT_TOP, floor: int = FLOOR) -> DataFrame:
    """Rows of the context: hubs, then a floor per cluster, then the largest.

    The cap is not above the number of keywords that have a volume, if any has.
    """
    order = [-F.col("volume_avg"), F.col("cidx"), F.col("ord")]
    others = nodes.where(~F.col("is_hub"))
    need = rank.top_n(others, ["run_id", "letter"], order, floor, "_k") if floor > 0 else others.limit(0).withColumn("_k", F.lit(1))
    hubs = nodes.where("is_hub").groupBy("run_id", "letter").agg(F.count(F.lit(1)).alias("_hubs"))
    firm = need.join(hubs, ["run_id", "letter"], "left").where(
        F.col("_k") <= F.lit(floor) - F.coalesce("_hubs", F.lit(0))).select("run_id", "keyword", F.lit(1).alias("_t"))
    tiered = nodes.join(firm, ["run_id", "keyword"], "left").withColumn(
        "tier", F.when(F.col("is_hub"), 0).when(F.col("_t").isNotNull(), 1).otherwise(2)).drop("_t")
    known = nodes.where(F.col("volume_avg") > 0).groupBy("run_id").agg(F.count(F.lit(1)).alias("_known"))
    kept = rank.top_n(tiered, RUN, [F.col("tier"), *order], top, "_p").join(known, RUN, "left")
    cap = F.least(F.lit(top), F.coalesce("_known", F.lit(top)))
    return kept.where(F.col("_p") <= cap).select(*nodes.columns, "tier")


def context_summary(nodes: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Counts over the whole graph, whatever the cap keeps."""
    n = nodes.groupBy("run_id").agg(F.count(F.lit(1)).alias("keyword_count"), cols.half_up(F.sum("volume_avg"), 0).alias("total_volume"))
    c = communities.groupBy("run_id").agg(F.count_distinct("cluster_id").alias("cluster_count"))
    e = edges.groupBy("run_id").agg(F.count(F.lit(1)).alias("edge_count"))
    return n.join(c, RUN).join(e, RUN, "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))


def known_letters(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    return rows.join(nodes.select("run_id", "letter").distinct(), ["run_id", "letter"], "left_semi")


def group_members(groups: DataFrame, nodes: DataFrame, context: DataFrame) -> DataFrame:
    """Members of a group's known clusters that the context kept."""
    letters = known_letters(groups, nodes).select("run_id", "group_id", "letter").distinct()
    return letters.join(context.select("run_id", "letter", "keyword", "volume_avg", "cidx", "ord"), ["run_id", "letter"])


def group_rollup(groups: DataFrame, nodes: DataFrame, context: DataFrame) -> DataFrame:
    """Facts of cluster groups (run_id, group_id, gpos, letter): volume, members, evidence, hubs.

    Hubs the context does not know are shown only when it knows none of them.
    """
    letters = known_letters(groups, nodes)
    members = group_members(groups, nodes, context)
    facts = members.groupBy("run_id", "group_id").agg(
        F.sum("volume_avg").alias("volume"), F.count(F.lit(1)).alias("member_count"))
    top = rank.top_n(members, ["run_id", "group_id"], [-F.col("volume_avg"), F.col("cidx"), F.col("ord")], EVIDENCE_TOP, "pos")
    shown = top.groupBy("run_id", "group_id").agg(ordered_list([F.col("pos")], F.col("keyword")).alias("evidence"))
    hubs = letters.join(nodes.where("is_hub").select("run_id", "letter", "keyword"), ["run_id", "letter"]).join(
        context.select("run_id", "keyword", F.lit(True).alias("in_context")), ["run_id", "keyword"], "left")
    every = ordered_list([F.col("gpos")], F.struct("keyword", "in_context"))
    names = hubs.groupBy("run_id", "group_id").agg(every.alias("h"), F.count_distinct("letter").alias("cluster_count"))
    known = F.transform(F.filter("h", lambda x: x["in_context"].isNotNull()), lambda x: x["keyword"])
    names = names.select("run_id", "group_id", "cluster_count", known.alias("known_hubs"),
                         F.when(F.size(known) > 0, known).otherwise(F.transform("h", lambda x: x["keyword"])).alias("hub_table"))
    return facts.join(shown, ["run_id", "group_id"]).join(names, ["run_id", "group_id"])


def cluster_flows(flows: DataFrame, nodes: DataFrame, context: DataFrame) -> DataFrame:
    """Flow facts for rows (run_id, flow_id, hub, path): known clusters only, two at least."""
    steps = flows.select("run_id", "flow_id", "hub", F.posexplode("path").alias("step", "letter"))
    hub_of = nodes.where("is_hub").select("run_id", "letter", F.col("keyword").alias("step_hub"))
    kept = known_letters(steps, nodes).join(hub_of, ["run_id", "letter"], "left")
    path = kept.groupBy("run_id", "flow_id", "hub").agg(
        ordered_list([F.col("step")], F.struct("letter", F.coalesce("step_hub", F.lit("")).alias("hub"))).alias("steps")
    ).where(F.size("steps") >= 2)
    facts = context.select("run_id", F.col("keyword").alias("hub"), F.col("volume_avg").alias("hub_volume"),
                           F.size("outgoing").alias("connectivity"))
    return path.join(facts, ["run_id", "hub"], "left").withColumn("connectivity", F.coalesce("connectivity", F.lit(0)))
