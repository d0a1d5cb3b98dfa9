"""Search journeys: transitions, node facts, hubs, the prefix tree, and cards of picked journeys."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import cols, rank
from ..functions.stage import staged
from .records import RUN, ordered_list

HUBS_TOP = 40
DOWNSTREAM_TOP = 6
EVIDENCE_TOP = 8
TREE_PATHS, TREE_DEPTH, TREE_ROOTS, TREE_CHILDREN = 24, 4, 5, 4


def journey_edges(journeys: DataFrame) -> DataFrame:
    """Transitions with their count and where they were first seen."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("seq") - 2),
        lambda i: F.struct(i.alias("step"), F.get("seq", i).alias("src"), F.get("seq", i + 1).alias("dst")))
    rows = journeys.where(F.size("seq") >= 2).select("run_id", "path_id", F.explode(pairs).alias("e"))
    return rows.groupBy("run_id", "e.src", "e.dst").agg(
        F.count(F.lit(1)).alias("weight"), F.min(F.struct("path_id", "e.step")).alias("seen"))


def journey_nodes(journeys: DataFrame, edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """Node facts; a node counts once per journey, neighbours count once."""
    steps = journeys.select("run_id", "path_id", F.posexplode(F.array_distinct("seq")).alias("step", "keyword"))
    seen = steps.groupBy("run_id", "keyword").agg(
        F.count(F.lit(1)).alias("path_count"), F.min(F.struct("path_id", "step")).alias("seen"))
    out = edges.groupBy("run_id", F.col("src").alias("keyword")).agg(
        F.count(F.lit(1)).alias("out_degree"), F.sum("weight").alias("out_weight"))
    into = edges.groupBy("run_id", F.col("dst").alias("keyword")).agg(F.count(F.lit(1)).alias("in_degree"))
    facts = metrics.select("run_id", "keyword", "volume_avg", "volume_trend", *cols.INTENTS)
    key = ["run_id", "keyword"]
    joined = seen.join(out, key, "left").join(into, key, "left").join(facts, key, "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("out_degree", "in_degree", "out_weight")]
    numbers = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("volume_avg", "volume_trend", *cols.INTENTS)]
    table = joined.select("run_id", "keyword", "path_count", "seen", *zero, *numbers)
    return table.withColumn("primary_intent", cols.dominant_intent())


def rank_journeys(journeys: DataFrame, nodes: DataFrame) -> DataFrame:
    """Journeys with their summed volume; a repeated node counts again."""
    steps = journeys.select("run_id", "path_id", F.explode("seq").alias("keyword"))
    volume = steps.join(nodes.select("run_id", "keyword", "volume_avg"), ["run_id", "keyword"]).groupBy("run_id", "path_id").agg(
        F.sum("volume_avg").alias("total_volume"))
    return journeys.join(volume, ["run_id", "path_id"]).withColumn("hops", F.size("seq"))


def journey_order() -> list:
    return [-F.col("total_volume"), -F.col("hops"), F.col("path_id")]


def branch_hubs(nodes: DataFrame, n: int = HUBS_TOP) -> DataFrame:
    order = [-F.col("out_degree"), -F.col("volume_avg"), -F.col("path_count"), F.col("seen")]
    return rank.top_n(nodes.where(F.col("out_degree") >= 2), RUN, order, n, "pos")


def downstream_list(edges: DataFrame, nodes: DataFrame, n: int = DOWNSTREAM_TOP) -> DataFrame:
    """The largest next nodes of every node."""
    facts = nodes.select("run_id", F.col("keyword").alias("dst"), "volume_avg")
    joined = edges.join(facts, ["run_id", "dst"])
    return rank.top_n(joined, ["run_id", "src"], [-F.col("volume_avg"), F.col("seen")], n, "pos").select(
        "run_id", "src", "pos", "dst", "volume_avg", "weight")


def flow_tree(ranked: DataFrame, nodes: DataFrame, paths: int = TREE_PATHS, depth: int = TREE_DEPTH,
              roots: int = TREE_ROOTS, children: int = TREE_CHILDREN) -> DataFrame:
    """Prefix tree of the top journeys; per level the largest nodes stay, children of dropped nodes vanish."""
    top = rank.top_n(ranked, RUN, journey_order(), paths, "rn")
    cuts = F.transform(F.sequence(F.lit(1), F.least(F.size("seq"), F.lit(depth))), lambda d: F.slice("seq", 1, d))
    prefixes = top.select("run_id", "rn", F.explode(cuts).alias("prefix"))
    counted = prefixes.groupBy("run_id", "prefix").agg(F.count(F.lit(1)).alias("count"), F.min("rn").alias("first"))
    facts = nodes.select("run_id", "keyword", "volume_avg", "primary_intent")
    counted = counted.select(
        "*", F.size("prefix").alias("depth"), F.element_at("prefix", -1).alias("keyword"),
        F.slice("prefix", 1, F.size("prefix") - 1).alias("parent")
    ).join(facts, ["run_id", "keyword"])
    order = [-F.col("volume_avg"), -F.col("count"), F.col("first")]
    # siblings are ranked whether or not their parent stays; at most `paths` of them share a parent
    place = F.row_number().over(W.partitionBy("run_id", "parent").orderBy(*order))
    fit = counted.withColumn("pos", place).where(F.col("pos") <= F.when(F.col("depth") == 1, roots).otherwise(children))
    fit = staged(fit)
    line = F.explode(F.transform(F.sequence(F.lit(1), F.col("depth")), lambda d: F.slice("prefix", 1, d))).alias("above")
    above = fit.select("run_id", "prefix", "depth", line).join(fit.select("run_id", F.col("prefix").alias("above")), ["run_id", "above"])
    whole = above.groupBy("run_id", "prefix", "depth").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == F.col("depth"))
    return fit.join(whole.select("run_id", "prefix"), ["run_id", "prefix"], "left_semi").select(
        "run_id", "prefix", "parent", "depth", "pos", "keyword", "count", "volume_avg", "primary_intent")


def context_summary(journeys: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    sums = [F.sum(k).alias(k) for k in cols.INTENTS]
    n = nodes.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("node_count"), F.sum(F.when(F.col("out_degree") >= 2, 1).otherwise(0)).alias("hub_count"),
        F.sum("volume_avg").alias("total_volume"), *sums)
    p = journeys.groupBy("run_id").agg(F.count(F.lit(1)).alias("path_count"))
    e = edges.groupBy("run_id").agg(F.count(F.lit(1)).alias("edge_count"))
    return n.join(p, RUN).join(e, RUN, "left").select(
        "run_id", "node_count", "path_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), "hub_count",
        "total_volume", cols.dominant_intent().alias("primary_intent"))


def journey_cards(picks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Picked journeys (run_id, pick_id, flow_type, seq, evidence): known nodes only, two at least."""
    facts = nodes.select("run_id", "keyword", "volume_avg")
    key = ["run_id", "pick_id"]
    steps = picks.select(*key, F.posexplode("seq").alias("step", "keyword")).join(facts, ["run_id", "keyword"])
    path = steps.groupBy(*key).agg(
        ordered_list([F.col("step")], F.col("keyword")).alias("nodes"), F.sum("volume_avg").alias("volume"),
        F.count(F.lit(1)).alias("hops")).where(F.col("hops") >= 2)
    chips = picks.select(*key, F.posexplode("evidence").alias("step", "keyword")).join(facts, ["run_id", "keyword"])
    chips = rank.top_n(chips, key, [-F.col("volume_avg"), F.col("step")], EVIDENCE_TOP, "pos")
    chips = chips.groupBy(*key).agg(ordered_list([F.col("pos")], F.col("keyword")).alias("evidence"))
    flow = F.lower(F.trim("flow_type"))
    kind = F.when(flow.isin("conversion", "comparison", "risk"), flow).otherwise("comparison")
    order = F.when(kind == "conversion", 0).when(kind == "risk", 2).otherwise(1)
    return picks.select(*key, kind.alias("flow_type"), order.alias("flow_order")).join(path, key).join(chips, key, "left")


def hub_cards(picks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Picked hubs (run_id, keyword) that are nodes, with their six largest next nodes."""
    known = picks.join(nodes.select("run_id", "keyword", "volume_avg", "out_degree"), ["run_id", "keyword"])
    down = downstream_list(edges, nodes).groupBy("run_id", F.col("src").alias("keyword")).agg(
        ordered_list([F.col("pos")], F.col("dst")).alias("downstream"))
    return known.join(down, ["run_id", "keyword"], "left")
