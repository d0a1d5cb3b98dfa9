"""Cross-finder insight: one row per keyword over query, journey and cluster tables, and what follows from it."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cols, rank
from ..functions.cols import half_up
from .records import RUN, ordered_list

STAGES = ("entry", "mid", "exit")
# Fixed values of the insight rules.
MISMATCH_TOLERANCE = 0.10
DEADEND_MIN_PATHS = 2
BRIDGE_MIN_TRANSITIONS = 2
BRIDGE_DIRECTION = 0.34
TREND_CLIP = 30.0
STRUCTURE_WEIGHTS = (0.6, 0.4)
STRUCTURE_EPSILON = 0.2
BACKLOG_CAP = 5
KEY = ["run_id", "keyword"]


def _first_persona(personas: DataFrame, out: str) -> DataFrame:
    return rank.first_wins(personas.select(*KEY, F.col("group_id").alias(out), "gpos"), KEY, [F.col("gpos")]).drop("gpos")


def finder_master(query: DataFrame, path_nodes: DataFrame, cluster_context: DataFrame, cluster_nodes: DataFrame,
                  query_personas: DataFrame, cluster_personas: DataFrame) -> DataFrame:
    """One row per keyword of any finder. Volume falls back on zero, intents and trend only on absence."""
    def side(df, prefix, *names):
        trimmed = df.withColumn("keyword", F.trim("keyword")).where(F.col("keyword") != "")
        return trimmed.select(*KEY, *[F.col(n).alias(f"{prefix}_{n}") for n in names], F.lit(True).alias(f"{prefix}_present"))

    intents = list(cols.INTENTS)
    q = side(query, "q", "volume_avg", "volume_trend", *intents)
    p = side(path_nodes, "p", "volume_avg", "volume_trend", "out_degree", "in_degree", "path_count", *intents)
    listed = side(cluster_context, "l", "volume_avg", "is_hub", "outgoing", *intents)
    c = side(cluster_nodes, "c", "letter").join(listed, KEY, "left")
    every = q.join(p, KEY, "full_outer").join(c, KEY, "full_outer")
    every = every.join(_first_persona(query_personas, "_pq"), KEY, "left").join(_first_persona(cluster_personas, "_pc"), KEY, "left")

    def flag(name):
        return F.coalesce(F.col(name), F.lit(False))

    def zero(name):
        return F.coalesce(F.col(name), F.lit(0))

    chosen = [
        F.coalesce(F.when(flag("q_present"), F.col(f"q_{k}")).when(flag("p_present"), F.col(f"p_{k}"))
                   .when(flag("l_present"), F.col(f"l_{k}")), F.lit(0.0)).alias(k) for k in intents]
    table = every.select(
        *KEY, flag("q_present").alias("q_present"), flag("p_present").alias("p_present"), flag("c_present").alias("c_present"),
        zero("q_volume_avg").alias("q_vol"), zero("p_volume_avg").alias("p_vol"), zero("l_volume_avg").alias("c_vol"),
        F.coalesce(cols.nz("q_volume_avg"), cols.nz("p_volume_avg"), cols.nz("l_volume_avg"), F.lit(0.0)).alias("volume"),
        (flag("q_present") | flag("p_present") | flag("l_present")).alias("has_intents"), *chosen,
        F.when(flag("q_present"), F.col("q_volume_trend")).when(flag("p_present"), F.col("p_volume_trend")).otherwise(0.0).alias("trend"),
        zero("p_out_degree").alias("out_degree"), zero("p_in_degree").alias("in_degree"), zero("p_path_count").alias("path_count"),
        F.coalesce("c_letter", F.lit("")).alias("cluster"), flag("l_is_hub").alias("is_hub"),
        F.coalesce("l_outgoing", F.array().cast("array<string>")).alias("outgoing"),
        F.coalesce("_pc", "_pq", F.lit("")).alias("persona"))
    return table.withColumn("m", cols.intent_weight()).withColumn("dominant", cols.dominant_intent())


def connectivity() -> Column:
    return F.col("is_hub").cast("int") + F.size("outgoing")


def covered(ran: str = "qpc") -> Column:
    """Present in every finder that ran (q query, p path, c cluster)."""
    return reduce(lambda a, b: a & b, [F.col(f"{s}_present") for s in ran])


def coverage_combos(master: DataFrame) -> DataFrame:
    parts = [F.when(F.col(f"{s}_present"), s.upper()).otherwise("") for s in "qpc"]
    return master.groupBy("run_id", F.concat(*parts).alias("combo")).agg(
        F.count(F.lit(1)).alias("count"), F.sum("volume").alias("volume"))


def gap_buckets(master: DataFrame, ran: str = "qpc") -> DataFrame:
    """Keywords one source has and another lacks, numbered by volume in each bucket; only between finders that ran."""
    q, p, c = (F.col(f"{s}_present") for s in "qpc")
    with_q, with_p, with_c = (F.lit(s in ran) for s in "qpc")
    tags = F.array(F.when(with_q & with_p & q & ~p, "q_not_p"), F.when(with_q & with_c & q & ~c, "q_not_c"),
                   F.when(with_q & (with_p | with_c) & (p | c) & ~q, "struct_not_q"))
    rows = master.select("run_id", F.explode(F.array_compact(tags)).alias("bucket"), "keyword", "volume", "m", "trend", "cluster")
    return rank.positions(rows, ["run_id", "bucket"], [-F.col("volume"), F.col("keyword")], "pos")


def volume_mismatch(master: DataFrame) -> DataFrame:
    seen = F.filter(F.array("q_vol", "p_vol", "c_vol"), lambda v: v > 0)
    hi, lo = F.array_max("_v"), F.array_min("_v")
    rows = master.withColumn("_v", seen).where((F.size("_v") >= 2) & (F.try_divide(hi - lo, hi) > MISMATCH_TOLERANCE))
    return rows.select(*KEY, "q_vol", "p_vol", "c_vol", half_up((hi - lo) / hi, 3).alias("spread"))


def _pct(part: Column, whole: Column) -> Column:
    return F.coalesce(half_up(F.try_divide(F.lit(100.0) * part, whole), 1), F.lit(0.0))


def coverage_pct(master: DataFrame, personas: DataFrame, ran: str = "qpc") -> DataFrame:
    """Share of volume every finder covers, over the run (group '') and per cluster group."""
    vol = F.sum("volume")
    both = F.sum(F.when(covered(ran), F.col("volume")).otherwise(0.0))
    all_rows = master.groupBy("run_id").agg(F.lit("").alias("group_id"), vol.alias("total"), both.alias("covered"))
    named = personas.select(*KEY, "group_id").join(master, KEY).groupBy("run_id", "group_id").agg(vol.alias("total"), both.alias("covered"))
    return all_rows.unionByName(named).withColumn("coverage_pct", _pct(F.col("covered"), F.col("total")))


def hub_divergence(master: DataFrame) -> DataFrame:
    """Ranks of a keyword in journeys, connectivity and demand, and how far they disagree."""
    axes = master.select(
        *KEY, "volume", "is_hub", "out_degree", "q_present", "p_present", "c_present",
        F.when(F.col("p_present"), F.col("out_degree").cast("double")).alias("_j"),
        F.when(F.col("c_present"), connectivity().cast("double")).alias("_c"),
        F.when(F.col("q_present"), F.col("q_vol") * F.col("m")).alias("_d"))
    ranked = rank.pct_rank_mid(axes, RUN, {"journey_rank": "_j", "connectivity_rank": "_c", "demand_rank": "_d"})
    names = ("journey", "connectivity", "demand")
    for n in names:
        ranked = ranked.withColumn(f"{n}_rank", half_up(f"{n}_rank", 4))
    vals = F.array_compact(F.array(*[f"{n}_rank" for n in names]))
    hi = sum((F.coalesce((F.col(f"{n}_rank") >= 0.66).cast("int"), F.lit(0)) for n in names), F.lit(0))
    first_low = F.coalesce(*[F.when(F.col(f"{n}_rank") < 0.4, n) for n in names])
    absent = F.coalesce(*[F.when(F.col(f"{n}_rank").isNull(), n) for n in names])
    kind = (F.when((F.size("_vals") == 3) & (hi == 3), "TRIPLE_ANCHOR").when(hi == 1, "BIASED")
            .when((hi >= 1) & first_low.isNotNull(), "HALF").otherwise("MIXED"))
    return ranked.withColumn("_vals", vals).where(F.size("_vals") >= 2).select(
        *KEY, *[f"{n}_rank" for n in names], half_up(F.array_max("_vals") - F.array_min("_vals"), 4).alias("dispersion"),
        kind.alias("type"), F.coalesce(absent, first_low, F.lit("")).alias("missing_axis"), "volume", "is_hub", "out_degree")


def journey_stage(master: DataFrame, journeys: DataFrame) -> DataFrame:
    """Where in a journey a keyword sits on average; off-journey keywords follow their intent."""
    steps = journeys.where(F.size("seq") >= 2).select("run_id", (F.size("seq") - 1).alias("_len"), F.posexplode("seq").alias("step", "keyword"))
    mean = steps.groupBy(*KEY).agg(F.avg(F.col("step") / F.col("_len")).alias("at"))
    by_place = F.when(F.col("at") < 0.34, "entry").when(F.col("at") < 0.67, "mid").when(F.col("at").isNotNull(), "exit")
    by_intent = F.when(F.col("dominant").isin("i", "n"), "entry").when(F.col("dominant") == "t", "exit").otherwise("mid")
    return master.join(mean, KEY, "left").withColumn("stage", F.coalesce(by_place, by_intent)).drop("at")


def _staged_members(personas: DataFrame, stages: DataFrame) -> DataFrame:
    return personas.select(*KEY, "group_id", "gpos").join(stages, KEY)


def persona_stage_matrix(personas: DataFrame, stages: DataFrame) -> DataFrame:
    """Volume, weighted monetization, top keywords and format mix of every group and stage."""
    members = _staged_members(personas, stages)
    cell = ["run_id", "group_id", "stage"]
    fmt = F.when(F.col("dominant") == "i", "guide").when(F.col("dominant") == "n", "brand").when(
        F.col("dominant") == "c", "compare").when(F.col("dominant") == "t", "product")
    facts = members.groupBy(*cell).agg(F.sum("volume").alias("volume"), F.sum(F.col("m") * F.col("volume")).alias("_mv"))
    top = rank.top_n(members, cell, [-F.col("volume"), F.col("keyword")], 5, "pos").groupBy(*cell).agg(
        ordered_list([F.col("pos")], F.col("keyword")).alias("top_keywords"))
    mix = members.withColumn("format", fmt).where("format is not null").groupBy(*cell, "format").agg(
        F.count(F.lit(1)).alias("count")).groupBy(*cell).agg(
        ordered_list([-F.col("count"), F.col("format")], F.struct("format", "count")).alias("format_mix"))
    dim = F.explode(F.array(*[F.lit(s) for s in STAGES])).alias("stage")
    cells = personas.select("run_id", "group_id").distinct().select("run_id", "group_id", dim)
    out = cells.join(facts, cell, "left").join(top, cell, "left").join(mix, cell, "left")
    return out.withColumn("volume", F.coalesce("volume", F.lit(0.0))).withColumn(
        "avg_m", F.coalesce(F.try_divide("_mv", cols.nz("volume")), F.lit(0.0))).drop("_mv")


def _by_stage(cells: DataFrame) -> DataFrame:
    """One row per group with its three volumes and weighted indices."""
    pick = [F.max(F.when(F.col("stage") == s, F.col(c))).alias(f"{s}_{c}") for s in STAGES for c in ("volume", "avg_m")]
    return cells.groupBy("run_id", "group_id").agg(*pick)


def matrix_gap_cells(cells: DataFrame) -> DataFrame:
    """Empty cells next to a cell with demand; severity is the largest neighbour."""
    e, m, x = (F.col(f"{s}_volume") for s in STAGES)
    near = {"entry": m, "mid": F.greatest(e, x), "exit": m}
    rows = F.explode(F.array(*[
        F.struct(F.lit(s).alias("stage"), F.col(f"{s}_volume").alias("volume"), near[s].alias("severity")) for s in STAGES]))
    out = _by_stage(cells).select("run_id", "group_id", rows.alias("r")).select("run_id", "group_id", "r.*")
    return out.where((F.col("volume") == 0) & (F.col("severity") > 0)).drop("volume")


def persona_leak(cells: DataFrame) -> DataFrame:
    """The stage after which the largest share of volume is gone; the earlier stage wins ties."""
    row = _by_stage(cells)
    total = F.coalesce(cols.nz(F.col("entry_volume") + F.col("mid_volume") + F.col("exit_volume")), F.lit(1.0))
    for s in STAGES:
        row = row.withColumn(f"{s}_share", F.col(f"{s}_volume") / total)
    first, second = F.col("entry_share") - F.col("mid_share"), F.col("mid_share") - F.col("exit_share")
    return row.select(
        "run_id", "group_id", F.when(first >= second, "entry").otherwise("mid").alias("leakiest"),
        half_up(F.greatest(first, second, F.lit(0.0)), 4).alias("dropoff"),
        *[half_up(f"{s}_share", 4).alias(f"{s}_share") for s in STAGES])


def intent_slope(cells: DataFrame) -> DataFrame:
    return _by_stage(cells).select(
        "run_id", "group_id", *[half_up(f"{s}_avg_m", 4).alias(f"{s}_m") for s in STAGES],
        half_up(F.col("exit_avg_m") - F.col("entry_avg_m"), 4).alias("slope"))


def downstream_concentration(downstream: DataFrame, master: DataFrame) -> DataFrame:
    """Herfindahl index of the volumes of a node's largest next nodes."""
    v = downstream.select("run_id", "src", F.col("dst").alias("keyword")).join(master.select(*KEY, "volume"), KEY).where("volume > 0")
    sums = v.groupBy("run_id", "src").agg(F.sum("volume").alias("s"), F.sum(F.col("volume") * F.col("volume")).alias("ss"))
    return sums.select("run_id", F.col("src").alias("keyword"), half_up(F.col("ss") / (F.col("s") * F.col("s")), 3).alias("concentration"))


def value_leak(master: DataFrame, concentration: DataFrame, brand_members: DataFrame) -> DataFrame:
    """Where monetizable demand runs off: keywords of both query and journey."""
    cands = master.where(F.col("p_present") & F.col("q_present") & F.col("has_intents")).withColumn(
        "_lf", F.col("out_degree") / (F.col("in_degree") + 1))
    cands = rank.with_min_max(cands, RUN, "_lf", "_lfn").withColumn("_raw", F.col("m") * F.col("volume") * F.col("_lfn"))
    scored = rank.with_min_max(cands, RUN, "_raw", "_score")
    dead = F.col("dominant").isin("t", "c") & (F.col("out_degree") == 0) & (F.col("path_count") >= DEADEND_MIN_PATHS)
    brands = brand_members.select(*KEY).distinct().withColumn("is_brand", F.lit(True))
    return scored.join(concentration, KEY, "left").join(brands, KEY, "left").select(
        *KEY, half_up("m", 4).alias("opp"), "volume", half_up("_lfn", 4).alias("leak_factor"), half_up("_score", 4).alias("leak_score"),
        F.when(dead, "deadend").otherwise("leak").alias("type"), "out_degree", "in_degree", "path_count", "concentration",
        "persona", F.coalesce("is_brand", F.lit(False)).alias("is_brand"), "trend")


def safe_points(leaks: DataFrame, n: int = 8) -> DataFrame:
    medians = rank.exact_medians(leaks, RUN, {"_med": "opp"})
    safe = rank.attached(leaks, medians, RUN).where(
        (F.col("opp") >= F.col("_med")) & (F.col("leak_factor") <= 0.34) & (F.col("in_degree") >= 1))
    order = [-F.col("opp"), -F.col("volume"), -F.col("leak_score"), F.col("keyword")]
    return rank.top_n(safe, RUN, order, n, "pos").select("run_id", "pos", "keyword", "opp", "volume", "leak_factor", "in_degree", "persona")


def brand_defense(leaks: DataFrame) -> DataFrame:
    return leaks.where("is_brand").select(*KEY, "opp", "volume", "leak_score")


def corridor_bridges(master: DataFrame, journey_edges: DataFrame, flow_pairs: DataFrame) -> DataFrame:
    """Cluster pairs linked in the graph or in named flows, with the traffic journeys show between them."""
    placed = master.where(F.col("c_present") & (F.col("cluster") != ""))
    links = placed.select("run_id", F.col("cluster").alias("a"), F.explode("outgoing").alias("b"))
    pairs = links.unionByName(flow_pairs.select("run_id", "a", "b")).where(F.col("a") != F.col("b")).select(
        "run_id", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    at = placed.select("run_id", "keyword", "cluster")
    moves = (
        journey_edges.select("run_id", "src", "dst", "weight")
        .join(at.select("run_id", F.col("keyword").alias("src"), F.col("cluster").alias("cs")), ["run_id", "src"])
        .join(at.select("run_id", F.col("keyword").alias("dst"), F.col("cluster").alias("cd")), ["run_id", "dst"])
        .where(F.col("cs") != F.col("cd"))
        .groupBy("run_id", F.least("cs", "cd").alias("x"), F.greatest("cs", "cd").alias("y"))
        .agg(F.sum(F.when(F.col("cs") < F.col("cd"), F.col("weight")).otherwise(0)).alias("_xy"),
             F.sum(F.when(F.col("cs") > F.col("cd"), F.col("weight")).otherwise(0)).alias("_yx"))
    )
    ms = placed.where("has_intents").groupBy("run_id", "cluster").agg(
        F.coalesce(F.try_divide(F.sum(F.col("m") * F.col("volume")), cols.nz(F.sum("volume"))), F.lit(0.0)).alias("cm"))
    b = pairs.join(moves, ["run_id", "x", "y"], "left").withColumn("_xy", F.coalesce("_xy", F.lit(0))).withColumn(
        "_yx", F.coalesce("_yx", F.lit(0)))
    back = F.col("_yx") > F.col("_xy")
    b = b.select(
        "run_id", F.when(back, F.col("y")).otherwise(F.col("x")).alias("from"), F.when(back, F.col("x")).otherwise(F.col("y")).alias("to"),
        F.greatest("_xy", "_yx").alias("fwd"), F.least("_xy", "_yx").alias("rev"), (F.col("_xy") + F.col("_yx")).alias("total"))
    b = b.join(ms.select("run_id", F.col("cluster").alias("from"), F.col("cm").alias("_mf")), ["run_id", "from"], "left")
    b = b.join(ms.select("run_id", F.col("cluster").alias("to"), F.col("cm").alias("_mt")), ["run_id", "to"], "left")
    b = rank.with_min_max(b, RUN, "total", "_s")
    delta = half_up(F.coalesce("_mt", F.lit(0.0)) - F.coalesce("_mf", F.lit(0.0)), 4)
    direction = F.coalesce(half_up(F.try_divide(F.col("fwd") - F.col("rev"), cols.nz(F.col("total").cast("double"))), 4), F.lit(0.0))
    verdict = (
        F.when(F.col("total") == 0, "false_adjacency").when(F.col("total") < BRIDGE_MIN_TRANSITIONS, "inconclusive")
        .when(F.col("intent_delta") < 0, "substitute_leak").when(F.col("directionality") >= BRIDGE_DIRECTION, "corridor")
        .otherwise("inconclusive"))
    return b.withColumn("intent_delta", delta).withColumn("directionality", direction).select(
        "run_id", "from", "to", "fwd", "rev", "total", "directionality", half_up("_s", 4).alias("strength"), "intent_delta",
        verdict.alias("verdict"))


def bridge_keyword(bridges: DataFrame, master: DataFrame, hubs: DataFrame) -> DataFrame:
    """The keyword that carries a bridge: a linking hub, else the largest linking member, else a hub."""
    members = master.where(F.col("c_present") & (F.col("cluster") != "")).select(
        "run_id", "cluster", "keyword", "volume", F.explode("outgoing").alias("other"))
    names = hubs.select("run_id", F.col("letter").alias("cluster"), F.col("keyword").alias("hub"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("from").alias("cluster"), F.col("to").alias("other")),
                             F.struct(F.lit(1).alias("side"), F.col("to").alias("cluster"), F.col("from").alias("other"))))
    sides = bridges.select("run_id", "from", "to", ends.alias("e")).select("run_id", "from", "to", "e.*").join(
        names, ["run_id", "cluster"], "left")
    linking = sides.join(members, ["run_id", "cluster", "other"]).select(
        "run_id", "from", "to", F.when(F.col("keyword") == F.col("hub"), F.col("side")).otherwise(F.col("side") + 2).alias("tier"),
        "volume", "keyword")
    spare = sides.where(F.col("hub").isNotNull()).select(
        "run_id", "from", "to", (F.col("side") + 4).alias("tier"), F.lit(0.0).alias("volume"), F.col("hub").alias("keyword"))
    best = rank.first_wins(linking.unionByName(spare), ["run_id", "from", "to"], [F.col("tier"), -F.col("volume"), F.col("keyword")])
    return bridges.join(best.select("run_id", "from", "to", F.col("keyword").alias("bridge_keyword")), ["run_id", "from", "to"], "left")


def priority_score(master: DataFrame, leaks: DataFrame, gaps: DataFrame) -> DataFrame:
    """Opportunity against the structure a keyword already has. Norms of structure run over every keyword."""
    rows = master.withColumn("_j", (F.col("path_count") * (1 + F.col("out_degree"))).cast("double")).withColumn(
        "_c", connectivity().cast("double"))
    bounds = rows.groupBy(*RUN).agg(F.min("_j").alias("jl"), F.max("_j").alias("jh"), F.min("_c").alias("cl"), F.max("_c").alias("ch"))
    w1, w2 = STRUCTURE_WEIGHTS
    structure = F.lit(w1) * rank.min_max("_j", "jl", "jh") + F.lit(w2) * rank.min_max("_c", "cl", "ch")
    mom = F.when(F.col("q_present") | F.col("p_present"),
                 F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("trend") / TREND_CLIP))).otherwise(0.0)
    gap = gaps.select(*KEY).distinct().withColumn("in_gap", F.lit(True))
    items = (
        rank.attached(rows, bounds, RUN).where(F.col("volume") > 0)
        .join(leaks.select(*KEY, "leak_score", F.lit(True).alias("in_leak"), "is_brand"), KEY, "left").join(gap, KEY, "left")
        .withColumn("structure", structure).withColumn("momentum", mom).withColumn("leak", F.coalesce("leak_score", F.lit(0.0)))
    )
    severity = 1.0 + F.col("leak") + F.when(F.col("in_gap"), 0.5).otherwise(0.0)
    items = items.withColumn("_num", F.col("volume") * F.col("m") * (1.0 + F.greatest(F.lit(0.0), F.col("momentum"))) * severity)
    items = rank.with_min_max(items, RUN, "_num", "num_norm").withColumn(
        "_score", F.col("num_norm") / (F.col("structure") + STRUCTURE_EPSILON))
    items = rank.with_min_max(items, RUN, "_score", "_disp")
    return items.select(
        *KEY, "volume", "m", "trend", "is_hub", "persona", "structure", "momentum", "leak", "num_norm", half_up("_disp", 4).alias("score"),
        *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("in_gap", "in_leak", "is_brand")])


def bucketed(items: DataFrame) -> DataFrame:
    """Each scored keyword in now, next or later; the order of the tests decides."""
    ranked = rank.attached(rank.pct_rank_mid(items, RUN, {"_r": "structure"}), rank.exact_medians(items, RUN, {"_med": "num_norm"}), RUN)
    tier = F.when(F.col("_r") >= 0.66, "high").when(F.col("_r") >= 0.33, "mid").otherwise("low")
    value, liked = F.col("num_norm") >= F.col("_med"), F.col("score") >= 0.5
    orphan = (F.col("structure") < 0.05) & (F.col("m") > 0)
    preempt = (F.col("momentum") > 0.2) & ~F.col("is_hub") & (F.col("trend") > 0)
    strand = (
        F.when(orphan, "orphan").when(preempt, "preempt")
        .when((F.col("tier") == "high") & (F.col("momentum") >= 0) & value, "quickwin")
        .when(F.col("tier").isin("high", "mid") & (value | liked), "build").when(F.col("tier") == "low", "orphan").otherwise("build"))
    bucket = F.when(F.col("strand") == "quickwin", "now").when(F.col("strand") == "build", "next").otherwise("later")
    return ranked.withColumn("tier", tier).withColumn("strand", strand).withColumn("bucket", bucket).drop("_r", "_med")


def backlog(buckets: DataFrame, n: int = BACKLOG_CAP) -> DataFrame:
    return rank.top_n(buckets, ["run_id", "bucket"], [-F.col("score"), F.col("keyword")], n, "rank")


def backlog_breakdown(shown: DataFrame, items: DataFrame, divergent: DataFrame, bridges: DataFrame) -> DataFrame:
    """Component shares of the shown rows and which of six signals brought them there."""
    bounds = items.groupBy(*RUN).agg(F.min("volume").alias("_lo"), F.max("volume").alias("_hi"))
    div = divergent.select(*KEY, F.lit(True).alias("_div"))
    bridge = bridges.select("run_id", F.col("bridge_keyword").alias("keyword"), F.lit(True).alias("_bridge")).distinct()
    signals = F.array_sort(F.array_compact(F.array(
        F.when(F.col("in_gap"), "coverage-gap"), F.when(F.col("_div"), "hub-divergence"), F.when(F.col("in_leak"), "value-leak"),
        F.when(F.col("_bridge"), "corridor-bridge"), F.when(F.col("is_brand"), "brand-defense"), F.when(F.col("trend") > 0, "momentum"))))
    return rank.attached(shown, bounds, RUN).join(div, KEY, "left").join(bridge, KEY, "left").select(
        "run_id", "bucket", "rank", "keyword", "strand", F.coalesce(F.nullif("persona", F.lit("")), "keyword").alias("target"), "score",
        half_up(rank.min_max("volume", "_lo", "_hi"), 4).alias("volume_share"), half_up("m", 4).alias("intent_share"),
        half_up(F.greatest(F.lit(0.0), F.col("momentum")), 4).alias("momentum_share"),
        half_up(F.col("structure") / sum(STRUCTURE_WEIGHTS), 4).alias("structure_share"), half_up("leak", 4).alias("leak_share"),
        signals.alias("signals"))


def total_kpis(leaks: DataFrame, buckets: DataFrame, coverage: DataFrame, counts: DataFrame) -> DataFrame:
    """Recoverable volume, orphans and coverage; complete when no finder reached its cap (counts: run_id, finder, size)."""
    rec = leaks.groupBy("run_id").agg(F.sum(F.when(F.col("leak_score") >= 0.5, F.col("volume")).otherwise(0.0)).alias("recoverable"))
    orphans = buckets.groupBy("run_id").agg(F.sum(F.when(F.col("strand") == "orphan", 1).otherwise(0)).alias("orphans"))
    cov = coverage.where(F.col("group_id") == "").select("run_id", "coverage_pct")
    full = counts.groupBy("run_id").agg((F.max("size") < 1000).alias("coverage_complete"))
    return cov.join(rec, RUN, "left").join(orphans, RUN, "left").join(full, RUN, "left")


def recap(group_facts: DataFrame, groups: DataFrame) -> DataFrame:
    """Number of core groups and the group with most members (groups: group_id, gpos, relation)."""
    named = group_facts.join(groups.select("group_id", "gpos", "relation"), "group_id")
    return named.groupBy("run_id").agg(
        F.sum(F.when(F.col("relation") == "core", 1).otherwise(0)).alias("core_groups"),
        F.min_by("group_id", F.struct(-F.col("member_count"), "gpos")).alias("largest_group"))


def path_recap(nodes: DataFrame, hubs: DataFrame) -> DataFrame:
    """How many nodes branch, and the first of the ordered hubs (run_id, pos, keyword)."""
    first = hubs.groupBy("run_id").agg(F.min_by("keyword", "pos").alias("top_hub"))
    counts = nodes.groupBy("run_id").agg(F.sum(F.when(F.col("out_degree") >= 2, 1).otherwise(0)).alias("hub_count"))
    return counts.join(first, RUN, "left").withColumn("top_hub", F.coalesce("top_hub", F.lit("")))


def cluster_recap(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """How many clusters there are, and the group (run_id, group_id, letter) that lists most of them; ties to the smaller group_id."""
    listed = groups.groupBy("run_id", "group_id").agg(F.count(F.lit(1)).alias("_n"))
    top = listed.groupBy("run_id").agg(F.min_by("group_id", F.struct(-F.col("_n"), "group_id")).alias("top_cluster_group"))
    counts = nodes.groupBy("run_id").agg(F.count_distinct("letter").alias("cluster_count"))
    return counts.join(top, RUN, "left").withColumn("top_cluster_group", F.coalesce("top_cluster_group", F.lit("")))


def leak_shape(out_degree="out_degree") -> Column:
    d = cols.col(out_degree)
    return F.when(d == 0, "deadend").when(d >= 4, "spread").otherwise("branch")


def shortlists(divergent: DataFrame, leaks: DataFrame, safe: DataFrame) -> DataFrame:
    """Rows that are shown: eight hubs; then flowing leaks, dead ends and safe points, a keyword once."""
    anchor = F.when(F.col("type") == "TRIPLE_ANCHOR", 0).otherwise(1)
    hubs = rank.top_n(divergent, RUN, [anchor, -F.col("dispersion"), -F.col("volume"), F.col("keyword")], 8, "pos")
    hubs = hubs.select("run_id", F.lit("hub").alias("list"), "pos", "keyword", F.col("type").alias("badge"), F.col("dispersion").alias("value"), F.lit("").alias("shape"))
    ordered = [-F.col("leak_score"), F.col("keyword")]
    flowing = rank.top_n(leaks.where((F.col("leak_score") > 0.01) & (F.col("out_degree") != 0)), RUN, ordered, 4, "pos")
    level = F.when(F.col("leak_score") >= 0.5, "urgent").when(F.col("leak_score") >= 0.12, "mid").otherwise("low")
    dead = rank.top_n(leaks.where(F.col("out_degree") == 0), RUN, [-F.col("volume"), *ordered], 2, "pos")
    calm = rank.top_n(safe, RUN, [-F.col("opp"), F.col("pos")], 3, "_p").drop("pos").withColumnRenamed("_p", "pos")
    rows = (
        flowing.select("run_id", F.lit("leak").alias("list"), "pos", "keyword", level.alias("badge"), F.col("leak_score").alias("value"), leak_shape().alias("shape"), F.lit(0).alias("_o"))
        .unionByName(dead.select("run_id", F.lit("deadend").alias("list"), "pos", "keyword", F.lit("deadend").alias("badge"), F.col("opp").alias("value"), leak_shape().alias("shape"), F.lit(1).alias("_o")))
        .unionByName(calm.select("run_id", F.lit("safe").alias("list"), "pos", "keyword", F.lit("safe").alias("badge"), F.col("opp").alias("value"), F.lit("").alias("shape"), F.lit(2).alias("_o")))
    )
    once = rank.first_wins(rows, KEY, [F.col("_o"), F.col("pos")]).drop("_o")
    return hubs.unionByName(once)
