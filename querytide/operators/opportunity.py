"""Query opportunity: scores, quadrants, funnel, and the facts of keyword groups."""

from pyspark.sql import DataFrame, functions as F

from ..functions import cols, rank
from .records import RUN, ordered_list

CONTEXT_TOP = 1000
EVIDENCE_TOP = 8


def scored(records: DataFrame) -> DataFrame:
    """Records with primary intent, monetization index, normalised volume, score and quadrant.

    Intents that are listed (has_intents, where the records tell) and all zero count as the first one.
    """
    zero = F.when(F.col("has_intents"), "i").otherwise("") if "has_intents" in records.columns else ""
    top = F.max(F.when(F.col("volume_avg") > 0, F.col("volume_avg")))
    max_log = F.coalesce(F.log10(top + 1), F.lit(1.0)).alias("max_log")
    medians = rank.exact_medians(records, RUN, {"med_volume": "volume_avg", "med_comp": "competition_index"})
    out = rank.attached(records, records.groupBy(*RUN).agg(max_log).join(medians, RUN), RUN)
    weight = cols.intent_weight()
    return out.select(
        *records.columns,
        cols.dominant_intent(zero=zero).alias("primary_intent"),
        weight.alias("m"),
        cols.volume_norm("volume_avg", "max_log").alias("volume_norm"),
        cols.opportunity_score("volume_avg", "competition_index", weight, "max_log").alias("score"),
        cols.quadrant("volume_avg", "competition_index", "med_volume", "med_comp").alias("quadrant"),
    )


def intent_funnel(records: DataFrame) -> DataFrame:
    """Share of each intent over all records, in percent."""
    sums = records.groupBy(*RUN).agg(*[F.sum(k).alias(k) for k in cols.INTENTS])
    total = F.coalesce(cols.nz(cols.intent_total()), F.lit(1.0))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("intent"), F.col(k).alias("s")) for k in cols.INTENTS]))
    return sums.select("run_id", total.alias("total"), rows.alias("r")).select(
        "run_id", "r.intent", cols.half_up(100 * F.col("r.s") / F.col("total"), 1).alias("pct"))


def kpis(records: DataFrame) -> DataFrame:
    sums = [F.sum(k).alias(k) for k in cols.INTENTS]
    agg = records.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("query_count"), F.sum("volume_avg").alias("total_volume"),
        F.avg(cols.nz("cpc")).alias("cpc"), *sums)
    return agg.select(
        "run_id", "query_count", "total_volume",
        cols.half_up(F.col("total_volume") / F.col("query_count"), 0).alias("avg_volume"),
        F.coalesce(cols.half_up("cpc", 2), F.lit(0.0)).alias("avg_cpc"),
        cols.dominant_intent().alias("primary_intent"))


def top_opportunities(scored_records: DataFrame, n: int = 20) -> DataFrame:
    return rank.top_n(scored_records, RUN, [-F.col("score"), F.col("ord")], n, "rn")


def top_trend_series(scored_records: DataFrame, monthly: DataFrame, n: int = 5) -> DataFrame:
    """Month values of the top keywords; labels are the months of the first record that has any."""
    top = top_opportunities(scored_records, n).select("run_id", "keyword", "rn")
    value = F.coalesce(F.col("total"), F.coalesce("gg", F.lit(0.0)) + F.coalesce("nv", F.lit(0.0)))
    months = monthly.join(top, ["run_id", "keyword"])
    series = months.groupBy("run_id", "rn", "keyword").agg(
        ordered_list([F.col("month")], value).alias("values")
    ).select("run_id", "rn", "keyword", F.posexplode("values").alias("idx", "value"))
    have = monthly.select("run_id", "keyword").distinct()
    first = rank.first_wins(
        scored_records.join(have, ["run_id", "keyword"], "left_semi").select("run_id", "keyword", "ord"), RUN, [F.col("ord")])
    labels = monthly.join(first.select("run_id", "keyword"), ["run_id", "keyword"], "left_semi").groupBy("run_id").agg(
        F.array_sort(F.collect_list("month")).alias("labels")
    ).select("run_id", F.posexplode("labels").alias("idx", "label"))
    return series.join(labels, ["run_id", "idx"], "left").select("run_id", "rn", "keyword", "idx", "label", "value")


def context_rows(records: DataFrame, n: int = CONTEXT_TOP) -> DataFrame:
    """The n largest keywords by volume."""
    return rank.top_n(records, RUN, [-F.col("volume_avg"), F.col("ord")], n, "pos")


def context_summary(records: DataFrame) -> DataFrame:
    """Totals over the full set, taken before the cut."""
    sums = [F.sum(k).alias(k) for k in cols.INTENTS]
    return records.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("keyword_count"), F.sum("volume_avg").alias("total_volume"), *sums
    ).select("run_id", "keyword_count", "total_volume", cols.dominant_intent().alias("primary_intent"))


def seed_counts(context: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows each seed kept in the cut; seeds that were pushed out count 0."""
    counts = context.groupBy("run_id", "seed_ord").agg(F.count(F.lit(1)).alias("kept"))
    return seeds.join(counts, ["run_id", "seed_ord"], "left").select(
        "run_id", "seed_ord", F.coalesce("kept", F.lit(0)).alias("kept"))


def known_members(members: DataFrame, context: DataFrame) -> DataFrame:
    """Group members that exist in the context, with its metrics."""
    return members.select("run_id", "group_id", "keyword", F.col("ord").alias("member_ord")).join(
        context.drop("ord"), ["run_id", "keyword"])


def evidence(members: DataFrame, n: int = EVIDENCE_TOP) -> DataFrame:
    top = rank.top_n(members, ["run_id", "group_id"], [-F.col("volume_avg"), F.col("member_ord")], n, "pos")
    return top.select("run_id", "group_id", "pos", "keyword", "volume_avg")


def group_rollup(members: DataFrame, context: DataFrame) -> DataFrame:
    """Volume, size and evidence of each group with at least one known member."""
    known = known_members(members, context)
    facts = known.groupBy("run_id", "group_id").agg(
        F.sum("volume_avg").alias("volume"), F.count(F.lit(1)).alias("member_count"))
    shown = evidence(known).groupBy("run_id", "group_id").agg(
        ordered_list([F.col("pos")], F.col("keyword")).alias("evidence"))
    return facts.join(shown, ["run_id", "group_id"])


def group_intent_share(members: DataFrame, context: DataFrame) -> DataFrame:
    """Volume-weighted leading intent of a group; a keyword without volume still has one vote."""
    known = known_members(members, context)
    vote = F.coalesce(cols.nz("volume_avg"), F.lit(1.0))
    sums = known.groupBy("run_id", "group_id").agg(*[F.sum(F.col(k) * vote).alias(k) for k in cols.INTENTS])
    total = cols.intent_total()
    stage = cols.dominant_intent()
    named = F.create_map(*[F.lit(x) for kv in (
        ("i", "informational"), ("n", "navigational"), ("c", "commercial"), ("t", "transactional")) for x in kv])
    return sums.select(
        "run_id", "group_id", F.coalesce(F.try_element_at(named, stage), F.lit("")).alias("stage"),
        F.when(total > 0, cols.half_up(100 * F.greatest(*cols.INTENTS) / cols.nz(total), 0)).alias("share"))


def evidence_filter(factors: DataFrame, context: DataFrame) -> DataFrame:
    """Evidence keywords that exist; a factor without any disappears."""
    return factors.join(context.select("run_id", "keyword"), ["run_id", "keyword"], "left_semi")
