"""Mixing sources to target weights with a budget that flows down a domain-language-source tree."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.stage import staged

LEAF = ["_m_domain", "_m_lang", "_m_source"]
BUCKET = 3  # leading hex digits of the seeded order: 4,096 buckets a leaf
BROADCAST_LEAVES = 50_000


@dataclass
class Plan:
    """Weights are whole numbers; a name that is not listed weighs `default`."""

    domain_weights: dict[str, int] = field(default_factory=dict)
    lang_weights: dict[str, int] = field(default_factory=dict)
    source_weights: dict[str, int] = field(default_factory=dict)
    default: int = 1
    budget: tuple[int, int] = (1, 2)  # share of all tokens, as a fraction
    epochs: int = 3  # how often a leaf may be read at most
    seed: int = 17


def n_words(text: Column) -> Column:
    """Runs of other characters than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(name: str, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for key, value in weights.items():
        out = F.when(F.col(name) == key, F.lit(value)).otherwise(out)
    return out.cast("decimal(38,0)")


def _pour(level: DataFrame, parent: list[str], name: str, weight: Column) -> DataFrame:
    """Split `_have` of each parent over its children in proportion to their weights, none above `_cap`.

    Children that their share would overfill get their capacity; what they leave goes to their siblings in
    proportion. In order of capacity per weight the full ones come first, so two running sums tell which.
    """
    rows = level.withColumn("_w", weight)
    by = W.partitionBy(*[F.col(c) for c in parent]) if parent else W.partitionBy(F.lit(0))
    order = by.orderBy((F.col("_cap") / F.col("_w").cast("double")), name)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest_w = F.sum("_w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    rest_b = F.col("_have") - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    d = lambda c: c.cast("decimal(38,0)")
    rows = rows.withColumn("_full", d(F.col("_cap")) * d(rest_w) <= F.col("_w") * d(rest_b))
    left = F.col("_have") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(by), F.lit(0))
    open_w = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(by)
    share = F.expr("_w * _left div _open")
    return (
        rows.withColumn("_left", d(left)).withColumn("_open", d(open_w))
        .withColumn("_give", F.when(F.col("_full"), F.col("_cap")).otherwise(share).cast("long"))
        .drop("_w", "_full", "_left", "_open", "_have")
    )


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """`_give` tokens for every leaf (columns LEAF, `_tokens`); rounding down leaves less than one token a node.

    A node takes at most what its leaves hold times the epochs. So a source that falls short is made up
    by the other sources of its language first, then by languages of its domain, then by domains.
    """
    caps = leaves.withColumn("_cap", F.col("_tokens") * plan.epochs)
    total = leaves.agg(F.coalesce(F.sum("_tokens"), F.lit(0)).alias("_all")).select(
        F.expr(f"_all * {plan.budget[0]} div {plan.budget[1]}").alias("_have")
    )
    parts = [_weight(c, w, plan.default) for c, w in zip(LEAF, (plan.domain_weights, plan.lang_weights, plan.source_weights))]
    have: DataFrame | None = None
    for depth in range(3):
        keys = LEAF[: depth + 1]
        level = caps.groupBy(*keys).agg(F.sum("_cap").alias("_cap"))
        # the top budget is one row
        level = level.withColumn("_have", total.scalar()) if have is None else level.join(have, LEAF[:depth])
        have = _pour(level, LEAF[:depth], LEAF[depth], parts[depth]).select(*keys, F.col("_give").alias("_have"))
    return leaves.join(have.withColumnRenamed("_have", "_give"), LEAF)


def mix(docs: DataFrame, domain: Column, plan: Plan, tokens: Column | None = None) -> DataFrame:
    """Rows of `docs` with `epoch` and `n_tokens`, one row per copy that the mix takes.

    A leaf with budget b and t tokens is read b div t times whole; the next epoch gives the documents at the
    front of its order md5(seed:epoch:doc_id), while their running total stays within the rest of b.
    Null languages, sources and domains count as ''; rows with equal doc_id stand or fall together;
    documents without tokens follow the order like others; empty tables give no rows. Columns named
    epoch or n_tokens are replaced, all others stay. No leaf is ordered as a whole: sums per bucket of
    the order find the bucket where the budget ends, and only its rows are sorted.
    """
    keyed = docs.drop("epoch", "n_tokens")
    parts = {"_m_domain": domain, "_m_lang": F.col("lang"), "_m_source": F.col("source")}
    keyed = keyed.withColumns({k: F.coalesce(v.cast("string"), F.lit("")) for k, v in parts.items()})
    keyed = keyed.withColumn("_m_tokens", n_words(F.col("text")) if tokens is None else tokens)
    slim = staged(keyed.select("doc_id", *LEAF, "_m_tokens"))
    given = budgets(slim.groupBy(*LEAF).agg(F.sum("_m_tokens").alias("_tokens")), plan)
    full = F.expr("_give div greatest(_tokens, 1)")
    leaves = staged(given.select(*LEAF, full.alias("_full"), (F.col("_give") - full * F.col("_tokens")).alias("_rest")))
    few = leaves.count() <= BROADCAST_LEAVES
    small = F.broadcast if few else (lambda x: x)
    key = F.md5(F.concat_ws(":", F.lit(str(plan.seed)), (F.col("_full") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    ordered = slim.join(small(leaves), LEAF).withColumn("_key", key)
    sums = ordered.groupBy(*LEAF, "_rest", F.substring("_key", 1, BUCKET).alias("_b")).agg(F.sum("_m_tokens").alias("_s"))
    total = F.sum("_s").over(W.partitionBy(*LEAF).orderBy("_b"))
    ends = (
        sums.withColumn("_upto", total)
        .where(F.col("_upto") > F.col("_rest"))
        .groupBy(*LEAF).agg(F.min(F.struct("_b", (F.col("_rest") - (F.col("_upto") - F.col("_s"))).alias("_room"))).alias("_e"))
        .select(*LEAF, F.col("_e._b").alias("_b"), F.col("_e._room").alias("_room"))
    )
    ends = staged(ends)
    edge = ordered.join(small(ends), LEAF).where(F.substring("_key", 1, BUCKET) == F.col("_b"))
    run = F.sum("_m_tokens").over(W.partitionBy(*LEAF, "_b").orderBy("_key"))  # equal keys together
    last = edge.withColumn("_run", run).where(F.col("_run") <= F.col("_room")).groupBy(*LEAF).agg(F.max("_key").alias("_last"))
    decided = staged(leaves.join(ends.join(last, LEAF, "left"), LEAF, "left").select(*LEAF, "_full", "_b", "_last"))
    taken = keyed.join(small(decided), LEAF).withColumn("_key", key)
    inside = F.col("_b").isNull() | (F.col("_key") < F.col("_b")) | F.coalesce(F.col("_key") <= F.col("_last"), F.lit(False))
    copies = (F.col("_full") + F.when(inside, 1).otherwise(0)).cast("int")
    taken = taken.withColumn("_copies", copies).where("_copies > 0")
    return (
        taken.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .withColumn("n_tokens", F.col("_m_tokens"))
        .drop(*LEAF, "_m_tokens", "_key", "_full", "_b", "_last", "_copies")
    )
