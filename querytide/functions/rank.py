"""Ranking building blocks that never put a whole run into one task.

A run (or a source, bucket, hub) may hold a third of all rows, so nothing here opens an
unbounded window over a run key. Orders are lists of ascending expressions: negate a number
to sort it downwards, and end with a unique tie-break.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import NumericType

from .stage import staged

GROUP_LIMIT = 1000  # Spark cuts row_number() <= k before the shuffle up to this k
SALTS = 64
BLOCK_END = 1 << 30  # beyond the block of any finite number
REACH_BLOCKS = 1024  # a block is 0.07 % wide
BROADCAST_ROWS = 100_000  # runs (or bundles) whose bounds may go to every task


def _salt(cols) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS))


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the earliest in `order`. Aggregates before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def top_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str | None = None) -> DataFrame:
    """First n rows per key, with their position when `rank` names a column.

    Each task keeps at most n rows per key before the final ranking sees them: up to GROUP_LIMIT Spark's own group
    limit does this before the shuffle. Beyond, where the order begins with a number, a histogram of it tells the block of values in which the
    n-th row lies, and only rows up to that block go on (`within_reach`); a salted first pass after one shuffle cuts blocks that hold many ties.
    """
    out = rank or "_rn"
    w = W.partitionBy(*keys).orderBy(*order)
    if n > GROUP_LIMIT:
        df = within_reach(df, keys, order, n)
        salted = df.withColumn("_salt", _salt(order))
        first = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_srn", F.row_number().over(first)).where(F.col("_srn") <= n).drop("_salt", "_srn")
    ranked = df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)
    return ranked if rank else ranked.drop(out)


def within_reach(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """Rows that can be among the first n of their key by the leading order value alone.

    Values fall into REACH_BLOCKS ordered blocks per doubling; their counts, summed before the shuffle, give the block of the n-th row.
    Unchanged where the order does not begin with a number.
    """
    lead = order[0] if isinstance(order[0], Column) else F.col(order[0])
    if not isinstance(df.select(lead.alias("_v")).schema[0].dataType, NumericType):
        return df
    v = lead.cast("double")
    endless = F.abs(v) == float("inf")
    block = F.when(v.isNull(), -BLOCK_END - 1).when(F.isnan(v), BLOCK_END + 1).when(endless, F.signum(v) * BLOCK_END).otherwise(_value_block(v, REACH_BLOCKS)).cast("long")
    counts = df.groupBy(*keys, block.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # blocks, not rows
    reach = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).where(F.col("_before") < n).groupBy(*keys).agg(F.max("_b").alias("_reach"))
    rows = attached(df, reach, keys, how="left")  # a null key meets no reach; its rows all go on
    return rows.where(F.col("_reach").isNull() | (block <= F.col("_reach"))).select(*df.columns)


def attached(df: DataFrame, stats: DataFrame, keys: list[str], *columns, how: str = "inner") -> DataFrame:
    """Every row with the one row its key has in `stats` (with the keys and `columns` of it, if named).

    The stats are staged (those that are already stay as they are, and are counted once), so they are computed once however many are chained; up to BROADCAST_ROWS of them
    go to every task and the rows of `df` stay where they are. More are joined by a shuffle that adaptive
    execution splits.
    """
    small = stats if hasattr(stats, "_stage_path") else staged(stats)
    if not hasattr(small, "_stage_rows"):
        small._stage_rows = small.count()
    side = small.select(*keys, *columns) if columns else small
    return df.join(F.broadcast(side) if small._stage_rows <= BROADCAST_ROWS else side, keys, how)


def running_total(df: DataFrame, keys: list[str], order: list, weight: Column, out: str) -> DataFrame:
    """Exclusive running sum of `weight` in `order` within each key.

    Rows are range-partitioned over (keys, order) and staged with the number of their partition. Sums per key and
    partition give the offsets; the ordered window then runs per partition instead of per key, so a key of any
    size is spread over as many tasks as its rows need.
    """
    names = [f"_o{i}" for i in range(len(order))]
    ranged = df.withColumns(dict(zip(names, order))).repartitionByRange(*keys, *names)
    t = staged(ranged.withColumn("_b", F.spark_partition_id()))
    sums = t.groupBy(*keys, "_b").agg(F.sum(weight).alias("_w"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "_b", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*keys, "_b").orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    return (
        attached(t, sums, [*keys, "_b"])
        .withColumn(out, F.col("_off") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .drop(*names, "_b", "_off")
    )


def positions(df: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """1-based position of every row of a key, for lists that are too long for one task."""
    return running_total(df, keys, order, F.lit(1), out).withColumn(out, (F.col(out) + 1).cast("long"))


def _value_block(v: Column, per: int = 64) -> Column:
    """Ordered block number of a number: `per` blocks per doubling, a pure function of the value."""
    size = F.floor(F.log2(F.abs(v)) * per) + 1100 * per
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("long") * size)


def _frequencies(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values `_v` of a key with `_cnt`, rows below `_less` and rows in all `_size`.

    Equal values are merged first, so ties cost nothing; the ordered part runs per value block.
    """
    freq = df.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_cnt")).withColumn("_b", _value_block(F.col("_v")))
    sums = freq.groupBy(*keys, "_b").agg(F.sum("_cnt").alias("_w"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        *keys, "_b", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_off"),
        F.sum("_w").over(W.partitionBy(*keys)).alias("_size"),
    )
    inside = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    less = F.col("_off") + F.coalesce(F.sum("_cnt").over(inside), F.lit(0))
    return freq.join(sums, [*keys, "_b"]).select(*keys, "_v", "_cnt", less.alias("_less"), "_size")


def _stacked(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per value column, so several distributions share one pass; NULL values take no part."""
    axes = F.array(*[F.struct(F.lit(v).alias("_axis"), F.col(v).cast("double").alias("_v")) for v in values])
    return df.select(*keys, F.explode(axes).alias("_s")).select(*keys, "_s.*").where(F.col("_v").isNotNull())


def exact_medians(df: DataFrame, keys: list[str], values: dict[str, str], upper: bool = False) -> DataFrame:
    """Exact median (or upper middle value) per key of each `values[out]`, from value frequencies."""
    freq = _frequencies(_stacked(df, keys, list(dict.fromkeys(values.values()))), [*keys, "_axis"])
    lo, hi = F.floor((F.col("_size") - 1) / 2), F.floor(F.col("_size") / 2)
    end = F.col("_less") + F.col("_cnt")
    middle = freq.where((F.col("_less") <= hi) & (end > lo))

    def at(p, v):
        return F.max(F.when((F.col("_axis") == v) & (F.col("_less") <= p) & (p < end), F.col("_v")))

    outs = [(at(hi, v) if upper else (at(lo, v) + at(hi, v)) / 2).alias(out) for out, v in values.items()]
    return middle.groupBy(*keys).agg(*outs)


def pct_rank_mid(df: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """Mid percentile ranks: half the share below plus half the share at or below; a lone value ranks 1.

    NULL marks rows that are not part of a distribution; their rank is NULL. A value that a large share of a key's rows has
    (zero, as a rule) would bring them all to one task: the ranks of such values, at most SALTS an axis, go to the rows as a list of their
    key, and only rows with other values are joined by value.
    """
    freq = _frequencies(_stacked(df, keys, list(values.values())), [*keys, "_axis"])
    mid = F.when(F.col("_size") == 1, F.lit(1.0)).otherwise((F.col("_less") + F.col("_less") + F.col("_cnt")) / 2 / F.col("_size"))
    freq = staged(freq.withColumn("_mid", mid))
    often = freq.where(F.col("_cnt") * SALTS > F.col("_size")).groupBy(*keys).agg(F.collect_list(F.struct("_axis", "_v", "_mid")).alias("_often"))
    columns = df.columns
    df = attached(df, often, keys, how="left")
    for out, v in values.items():
        df, ranks = spread_by_value(df, v, out), freq.where(F.col("_axis") == v).select(*keys, F.col("_v").alias("_match"), F.lit(0).alias("_salt"), F.col("_mid"))
        df = df.join(ranks, [*keys, "_match", "_salt"], "left").withColumn(out, F.coalesce(out, "_mid")).drop("_match", "_salt", "_mid")
    return df.select(*columns, *values)


def spread_by_value(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds `out`, the rank of a frequent value (from `_often`), `_match`, the value where it is not frequent, and `_salt`.

    Rows without `_match` are not looked up; the salt spreads them, for equal keys, null among them, go to one task.
    """
    v = F.col(value).cast("double")
    hit = F.get(F.filter("_often", lambda x: (x["_axis"] == value) & (x["_v"] == v)), F.lit(0))["_mid"]
    df = df.withColumn(out, hit).withColumn("_match", F.when(F.col(out).isNull(), v))
    return df.withColumn("_salt", F.when(F.col("_match").isNull(), F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if c not in ("_often", "_match", out) and "map<" not in kind]), F.lit(SALTS - 1)) + 1).otherwise(0).cast("int"))


def min_max(value, lo, hi) -> Column:
    """Min-max norm; a constant positive distribution is 1, a constant zero one is 0."""
    v, lo, hi = (F.col(x) if isinstance(x, str) else x for x in (value, lo, hi))
    scaled = F.least(F.greatest(F.try_divide(v - lo, hi - lo), F.lit(0.0)), F.lit(1.0))
    return F.when(hi > lo, scaled).when(hi > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def with_min_max(df: DataFrame, keys: list[str], value: str, out: str, where: Column | None = None) -> DataFrame:
    """Min-max norm of `value` over the rows of a key (over those matching `where`, if given)."""
    seen = F.col(value) if where is None else F.when(where, F.col(value))
    stats = df.groupBy(*keys).agg(F.min(seen).alias("_lo"), F.max(seen).alias("_hi"))
    return attached(df, stats, keys).withColumn(out, min_max(value, "_lo", "_hi")).drop("_lo", "_hi")
