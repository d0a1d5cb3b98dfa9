"""Demand shift over four years: aligned series, interval totals, detectors, bundles, market comparison.

A keyword's months are one row with arrays on its run's month grid, so every per-series rule is a
row expression without a shuffle; only bundle sums and comparisons shuffle.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import cols, rank
from ..functions.cols import half_up
from ..functions.stage import staged
from .records import ordered_list

GRID_MONTHS = 48
# Fixed values of the demand rules.
MIN_TOTAL = 12
NEW_RATIO = 0.10
NEW_YOY_MONTHS = 24
YOY_MIN_BASE = 30
STEP_MIN_BASE, STEP_JUMP, STEP_HOLD, STEP_OTHER_MAX = 100, 2.5, 2.0, 0.5
SPIKE_RATIO, SPIKE_RETURN = 3.0, 1.5
LEVEL_JUMP, LEVEL_HOLD, LEVEL_DOMINANCE, LEVEL_EXCESS = 1.8, 1.5, 0.7, 0.3
SAME_FLOW, MIN_PEERS, MAX_PEERS, MIN_SCALE = 0.15, 3, 10, 0.05
COVER_MIN = 0.90
TOP_QUERIES = 5
BUNDLE = ["run_id", "bundle_id"]


def total_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean_of(a: Column, first: Column, n: int) -> Column:
    """Mean of n values from the 0-based index `first`."""
    return total_of(F.slice(a, first + 1, n)) / n


def blocks(a: Column) -> Column:
    """Sums of consecutive twelve-month blocks."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / 12).cast("int") - 1),
                       lambda k: total_of(F.slice(a, k * 12 + 1, 12)))


def first_where(indices: Column, test) -> Column:
    return F.get(F.filter(indices, test), F.lit(0))


def between(lo: int, hi: Column) -> Column:
    """Indices lo..hi, empty when hi < lo."""
    return F.when(hi >= lo, F.sequence(F.lit(lo), hi)).otherwise(F.array().cast("array<int>"))


def month_grid(monthly: DataFrame) -> DataFrame:
    """Last 48 months present in a run, cut to whole years from the end."""
    months = monthly.select("run_id", "month").distinct()
    back = F.row_number().over(W.partitionBy("run_id").orderBy(F.col("month").desc()))
    last = months.withColumn("_k", back).where(F.col("_k") <= GRID_MONTHS)
    grid = last.groupBy("run_id").agg(F.array_sort(F.collect_list("month")).alias("months"))
    whole = (F.floor(F.size("months") / 12) * 12).cast("int")
    return grid.select("run_id", F.slice("months", F.size("months") - whole + 1, whole).alias("months"))


def align_months(monthly: DataFrame) -> DataFrame:
    """One row per keyword with nv, gg and total on the grid; missing cells are 0."""
    grid = month_grid(monthly)
    cell = F.struct("month", F.struct("nv", "gg", "total").alias("v"))
    # one pass: a month off the grid stays in the map of its keyword and is read by nobody
    cells = F.collect_list(F.when(F.col("month").isNotNull(), cell))
    rows = monthly.groupBy("run_id", "keyword").agg(F.map_from_entries(cells).alias("_m"))
    every = rank.attached(rows, grid, ["run_id"])

    def vector(name):
        return F.transform("months", lambda m: F.coalesce(F.try_element_at("_m", m)[name], F.lit(0.0))).alias(name)

    return every.select("run_id", "keyword", cols.norm_kw("keyword").alias("key"), "months", *[vector(n) for n in ("nv", "gg", "total")])


def grid_rows(series: DataFrame) -> DataFrame:
    cells = F.arrays_zip("months", "nv", "gg", "total")
    return series.select("run_id", "keyword", F.posexplode(cells).alias("idx", "c")).select(
        "run_id", "keyword", "idx", F.col("c.months").alias("month"), "c.nv", "c.gg", "c.total")


def interval_labels(months="months") -> Column:
    """Labels like 00.12-01.11 of the twelve-month blocks."""
    m = cols.col(months)

    def short(x):
        return F.replace(F.substr(x, F.lit(3), F.lit(5)), F.lit("-"), F.lit("."))

    return F.transform(F.sequence(F.lit(0), F.floor(F.size(m) / 12).cast("int") - 1),
                       lambda k: F.concat(short(F.get(m, k * 12)), F.lit("-"), short(F.get(m, k * 12 + 11))))


def growth(now: Column, base: Column) -> Column:
    return F.when(base > 0, F.try_divide(now, base) - 1)


def with_stats(rows: DataFrame, series: str) -> DataFrame:
    """Interval totals, rates, direction, newness and peak of `series` (needs `months`)."""
    v = F.col(series)
    df = rows.withColumn("t", blocks(v)).withColumn("_n", F.size(v)).withColumn(
        "_first", F.array_position(F.transform(v, lambda x: x > 0), True) - 1)
    last, head = F.element_at("t", -1), F.get("t", F.lit(0))
    prev = F.when(F.size("t") >= 2, F.element_at("t", -2))
    steps = F.transform(F.slice("t", 2, F.size("t")), lambda x, i: F.when(x > F.get("t", i), "↑").when(x < F.get("t", i), "↓").otherwise("→"))
    new = (last > 0) & (F.col("_first") >= 3) & ((head == 0) | (head < last * NEW_RATIO))
    fresh = (last > 0) & (F.col("_first") >= 0) & (F.col("_first") >= F.col("_n") - NEW_YOY_MONTHS)
    peak = F.array_position(v, F.array_max(v)) - 1
    return df.select(
        *rows.columns, "t", half_up(last / 12, 0).alias("avg"), F.when(~new, growth(last, head)).alias("gt"),
        F.when(~fresh, growth(last, prev)).alias("yoy"), fresh.alias("yoy_new"), F.array_join(steps, "").alias("dir"),
        new.alias("is_new"), F.when(new, F.get("months", F.col("_first").cast("int"))).alias("since"),
        F.get("months", peak.cast("int")).alias("peak_month"), F.array_max(v).alias("peak_value"))


def monthly_yoy(series: str = "own") -> Column:
    """Change to the same month a year before; NULL on a thin base."""
    v = F.col(series)
    return F.transform(F.sequence(F.lit(12), F.size(v) - 1), lambda i: F.when(
        F.get(v, i - 12) >= YOY_MIN_BASE, F.try_divide(F.get(v, i), F.get(v, i - 12)) - 1))


def single_engine_step(series: DataFrame) -> DataFrame:
    """First month one engine jumps and holds while the other does not move; gg is tried before nv."""
    def detect(a, b):
        def hit(m):
            pre, post = mean_of(a, m - 3, 3), mean_of(a, m, 3)
            base = F.greatest(mean_of(b, m - 3, 3), F.lit(1.0))
            return ((pre >= STEP_MIN_BASE) & (F.get(a, m) >= STEP_JUMP * pre) & (post >= STEP_JUMP * pre)
                    & (mean_of(a, m + 3, 4) >= STEP_HOLD * pre) & (F.abs(F.get(b, m) / base - 1) < STEP_OTHER_MAX))

        return first_where(between(3, F.size(a) - 7), hit)

    nv, gg = F.col("nv"), F.col("gg")
    df = series.withColumn("_g", detect(gg, nv)).withColumn("_n", detect(nv, gg))
    engine = F.when(F.col("_g").isNotNull(), "gg").when(F.col("_n").isNotNull(), "nv")
    df = df.withColumn("engine", engine).withColumn("_i", F.coalesce("_g", "_n")).where(F.col("engine").isNotNull())
    a = F.when(F.col("engine") == "gg", gg).otherwise(nv)
    b = F.when(F.col("engine") == "gg", nv).otherwise(gg)
    i = F.col("_i")
    return df.withColumn("_a", a).withColumn("_b", b).where(total_of(F.col("_b")) >= MIN_TOTAL).select(
        "run_id", "keyword", "engine", F.get("months", i).alias("month"),
        half_up(mean_of(F.col("_a"), i - 3, 3), 0).alias("before"), half_up(F.get("_a", i), 0).alias("after"),
        half_up(F.get("_b", i) / F.greatest(mean_of(F.col("_b"), i - 3, 3), F.lit(1.0)) - 1, 3).alias("other_change"))


def _context_median(v: Column, i: Column) -> Column:
    around = F.array_sort(F.concat(F.slice(v, i - 2, 3), F.slice(v, i + 2, 3)))
    k = F.size(around)
    return (F.get(around, F.floor((k - 1) / 2).cast("int")) + F.get(around, F.floor(k / 2).cast("int"))) / 2


def spikes(rows: DataFrame, keys: list[str], series: str) -> DataFrame:
    """First month three times its surroundings that falls back within two months."""
    v = F.col(series)

    def hit(i):
        base = _context_median(v, i)
        return (base > 0) & (F.get(v, i) >= base * SPIKE_RATIO) & (F.array_min(F.slice(v, i + 2, 2)) <= base * SPIKE_RETURN)

    df = rows.withColumn("_i", first_where(between(3, F.size(v) - 2), hit)).where(F.col("_i").isNotNull())
    i = F.col("_i")
    return df.select(*keys, F.get("months", i).alias("month"), half_up(F.get(v, i), 0).alias("value"),
                     half_up(_context_median(v, i), 0).alias("base"))


# ---- bundles

def measured(bundle_keywords: DataFrame, series: DataFrame) -> DataFrame:
    """Bundle keywords (run_id, bundle_id, ord, keyword) with their series, found by key; NULL when absent."""
    s = series.select("run_id", "key", F.col("keyword").alias("record"), "months", "nv", "gg", "total")
    return bundle_keywords.withColumn("key", cols.norm_kw("keyword")).join(s, ["run_id", "key"], "left")


def has_data() -> Column:
    return F.coalesce(total_of(F.col("total")) >= MIN_TOTAL, F.lit(False))


def dropped_no_data(bundle_keywords: DataFrame, series: DataFrame) -> DataFrame:
    return measured(bundle_keywords, series).where(~has_data()).select(*BUNDLE, "ord", "keyword", F.lit("nodata").alias("reason"))


def bundle_members(bundle_keywords: DataFrame, series: DataFrame) -> DataFrame:
    """Members of each bundle with their own series.

    A record reached by two spellings counts once. A member whose whole gg series repeats an earlier
    member's contributes nv only; `same_as` names the earlier one.
    """
    rows = measured(bundle_keywords, series).where(has_data())
    rows = rank.first_wins(rows.drop("key", "keyword"), [*BUNDLE, "record"], [F.col("ord")]).withColumn("_h", F.xxhash64("gg"))
    sized = rows.where(total_of(F.col("gg")) > 0)
    first = sized.groupBy(*BUNDLE, "_h", "gg").agg(F.min_by(F.struct(F.col("ord").alias("_o"), F.col("record").alias("_r")), "ord").alias("_f"))
    joined = rows.join(first, [*BUNDLE, "_h", "gg"], "left")
    again = F.col("_f._o") < F.col("ord")
    own = F.when(again, F.col("nv")).otherwise(F.zip_with("nv", "gg", lambda a, b: a + b))
    return joined.select(*BUNDLE, "ord", F.col("record").alias("keyword"), "months", own.alias("own"),
                         F.when(again, F.col("_f._r")).alias("same_as"))


def bundle_series(members: DataFrame) -> DataFrame:
    """Monthly sum over the members, and how many there are."""
    cells = members.select(*BUNDLE, F.posexplode("own").alias("idx", "v")).groupBy(*BUNDLE, "idx").agg(F.sum("v").alias("v"))
    total = cells.groupBy(*BUNDLE).agg(ordered_list([F.col("idx")], F.col("v")).alias("own"))
    size = members.groupBy(*BUNDLE).agg(F.count(F.lit(1)).alias("n"), F.any_value("months").alias("months"))
    return total.join(size, BUNDLE)


def bundle_rollup(members: DataFrame) -> DataFrame:
    return with_stats(bundle_series(members), "own")


NEAREST = 8  # gains kept for each loss, month and size class
SLOT_ROWS = 200_000


def _moves(members: DataFrame, bundles: DataFrame) -> DataFrame:
    """Members that lose or gain a level somewhere: `lost` and `won` hold (m, p, q), the means before and after month m."""
    stats = with_stats(members, "own").select(*BUNDLE, "keyword", F.struct((-F.col("avg")).alias("o1"), F.col("ord").cast("long").alias("o2")).alias("_o"), "months", "own")
    floor = bundles.select(*BUNDLE, F.greatest(F.lit(100.0), 0.05 * total_of(F.col("own")) / F.size("own")).alias("_floor"))
    own = F.col("own")
    cells = F.transform(between(3, F.size("own") - 3), lambda m: F.struct(m.alias("m"), mean_of(own, m - 3, 3).alias("p"), mean_of(own, m, 3).alias("q")))
    rows = rank.attached(stats, floor, BUNDLE).withColumn("_c", cells)
    lost = F.filter("_c", lambda c: (c["p"] >= F.col("_floor")) & (c["q"] < 0.5 * c["p"]))
    won = F.filter("_c", lambda c: (c["q"] > 1.5 * F.greatest(c["p"], F.lit(1.0))) & (c["q"] > c["p"]))
    rows = rows.select(*BUNDLE, "keyword", "_o", "months", lost.alias("lost"), won.alias("won"))
    return rows.where((F.size("lost") > 0) | (F.size("won") > 0))


def _nearest(moves: DataFrame, keep: int | None) -> DataFrame:
    """Pairs (from, to, m, fit) of a loss and a gain of 0.6 to 1.6 times its size in the same month.

    Losses and gains meet in classes of size (doublings), a loss in its own and the two beside it. In each class a loss keeps the
    `keep` gains that fit best, ties by the gainer's order, before any pair is made; None keeps all. A row without `to` says that some were
    left out, none of them better than its fit and order.
    """
    lost = moves.select(*BUNDLE, F.col("keyword").alias("from"), F.explode("lost").alias("c")).select(*BUNDLE, "from", F.col("c.m").alias("m"), (F.col("c.p") - F.col("c.q")).alias("size"))
    won = moves.select(*BUNDLE, F.col("keyword").alias("to"), "_o.o1", "_o.o2", F.explode("won").alias("c")).select(
        *BUNDLE, "to", "o1", "o2", F.col("c.m").alias("m"), (F.col("c.q") - F.col("c.p")).alias("size"))
    own = F.floor(F.log2("size"))
    lost = lost.withColumn("class", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: own + d)))
    key = [*BUNDLE, "m", "class"]
    won = won.withColumn("class", own)
    own_names = lambda rows: rows.select(*[F.col(c).alias(c) for c in rows.columns])  # noqa: E731  # both sides come from one table
    lost, won = own_names(lost.join(won.select(*key).distinct(), key, "left_semi")), own_names(won.join(lost.select(*key).distinct(), key, "left_semi"))
    schema = "run_id string, bundle_id string, `from` string, `to` string, m int, fit double, o1 double, o2 long"
    sizes = moves.agg(F.sum(3 * F.size("lost") + F.size("won")).alias("n")).first().n or 0
    slot = F.pmod(F.xxhash64(*key), F.lit(max(1, -(-sizes // SLOT_ROWS))))  # many small classes share a task

    def pick(lost: pd.DataFrame, won: pd.DataFrame) -> pd.DataFrame:
        names = ["run_id", "bundle_id", "from", "to", "m", "fit", "o1", "o2"]
        if not len(lost) or not len(won):
            return pd.DataFrame({c: pd.Series(dtype="object" if c in names[:4] else "float64") for c in names}).astype({"m": "int32", "o2": "int64"})
        groups = pd.concat([lost[key], won[key]]).groupby(key, sort=False).ngroup().to_numpy()
        mine, theirs = groups[: len(lost)], groups[len(lost) :]
        size, o1, o2 = (won[c].to_numpy() for c in ("size", "o1", "o2"))
        up, down = np.lexsort((o2, o1, size, theirs)), np.lexsort((-o2, -o1, size, theirs))  # `down` is read backwards, so that ties come in order there too
        want, n = lost["size"].to_numpy(), len(won) if keep is None else keep

        def place(values, after):
            """Where each value stands among the gains of its class, before or after equal ones."""
            turn = np.repeat([0, 1] if after else [1, 0], [len(up), len(values)])
            order = np.lexsort((turn, np.concatenate([size[up], values]), np.concatenate([theirs[up], mine])))
            gain = order < len(up)
            out = np.empty(len(values), np.int64)
            out[order[~gain] - len(up)] = np.cumsum(gain)[~gain]
            return out

        def spans(a, b):
            counts = np.maximum(b - a, 0)
            return np.repeat(np.arange(len(a)), counts), np.arange(counts.sum()) + np.repeat(a - (np.cumsum(counts) - counts), counts)

        first, middle, last = place(want * 0.6, False), place(want, False), place(want * 1.6, True)
        over, at = spans(middle, np.minimum(last, middle + n))
        under, below = spans(np.maximum(first, middle - n), middle)
        row, col = np.concatenate([over, under]), np.concatenate([up[at], down[below]])
        fit = np.abs(size[col] / want[row] - 1)
        order = np.lexsort((o2[col], o1[col], fit, row))
        row, col, fit = row[order], col[order], fit[order]
        rank_in = np.arange(len(row)) - np.searchsorted(row, row)
        row, col, fit, rank_in = (x[rank_in < n] for x in (row, col, fit, rank_in))
        worst = np.flatnonzero((rank_in == n - 1) & ((last - first)[row] > n))
        row, fit, to = np.concatenate([row, row[worst]]), np.concatenate([fit, fit[worst]]), [*won["to"].to_numpy()[col], *[None] * len(worst)]
        col = np.concatenate([col, col[worst]])
        got = lost[["run_id", "bundle_id", "from", "m"]].iloc[row].reset_index(drop=True)
        return got.assign(to=pd.Series(to, dtype="object"), fit=fit, o1=o1[col], o2=o2[col])[names]

    return lost.withColumn("slot", slot).groupBy("slot").cogroup(won.withColumn("slot", slot).groupBy("slot")).applyInPandas(pick, schema)


def _picks(moves: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The best and the second best shift of each bundle, and the bundles for which pairs that were left out might be better."""
    side = lambda role: moves.select(*BUNDLE, F.col("keyword").alias(role), F.col("_o").alias(f"_{role}"), F.col("lost" if role == "from" else "won").alias(f"c_{role}"), *(["months"] if role == "from" else []))
    rows = near.join(side("from"), [*BUNDLE, "from"])
    pairs = rows.where(F.col("to").isNotNull() & (F.col("from") != F.col("to"))).drop("o1", "o2").join(side("to"), [*BUNDLE, "to"])
    ratio = lambda x, y: (y["q"] - y["p"] >= 0.6 * (x["p"] - x["q"])) & (y["q"] - y["p"] <= 1.6 * (x["p"] - x["q"]))
    earlier = F.exists("c_from", lambda x: (x["m"] < F.col("m")) & F.exists("c_to", lambda y: (y["m"] == x["m"]) & ratio(x, y)))
    at = lambda role: F.get(F.filter(f"c_{role}", lambda c: c["m"] == F.col("m")), F.lit(0))
    order = F.struct("fit", F.col("_from").alias("f"), F.col("_to").alias("t"))
    events = staged(pairs.where(~earlier).select(*BUNDLE, "from", "to", F.get("months", "m").alias("month"), order.alias("order"), at("from").alias("_x"), at("to").alias("_y")))
    left = rows.where(F.col("to").isNull()).select(*BUNDLE, "from", F.struct("fit", F.col("_from").alias("f"), F.struct("o1", "o2").alias("t")).alias("bound"))
    best = staged(rank.first_wins(events, BUNDLE, [F.col("order")]))
    used = best.select(*BUNDLE, F.col("from").alias("_a"), F.col("to").alias("_b"), F.col("order").alias("_best"))
    free = events.join(used, BUNDLE).where(~F.col("from").isin(F.col("_a"), F.col("_b")) & ~F.col("to").isin(F.col("_a"), F.col("_b")))
    second = staged(rank.first_wins(free.drop("_a", "_b", "_best"), BUNDLE, [F.col("order")]))
    known = left.join(used, BUNDLE, "left").join(second.select(*BUNDLE, F.col("order").alias("_second")), BUNDLE, "left")
    above = lambda c: F.col(c).isNull() | (F.col(c) > F.col("bound"))
    other = ~F.coalesce(F.col("from").isin(F.col("_a"), F.col("_b")), F.lit(False))
    unsure = known.where(above("_best") | (other & above("_second"))).select(*BUNDLE).distinct()
    return best.withColumn("pick", F.lit(1)).unionByName(second.withColumn("pick", F.lit(2))), unsure


def notation_shifts(members: DataFrame, bundles: DataFrame) -> DataFrame:
    """Up to two spelling shifts per bundle: one member loses what another gains in the same month.

    Of two months in which a pair fits, the first counts; the best fitting pair is picked, then the best without its members. Only the nearest
    gains of each loss are paired; bundles where that may not be enough (pairs that fitted in an earlier month can stand in the way) are
    paired in full.
    """
    moves = staged(_moves(members, bundles))
    picks, unsure = _picks(moves, staged(_nearest(moves, NEAREST)))
    unsure = staged(unsure)
    if not unsure.isEmpty():
        rest = staged(moves.join(unsure, BUNDLE, "left_semi"))
        whole, _ = _picks(rest, staged(_nearest(rest, None)))
        picks = picks.join(unsure, BUNDLE, "left_anti").unionByName(whole)
    half = lambda c, name: half_up(F.col(c), 0).alias(name)
    return picks.select(*BUNDLE, "pick", "month", "from", "to", half("_x.p", "from_before"), half("_x.q", "from_after"), half("_y.p", "to_before"), half("_y.q", "to_after"))


def level_jumps(members: DataFrame, bundles: DataFrame) -> DataFrame:
    """The first level change of a bundle, reported when one member made most of it. Later months are not tried."""
    v = F.col("own")

    def hit(m):
        pre = mean_of(v, m - 3, 3)
        return (pre >= 100) & (mean_of(v, m, 3) >= LEVEL_JUMP * pre) & (mean_of(v, m + 3, 4) >= LEVEL_HOLD * pre)

    jump = bundles.where(F.col("n") >= 2).withColumn("m", first_where(between(3, F.size(v) - 7), hit)).where(F.col("m").isNotNull())
    jump = jump.select(*BUNDLE, "m", F.get("months", "m").alias("month"), mean_of(v, F.col("m") - 3, 3).alias("pre"),
                       mean_of(v, F.col("m"), 3).alias("post"))
    rows = members.select(*BUNDLE, "keyword", "ord", "own").join(jump, BUNDLE)
    before = mean_of(F.col("own"), F.col("m") - 3, 3)
    rows = rows.withColumn("share", (mean_of(F.col("own"), F.col("m"), 3) - before) / (F.col("post") - F.col("pre"))).withColumn(
        "prior", before / F.col("pre")).drop("own")
    best = rank.first_wins(rows, BUNDLE, [-F.col("share"), F.col("ord")])
    return best.where((F.col("share") >= LEVEL_DOMINANCE) & (F.col("share") - F.col("prior") >= LEVEL_EXCESS)).select(
        *BUNDLE, "month", "keyword", half_up("pre", 0).alias("before"), half_up("post", 0).alias("after"),
        half_up("share", 3).alias("share"), half_up("prior", 3).alias("prior"))


# ---- market comparison

def last_total() -> Column:
    return F.element_at("t", -1)


def peer_scale_filter(peers: DataFrame, target: DataFrame) -> DataFrame:
    """Peers of at least 5% of the target's last year; the ten largest are kept, small ones are flagged."""
    t = target.select("run_id", last_total().alias("_target"))
    rows = peers.join(t, "run_id").withColumn(
        "small", (F.col("_target") > 0) & (last_total() < MIN_SCALE * F.col("_target")))
    kept = rank.top_n(rows.where(~F.col("small")), ["run_id"], [-F.col("avg"), F.col("bord")], MAX_PEERS, "pos")
    small = rows.where("small").withColumn("pos", F.lit(0))
    return kept.unionByName(small).drop("_target")


def _verdict(diff: Column, peers: Column, target: Column) -> Column:
    return (F.when(target.isNull() | (peers < MIN_PEERS), "hold").when(F.abs(diff) < SAME_FLOW, "same")
            .when(diff < 0, "weak").otherwise("strong"))


def market_verdict(kept: DataFrame, target: DataFrame) -> DataFrame:
    """Target growth against the median peer (at most ten kept peers per run)."""
    base = kept.groupBy("run_id").agg(
        F.median("gt").alias("baseline"), F.count("gt").alias("peers"),
        F.sum(F.when(F.col("gt") > 0, 1).otherwise(0)).alias("ups"), F.sum(F.when(F.col("gt") < 0, 1).otherwise(0)).alias("downs"))
    rows = target.select("run_id", F.col("gt").alias("target_gt")).join(base, "run_id", "left").withColumn("peers", F.coalesce("peers", F.lit(0)))
    verdict = _verdict(F.col("target_gt") - F.col("baseline"), F.col("peers"), F.col("target_gt"))
    held = verdict == "hold"
    return rows.select(
        "run_id", "target_gt", F.when(~held, F.col("baseline")).alias("baseline"),
        F.when(~held, F.col("target_gt") - F.col("baseline")).alias("diff"), "peers", verdict.alias("verdict"), "ups", "downs")


def leave_one_out(kept: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Peers whose absence changes the verdict. Ten peers at most, so the self-join is bounded by the cap."""
    rows = kept.where(F.col("gt").isNotNull()).select("run_id", "bundle_id", "gt")
    rest = rows.alias("a").join(rows.select("run_id", F.col("bundle_id").alias("other"), F.col("gt").alias("ogt")), "run_id").where(
        F.col("bundle_id") != F.col("other"))
    without = rest.groupBy("run_id", "bundle_id").agg(F.median("ogt").alias("_base"), F.count(F.lit(1)).alias("_peers"))
    v = verdicts.where((F.col("verdict") != "hold") & (F.col("peers") > MIN_PEERS)).select("run_id", "target_gt", "verdict")
    again = _verdict(F.col("target_gt") - F.col("_base"), F.col("_peers"), F.col("target_gt"))
    rows = without.join(v, "run_id").withColumn("verdict_without", again)
    return rows.select("run_id", "bundle_id", "verdict", "verdict_without", (F.col("verdict") != F.col("verdict_without")).alias("flips"))


def relative_growth(kept: DataFrame, verdicts: DataFrame) -> DataFrame:
    return kept.join(verdicts.select("run_id", "baseline"), "run_id").withColumn("rel", F.col("gt") - F.col("baseline")).drop("baseline")


def representative_cover(rows: DataFrame, broad_rows: DataFrame) -> DataFrame:
    """Share of the broad bundle's last year that the representative spellings reach."""
    b = broad_rows.select(*BUNDLE, last_total().alias("_broad"), F.col("n").alias("cover_n")).where(F.col("_broad") > 0)
    cover = F.least(F.lit(1.0), last_total() / F.col("_broad"))
    return rows.join(b, BUNDLE).select(*BUNDLE, cover.alias("cover"), "cover_n", (cover < COVER_MIN).alias("cover_low"))


def flow_type(d="dir") -> Column:
    x = cols.col(d)
    return (F.when(F.length(x) < 2, "none").when(x.rlike("^↑+$"), "rising").when(x.rlike("^↓+$"), "falling")
            .when(x.endswith("↑") & x.contains("↓"), "fall_then_rise").when(x.endswith("↓") & x.contains("↑"), "rise_then_fall")
            .otherwise("flat"))


def canonical_spelling(keyword, variants) -> Column:
    """Space-free text with every variant (an array of names) replaced by the first one, longest variant first."""
    flat = F.transform(variants, lambda v: cols.norm_kw(v))
    lead = F.get(flat, F.lit(0))
    ordered = F.transform(F.array_sort(F.transform(F.array_distinct(flat), lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda x: x["v"])
    others = F.filter(ordered, lambda v: (v != "") & (v != lead))
    return F.aggregate(F.coalesce(others, F.array().cast("array<string>")), cols.norm_kw(keyword), lambda text, v: F.replace(text, v, lead))


def merged_top_queries(members: DataFrame, variants: DataFrame, n: int = TOP_QUERIES) -> DataFrame:
    """Largest queries of a bundle after spellings are merged; named after the largest spelling.

    variants: run_id, ord, name, the spellings of what the run is about; the first stands for all. A run without any keeps its texts.
    """
    lists = variants.groupBy("run_id").agg(ordered_list([F.col("ord")], F.col("name")).alias("_names"))
    rows = rank.attached(with_stats(members, "own"), lists, ["run_id"], how="left").select(
        *BUNDLE, "keyword", "avg", "ord", canonical_spelling("keyword", F.col("_names")).alias("key"),
        last_total().alias("last"), F.element_at("t", -2).alias("prev"))
    merged = rows.groupBy(*BUNDLE, "key").agg(
        F.sum("last").alias("last"), F.sum("prev").alias("prev"), F.count(F.lit(1)).alias("spellings"),
        F.min(F.struct(-F.col("avg"), "ord")).alias("seen"),
        F.min_by("keyword", F.struct(-F.col("last"), -F.col("avg"), "ord")).alias("keyword"))
    top = rank.top_n(merged, BUNDLE, [-F.col("last"), F.col("seen")], n, "pos")
    return top.select(*BUNDLE, "pos", "keyword", "spellings", "last", growth(F.col("last"), F.col("prev")).alias("yoy"))


# ---- internal composition

def part_intervals(parts: DataFrame) -> DataFrame:
    """Part rows by interval with share and rank. The parts of a run are the bundles of one plan."""
    rows = parts.select(*BUNDLE, "bord", "avg", F.posexplode("t").alias("k", "value"))
    total = rows.groupBy("run_id", "k").agg(F.sum("value").alias("_all"))
    place = F.row_number().over(W.partitionBy("run_id", "k").orderBy(-F.col("value"), -F.col("avg"), "bord"))
    return rows.join(total, ["run_id", "k"]).withColumn("rank", place).withColumn(
        "share", F.try_divide("value", cols.nz("_all"))).drop("_all")


def new_per_interval(members: DataFrame) -> DataFrame:
    """New queries of a part by the interval they start in."""
    rows = with_stats(members, "own").where("is_new")
    k = F.floor((F.array_position("months", F.col("since")) - 1) / 12)
    return rows.groupBy(*BUNDLE, k.alias("k")).agg(F.count(F.lit(1)).alias("new_queries"))


def composition_summary(parts: DataFrame, intervals: DataFrame) -> DataFrame:
    """Concentration of the two largest parts per interval, growth counts, top grower and dropper."""
    top2 = intervals.groupBy("run_id", "k").agg(F.sum(F.when(F.col("rank") <= 2, F.col("share"))).alias("c"))
    conc = top2.groupBy("run_id").agg(F.min_by("c", "k").alias("conc_from"), F.max_by("c", "k").alias("conc_to"))
    known = parts.where(F.col("gt").isNotNull())
    grow = known.groupBy("run_id").agg(
        F.sum(F.when(F.col("gt") > 0, 1).otherwise(0)).alias("ups"), F.sum(F.when(F.col("gt") < 0, 1).otherwise(0)).alias("downs"),
        F.max_by("bundle_id", F.struct("gt", "avg", -F.col("bord"))).alias("_g"),
        F.min_by("bundle_id", F.struct("gt", -F.col("avg"), "bord")).alias("_d"))
    return conc.join(grow, "run_id", "left").select(
        "run_id", "conc_from", "conc_to", "ups", "downs", F.when(F.col("ups") > 0, F.col("_g")).alias("top_grower"),
        F.when(F.col("downs") > 0, F.col("_d")).alias("top_dropper"))


def validated_keywords(plan: DataFrame, related: DataFrame, cluster_nodes: DataFrame) -> DataFrame:
    """Plan keywords (run_id, bundle_id, keyword, verify): known to a list or graph, or to be verified by measurement."""
    clu = cluster_nodes.select("run_id", cols.norm_kw("keyword").alias("key")).distinct().withColumn("_c", F.lit(True))
    rel = related.select("run_id", cols.norm_kw("keyword").alias("key")).distinct().withColumn("_r", F.lit(True))
    rows = plan.withColumn("key", cols.norm_kw("keyword")).join(clu, ["run_id", "key"], "left").join(rel, ["run_id", "key"], "left")
    found = F.coalesce("_c", "_r", F.lit(False))
    status = F.when(F.col("verify"), "verify").when(found, "kept").otherwise("notfound")
    return rows.withColumn("status", status).withColumn("src", F.when(F.col("_c"), "cluster").when(F.col("_r"), "intent")).drop("_c", "_r", "key")


def bundle_source(validated: DataFrame) -> DataFrame:
    kept = validated.where(F.col("status") != "notfound")
    return kept.groupBy(*BUNDLE).agg(F.count(F.lit(1)).alias("kept"), F.when(
        F.max((F.col("src") == "cluster").cast("int")) == 1, "cluster").otherwise("intent").alias("src"))


def sum_check(rows: DataFrame, members: DataFrame, parts_total: DataFrame | None = None) -> DataFrame:
    """Bundles whose months are not the sum of their members or whose intervals are not the sum of their months."""
    again = bundle_series(members).select(*BUNDLE, F.col("own").alias("_sum"))
    bad = rows.join(again, BUNDLE, "left").select(
        *BUNDLE, F.array_compact(F.array(
            F.when(~F.equal_null("own", "_sum"), "months"), F.when(~F.equal_null(blocks(F.col("own")), F.col("t")), "intervals"))).alias("violations"))
    bad = bad.where(F.size("violations") > 0)
    if parts_total is None:
        return bad
    months = rows.select("run_id", F.posexplode("own").alias("idx", "v")).groupBy("run_id", "idx").agg(F.sum("v").alias("v"))
    whole = months.groupBy("run_id").agg(ordered_list([F.col("idx")], F.col("v")).alias("_sum"))
    off = parts_total.join(whole, "run_id", "left").where(~F.equal_null("own", "_sum"))
    return bad.unionByName(off.select("run_id", F.lit("total").alias("bundle_id"), F.array(F.lit("total")).alias("violations")))


def combined_row(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Several bundle rows as one: the sum of their months with its statistics."""
    renamed = rows.select("run_id", F.concat_ws("|", *keys).alias("bundle_id"), "own", "months")
    return with_stats(bundle_series(renamed), "own")


def demand_kpis(target: DataFrame, target_members: DataFrame, verdicts: DataFrame, intervals: DataFrame) -> DataFrame:
    """Verdict and growth, months above last year, lead query and lead part with their shares."""
    recent = F.slice(monthly_yoy("own"), -12, 12)
    base = target.select("run_id", "gt", "avg", "yoy", F.size(F.filter(recent, lambda x: x > 0)).alias("up_months"), last_total().alias("_last"))
    lead = with_stats(target_members, "own").groupBy("run_id").agg(
        F.min_by(F.struct("keyword", last_total().alias("v")), F.struct(-last_total(), -F.col("avg"), "ord")).alias("_lead"))
    last = intervals.groupBy("run_id").agg(F.max_by(F.struct("bundle_id", "share"), F.struct("k", F.col("avg"), -F.col("bord"))).alias("_part"))
    out = base.join(verdicts.select("run_id", "verdict", "diff"), "run_id", "left").join(lead, "run_id", "left").join(last, "run_id", "left")
    return out.select("run_id", "verdict", "diff", "gt", "avg", "yoy", "up_months", F.col("_lead.keyword").alias("lead_query"),
                      F.try_divide(F.col("_lead.v"), cols.nz("_last")).alias("lead_share"),
                      F.col("_part.bundle_id").alias("top_part"), F.col("_part.share").alias("top_part_share"))


def far_peers(kept: DataFrame, closeness: DataFrame) -> DataFrame:
    """Compared peers (closeness: run_id, bundle_id, near) without evidence that people see them beside the target."""
    return kept.select(*BUNDLE).join(closeness.select(*BUNDLE, "near"), BUNDLE).where(F.col("near") != "near")


def sub_bundle_shares(subs: DataFrame, total: DataFrame) -> DataFrame:
    """Share of the parts' last interval that each sub-bundle has (total: run_id, t)."""
    whole = total.select("run_id", last_total().alias("_all"))
    return subs.join(whole, "run_id").withColumn("share", F.try_divide(last_total(), cols.nz("_all"))).drop("_all")


def interval_rates(rows: DataFrame) -> DataFrame:
    """Change rate of each interval to the one before, and over all intervals."""
    t = F.col("t")
    return rows.select(*BUNDLE, F.transform(F.slice(t, 2, F.size(t)), lambda x, i: F.try_divide(x, cols.nz(F.get(t, i))) - 1).alias("rates"),
                       (F.try_divide(last_total(), cols.nz(F.get(t, F.lit(0)))) - 1).alias("overall"))


def top_and_other(intervals: DataFrame, rows: DataFrame, n: int = 6) -> DataFrame:
    """The n largest parts by average and the rest of each interval as one line."""
    top = rank.top_n(rows.select("run_id", "bundle_id", "avg", "bord"), ["run_id"], [-F.col("avg"), F.col("bord")], n, "pos").select(*BUNDLE, F.lit(True).alias("_top"))
    named = intervals.join(top, BUNDLE, "left").withColumn("line", F.when(F.col("_top"), F.col("bundle_id")).otherwise("other"))
    return named.groupBy("run_id", "line", "k").agg(F.sum("value").alias("value"))


def drivers(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The member that moved a bundle most, one that moved its way first."""
    t = with_stats(members, "own").select(*BUNDLE, "keyword", "avg", "ord", (last_total() - F.get("t", F.lit(0))).alias("delta"))
    total = rows.select(*BUNDLE, (last_total() - F.get("t", F.lit(0))).alias("_d"))
    same = (F.col("delta") >= 0) == (F.col("_d") >= 0)
    out = t.join(total, BUNDLE).withColumn("_o", F.when(same, 0).otherwise(1))
    return rank.first_wins(out, BUNDLE, [F.col("_o"), -F.abs("delta"), -F.col("avg"), F.col("ord")]).select(*BUNDLE, "keyword", "delta")


def interval_badges(rows: DataFrame, new_counts: DataFrame) -> DataFrame:
    """Per interval: value, new badge, and new queries outside the interval the bundle itself starts in."""
    k0 = F.when(F.col("is_new"), F.floor((F.array_position("months", F.col("since")) - 1) / 12))
    cells = rows.withColumn("_k0", k0).select(*BUNDLE, "t", "_k0", F.posexplode("t").alias("k", "value"))
    started = (F.col("k") == F.col("_k0")) | ((F.col("k") > 0) & (F.get("t", F.col("k") - 1) == 0))
    out = cells.join(new_counts, [*BUNDLE, "k"], "left")
    return out.select(*BUNDLE, "k", "value", (F.coalesce(started, F.lit(False)) & (F.col("value") > 0)).alias("new_badge"),
                      F.when(F.coalesce(F.col("k") == F.col("_k0"), F.lit(False)), 0).otherwise(F.coalesce("new_queries", F.lit(0))).alias("new_queries"))


# ---- text audit

# The number pattern, units whose numbers are compared as plain counts, words a narrative may not use.
NUMBER = r"[+\-−]?\d[\d,]*(?:\.\d+)?\s*(?:%p|%|만|万|배|회|건|개월|개|K|M)?"
VALUE_UNIT = r"(%p|%|만|万|배|K|M)$"
COUNT_UNIT = r"(건|개월|개|회)$"
BANNED_WORDS = ["거짓말", "속인다", "속이", "충격", "몰락", "폭망", "망했", "사기", "처참", "참패", "괴멸"]


def numbers_in(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Distinct checkable numbers per row, in comparable form; bare small numbers and years are left out."""
    token = F.trim("tok")
    value = F.regexp_replace(token, r"[^\d.]", "").try_cast("double")
    bare = ~token.rlike(VALUE_UNIT) & ((value <= 12) | value.between(1990, 2100))
    found = texts.select(*keys, F.explode(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))).alias("tok"))
    plain = F.regexp_replace(F.translate(token, "−, ", "-"), COUNT_UNIT, "")
    return found.where(value.isNotNull() & ~bare).select(*keys, plain.alias("number")).distinct()


def number_grounding(texts: DataFrame, facts: DataFrame, scope: list[str], text_id: str) -> DataFrame:
    """Numbers of a narrative that its facts do not contain; a plus sign may be left out."""
    said = numbers_in(texts, [*scope, text_id], "text")
    known = numbers_in(facts, scope, "text")
    known = known.unionByName(known.select(*scope, F.regexp_replace("number", r"^\++", "").alias("number"))).distinct()
    return said.join(known, [*scope, "number"], "left_anti")


def word_audit(texts: DataFrame, words: list[str], scope: list[str], text_id: str) -> DataFrame:
    """Words that must not appear: banned ones, and verdict words other than the computed verdict."""
    found = F.array_compact(F.array(*[F.when(F.col("text").contains(w), F.lit(w)) for w in words]))
    return texts.select(*scope, text_id, F.explode(found).alias("word"))
