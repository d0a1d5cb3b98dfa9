"""Season and trend: relevance, themes, seasonal indices and phases, monthly keywords, trend lists.

Works on the aligned four-year series of operators.demand (months, nv, gg per keyword row). What a run is about comes in tables,
so one job serves runs with other seeds, filters and themes:

* setup: run_id, seed, rel, exc (patterns, null: none), min_total (null: MIN_TOTAL), skip (names, null: the seed); one row a run;
* themes: run_id, tord, theme, pattern; a query has the first theme whose pattern it holds.

`season_spec` puts both together. Patterns ignore case. A run without a row in setup has no filters, the usual floor and no themes.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import cols, rank
from ..functions.cols import circular_distance, half_up
from .demand import blocks, total_of
from .records import RUN, ordered_list

# Fixed values of the season rules.
MIN_TOTAL = 1000
NEW_MONTH, NEW_MIN, SURGE_MIN, SURGE_RATIO = 24, 600, 1200, 2
YEAR_TOKEN = r"(20[12]\d|2[3-9]\s?[년年])"
MONTH_INDEX = 1.4
ALL_YEAR_RATIO, PEAK_SHARE, OFF_INDEX, REBOUND_INDEX = 1.4, 0.7, 0.9, 1.1
PHASE_ORDER = ["prepare", "rising", "peak", "rebound", "hold", "leaving", "off", "all-year"]
TREND_MIN = 5000
KEY = ["run_id", "keyword"]


def own_series(series: DataFrame) -> DataFrame:
    return series.withColumn("own", F.zip_with("nv", "gg", lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))))


def season_spec(setup: DataFrame, themes: DataFrame) -> DataFrame:
    """One row a run: s_seed, s_rel, s_exc, s_floor, s_skip (keys) and s_rules, the themes in their order."""
    rules = themes.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("tord", "theme", "pattern"))).alias("s_rules"))
    skip = F.transform(F.coalesce("skip", F.array("seed")), lambda x: cols.norm_kw(x))
    return setup.select("run_id", F.col("seed").alias("s_seed"), F.col("rel").alias("s_rel"), F.col("exc").alias("s_exc"),
                        F.coalesce("min_total", F.lit(float(MIN_TOTAL))).cast("double").alias("s_floor"), skip.alias("s_skip")).join(rules, "run_id", "full_outer")


def holds(text, pattern) -> Column:
    """A text has a place that fits the pattern of its row, whatever the case; null without a pattern."""
    return F.regexp_like(cols.col(text), F.concat(F.lit("(?i)"), cols.col(pattern)))


def relevance_filter(series: DataFrame, spec: DataFrame) -> DataFrame:
    """Queries with a status: kept, off (not relevant) or low (below the floor). Empty series go first."""
    ok = F.coalesce(holds("keyword", "s_rel"), F.lit(True)) & ~F.coalesce(holds("keyword", "s_exc"), F.lit(False))
    floor = F.coalesce("s_floor", F.lit(float(MIN_TOTAL)))
    rows = own_series(series).withColumn("total4", total_of(F.col("own"))).where(F.col("total4") > 0)
    rows = rank.attached(rows, spec, RUN, "s_rel", "s_exc", "s_floor", how="left")
    return rows.withColumn("status", F.when(~ok, "off").when(F.col("total4") < floor, "low").otherwise("kept")).drop("s_rel", "s_exc", "s_floor")


def sum_between(v: Column, first: int, n: int) -> Column:
    return total_of(F.slice(v, first + 1, n))


def themed_by(rows: DataFrame, spec: DataFrame) -> DataFrame:
    """Adds `theme`, the first theme of the run whose pattern matches. The rules of a run are a short list; rows stay where they are."""
    rows = rank.attached(rows, spec, RUN, "s_rules", how="left")
    fits = F.filter("s_rules", lambda r: holds(F.col("keyword"), r["pattern"]))
    return rows.withColumn("theme", F.get(fits, F.lit(0))["theme"]).drop("s_rules")


def classified(rows: DataFrame, spec: DataFrame) -> DataFrame:
    """Year totals, first month, three-month change, new/surge signal and theme of kept queries."""
    own = F.col("own")
    df = rows.where(F.col("status") == "kept").withColumn("t", blocks(own)).withColumn("e3", F.get("t", F.lit(2))).withColumn(
        "e4", F.get("t", F.lit(3))).withColumn("first", F.array_position(F.transform(own, lambda v: v > 0), True) - 1)
    now3, then3 = sum_between(own, 45, 3), sum_between(own, 33, 3)
    new = (F.col("first") >= NEW_MONTH) & (F.col("e4") >= NEW_MIN) & (F.col("e4") > F.col("e3"))
    surge = (F.col("e3") > 0) & (F.col("e4") >= SURGE_MIN) & (F.try_divide("e4", cols.nz("e3")) >= SURGE_RATIO)
    signal = F.when(F.col("keyword").rlike(YEAR_TOKEN), None).when(new, "new").when(surge, "surge")
    df = df.withColumn("yoy3", F.when(then3 > 0, F.try_divide(now3, then3) - 1)).withColumn("signal", signal)
    return themed_by(df, spec)


def calendar_start() -> Column:
    return F.substring(F.get("months", F.lit(0)), 6, 2).cast("int")


def _year_shapes(own: Column) -> Column:
    """Each twelve-month block divided by its mean, blocks without volume left out."""
    years = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice(own, k * 12 + 1, 12))
    sized = F.transform(years, lambda y: F.struct(y.alias("y"), (total_of(y) / 12).alias("mu")))
    return F.transform(F.filter(sized, lambda s: s["mu"] > 0), lambda s: F.transform(s["y"], lambda v: v / s["mu"]))


def _median(values: Column) -> Column:
    a = F.array_sort(values)
    k = F.size(a)
    return (F.get(a, F.floor((k - 1) / 2).cast("int")) + F.get(a, F.floor(k / 2).cast("int"))) / 2


def with_index(rows: DataFrame) -> DataFrame:
    """Adds twelve seasonal indices by calendar month, the peak month, the peak of every year."""
    at = lambda c: F.pmod(c - F.col("_start"), F.lit(12))
    df = rows.withColumn("_start", calendar_start()).withColumn("_shapes", _year_shapes(F.col("own")))
    index = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda c: F.when(F.size("_shapes") > 0, half_up(_median(
        F.transform("_shapes", lambda y: F.get(y, at(c)))), 3)).otherwise(0.0))
    peaks = F.transform("_shapes", lambda y: F.pmod(F.col("_start") + F.array_position(y, F.array_max(y)).cast("int") - 2, F.lit(12)) + 1)
    df = df.withColumn("index", index).withColumn("year_peaks", peaks)
    peak = F.array_position("index", F.array_max("index")).cast("int")
    return df.withColumn("peak", peak).withColumn("years", F.size("year_peaks")).withColumn(
        "hits", F.size(F.filter("year_peaks", lambda m: m == F.col("peak")))).drop("_start", "_shapes")


def _phase_function():
    """The batch function is local, so tasks receive its code and need no installed package."""

    def phases(index: pd.Series) -> pd.Series:
        """Phases of whole batches at once: rows are queries, columns the twelve months of the circle."""
        if index.empty:
            return index
        ix = np.maximum(np.vstack(index.to_numpy()), 0.01)
        top = ix.max(axis=1, keepdims=True)
        clear = np.where(ix >= 1 + PEAK_SHARE * (top - 1), "peak", np.where(ix < OFF_INDEX, "off", "")).astype("<U8")

        def nearest(p, free, step):
            """Next month in a direction whose phase is not `free`, and its distance (99 when there is none)."""
            found, far = np.full(p.shape, "", dtype="<U8"), np.full(p.shape, 99)
            for d in range(12, 0, -1):
                seen = np.roll(p, -d * step, axis=1)
                found, far = np.where(seen != free, seen, found), np.where(seen != free, d, far)
            return found, far

        ahead, distance = nearest(clear, "", 1)
        behind, _ = nearest(clear, "", -1)
        local = (ix >= np.roll(ix, 1, axis=1)) & (ix >= np.roll(ix, -1, axis=1)) & (ix >= REBOUND_INDEX)
        phase = np.select(
            [clear != "", (ahead == "off") & local, (ahead == "off") & (distance <= 2), (behind == "off") & (ahead == "peak")],
            [clear, "rebound", "leaving", "rising"], "hold").astype("<U8")
        after, left = nearest(phase, "off", 1)
        _, right = nearest(phase, "off", -1)
        last = (phase == "off") & np.isin(after, ["rising", "peak"]) & (left <= np.minimum(2, left + right - 2))
        phase = np.where(last, "prepare", phase)
        flat = top[:, 0] / ix.min(axis=1) < ALL_YEAR_RATIO
        phase[flat] = "all-year"
        return pd.Series(phase.tolist())

    return F.pandas_udf(phases, ArrayType(StringType()))


def with_phases(rows: DataFrame) -> DataFrame:
    """Phase of every month of the year around the seasonal index.

    First the clear months (peak, off), then the ones between by their nearest clear neighbours on
    the circle, last the final off months before a rise become preparation.
    """
    return rows.withColumn("phases", _phase_function()("index"))


def themed(rows: DataFrame) -> DataFrame:
    """Each query once under its theme and once under the base group 'all'."""
    names = F.array_compact(F.array(F.lit("all"), F.col("theme")))
    return rows.withColumn("group", F.explode(names))


def theme_rollup(rows: DataFrame) -> DataFrame:
    """Sum of the members of every theme, and of all, with year totals, changes, signals, index and phases."""
    parts = themed(rows)
    cells = parts.select("run_id", "group", F.posexplode("own").alias("idx", "v")).groupBy("run_id", "group", "idx").agg(F.sum("v").alias("v"))
    total = cells.groupBy("run_id", "group").agg(ordered_list([F.col("idx")], F.col("v")).alias("own"))
    size = parts.groupBy("run_id", "group").agg(
        F.count(F.lit(1)).alias("size"), F.count("signal").alias("signals"), F.any_value("months").alias("months"))
    own = F.col("own")
    df = total.join(size, ["run_id", "group"]).withColumn("e3", sum_between(own, 24, 12)).withColumn("e4", sum_between(own, 36, 12))
    df = df.withColumn("yoy12", half_up(F.try_divide("e4", cols.nz("e3")) - 1, 4)).withColumn(
        "yoy3", half_up(F.try_divide(sum_between(own, 45, 3), cols.nz(sum_between(own, 33, 3))) - 1, 4))
    return with_phases(with_index(df))


def theme_top(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n largest queries of every group."""
    return rank.top_n(themed(rows), ["run_id", "group"], [-F.col("total4"), F.col("keyword")], n, "pos")


def theme_odd(indexed_rows: DataFrame, themes: DataFrame, n: int = 3) -> DataFrame:
    """Queries outside the top ten that reliably peak in another part of the year than their theme."""
    peak = themes.select("run_id", "group", F.col("peak").alias("theme_peak"))
    top = theme_top(indexed_rows).select("run_id", "group", "keyword")
    rest = themed(indexed_rows).where(F.col("e4") >= 3000).join(top, ["run_id", "group", "keyword"], "left_anti").join(peak, ["run_id", "group"])
    need = F.when(F.col("years") >= 4, 3).otherwise(F.col("years"))
    odd = rest.where((F.col("years") >= 2) & (circular_distance("peak", "theme_peak") >= 2) & (F.col("hits") >= need)
                     & (half_up(F.array_max("index"), 2) >= MONTH_INDEX))
    return rank.top_n(odd, ["run_id", "group"], [-F.col("total4"), F.col("keyword")], n, "pos").select(
        "run_id", "group", "pos", "keyword", "e4", "peak", "theme_peak", "hits", "years")


def theme_order(themes: DataFrame, now: Column) -> DataFrame:
    """Off-season flag against the base row, and the reading order for the month `now`."""
    base = themes.where(F.col("group") == "all").select("run_id", F.col("index").alias("_bi"), F.col("peak").alias("_bp"))
    rows = themes.where(F.col("group") != "all").join(base, "run_id")
    off = (F.array_max("index") - F.get("_bi", F.col("peak") - 1) >= 0.15) & (circular_distance("peak", "_bp") >= 2)
    place = F.array_position(F.array(*[F.lit(p) for p in PHASE_ORDER]), F.get("phases", now - 1))
    return rows.select("run_id", "group", off.alias("off"), F.get("phases", now - 1).alias("phase_now"),
                       (place - 1).cast("int").alias("phase_order"), F.pmod(F.col("peak") - now, F.lit(12)).alias("months_to_peak"), "e4")


def next_month() -> Column:
    """The month after the last one of the data."""
    return F.substring(F.element_at("months", -1), 6, 2).cast("int") % 12 + 1


def monthly_keywords(indexed_rows: DataFrame, spec: DataFrame) -> DataFrame:
    """Queries that reliably peak in two adjacent months; the best window decides, the first one on ties. Names of `skip` are left out."""
    rows = indexed_rows.where((sum_between(F.col("own"), 24, 24) >= 500) & (F.col("years") >= 2))
    need = F.when(F.col("years") >= 4, 3).otherwise(F.col("years"))

    def window(a):
        b = a % 12 + 1
        ia, ib = F.get("index", a - 1), F.get("index", b - 1)
        inside = F.filter("year_peaks", lambda m: (m == a) | (m == b))
        return F.struct(F.size(inside).alias("n"), F.greatest(ia, ib).alias("ix"), (-a).alias("order"),
                        F.when(ib > ia, b).otherwise(a).alias("month"),
                        F.when(F.array_contains(inside, a), a).otherwise(b).alias("span_from"),
                        F.when(F.array_contains(inside, b), b).otherwise(a).alias("span_to"))

    windows = F.filter(F.transform(F.sequence(F.lit(1), F.lit(12)), window), lambda w: (w["n"] >= F.col("_need")) & (w["ix"] >= MONTH_INDEX))
    best = rows.withColumn("_need", need).withColumn("w", F.array_max(windows)).where(F.col("w").isNotNull())
    at = F.pmod(F.col("w.month") - calendar_start(), F.lit(12))
    values = F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.get("own", at + 12 * k)), lambda v: v > 0)
    volume = F.coalesce(half_up(F.try_divide(total_of(values), F.size(values)), 0), F.lit(0.0))
    skipped = F.coalesce(F.array_contains("s_skip", cols.norm_kw("keyword")), F.lit(False))
    return rank.attached(best, spec, RUN, "s_skip", how="left").where(~skipped).select(
        *KEY, "theme", F.col("w.month").alias("month"), F.col("w.n").alias("hits"), "years", F.col("w.span_from").alias("span_from"),
        F.col("w.span_to").alias("span_to"), half_up("w.ix", 2).alias("index"), volume.alias("volume"))


def signal_lists(rows: DataFrame) -> DataFrame:
    gain = F.when(F.col("signal") == "new", F.col("e4")).otherwise(F.col("e4") - F.col("e3"))
    return rows.where(F.col("signal").isNotNull()).select(
        *KEY, "signal", F.get("months", F.col("first").cast("int")).alias("first_month"), "e3", "e4", "yoy3", "theme", gain.alias("sort_value"))


def untagged_review(rows: DataFrame, spec: DataFrame) -> DataFrame:
    """Queries without a theme: only the seed, or something the rules miss. Warns above 10% of volume or 20% of queries."""
    rows = rank.attached(rows, spec, RUN, "s_seed", "s_rel", how="left")
    low = F.lower("keyword")
    rest = F.when(F.length("s_seed") > 0, F.replace(low, F.lower("s_seed"), F.lit(" "))).otherwise(low)
    rest = F.when(F.col("s_rel").isNotNull(), F.regexp_replace(rest, F.concat(F.lit("(?i)"), "s_rel"), F.lit(" "))).otherwise(rest)
    bare = F.col("theme").isNull()
    core = bare & (F.trim(rest) != "")
    agg = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("e4").alias("_all"), F.sum(bare.cast("int")).alias("untagged"),
        F.sum(F.when(bare, F.col("e4")).otherwise(0.0)).alias("_u"), F.sum(core.cast("int")).alias("core"),
        F.sum(F.when(core, F.col("e4")).otherwise(0.0)).alias("_c"))
    whole = F.coalesce(cols.nz("_all"), F.lit(1.0))
    share = half_up(F.col("_c") / whole, 4)
    return agg.select("run_id", "untagged", half_up(F.col("_u") / whole, 4).alias("untagged_share"), "core", share.alias("core_share"),
                      ((share > 0.1) | (F.col("core") / F.col("_n") > 0.2)).alias("warn"))


def change_pool(rows: DataFrame) -> DataFrame:
    """Every kept query whose last year differs from the one before, with its direction."""
    side = F.when(F.col("e4") > F.col("e3"), "up").when(F.col("e4") < F.col("e3"), "down")
    return rows.withColumn("side", side).where(F.col("side").isNotNull())


def trend_pool(pool: DataFrame, min_volume: float = TREND_MIN) -> DataFrame:
    big = F.greatest("e3", "e4")
    branch = (F.when((F.col("e3") <= big * 0.02) & (F.col("e4") > 0), "new").when((F.col("e3") > 0) & (F.try_divide("e4", cols.nz("e3")) >= 1.5), "growing")
              .when((F.col("e3") > 0) & (F.try_divide("e4", cols.nz("e3")) <= 0.5), "falling"))
    return pool.where(big >= min_volume).withColumn("branch", branch).withColumn("size", big).where(F.col("branch").isNotNull())


def co_spike_months(pool: DataFrame, min_queries: int = 20, min_share: float = 0.8) -> DataFrame:
    """Months in which many queries of one theme jump together, a sign of a data artefact."""
    last = pool.select("run_id", "keyword", F.coalesce("theme", F.lit("")).alias("theme"), F.slice("months", 25, 24).alias("m"), F.slice("own", 25, 24).alias("s"))
    middle = last.withColumn("_med", F.get(F.array_sort("s"), F.lit(12))).where(F.col("_med") >= 50)
    hits = middle.select("run_id", "theme", "_med", F.explode(F.arrays_zip("m", "s")).alias("c")).where(F.col("c.s") >= 4 * F.col("_med"))
    per = hits.groupBy("run_id", F.col("c.m").alias("month"), "theme").agg(F.count(F.lit(1)).alias("k"))
    out = per.groupBy("run_id", "month").agg(F.sum("k").alias("queries"), F.max("k").alias("_top"), F.min_by("theme", F.struct(-F.col("k"), "theme")).alias("theme"))
    return out.where((F.col("queries") >= min_queries) & (F.col("_top") >= min_share * F.col("queries"))).withColumn(
        "share", F.col("_top") / F.col("queries")).drop("_top")


def quarter_direction(pool: DataFrame, base: float = 10, n: int = 20) -> DataFrame:
    """Largest quarter moves up and down, on the quarter alone and confirmed by the year before."""
    own = F.col("own")
    rows = pool.select(*KEY, "theme", sum_between(own, 33, 3).alias("y0"), sum_between(own, 42, 3).alias("q0"), sum_between(own, 45, 3).alias("q1"))
    rows = rows.where(F.col("q0") >= base)
    year = F.col("y0") >= base
    up, down = F.col("q1") > F.col("q0"), F.col("q1") < F.col("q0")
    tags = F.array_compact(F.array(
        F.when(up, "up_qoq"), F.when(up & year & (F.col("q1") > F.col("y0")), "up_both"),
        F.when(down, "down_qoq"), F.when(down & year & (F.col("q1") < F.col("y0")), "down_both")))
    gain = F.col("q1") - F.col("q0")
    listed = rows.withColumn("gain", gain).withColumn("list", F.explode(tags))
    return rank.top_n(listed, ["run_id", "list"], [-F.abs("gain"), F.col("keyword")], n, "pos")


def season_calendar(monthly: DataFrame) -> DataFrame:
    """Number of season keywords by theme and month; keywords without a theme in a row of their own."""
    named = monthly.withColumn("theme", F.coalesce("theme", F.lit("(none)")))
    wide = named.groupBy("run_id", "theme").pivot("month", list(range(1, 13))).agg(F.count(F.lit(1)))
    months = [F.coalesce(F.col(f"`{m}`"), F.lit(0)).alias(f"m{m}") for m in range(1, 13)]
    total = sum((F.coalesce(F.col(f"`{m}`"), F.lit(0)) for m in range(1, 13)), F.lit(0))
    return wide.select("run_id", "theme", total.alias("keywords"), *months)


def collection_meta(listed: DataFrame, series: DataFrame, filtered: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts of the collection: queried by source, returned, and what the filters left (listed: keyword, src)."""
    def count(cond):
        return F.sum(F.when(cond, 1).otherwise(0))

    q = listed.groupBy("run_id").agg(F.count(F.lit(1)).alias("queried"), count(F.col("src") == "rel").alias("from_related"),
                                     count(F.col("src") == "clu").alias("from_cluster"))
    r = series.groupBy("run_id").agg(F.count(F.lit(1)).alias("returned"))
    f = filtered.groupBy("run_id").agg(*[count(F.col("status") == s).alias(s) for s in ("kept", "off", "low")])
    origin = rows.join(listed.select(*KEY, "src"), KEY, "left").where(F.coalesce(F.col("src"), F.lit("rel")) == "clu")
    c = origin.groupBy("run_id").agg(F.count(F.lit(1)).alias("cluster_kept"), F.count("signal").alias("cluster_signals"))
    out = q.join(r, RUN, "left").join(f, RUN, "left").join(c, RUN, "left")
    return out.select("run_id", *[F.coalesce(F.col(x), F.lit(0)).alias(x) for x in (
        "queried", "from_related", "from_cluster", "returned", "kept", "off", "low", "cluster_kept", "cluster_signals")])


def seed_series(filtered: DataFrame, spec: DataFrame) -> DataFrame:
    """Monthly volumes of each run's seed itself, whatever the filters made of it."""
    rows = rank.attached(filtered, spec, RUN, "s_seed")
    own = rows.where(cols.norm_kw("keyword") == cols.norm_kw("s_seed"))
    return own.select("run_id", F.posexplode(F.arrays_zip("months", "own")).alias("idx", "c")).select(
        "run_id", "idx", F.col("c.months").alias("month"), F.col("c.own").alias("volume"))


def trend_members(chosen: DataFrame, pool: DataFrame, shown: int = 10, keep: int = 5) -> DataFrame:
    """Members (run_id, trend, trend_ord, ord, keyword) of chosen trends that move like their first one."""
    rows = chosen.join(pool.select(*KEY, "branch", "e3", "e4", "size"), KEY).withColumn(
        "side", F.when(F.col("branch") == "falling", "down").otherwise("up"))
    trend = ["run_id", "trend"]
    lead = rank.first_wins(rows.select(*trend, "ord", "side"), trend, [F.col("ord")]).select(*trend, F.col("side").alias("_lead"))
    same = rows.join(lead, trend).where(F.col("side") == F.col("_lead"))
    sized = same.groupBy(*trend).agg(F.count(F.lit(1)).alias("members"), F.max("size").alias("largest"), F.first("trend_ord").alias("_t")).where(F.col("members") >= 2)
    kept = rank.top_n(sized, RUN, [-F.col("largest"), F.col("_t")], keep)
    return rank.top_n(same.join(kept.drop("_t"), trend), trend, [F.col("ord")], shown, "pos").select(
        "run_id", "trend", "trend_ord", "pos", "keyword", "side", "members", "largest", "e3", "e4")
