import random

import pytest
from pyspark.sql import functions as F

from querytide.operators import demand, season


LITERAL_PHASES = [  # indices of twelve months and their phases, worked out on paper
    ([1.0] * 12, ["all-year"] * 12),
    ([0.0] * 12, ["all-year"] * 12),
    ([0.2] * 11 + [5.0], ["off"] * 9 + ["prepare", "prepare", "peak"]),
    # one peak in July, climbed from May, left at once; the two months before the climb are for preparing
    ([0.5, 0.5, 0.5, 0.5, 0.95, 1.0, 2.0, 0.5, 0.5, 0.5, 0.5, 0.5], ["off", "off", "prepare", "prepare", "rising", "rising", "peak"] + ["off"] * 5),
    # after the peak two months fade out
    ([0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 2.0, 1.0, 0.95, 0.5, 0.5, 0.5], ["off"] * 4 + ["prepare", "prepare", "peak", "leaving", "leaving", "off", "off", "off"]),
]


def phases_of(spark, rows):
    df = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(rows)], "k int, index array<double>")
    return [r.phases for r in season.with_phases(df).orderBy("k").collect()]


def test_phases_of_literal_years(spark):
    assert phases_of(spark, [x for x, _ in LITERAL_PHASES]) == [p for _, p in LITERAL_PHASES]


def test_phases_turn_with_the_year(spark):
    r = random.Random(3)
    rows = [[r.choice([0.3, 0.6, 0.95, 1.0, 1.15, 1.6, 2.5]) for _ in range(12)] for _ in range(60)]
    turns = [r.randrange(12) for _ in rows]
    turned = [x[k:] + x[:k] for x, k in zip(rows, turns)]
    assert phases_of(spark, turned) == [p[k:] + p[:k] for p, k in zip(phases_of(spark, rows), turns)]


def months(n):
    return [f"{2020 + k // 12}-{k % 12 + 1:02d}" for k in range(n)]


def series(spark, rows):
    m = months(48)
    return spark.createDataFrame([("a", k, k.replace(" ", ""), m, nv, gg, [x + y for x, y in zip(nv, gg)]) for k, nv, gg in rows],
                                 "run_id string, keyword string, key string, months array<string>, nv array<double>, gg array<double>, total array<double>")


Z = [0.0] * 48


def test_new_and_thin_series(spark):
    late = [0.0] * 30 + [50.0] * 18
    s = season.own_series(series(spark, [("late", late, Z), ("flat", [10.0] * 48, Z)]))
    got = {r.keyword: r for r in demand.with_stats(s, "own").collect()}
    assert got["late"].is_new and got["late"].gt is None and got["late"].yoy is None and got["late"].since == "2022-07"
    assert (got["flat"].gt, got["flat"].yoy, got["flat"].dir, got["flat"].avg, got["flat"].peak_month) == (0.0, 0.0, "→→→", 10.0, "2020-01")


def test_single_engine_step_needs_the_other_engine_to_hold_still(spark):
    jump = [100.0] * 20 + [300.0] * 28
    s = series(spark, [("step", [50.0] * 48, jump), ("both", [50.0] * 20 + [150.0] * 28, jump), ("alone", Z, jump)])
    got = [(r.keyword, r.engine, r.month, r.before, r.after, r.other_change) for r in demand.single_engine_step(s).collect()]
    assert got == [("step", "gg", "2021-09", 100.0, 300.0, 0.0)]


def test_spike_falls_back(spark):
    s = season.own_series(series(spark, [("spike", [10.0] * 20 + [90.0] + [10.0] * 27, Z), ("stays", [10.0] * 20 + [90.0] * 28, Z)]))
    got = [(r.keyword, r.month, r.value, r.base) for r in demand.spikes(s, ["keyword"], "own").collect()]
    assert got == [("spike", "2021-09", 90.0, 10.0)]


def bundle(spark, names):
    return spark.createDataFrame([("a", "b", k, n) for k, n in enumerate(names)], "run_id string, bundle_id string, ord long, keyword string")


def test_bundle_counts_a_record_once_and_a_repeated_engine_series_once(spark):
    s = series(spark, [("on run", [1.0] * 48, [2.0] * 48), ("copy", [3.0] * 48, [2.0] * 48), ("thin", [0.0] * 47 + [5.0], Z)])
    kws = bundle(spark, ["on run", "onrun", "copy", "thin", "absent"])
    members = demand.bundle_members(kws, s)
    assert {(r.keyword, r.same_as, sum(r.own)) for r in members.collect()} == {("on run", None, 144.0), ("copy", "on run", 144.0)}
    assert demand.bundle_rollup(members).first().own == [6.0] * 48
    assert {r.keyword for r in demand.dropped_no_data(kws, s).collect()} == {"thin", "absent"}
    assert demand.sum_check(demand.bundle_rollup(members), members).count() == 0


def test_spelling_shift_and_level_jump(spark):
    down = [500.0] * 20 + [100.0] * 28
    up = [50.0] * 20 + [450.0] * 28
    s = series(spark, [("old name", down, Z), ("new name", up, [1.0] * 48)])
    members = demand.bundle_members(bundle(spark, ["old name", "new name"]), s)
    rows = demand.bundle_rollup(members)
    got = [(r["from"], r.to, r.month, r.pick) for r in demand.notation_shifts(members, rows).collect()]
    assert got == [("old name", "new name", "2021-08", 1)] or got == [("old name", "new name", "2021-09", 1)]
    alone = series(spark, [("big", [100.0] * 20 + [900.0] * 28, Z), ("rest", [100.0] * 48, [1.0] * 48)])
    m2 = demand.bundle_members(bundle(spark, ["big", "rest"]), alone)
    jumps = demand.level_jumps(m2, demand.bundle_rollup(m2)).collect()
    assert [(r.keyword, r.share) for r in jumps] == [("big", 1.0)]


def plain_shifts(rows, floor):
    """All pairs of a bundle, month by month; rows: name, average, order, series."""
    mean = lambda s, a: sum(s[a : a + 3]) / 3
    events = []
    for a, fa, oa, s in rows:
        for b, fb, ob, t in rows:
            for m in range(3, len(s) - 2):
                p, q, r, u = mean(s, m - 3), mean(s, m), mean(t, m - 3), mean(t, m)
                if a != b and p >= floor and q < 0.5 * p and u > 1.5 * max(r, 1.0) and u > r and 0.6 * (p - q) <= u - r <= 1.6 * (p - q):
                    events.append((abs((u - r) / (p - q) - 1), (-fa, oa), (-fb, ob), a, b, m))
                    break
    best = min(events, default=None)
    second = min((e for e in events if not {e[3], e[4]} & {best[3], best[4]}), default=None)
    return [e[3:] for e in (best, second) if e]


@pytest.mark.parametrize("keep", [2, 8])
def test_spelling_shifts_equal_all_pairs(spark, monkeypatch, keep):
    import random

    monkeypatch.setattr(demand, "NEAREST", keep)
    rng = random.Random(keep)
    rows, want = [], {}
    for k in range(12):
        names = []
        for i in range(30):
            jump, step = rng.choice([12, 12, 20, 30]), float(rng.choice([300, 300, 301, 400, 600, 900]))
            kind = rng.choice(["down", "up", "both"])
            v = [float(rng.randint(0, 20)) for _ in range(48)]
            v = [x + (step if (kind == "down" and m < jump) or (kind == "up" and m >= jump) or (kind == "both" and jump <= m < jump + 9) else 0.0) for m, x in enumerate(v)]
            names.append((f"n{i}", v))
        rows += [(f"b{k}", i, n, v) for i, (n, v) in enumerate(names)]
    months = [f"{2020 + m // 12}-{m % 12 + 1:02d}" for m in range(48)]
    members = spark.createDataFrame([("a", b, i, n, months, v) for b, i, n, v in rows], "run_id string, bundle_id string, ord long, keyword string, months array<string>, own array<double>")
    whole = demand.bundle_series(members)
    stats = {(r.bundle_id, r.keyword): r.avg for r in demand.with_stats(members, "own").collect()}
    for b in {r[0] for r in rows}:
        mine = [(n, stats[(b, n)], i, v) for x, i, n, v in rows if x == b]
        floor = max(100.0, 0.05 * sum(sum(v) for *_, v in mine) / 48)
        want[b] = [(a, c, months[m]) for a, c, m in plain_shifts(mine, floor)]
    got = {}
    for r in demand.notation_shifts(members, whole).orderBy("pick").collect():
        got.setdefault(r.bundle_id, []).append((r["from"], r.to, r.month))
    assert got == {b: e for b, e in want.items() if e}


def test_a_bundle_that_breaks_in_one_month_makes_few_pairs(spark):
    months = [f"{2020 + m // 12}-{m % 12 + 1:02d}" for m in range(48)]
    rows = [("a", "b", i, f"n{i}", months, [500.0 + i] * 20 + [10.0] * 28 if i % 2 else [10.0] * 20 + [500.0 + i] * 28) for i in range(3000)]
    members = spark.createDataFrame(rows, "run_id string, bundle_id string, ord long, keyword string, months array<string>, own array<double>")
    small = members.withColumn("own", F.transform("own", lambda v: v / 1000))  # the floor of a bundle this size would hide its members
    moves = demand._moves(members, demand.bundle_series(small))
    near = demand._nearest(moves, demand.NEAREST)
    months_hit = moves.select(F.explode("lost")).count()
    assert 0 < near.count() <= months_hit * 3 * (demand.NEAREST + 1)
    assert demand.notation_shifts(members, demand.bundle_series(small)).count() == 2


def test_variants_of_each_run(spark):
    s = series(spark, [("new ring", [1.0] * 48, Z), ("new rings", [2.0] * 48, Z), ("newcircle", [3.0] * 48, Z)])
    members = demand.bundle_members(bundle(spark, ["new ring", "new rings", "newcircle"]), s)
    both = members.withColumn("run_id", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    names = spark.createDataFrame([("a", 0, "ring"), ("a", 1, "rings"), ("a", 2, "circle"), ("b", 0, "rings"), ("b", 1, "ring")], "run_id string, ord int, name string")
    got = sorted((r.run_id, r.keyword, r.spellings) for r in demand.merged_top_queries(both, names).collect())
    alone = [(1, k) for k in ("new ring", "new rings", "newcircle")]
    assert [x for x in got if x[0] == "a"] == [("a", "newcircle", 3)]
    assert [(n, k) for r, k, n in got if r == "c"] == alone
    # a variant is replaced wherever it stands: "rings" holds "ring", whose place the first name takes
    assert [(n, k) for r, k, n in got if r == "b"] == alone


def verdict_rows(spark, gts):
    rows = [("a", f"p{k}", g, 100.0 - k, k, [100.0, 100.0, 100.0, 100.0]) for k, g in enumerate(gts)]
    return spark.createDataFrame(rows, "run_id string, bundle_id string, gt double, avg double, bord int, t array<double>")


@pytest.mark.parametrize("gts,target,want", [
    ([0.1, 0.2, 0.3], 0.25, "same"), ([0.1, 0.2, 0.3], 0.0, "weak"), ([0.1, 0.2, 0.3], 0.5, "strong"), ([0.1, 0.2], 0.5, "hold"), ([0.1, 0.2, None], 0.5, "hold"), ([0.1, 0.2, 0.3], None, "hold")])
def test_market_verdict(spark, gts, target, want):
    t = spark.createDataFrame([("a", target)], "run_id string, gt double")
    assert demand.market_verdict(verdict_rows(spark, gts), t).first().verdict == want


def test_leaving_one_peer_out(spark):
    t = spark.createDataFrame([("a", 0.0)], "run_id string, gt double")
    peers = verdict_rows(spark, [0.0, 0.05, 0.4, 0.5])
    v = demand.market_verdict(peers, t)
    assert v.first().verdict == "weak"
    assert {r.bundle_id: r.flips for r in demand.leave_one_out(peers, v).collect()} == {"p0": False, "p1": False, "p2": True, "p3": True}


def test_numbers_in_text(spark):
    said = spark.createDataFrame([("kr", 1, "약 1,200회 · +15.0%p · 2024년 · 12개 · 3배 · −5%")], "lang string, doc_id int, text string")
    fact = spark.createDataFrame([("kr", "1200 건, +15.0%p, 3배")], "lang string, text string")
    assert [r.number for r in demand.number_grounding(said, fact, ["lang"], "doc_id").collect()] == ["-5%"]


def test_theme_is_the_first_match_and_year_tokens_cancel_signals(spark):
    late = [0.0] * 30 + [500.0] * 18
    s = series(spark, [("red hot ring", late, Z), ("ring 2024", late, Z), ("RED ring", [100.0] * 48, Z), ("cold rod", [100.0] * 48, Z)])
    spec = season_spec(spark, [("a", "ring", "ring", None, 1000.0, None)], [("a", 0, "hot", "hot"), ("a", 1, "red", "red")])
    kept = season.relevance_filter(s, spec)
    assert {r.keyword: r.status for r in kept.collect()}["cold rod"] == "off"
    got = {r.keyword: (r.theme, r.signal) for r in season.classified(kept, spec).collect()}
    assert got == {"red hot ring": ("hot", "new"), "ring 2024": (None, None), "RED ring": ("red", None)}


def season_spec(spark, setup, themes):
    return season.season_spec(spark.createDataFrame(setup, "run_id string, seed string, rel string, exc string, min_total double, skip array<string>"),
                              spark.createDataFrame(themes, "run_id string, tord int, theme string, pattern string"))


def test_every_run_has_its_own_filters_and_themes(spark):
    one = series(spark, [("hot ring", [30.0] * 48, Z), ("cold ring", [30.0] * 48, Z), ("hot rod", [10.0] * 48, Z)]).drop("run_id")
    s = one.withColumn("run_id", F.explode(F.array(*[F.lit(r) for r in "abc"])))
    spec = season_spec(spark, [("a", "Ring", "RING", None, None, None), ("b", "rod", None, "cold", 100.0, [])], [("a", 5, "late", "ring"), ("a", 2, "early", "HOT"), ("b", 0, "all", ".")])
    filtered = season.relevance_filter(s, spec)
    status = {(r.run_id, r.keyword): r.status for r in filtered.collect()}
    assert status == {("a", "hot ring"): "kept", ("a", "cold ring"): "kept", ("a", "hot rod"): "off", ("b", "hot ring"): "kept", ("b", "cold ring"): "off", ("b", "hot rod"): "kept",
                      ("c", "hot ring"): "kept", ("c", "cold ring"): "kept", ("c", "hot rod"): "low"}
    themes = {(r.run_id, r.keyword): r.theme for r in season.classified(filtered, spec).collect()}
    assert themes == {("a", "hot ring"): "early", ("a", "cold ring"): "late", ("b", "hot ring"): "all", ("b", "hot rod"): "all", ("c", "hot ring"): None, ("c", "cold ring"): None}
    review = {r.run_id: (r.untagged, r.core) for r in season.untagged_review(season.classified(filtered, spec), spec).collect()}
    assert review == {"a": (0, 0), "b": (0, 0), "c": (2, 2)}
