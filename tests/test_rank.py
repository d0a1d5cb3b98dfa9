import random
import statistics

from pyspark.sql import functions as F

from querytide.functions import rank


def frame(spark, rows, schema="run_id string, keyword string, v double, ord long"):
    return spark.createDataFrame(rows, schema)


def sample(n, seed=7):
    """One run holds most rows, values tie often, zeros are frequent."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        run = "hot" if r.random() < 0.8 else r.choice(["a", "b"])
        v = r.choice([0.0, 0.0, float(r.randint(1, 9)), -1.5, r.random() * 1e6])
        rows.append((run, f"k{k}", v, k))
    return rows


def by_run(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(row)
    return out


def test_first_wins_keeps_the_earliest_row_of_a_key(spark):
    rows = [("a", "x", 2.0, 3), ("a", "x", 1.0, 1), ("a", "y", 5.0, 2), ("b", "x", 9.0, 9)]
    got = rank.first_wins(frame(spark, rows), ["run_id", "keyword"], [F.col("ord")]).collect()
    assert {(r.run_id, r.keyword, r.v) for r in got} == {("a", "x", 1.0), ("a", "y", 5.0), ("b", "x", 9.0)}


def test_top_n_matches_a_sort_below_and_above_the_group_limit(spark):
    rows = sample(4000)
    for n in (3, 1500):
        got = rank.top_n(frame(spark, rows), ["run_id"], [-F.col("v"), F.col("ord")], n, "rn").collect()
        want = {}
        for run, part in by_run(rows).items():
            for k, row in enumerate(sorted(part, key=lambda x: (-x[2], x[3]))[:n], 1):
                want[(run, row[1])] = k
        assert {(r.run_id, r.keyword): r.rn for r in got} == want


def test_top_n_sends_on_only_rows_within_reach(spark):
    """A run of 300,000 rows: below 2 n of them pass the histogram, whatever the sign and the order; ties and odd values stay right."""
    run = spark.range(300_000).select(F.lit("a").alias("run_id"), F.concat(F.lit("k"), "id").alias("keyword"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1000 - 5e5).alias("v"), F.col("id").alias("ord"))
    for order in ([-F.col("v"), F.col("ord")], [F.col("v"), F.col("ord")]):
        left = rank.within_reach(run, ["run_id"], order, 2000)
        assert 2000 <= left.count() < 4000
        want = [r.ord for r in run.orderBy(*order).limit(2000).collect()]
        assert [r.ord for r in rank.top_n(run, ["run_id"], order, 2000, "rn").orderBy("rn").collect()] == want
    odd = [("a", "x", x, k) for k, x in enumerate([None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e-320, -1e308, 1e308, 5.0] * 200)]
    rows = frame(spark, odd + [(None, "y", 1.0, 1)])
    for n in (1100, 1500):
        want = {r.ord for r in rows.where("run_id = 'a'").orderBy("v", "ord").limit(n).collect()}
        got = rank.top_n(rows, ["run_id"], [F.col("v"), F.col("ord")], n).collect()
        assert {r.ord for r in got if r.run_id == "a"} == want and sum(r.run_id is None for r in got) == 1
    assert rank.within_reach(rows, ["run_id"], [F.col("keyword")], 3) is rows


def test_positions_are_dense_and_in_order(spark):
    rows = sample(3000)
    got = rank.positions(frame(spark, rows), ["run_id"], [-F.col("v"), F.col("ord")], "pos").collect()
    want = {(run, row[1]): k for run, part in by_run(rows).items()
            for k, row in enumerate(sorted(part, key=lambda x: (-x[2], x[3])), 1)}
    assert {(r.run_id, r.keyword): r.pos for r in got} == want


def test_medians_are_exact_for_even_odd_and_single_rows(spark):
    rows = sample(1001) + [("one", "k", 4.0, 1), ("two", "k", 1.0, 1), ("two", "l", 2.0, 2)]
    got = rank.exact_medians(frame(spark, rows), ["run_id"], {"m": "v", "o": "ord"}).collect()
    for r in got:
        part = by_run(rows)[r.run_id]
        assert r.m == statistics.median(x[2] for x in part)
        assert r.o == statistics.median(x[3] for x in part)
    upper = {r.run_id: r.m for r in rank.exact_medians(frame(spark, rows), ["run_id"], {"m": "v"}, upper=True).collect()}
    assert upper["two"] == 2.0 and upper["hot"] == sorted(x[2] for x in by_run(rows)["hot"])[len(by_run(rows)["hot"]) // 2]


def test_percentile_rank_counts_ties_half_and_a_lone_value_as_one(spark):
    rows = sample(800) + [("one", "k", 4.0, 1)]
    got = rank.pct_rank_mid(frame(spark, rows), ["run_id"], {"p": "v"}).collect()
    for r in got:
        vs = [x[2] for x in by_run(rows)[r.run_id]]
        want = 1.0 if len(vs) == 1 else (sum(x < r.v for x in vs) + sum(x <= r.v for x in vs)) / 2 / len(vs)
        assert abs(r.p - want) < 1e-12


def test_frequent_values_do_not_go_to_one_task(spark):
    """Nine of ten rows are zero or out of the distribution: no key of the join by value has more than a tenth of the rows."""
    rows = [("a", f"k{k}", None if k % 3 == 0 else 0.0 if k % 10 else float(k % 700), k) for k in range(6000)]
    df = frame(spark, rows).withColumn("w", F.col("v") + 1).withColumn("m", F.create_map(F.lit("x"), F.col("v")))
    seen = {}
    split = rank.spread_by_value

    def watched(df, value, out):
        got = split(df, value, out)
        seen[value] = max(r["count"] for r in got.groupBy("run_id", "_match", "_salt").count().collect())
        return got

    rank.spread_by_value = watched
    try:
        got = rank.pct_rank_mid(df, ["run_id"], {"p": "v", "q": "w"}).drop("m").collect()
    finally:
        rank.spread_by_value = split
    assert max(seen.values()) < 600
    vs = sorted(x[2] for x in rows if x[2] is not None)
    import bisect

    for r in got:
        want = None if r.v is None else (bisect.bisect_left(vs, r.v) + bisect.bisect_right(vs, r.v)) / 2 / len(vs)
        assert (r.p is None and r.q is None) if want is None else abs(r.p - want) < 1e-12 and r.q == r.p
    assert len(got) == 6000


def test_percentile_rank_ignores_rows_outside_the_distribution(spark):
    rows = [("a", "x", 1.0, 1), ("a", "y", None, 2), ("a", "z", 3.0, 3)]
    got = {r.keyword: r.p for r in rank.pct_rank_mid(frame(spark, rows), ["run_id"], {"p": "v"}).collect()}
    assert got == {"x": 0.25, "y": None, "z": 0.75}


def test_min_max_of_constant_distributions(spark):
    rows = [("zero", "x", 0.0, 1), ("flat", "x", 2.0, 1), ("flat", "y", 2.0, 2), ("span", "x", 1.0, 1), ("span", "y", 5.0, 2), ("span", "z", 2.0, 3)]
    got = {(r.run_id, r.keyword): r.n for r in rank.with_min_max(frame(spark, rows), ["run_id"], "v", "n").collect()}
    assert got == {("zero", "x"): 0.0, ("flat", "x"): 1.0, ("flat", "y"): 1.0, ("span", "x"): 0.0, ("span", "y"): 1.0, ("span", "z"): 0.25}


def test_empty_inputs_stay_empty(spark):
    empty = frame(spark, [])
    assert rank.positions(empty, ["run_id"], [F.col("ord")], "p").count() == 0
    assert rank.exact_medians(empty, ["run_id"], {"m": "v"}).count() == 0
    assert rank.top_n(empty, ["run_id"], [F.col("ord")], 2000).count() == 0
