import random

import pytest
from pyspark.sql import functions as F

from querytide.operators import clusters, journeys, records


def quota_by_hand(lists, cap):
    share, picked = max(cap // len(lists), 1), []
    for names in lists:
        fresh = [k for k in names if k not in picked]
        picked += fresh[:share]
    for names in lists:
        picked += [k for k in names if k not in picked]
    return picked[:cap]


@pytest.mark.parametrize("seed", range(3))
def test_seed_quota_matches_a_restatement(spark, seed):
    r = random.Random(seed)
    lists = [r.sample([f"k{x}" for x in range(40)], r.randint(1, 30)) for _ in range(r.randint(1, 6))]
    rows = [("a", s, k, q) for s, names in enumerate(lists) for k, q in enumerate(names)]
    df = spark.createDataFrame(rows, "run_id string, seed_ord int, rank long, keyword string")
    for cap in (5, 17, 100):
        got = [x.keyword for x in records.multi_seed_quota(df, cap).orderBy("pos").collect()]
        assert set(got) == set(quota_by_hand(lists, cap)) and len(got) == len(set(got))


def tree_by_hand(paths, volume, roots, children, depth):
    counts = {}
    for p in paths:
        for d in range(1, min(len(p), depth) + 1):
            counts.setdefault(tuple(p[:d]), [0, len(counts)])[0] += 1
    kept, level = set(), [()]
    for d in range(1, depth + 1):
        following = []
        for parent in level:
            kids = sorted((k for k in counts if len(k) == d and k[:-1] == parent), key=lambda k: (-volume[k[-1]], -counts[k][0], counts[k][1]))
            following += kids[: roots if d == 1 else children]
        kept |= set(following)
        level = following
    return {(k, counts[k][0]) for k in kept}


@pytest.mark.parametrize("seed", range(3))
def test_flow_tree_matches_a_restatement(spark, seed):
    r = random.Random(seed)
    names = [f"n{k}" for k in range(7)]
    volume = {n: float(r.randint(0, 5)) for n in names}
    paths = [[r.choice(names) for _ in range(r.randint(1, 6))] for _ in range(30)]
    ranked = spark.createDataFrame([("a", k, p, float(1000 - k), len(p)) for k, p in enumerate(paths)],
                                   "run_id string, path_id long, seq array<string>, total_volume double, hops int")
    nodes = spark.createDataFrame([("a", n, v, "i") for n, v in volume.items()], "run_id string, keyword string, volume_avg double, primary_intent string")
    got = {(tuple(x.prefix), x["count"]) for x in journeys.flow_tree(ranked, nodes, 24, 4, 3, 2).collect()}
    assert got == tree_by_hand(paths[:24], volume, 3, 2, 4)


def test_edges_count_transitions_and_nodes_count_journeys_once(spark):
    j = spark.createDataFrame([("a", 1, ["x", "y", "x", "y"]), ("a", 2, ["y"])], "run_id string, path_id long, seq array<string>")
    edges = journeys.journey_edges(j)
    assert {(e.src, e.dst, e.weight) for e in edges.collect()} == {("x", "y", 2), ("y", "x", 1)}
    m = spark.createDataFrame([("a", "x", 5.0, 1.0, 1.0, 0.0, 0.0, 0.0)], "run_id string, keyword string, volume_avg double, volume_trend double, i double, n double, c double, t double")
    got = {n.keyword: (n.path_count, n.out_degree, n.in_degree, n.out_weight, n.volume_avg, n.primary_intent) for n in journeys.journey_nodes(j, edges, m).collect()}
    assert got == {"x": (1, 1, 1, 2, 5.0, "i"), "y": (2, 1, 1, 1, 0.0, "")}


def graph(spark):
    comm = [("a", "10", 0, "k1"), ("a", "2", 0, "k2"), ("a", "2", 1, "k3"), ("a", "x", 0, "k2"), ("a", "x", 1, "k4")]
    rels = [("a", "k1", "k2"), ("a", "k1", "k2"), ("a", "k3", "k4"), ("a", "k1", "zz")]
    vol = [("a", "k2", 5.0, 1.0, 0.0, 0.0, 0.0), ("a", "k3", 7.0, 1.0, 0.0, 0.0, 0.0)]
    return (spark.createDataFrame(comm, "run_id string, cluster_id string, ord long, keyword string"), spark.createDataFrame(rels, "run_id string, a string, b string"),
            spark.createDataFrame(vol, "run_id string, keyword string, volume_avg double, i double, n double, c double, t double"))


def test_clusters_sort_by_number_and_the_first_community_keeps_a_keyword(spark):
    comm, rels, vol = graph(spark)
    nodes = {n.keyword: n for n in clusters.cluster_nodes_table(comm, rels, vol).collect()}
    assert {k: n.letter for k, n in nodes.items()} == {"k2": "A", "k3": "A", "k1": "B", "k4": "C"}
    assert {k: n.degree for k, n in nodes.items()} == {"k1": 3, "k2": 2, "k3": 1, "k4": 1}
    assert nodes["k2"].outgoing == ["B"] and nodes["k1"].outgoing == ["A"] and nodes["k3"].outgoing == ["C"]
    assert {k for k, n in nodes.items() if n.is_hub} == {"k2", "k1", "k4"}


def test_context_keeps_every_hub_and_is_capped_by_known_volumes(spark):
    comm, rels, vol = graph(spark)
    nodes = clusters.cluster_nodes_table(comm, rels, vol)
    assert {r.keyword for r in clusters.context_selection(nodes, 100, 1).collect()} == {"k2", "k1"}  # two keywords have a volume
    every = nodes.withColumn("volume_avg", F.col("volume_avg") + 1)
    assert {r.keyword for r in clusters.context_selection(every, 3, 1).collect()} == {"k1", "k2", "k4"}
    assert clusters.context_selection(every, 100, 6).count() == 4


def test_enrichment_takes_clusters_round_by_round(spark):
    rows = [("a", f"b{k}", "A", 0, k, 100 - k) for k in range(10)] + [("a", f"s{k}", "B", 1, k, 1) for k in range(3)]
    nodes = spark.createDataFrame(rows, "run_id string, keyword string, letter string, cidx int, ord long, degree long")
    got = [r.keyword for r in clusters.enrich_selection(nodes, 5, 2).orderBy("pos").collect()]
    assert got == ["b0", "b1", "b2", "s0", "s1"]


def test_batches_leave_out_measured_queries(spark):
    want = spark.createDataFrame([("a", f"k {k}", k) for k in range(7)], "run_id string, keyword string, pos long")
    done = spark.createDataFrame([("a", "K2")], "run_id string, keyword string")
    got = {(r.keyword, r.batch_no) for r in records.enrichment_batches(want, done, 3).collect()}
    assert got == {("k 0", 0), ("k 1", 0), ("k 3", 0), ("k 4", 1), ("k 5", 1), ("k 6", 1)}


def test_seeds_of_any_number_take_their_quota_and_too_many_fail(spark):
    from pyspark.errors import PySparkException

    from querytide.operators import records

    lists = spark.createDataFrame([("a", s, r, f"k{s}_{r}") for s in (5, 70, 71) for r in range(1, 6)], "run_id string, seed_ord int, rank int, keyword string")
    got = records.multi_seed_quota(lists, 6).collect()
    assert [(r.seed_ord, r.fill) for r in sorted(got, key=lambda r: r.pos)] == [(5, 0), (5, 0), (70, 0), (70, 0), (71, 0), (71, 0)]
    many = spark.createDataFrame([("a", s, 1, f"k{s}") for s in range(12)], "run_id string, seed_ord int, rank int, keyword string")
    try:
        records.multi_seed_quota(many, 60).collect()
        raise AssertionError("twelve seeds were taken")
    except PySparkException as e:
        assert "more than 10 seeds" in str(e)


def test_letters_never_repeat(spark):
    from querytide.functions import cols

    rows = spark.range(20_000).select("id", cols.cluster_letter("id").alias("l"))
    assert rows.select("l").distinct().count() == 20_000
    named = {r.id: r.l for r in rows.where("id in (0, 25, 26, 701, 702, 18277, 18278)").collect()}
    assert named == {0: "A", 25: "Z", 26: "AA", 701: "ZZ", 702: "AAA", 18277: "ZZZ", 18278: "AAAA"}


def test_names_are_found_where_they_first_count(spark):
    from querytide.operators import classify

    texts = ["red ring redbrand#7", "predate redbrand#7", "redbrand#7 brand#7", "zzbrand#7 x", "red date", "ring brand#7"]
    q = spark.createDataFrame([("a", x) for x in texts], "run_id string, query string")
    names = spark.createDataFrame([("a", "brand#7"), ("b", "red")], "run_id string, name string")
    got = {r.query: r.at for r in classify.bound_match(q, names, "at").collect()}
    assert got == {"red ring redbrand#7": 13, "predate redbrand#7": 12, "redbrand#7 brand#7": 4, "zzbrand#7 x": 0, "red date": 0, "ring brand#7": 6}
    both = spark.createDataFrame([("a", "redbrand#7 brand#7")], "run_id string, query string")
    assert classify.bound_match(both, names, "at").first().at == 12  # red is no word of its own there


def test_watched_brands_are_never_cut(spark):
    from querytide.operators import brand

    rows = [("a", c, b, float(v), 0.1) for c in ("x", "y") for v, b in enumerate(["own", "w1", "w2", "w3", "big", "bigger"])]
    shares = spark.createDataFrame(rows, "run_id string, category string, brand string, volume double, share double")
    assert {r.brand for r in brand.brand_columns(shares, "own", ["w1", "w2", "w3"], 1).collect()} == {"w1", "w2", "w3"}
