"""Keys, record selection and work lists over the tables of the readers."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import cols, rank

RUN = ["run_id"]
MAX_SEEDS = 10
LOOKUP_CAP = 1000  # keywords one enrichment call takes


def ordered_list(order: list, value: Column) -> Column:
    """Aggregate: values as an array in `order`. Only for groups with a fixed bound."""
    tagged = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(tagged)), lambda s: s["v"])


def monthly_volume(info: DataFrame) -> DataFrame:
    """Month rows of keyword_info. Without engine columns anywhere in a series, the total is read as gg."""
    months = F.filter("monthly_volume", lambda m: m["month"].isNotNull() & (m["month"] != ""))
    split = F.exists("_m", lambda m: m["nv"].isNotNull() | m["gg"].isNotNull())
    keys = [c for c in info.columns if c in ("run_id", "keyword")]
    rows = (
        info.withColumn("_m", F.array_sort(months)).withColumn("_split", split)
        .select(*keys, "_split", F.posexplode("_m").alias("idx", "m"))
    )
    nv = F.when(F.col("_split"), cols.num("m.nv")).otherwise(0.0)
    gg = F.when(F.col("_split"), cols.num("m.gg")).otherwise(cols.num("m.total"))
    return rows.select(
        *keys, "idx", F.col("m.month").alias("month"), nv.alias("nv"), gg.alias("gg"),
        F.when(F.col("m.total").isNotNull(), cols.num("m.total")).otherwise(nv + gg).alias("total"),
    )


def read_paths(raw: DataFrame) -> DataFrame:
    """Journeys with trimmed nodes, no blanks, no immediate repeats, none empty."""
    named = F.filter(F.transform("seq", lambda x: F.trim(x)), lambda x: x != "")
    kept = F.filter("_seq", lambda x, i: (i == 0) | (x != F.get("_seq", i - 1)))
    return raw.withColumn("_seq", named).withColumn("seq", kept).drop("_seq").where(F.size("seq") > 0)


def related_queries(lists: DataFrame) -> DataFrame:
    """Ordered lists to rows; the position is the volume rank."""
    keys = [c for c in lists.columns if c != "queries"]
    return lists.select(*keys, F.posexplode("queries").alias("pos", "query")).select(
        *keys, (F.col("pos") + 1).cast("long").alias("rank"), "query"
    )


def community_order(cluster_id="cluster_id") -> list[Column]:
    """Numeric community ids by number, then the others by text."""
    n = F.when(cols.col(cluster_id).rlike(r"^\d+$"), cols.col(cluster_id).try_cast("long"))
    return [n.isNull().cast("int"), F.coalesce(n, F.lit(0)), cols.col(cluster_id)]


def cluster_nodes(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Distinct nodes in order of first appearance: edge endpoints, then members not seen in an edge."""
    ends = F.explode(F.array(*[
        F.struct(F.lit(k).alias("side"), F.col(c).alias("keyword")) for k, c in enumerate("ab")
    ]))
    a = edges.select("run_id", "ord", ends.alias("e")).select(
        "run_id", F.col("e.keyword").alias("keyword"),
        F.struct(F.lit(0).alias("part"), F.lit(0).alias("z"), F.lit(0).cast("long").alias("k"),
                 F.col("ord").cast("string").alias("id"), F.col("e.side").cast("long").alias("pos")).alias("at"),
    )
    z, k, cid = community_order()
    b = communities.select(
        "run_id", "keyword",
        F.struct(F.lit(1).alias("part"), z.alias("z"), k.alias("k"), cid.alias("id"),
                 F.col("ord").cast("long").alias("pos")).alias("at"),
    )
    first = a.unionByName(b).groupBy("run_id", "keyword").agg(F.min("at").alias("at"))
    return rank.positions(first, RUN, [F.col("at")], "pos").select("run_id", "pos", "keyword")


def merge_first_wins(chunks: DataFrame, key: str = "keyword", normalised: bool = False) -> DataFrame:
    """Records of ordered files, the earliest file and row of a key wins."""
    k = cols.norm_kw(key) if normalised else F.col(key)
    return rank.first_wins(chunks.withColumn("_key", k), ["run_id", "_key"], [F.col("file_ord"), F.col("row_ord")]).drop("_key")


def dedupe_seed_records(records: DataFrame) -> DataFrame:
    """Union of the seeds' lists, each keyword once, so volumes are not counted twice."""
    return rank.first_wins(records, ["run_id", "keyword"], [F.col("seed_ord"), F.col("rank")])


def multi_seed_quota(lists: DataFrame, cap: int = LOOKUP_CAP) -> DataFrame:
    """Every seed takes its quota of new queries in seed order, leftover slots fill list by list.

    Seeds may be numbered in any way. No list can contribute beyond its first `cap` rows, so the greedy
    passes see at most MAX_SEEDS * cap rows of a run; that bound is what lets them be windows over the
    run. A run with more seeds fails with a message: it is rejected, never cut.
    """
    seeds = lists.groupBy("run_id").agg(F.array_sort(F.collect_set("seed_ord")).alias("_seeds")).withColumn("_n", F.size("_seeds"))
    refused = F.raise_error(F.concat(F.lit(f"more than {MAX_SEEDS} seeds in run "), F.col("run_id").cast("string")))
    seeds = seeds.withColumn("_n", F.when(F.col("_n") > MAX_SEEDS, refused.cast("int")).otherwise(F.col("_n")))
    heads = rank.top_n(lists, ["run_id", "seed_ord"], [F.col("rank"), F.col("keyword")], cap)
    heads = heads.join(seeds.select("run_id", "_seeds"), "run_id").withColumn("seed_ord", F.array_position("_seeds", F.col("seed_ord")) - 1)
    picked = heads.groupBy("run_id", "keyword").agg(
        *[F.min(F.when(F.col("seed_ord") == s, F.col("rank"))).alias(f"_r{s}") for s in range(MAX_SEEDS)]
    )
    picked = (
        picked.join(seeds, "run_id")
        .withColumn("_quota", F.greatest(F.floor(F.lit(cap) / F.col("_n")), F.lit(1)))
        .withColumn("_seed", F.lit(None).cast("int"))
    )
    for s in range(MAX_SEEDS):
        open_row = F.col("_seed").isNull() & F.col(f"_r{s}").isNotNull()
        w = W.partitionBy("run_id").orderBy(F.when(open_row, F.col(f"_r{s}")).asc_nulls_last(), "keyword")
        picked = picked.withColumn("_turn", F.row_number().over(w)).withColumn(
            "_seed", F.when(open_row & (F.col("_turn") <= F.col("_quota")), F.lit(s)).otherwise(F.col("_seed"))
        )
    listed = F.coalesce(*[F.when(F.col(f"_r{s}").isNotNull(), F.lit(s)) for s in range(MAX_SEEDS)])
    picked = picked.withColumn("fill", F.col("_seed").isNull().cast("int")).withColumn(
        "seed_ord", F.coalesce("_seed", listed)
    )
    at = F.coalesce(*[F.when(F.col("seed_ord") == s, F.col(f"_r{s}")) for s in range(MAX_SEEDS)])
    picked = picked.withColumn("rank", at)
    order = [F.col("fill"), F.col("seed_ord"), F.col("rank"), F.col("keyword")]
    out = rank.top_n(picked, RUN, order, cap, "pos")
    return out.withColumn("seed_ord", F.get("_seeds", F.col("seed_ord"))).select("run_id", "pos", "keyword", "seed_ord", "fill")


def finder_union(query: DataFrame, journey_nodes: DataFrame, cluster_pick: DataFrame, cap: int = LOOKUP_CAP) -> DataFrame:
    """Distinct keywords with priority query, journey, cluster. Each input carries its own `pos`."""
    parts = [
        df.select("run_id", "keyword", F.lit(k).alias("source_ord"), F.col("pos").cast("long").alias("ord"))
        for k, df in enumerate((query, journey_nodes, cluster_pick))
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    every = every.withColumn("keyword", F.trim("keyword")).where(F.col("keyword") != "")
    first = rank.first_wins(every, ["run_id", "keyword"], [F.col("source_ord"), F.col("ord")])
    return rank.top_n(first, RUN, [F.col("source_ord"), F.col("ord"), F.col("keyword")], cap, "pos")


def split_back(enriched: DataFrame, query: DataFrame) -> DataFrame:
    """Enriched records of the query source only."""
    return enriched.join(query.select("run_id", "keyword"), ["run_id", "keyword"], "left_semi")


def tagged_candidates(intent: DataFrame, nodes: DataFrame) -> DataFrame:
    """Intent list, then cluster nodes not yet seen by key; `src` keeps the origin."""
    a = intent.select("run_id", "keyword", F.lit("rel").alias("src"), F.lit(0).alias("_s"), F.col("pos").cast("long").alias("pos"))
    b = nodes.select("run_id", "keyword", F.lit("clu").alias("src"), F.lit(1).alias("_s"), F.col("pos").cast("long").alias("pos"))
    both = a.unionByName(b).withColumn("key", cols.norm_kw("keyword")).where(F.col("key") != "")
    return rank.first_wins(both, ["run_id", "key"], [F.col("_s"), F.col("pos")]).select("run_id", "keyword", "src", "_s", "pos")


def enrichment_batches(wanted: DataFrame, done: DataFrame | None = None, chunk: int = LOOKUP_CAP) -> DataFrame:
    """Consecutive batches in list order, without keys that already have a volume."""
    if done is not None:
        have = done.select("run_id", cols.ns("keyword").alias("_key")).distinct()
        wanted = wanted.withColumn("_key", cols.ns("keyword")).join(have, ["run_id", "_key"], "left_anti").drop("_key")
    placed = rank.positions(wanted, RUN, [F.col("pos"), F.col("keyword")], "_at")
    return placed.withColumn("batch_no", F.floor((F.col("_at") - 1) / chunk)).select("run_id", "batch_no", "keyword")


def journey_node_list(journeys: DataFrame, cap: int = LOOKUP_CAP) -> DataFrame:
    """Distinct nodes in order of first appearance."""
    steps = journeys.select("run_id", "path_id", F.posexplode("seq").alias("step", "keyword"))
    first = steps.groupBy("run_id", "keyword").agg(F.min(F.struct("path_id", "step")).alias("at"))
    return rank.top_n(first, RUN, [F.col("at"), F.col("keyword")], cap, "pos").select("run_id", "pos", "keyword")


def record_count_audit(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Payloads whose record count is zero or differs from what was announced."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    found = F.coalesce("found", F.lit(0))
    verdict = F.when(found == 0, "empty").when(found < F.col("expected"), "short").when(
        found > F.col("expected"), "mismatch").otherwise("ok")
    return expected.join(counts, keys, "left").select(
        *keys, "expected", found.cast("long").alias("found"), verdict.alias("verdict"))


def plan_query_list(bundles: DataFrame) -> DataFrame:
    """Queries to measure for a plan: bundle order, keywords before broad lists, first appearance."""
    order = [F.col("bundle_ord"), F.col("broad"), F.col("ord")]
    return rank.first_wins(bundles.select("run_id", "keyword", "bundle_ord", "broad", "ord"), ["run_id", "keyword"], order)


def report_keywords(parts: list[DataFrame]) -> DataFrame:
    """Keywords that appear in the outputs, in order of first appearance; each part has a `pos`."""
    tagged = [
        p.select("run_id", "keyword", F.lit(k).alias("part"), F.col("pos").cast("long").alias("pos"))
        for k, p in enumerate(parts)
    ]
    every = tagged[0]
    for p in tagged[1:]:
        every = every.unionByName(p)
    every = every.where(F.col("keyword").isNotNull() & (F.col("keyword") != ""))
    return rank.first_wins(every, ["run_id", "keyword"], [F.col("part"), F.col("pos")])
