"""Brand competition: branded queries, share of search, journeys, facets, verdicts and the lists drawn from them.

Tables are keyed by run_id. Brands come as names (run_id, brand, name): the brand itself and its
aliases; excludes (run_id, brand, text) are other words that merely contain a brand. The set-up has a row for
a run: own_brand, own_words (words that mark the own brand's queries) and watch (brands that are always
shown), so one job serves runs of different brands; a run without a row has none of them.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import cols, rank
from ..functions.cols import half_up
from .records import RUN

# Fixed values of the brand rules.
NAME_RATIO_MIN, BRAND_VOLUME_MIN, JOURNEY_FLOOR, MODIFIERS_MIN = 10, 1000, 3, 30
COMPETITORS, MATRIX_BRANDS = 8, 10
JOURNEY_LIMIT_MIN = 300
VERDICT_PRIORITY = ["even", "behind", "none", "ahead"]
CAT = ["run_id", "category"]


def with_setup(df: DataFrame, setup: DataFrame, *columns: str) -> DataFrame:
    return rank.attached(df, setup, RUN, *columns, how="left")


def is_own(brand: str = "brand") -> Column:
    return F.col(brand).eqNullSafe(F.col("own_brand"))


def holds_own_word(text: str) -> Column:
    """Whether the text holds one of the run's own words, whatever their case."""
    return F.coalesce(F.exists("own_words", lambda w: F.contains(F.lower(text), F.lower(w))), F.lit(False))


def brand_hits(queries: DataFrame, names: DataFrame, excludes: DataFrame) -> DataFrame:
    """Which brand a query holds: some word start of the space-free query begins with a name.

    Prefixes of exactly the lengths that names have become join keys, so no query meets a brand it
    does not hold. A one-character brand must be a word of its own. Excludes come first.
    """
    n = names.select("run_id", "brand", cols.ns("name").alias("text"), F.length("brand").alias("_len"), "name").where(F.col("text") != "")
    keyed = n.where((F.col("_len") > 1) | (F.col("name") == F.col("brand"))).select(
        "run_id", "brand", F.when(F.col("_len") == 1, "word").otherwise("start").alias("kind"), "text").distinct()
    lengths = keyed.groupBy("run_id").agg(F.array_sort(F.collect_set(F.length("text"))).alias("_lens"))
    words = rank.attached(queries.select("run_id", "query").distinct(), lengths, RUN).withColumn(
        "_w", F.filter(F.split(F.lower("query"), r"\s+"), lambda x: x != "")).where(F.size("_w") > 0)
    tails = F.transform(F.sequence(F.lit(1), F.size("_w")), lambda i: F.array_join(F.slice("_w", i, F.size("_w")), ""))
    starts = F.flatten(F.transform(tails, lambda t: F.transform(
        F.filter("_lens", lambda k: k <= F.length(t)), lambda k: F.struct(F.lit("start").alias("kind"), F.substr(t, F.lit(1), k).alias("text")))))
    tokens = F.transform("_w", lambda x: F.struct(F.lit("word").alias("kind"), x.alias("text")))
    probes = words.select("run_id", "query", F.explode(F.array_distinct(F.concat(starts, tokens))).alias("p")).select("run_id", "query", "p.*")
    hits = probes.join(keyed, ["run_id", "kind", "text"]).select("run_id", "query", "brand").distinct()
    barred = excludes.groupBy("run_id", "brand").agg(F.collect_set(cols.ns("text")).alias("_x"))
    hits = hits.join(barred, ["run_id", "brand"], "left")
    return hits.where(~F.coalesce(F.exists("_x", lambda z: F.contains(cols.ns("query"), z)), F.lit(False))).drop("_x")


def category_modifiers(lists: DataFrame, setup: DataFrame) -> DataFrame:
    """Text before the category in queries that end with it (lists: run_id, category, rank, query)."""
    q, c = F.col("query"), F.col("category")
    flat_q, flat_c = F.replace(q, F.lit(" "), F.lit("")), F.replace(c, F.lit(" "), F.lit(""))
    cut = F.when(F.endswith(q, c), F.length(q) - F.length(c)).otherwise(F.length(flat_q) - F.length(flat_c))
    rows = lists.where(F.endswith(flat_q, flat_c)).withColumn("modifier", F.trim(F.substr(q, F.lit(1), cut)))
    rows = rows.where((F.col("modifier") != "") & (F.replace("modifier", F.lit(" "), F.lit("")) != flat_c))
    rows = with_setup(rows.select(*CAT, "rank", "query", "modifier"), setup, "own_words")
    return rows.withColumn("own", holds_own_word("modifier")).drop("own_words")


def unique_modifiers(modifiers: DataFrame) -> DataFrame:
    return rank.first_wins(modifiers.select(*CAT, "modifier", "rank", "own"), [*CAT, "modifier"], [F.col("rank")])


def journey_candidates(journeys: DataFrame, setup: DataFrame, known: DataFrame, n: int = 22) -> DataFrame:
    """Nodes two to four of journeys that start at the category: where rivals outside the list show up."""
    flat = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    rows = journeys.where(F.get("seq", F.lit(0)) == F.col("category")).select(*CAT, F.explode(F.slice("seq", 2, 3)).alias("node"))
    rows = rows.where(~F.contains(flat(F.col("node")), flat(F.col("category"))))
    counts = with_setup(rows, setup, "own_words").where(~holds_own_word("node")).groupBy(*CAT, "node").agg(F.count(F.lit(1)).alias("n"))
    top = rank.top_n(counts, CAT, [-F.col("n"), F.col("node")], n, "pos")
    listed = known.groupBy(*CAT).agg(F.collect_set("brand").alias("_known"))
    return top.join(listed, CAT, "left").withColumn(
        "known", F.coalesce(F.exists("_known", lambda b: F.contains("node", b)), F.lit(False))).drop("_known")


def brand_query_list(categories: DataFrame, lists: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries to measure: each category term, then its branded queries; a query is asked once."""
    branded = lists.join(hits.select("run_id", "query").distinct(), ["run_id", "query"], "left_semi")
    rows = categories.select("run_id", "cord", F.col("category").alias("query"), F.lit(0).cast("long").alias("rank")).unionByName(
        branded.join(categories.select(*CAT, "cord"), CAT).select("run_id", "cord", "query", "rank"))
    return rank.first_wins(rows, ["run_id", "query"], [F.col("cord"), F.col("rank")])


def volume_lookup(asked: DataFrame, volumes: DataFrame) -> DataFrame:
    """Volume of a query: exact, else the largest spelling equal without spaces. NULL is not listed, 0 is zero."""
    exact = volumes.select("run_id", F.col("keyword").alias("query"), F.col("volume").alias("_exact"))
    loose = volumes.groupBy("run_id", cols.ns("keyword").alias("_key")).agg(F.max("volume").alias("_loose"))
    rows = asked.join(exact, ["run_id", "query"], "left").withColumn("_key", cols.ns("query")).join(loose, ["run_id", "_key"], "left")
    return rows.withColumn("volume", F.coalesce("_exact", "_loose")).drop("_exact", "_loose", "_key")


def share_of_search(lists: DataFrame, hits: DataFrame, volumes: DataFrame) -> DataFrame:
    """Branded volume per category and brand with its share; brands without volume are left out."""
    measured = volume_lookup(lists.select(*CAT, "query"), volumes).withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    rows = measured.join(hits, ["run_id", "query"])
    per = rows.groupBy(*CAT, "brand").agg(
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("queries"),
        F.max_by("query", F.struct("volume", "query")).alias("top_query")).where(F.col("volume") > 0)
    whole = per.groupBy(*CAT).agg(F.sum("volume").alias("_den"))
    return per.join(whole, CAT).withColumn("share", half_up(F.col("volume") / F.col("_den") * 100, 1)).drop("_den")


def name_ratio(categories: DataFrame, lists: DataFrame, hits: DataFrame, shares: DataFrame, volumes: DataFrame) -> DataFrame:
    """Distinct branded volume against it plus the volume of the category term."""
    kept = lists.select(*CAT, "query").join(hits, ["run_id", "query"]).join(shares.select(*CAT, "brand"), [*CAT, "brand"], "left_semi")
    one = volume_lookup(kept.select(*CAT, "query").distinct(), volumes)
    branded = one.groupBy(*CAT).agg(F.sum(F.coalesce("volume", F.lit(0.0))).alias("branded"), F.count(F.lit(1)).alias("branded_queries"))
    term = volume_lookup(categories.select(*CAT, F.col("category").alias("query")), volumes).select(*CAT, F.coalesce("volume", F.lit(0.0)).alias("term_volume"))
    out = term.join(branded, CAT, "left").withColumn("branded", F.coalesce("branded", F.lit(0.0)))
    both = F.col("branded") + F.col("term_volume")
    return out.select(*CAT, "term_volume", "branded", F.coalesce("branded_queries", F.lit(0)).alias("branded_queries"),
                      F.coalesce(half_up(F.try_divide("branded", cols.nz(both)) * 100, 1), F.lit(0.0)).alias("name_ratio"))


def competitors(shares: DataFrame, setup: DataFrame) -> DataFrame:
    others = with_setup(shares, setup, "own_brand").where(~is_own()).drop("own_brand")
    return rank.top_n(others, CAT, [-F.col("volume"), F.col("brand")], COMPETITORS, "pos")


def naming_verdict(ratios: DataFrame, shares: DataFrame, setup: DataFrame) -> DataFrame:
    """Who owns a category by name; none where branded demand is too thin."""
    mine = with_setup(shares, setup, "own_brand").where(is_own()).select(*CAT, F.col("volume").alias("own_volume"), F.col("share").alias("own_share"),
                                                      F.col("queries").alias("own_queries"))
    lead = competitors(shares, setup).where(F.col("pos") == 1).select(*CAT, F.col("brand").alias("top_brand"), F.col("share").alias("top_share"))
    rows = ratios.join(mine, CAT, "left").join(lead, CAT, "left")
    axis = cols.two_x(F.coalesce("own_share", F.lit(0.0)), F.coalesce("top_share", F.lit(0.0)), 0)
    thin = (F.col("branded") < BRAND_VOLUME_MIN) | (F.col("name_ratio") < NAME_RATIO_MIN)
    return rows.withColumn("verdict", F.when(thin, "none").otherwise(axis))


def journey_brand_index(journeys: DataFrame, hits: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """Distinct queries of a brand on the journeys of a seed, and its nearest step after the seed."""
    flat = lambda x: cols.ns(x)
    at = F.array_position(F.transform("seq", lambda x: flat(x) == flat(F.col(seed))), True)
    rows = journeys.select(*keys, F.when(at > 0, at - 1).otherwise(0).alias("_at"), F.posexplode("seq").alias("i", "query"))
    step = F.col("i") - F.col("_at")
    return rows.withColumn("step", F.when(step != 0, step.cast("int"))).join(hits, ["run_id", "query"]).groupBy(*keys, "brand").agg(
        F.count_distinct("query").alias("n"), F.min("step").alias("step"))


def journey_axis(index: DataFrame, keys: list[str], setup: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """The two-to-one rule on journeys; the rival with most queries leads, a nearer step breaks ties."""
    step = F.when(F.col("step") > 0, F.col("step")).otherwise(99)
    marked = with_setup(index, setup, "own_brand")
    lead = rank.first_wins(marked.where(~is_own()), keys, [-F.col("n"), step, F.col("brand")]).select(
        *keys, F.col("brand").alias("top"), F.col("n").alias("top_n"), F.col("step").alias("top_step"))
    mine = marked.where(is_own()).select(*keys, F.col("n").alias("own_n"), F.col("step").alias("own_step"))
    total = index.groupBy(*keys).agg(F.sum("n").alias("branded"))
    base = total if every is None else every.select(*keys).distinct().join(total, keys, "left")
    rows = base.join(mine, keys, "left").join(lead, keys, "left")
    for c in ("own_n", "top_n", "branded"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)))
    return rows.withColumn("axis", cols.two_x("own_n", "top_n", JOURNEY_FLOOR))


def facet_metrics(facets: DataFrame, volumes: DataFrame, setup: DataFrame) -> DataFrame:
    """Volume of "facet category" and of the own brand with it; rate only where both are known."""
    all_q = volume_lookup(facets.withColumn("query", F.concat_ws(" ", "facet", "category")), volumes).withColumnRenamed("query", "facet_query")
    named = with_setup(all_q.withColumnRenamed("volume", "facet_volume"), setup, "own_brand")
    asked = F.when(F.col("own_brand").isNotNull(), F.concat_ws(" ", "own_brand", "facet", "category"))
    both = volume_lookup(named.withColumn("query", asked), volumes).drop("query", "own_brand").withColumnRenamed("volume", "own_volume")
    return both.withColumn("rate", half_up(F.try_divide("own_volume", cols.nz("facet_volume")) * 100, 1))


def category_evidence(categories: DataFrame, brand_journeys: DataFrame, brand_queries: DataFrame, lists: DataFrame,
                      modifiers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """How much of the run speaks about a category. Terms of a run are few; texts are tested against their array."""
    terms = categories.groupBy("run_id").agg(F.collect_set("category").alias("_terms"))

    def mentions(df, text, out):
        found = rank.attached(df, terms, RUN).select("run_id", F.explode(F.filter("_terms", lambda t: F.contains(text, t))).alias("category"))
        return found.groupBy(*CAT).agg(F.count(F.lit(1)).alias(out))

    path = mentions(brand_journeys, F.array_join("seq", " > "), "path_mentions")
    named = mentions(brand_queries, F.col("query"), "query_mentions")
    size = lists.groupBy(*CAT).agg(F.count(F.lit(1)).alias("listed"))
    mods = modifiers.groupBy(*CAT).agg(F.count(F.lit(1)).alias("modifiers"))
    out = categories.select(*CAT).join(verdicts.select(*CAT, "own_queries"), CAT, "left")
    for part in (path, named, size, mods):
        out = out.join(part, CAT, "left")
    numbers = ["own_queries", "path_mentions", "query_mentions", "listed", "modifiers"]
    return out.select(*CAT, *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.col("listed").isNotNull().alias("queried"))


def deep_candidates(judged: DataFrame) -> DataFrame:
    """Categories with enough modifiers, weak and open ones first; thin ones point to a broader term."""
    place = F.array_position(F.array(*[F.lit(v) for v in VERDICT_PRIORITY]), F.col("verdict"))
    ok = F.col("modifiers") >= MODIFIERS_MIN
    flat = F.lower(F.replace("category", F.lit(" "), F.lit("")))
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.length(flat)), lambda i: F.transform(
        F.sequence(F.lit(1), F.length(flat) - i + 1), lambda k: F.substr(flat, i, k))))
    inside = judged.select(*CAT, flat.alias("_flat"), F.explode(F.array_distinct(pieces)).alias("_piece"))
    terms = judged.select("run_id", flat.alias("_piece"), F.col("category").alias("broader"), "modifiers", "cord")
    wider = inside.join(terms, ["run_id", "_piece"]).where(F.col("category") != F.col("broader"))
    best = rank.first_wins(wider.select(*CAT, "broader", "modifiers", "cord"), CAT, [-F.col("modifiers"), F.col("cord")]).select(
        *CAT, "broader", F.col("modifiers").alias("broader_modifiers"))
    return judged.join(best, CAT, "left").select(
        *CAT, "verdict", "modifiers", "term_volume", ok.alias("possible"), F.when(ok, (place - 1).cast("int")).alias("priority"),
        F.when(~ok & (F.col("broader_modifiers") >= MODIFIERS_MIN), F.col("broader")).alias("broader"))


def status(verdict="verdict", axis="axis") -> Column:
    """Naming verdict as a status; an unclaimed category the own brand leads on journeys is emerging."""
    v, a = cols.col(verdict), cols.col(axis)
    return (F.when(v == "ahead", "owned").when(v == "even", "contested").when(v == "behind", "trailing")
            .when(a == "ahead", "emerging").otherwise("unclaimed"))


def axis_status(axis) -> Column:
    a = cols.col(axis)
    return F.when(a == "ahead", "owned").when(a == "even", "contested").when(a == "behind", "trailing")


def brand_matrix(shares: DataFrame) -> DataFrame:
    """Competition rank of every brand inside a category. A category holds at most the run's brands."""
    return shares.withColumn("rank", F.rank().over(W.partitionBy(*CAT).orderBy(-F.col("volume"))))


def matrix_columns(shares: DataFrame, setup: DataFrame, n: int = MATRIX_BRANDS) -> DataFrame:
    """Columns of the main table over all brands of a run: the own one at 0, then those in most categories, larger volume first.

    The first `n` after the own brand are shown at once, the others on demand; the own brand is there without volume too.
    """
    sums = shares.groupBy("run_id", "brand").agg(F.count(F.lit(1)).alias("categories"), F.sum("volume").alias("volume"))
    sums = with_setup(sums.where(F.col("volume") > 0), setup, "own_brand")
    others = rank.positions(sums.where(~is_own()).drop("own_brand"), RUN, [-F.col("categories"), -F.col("volume"), F.col("brand")], "pos")
    found = sums.where(is_own()).select("run_id", "categories", "volume")
    mine = setup.where(F.col("own_brand").isNotNull()).select("run_id", F.col("own_brand").alias("brand")).join(found, "run_id", "left").select(
        "run_id", "brand", F.coalesce("categories", F.lit(0)).alias("categories"), F.coalesce("volume", F.lit(0.0)).alias("volume"), F.lit(0).cast("long").alias("pos"))
    return mine.unionByName(others.select(*mine.columns)).withColumn("shown", F.col("pos") <= n)


def same_setup(rows: DataFrame, own_brand: str | None, watch: list[str]) -> DataFrame:
    """One own brand and one watch list as the set-up of every run."""
    return rows.select("run_id").distinct().select("run_id", F.lit(own_brand).cast("string").alias("own_brand"), F.array(*[F.lit(b) for b in watch]).cast("array<string>").alias("watch"))


def brand_columns(shares: DataFrame, setup: DataFrame | str | None, *more) -> DataFrame:
    """Brands of the competition table: all watched ones first, then those in at least two categories by volume; own brand apart.

    The set-up is a table, or the own brand and the watched ones of all runs; n may follow.
    The cut after n + 1 brands leaves out others only, never a watched one.
    """
    if not isinstance(setup, DataFrame):
        setup, more = same_setup(shares, setup, more[0]), more[1:]
    n = more[0] if more else MATRIX_BRANDS
    rivals = competitors(shares, setup).groupBy("run_id", "brand").agg(F.count(F.lit(1)).alias("categories"), F.sum("volume").alias("volume"))
    watched = F.coalesce(F.array_contains("watch", F.col("brand")), F.lit(False))
    rows = with_setup(rivals, setup, "watch").withColumn("watch", watched).where(F.col("watch") | (F.col("categories") >= 2))
    most = setup.agg(F.max(F.size("watch"))).first()[0] or 0  # the longest list of watched brands
    order = [F.when(F.col("watch"), 0).otherwise(1), -F.col("volume"), F.col("brand")]
    return rank.top_n(rows, RUN, order, n + 1 + most, "pos").where(F.col("watch") | (F.col("pos") <= n + 1))


def outside_top(matrix: DataFrame, columns: DataFrame, setup: DataFrame) -> DataFrame:
    """First and second brands of a category that the shown columns leave out."""
    first = with_setup(matrix.where(F.col("rank") <= 2), setup, "own_brand").where(~is_own())
    return first.join(columns.select("run_id", "brand"), ["run_id", "brand"], "left_anti").select(
        *CAT, "brand", "rank", "volume")


def position_ratio(judged: DataFrame) -> DataFrame:
    """Own share against the leader's; journeys stand in where the share was not measured."""
    share = F.when(F.col("top_share") > 0, F.try_divide(F.coalesce("own_share", F.lit(0.0)), F.col("top_share"))).otherwise(8.0)
    walk = F.when(F.col("axis").isNotNull(), (F.col("own_n") + 1) / (F.col("top_n") + 1)).otherwise(1.0)
    return judged.select(*CAT, "status", F.when(F.col("own_share").isNotNull(), share).otherwise(walk).alias("ratio"))


def demand_by_status(judged: DataFrame) -> DataFrame:
    return judged.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("categories"), F.sum("term_volume").alias("volume"))


def facet_summary(facets: DataFrame) -> DataFrame:
    """Facets of deep categories (with their journey axis): share of the category, bucket, and whether any brand is there."""
    whole = facets.groupBy(*CAT).agg(F.sum("facet_volume").alias("_all"))
    present = (F.coalesce("own_n", F.lit(0)) > 0) | (F.coalesce("top_n", F.lit(0)) > 0)
    named = F.coalesce(F.col("own_volume") > 0, F.lit(False))
    rows = facets.join(whole, CAT).withColumn("share", F.try_divide("facet_volume", cols.nz("_all"))).drop("_all")
    return rows.withColumn("bucket", F.when(named, "named").when(present, "walked").otherwise("absent")).withColumn("open", ~named & ~present)


def facet_highlights(summary: DataFrame) -> DataFrame:
    """Per category: volume by bucket and the largest facet the own brand trails in."""
    sums = [F.sum(F.when(F.col("bucket") == b, F.coalesce("facet_volume", F.lit(0.0))).otherwise(0.0)).alias(f"{b}_volume") for b in ("named", "walked", "absent")]
    lost = F.when(F.col("axis") == "behind", F.col("facet"))
    won = F.when(F.col("axis") == "ahead", 1).otherwise(0)
    worst = F.min_by(lost, F.when(lost.isNotNull(), F.struct(-F.coalesce("facet_volume", F.lit(0.0)), F.col("facet"))))
    return summary.groupBy(*CAT).agg(*sums, F.sum(won).alias("ahead"), worst.alias("worst_facet"), F.sum(F.col("open").cast("int")).alias("open_facets"))


def keep_and_take(judged: DataFrame, n: int = 5) -> DataFrame:
    """Positions to keep, and the largest trailing categories at or above the upper median of demand."""
    middle = rank.exact_medians(judged, RUN, {"_mid": "term_volume"}, upper=True)
    keep = judged.where(F.col("status").isin("owned", "emerging")).select(*CAT, "status", "term_volume", F.lit("keep").alias("list"))
    trail = judged.where(F.col("status") == "trailing").join(middle, RUN).where(F.col("term_volume") >= F.col("_mid"))
    take = rank.top_n(trail, RUN, [-F.col("term_volume"), F.col("cord")], n).select(*CAT, "status", "term_volume", F.lit("take").alias("list"))
    return keep.unionByName(take)


def facet_mismatch(judged: DataFrame, facets: DataFrame) -> DataFrame:
    """Deep categories whose facets disagree among themselves or with the category."""
    rows = facets.withColumn("s", axis_status("axis")).where(F.col("s").isNotNull())
    counts = [F.sum((F.col("s") == s).cast("int")).alias(s) for s in ("owned", "contested", "trailing")]
    per = rows.groupBy(*CAT).agg(*counts, F.count_distinct("s").alias("_k"), F.min("s").alias("_one"))
    return per.join(judged.select(*CAT, "status"), CAT).where((F.col("_k") > 1) | (F.col("_one") != F.col("status"))).drop("_k", "_one")


def recurring_rivals(judged: DataFrame, rivals: DataFrame, n: int = 6) -> DataFrame:
    """Brands that lead at least two categories, with their appearances and the demand around them."""
    rows = rivals.join(judged.select(*CAT, "term_volume"), CAT).groupBy("run_id", "brand").agg(
        F.sum((F.col("pos") == 1).cast("int")).alias("leads"), F.count(F.lit(1)).alias("appearances"), F.sum("term_volume").alias("demand"))
    return rank.top_n(rows.where(F.col("leads") >= 2), RUN, [-F.col("leads"), -F.col("demand"), F.col("brand")], n, "pos")


def group_status_mix(judged: DataFrame) -> DataFrame:
    """Statuses per category group; shown where two groups have at least three categories."""
    counts = [F.sum((F.col("status") == s).cast("int")).alias(s) for s in ("owned", "emerging", "contested", "trailing", "unclaimed")]
    mix = judged.groupBy("run_id", "group").agg(*counts, F.sum("term_volume").alias("demand"), F.count(F.lit(1)).alias("_n"))
    big = mix.groupBy("run_id").agg(F.sum((F.col("_n") >= 3).cast("int")).alias("_big")).where(F.col("_big") >= 2)
    return mix.join(big, RUN, "left_semi").drop("_n")


def naming_journey_conflict(judged: DataFrame, n: int = 8) -> DataFrame:
    other = axis_status("axis")
    rows = judged.withColumn("journey_status", other).where(
        F.col("status").isin("owned", "contested", "trailing") & other.isNotNull() & (other != F.col("status")))
    return rank.top_n(rows, RUN, [-F.col("term_volume"), F.col("cord")], n, "pos").select(*CAT, "pos", "status", "journey_status", "term_volume")


def watch_span(rivals: DataFrame, setup: DataFrame) -> DataFrame:
    """How many categories a watched brand is in, and its biggest spot."""
    rows = with_setup(rivals, setup, "watch").where(F.array_contains("watch", F.col("brand")) & (F.col("volume") > 0))
    return rows.groupBy("run_id", "brand").agg(
        F.count(F.lit(1)).alias("categories"), F.min_by(F.struct("category", "volume", "share"), F.struct(-F.col("volume"), "category")).alias("_b")
    ).select("run_id", "brand", "categories", F.col("_b.category").alias("biggest"), F.col("_b.volume").alias("volume"), F.col("_b.share").alias("share"))


def presence_priority(judged: DataFrame) -> DataFrame:
    """Six reading rows by what the own brand sells and where it stands; in each the largest category first."""
    p, s = F.col("presence"), F.col("status")
    row = (F.when((p == "selling") & (s == "trailing"), 1).when((p == "selling") & (s == "contested"), 2)
           .when((p == "selling") & s.isin("owned", "emerging"), 3).when((p == "selling") & (s == "unclaimed"), 4)
           .when(p == "partly", 5).when(p.isin("not_sold", "unverified"), 6))
    return judged.withColumn("priority", row).where(F.col("priority").isNotNull()).select("run_id", "priority", "category", "term_volume", "status")


def unmeasured_list(judged: DataFrame, facets: DataFrame) -> DataFrame:
    """What a run did not measure, with the reason."""
    deep = facets.groupBy(*CAT).agg(F.max(F.col("axis").isNotNull().cast("int")).alias("_walked"))
    rows = judged.join(deep, CAT, "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("own_share").isNull(), "own_share"), F.when(F.col("deep") & (F.coalesce("_walked", F.lit(0)) == 0), "facet_journeys"),
        F.when((F.col("modifiers") < MODIFIERS_MIN) & ~F.col("deep"), "thin"),
        F.when((F.col("own_queries") == 0) & (F.col("path_mentions") == 0), "no_evidence")))
    return rows.select(*CAT, F.explode(reasons).alias("reason"))


def brand_detail_rows(categories: DataFrame, listed: DataFrame, shares: DataFrame, lists: DataFrame, index: DataFrame, setup: DataFrame) -> DataFrame:
    """Own brand, competitors, then listed brands without data: share, queries, rank of the top query, journeys."""
    comp = competitors(shares, setup).select(*CAT, "brand", (F.col("pos") + 0).alias("o"))
    mine = with_setup(categories.select(*CAT), setup, "own_brand").where(F.col("own_brand").isNotNull()).select(*CAT, F.col("own_brand").alias("brand"), F.lit(0).alias("o"))
    extra = listed.select(*CAT, "brand", F.lit(100).alias("o"))
    rows = rank.first_wins(mine.unionByName(comp).unionByName(extra), [*CAT, "brand"], [F.col("o")])
    facts = shares.select(*CAT, "brand", "volume", "share", "queries", "top_query")
    place = lists.groupBy(*CAT, F.col("query").alias("top_query")).agg(F.min("rank").alias("top_rank"))
    walked = index.select(*CAT, "brand", F.col("n").alias("journey_queries"))
    out = rows.join(facts, [*CAT, "brand"], "left").join(place, [*CAT, "top_query"], "left").join(walked, [*CAT, "brand"], "left")
    shown = F.when(F.col("o") < 100, F.col("volume"))
    whole = out.groupBy(*CAT).agg(F.sum(shown).alias("_sum"))
    return out.join(whole, CAT).select(
        *CAT, "brand", shown.alias("volume"), F.when(F.col("o") < 100, F.col("share")).alias("share"), F.coalesce("queries", F.lit(0)).alias("queries"),
        "top_rank", F.coalesce("journey_queries", F.lit(0)).alias("journey_queries"),
        F.coalesce(half_up(F.try_divide(shown, cols.nz("_sum")) * 100, 1), F.lit(0.0)).alias("table_share"))


def run_coverage_audit(categories: DataFrame, lists: DataFrame, journeys: DataFrame, judged: DataFrame, wanted: DataFrame, volumes: DataFrame,
                       facets: DataFrame, facet_journeys: DataFrame, limits: DataFrame, watched: DataFrame) -> DataFrame:
    """Findings of a run: missing inputs, journeys where none belong, mixed or low limits, thin volume coverage."""
    def finding(df, name, detail):
        return df.select("run_id", F.lit(name).alias("finding"), detail.alias("detail"))

    have = journeys.select(*CAT).distinct()
    blank = judged.where(F.col("verdict") == "none").select(*CAT)
    missing = categories.select(*CAT).join(lists.select(*CAT).distinct(), CAT, "left_anti")
    no_path = blank.join(have, CAT, "left_anti")
    extra = have.join(blank, CAT, "left_anti")
    mixed = limits.groupBy("run_id", "source").agg(F.count_distinct("limit").alias("_k")).where(F.col("_k") > 1)
    known = volumes.select("run_id", F.col("keyword").alias("query"), F.lit(1).alias("_v")).distinct()
    cover = wanted.join(known, ["run_id", "query"], "left").groupBy("run_id").agg(
        (F.sum(F.coalesce("_v", F.lit(0))) / F.count(F.lit(1)) * 100).alias("_c")).where(F.col("_c") < 95)
    shallow = facets.select(*CAT, "facet").join(facet_journeys.select(*CAT, "facet").distinct(), [*CAT, "facet"], "left_anti")
    c = F.col("category")
    out = finding(missing, "related list missing", c).unionByName(finding(no_path, "journeys missing", c))
    out = out.unionByName(finding(extra, "journeys not needed", c)).unionByName(finding(mixed, "limits differ", F.col("source")))
    low = limits.where((F.col("source") == "journeys") & (F.col("limit") < JOURNEY_LIMIT_MIN)).select("run_id", "source").distinct()
    unlisted = watched.select(*CAT).join(categories.select(*CAT), CAT, "left_anti")
    out = out.unionByName(finding(low, "limit too low", F.col("source"))).unionByName(finding(unlisted, "watched category missing", c))
    out = out.unionByName(finding(cover, "volume coverage", F.floor("_c").cast("string")))
    return out.unionByName(finding(shallow, "facet journeys missing", F.concat_ws(" ", "facet", "category")))
