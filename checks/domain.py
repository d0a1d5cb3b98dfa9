"""Driver tables as search-demand tables, once as DataFrames and once as SQL pieces.

run_id is the customer's market segment (one run per seed and market), a keyword is
"brand adjective noun", searches are ten per unit sold.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from querytide.functions import rank
from querytide.functions.stage import staged
from querytide.operators import records

from .sqlkit import piece

# Fixed values of the fixture.
NOUNS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
ADJECTIVES = ["blue", "cold", "hot", "large", "new", "old", "red", "small"]
ALTERNATIVE_NOUNS = ["anvil", "widget"]
QUERY_FLOOR = 20.0
LINES_A_TASK = 250_000


def _text(*parts: str):
    return F.lower(F.concat_ws(" ", *parts))


def _index(words: list[str], c):
    out = F.lit(None).cast("int")
    for k, w in enumerate(words):
        out = F.when(c == w, F.lit(k)).otherwise(out)
    return out


def sql_index(words: list[str], c: str) -> str:
    return f"(list_position({words!r}, {c}) - 1)"


class _Domain:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._staged: dict[str, DataFrame] = {}

    def stage(self, name: str, build) -> DataFrame:
        """A table several operators of one query read: written once, then scanned."""
        if name not in self._staged:
            self._staged[name] = staged(build())
        return self._staged[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        """Every line with its run, keyword and `lead`, the other keyword that leads its order (null on the lead's own lines).

        The joins are the dear part of nearly every query, so they are made once, without the texts they can do without, and staged.
        custkey, odate and l_orderkey stand on one line of an order only, the one with `leads`.
        """
        texts = self.stage("lines", self._joined)
        return texts.withColumn("keyword", _text("p_brand", "p_name")).withColumn("related", _text("p_brand", "p_name", "p_type"))

    def _joined(self) -> DataFrame:
        """Lines in tasks of LINES_A_TASK, whole orders in each: the join with the orders and the leads need no further shuffle."""
        line = self.table("lineitem").where("l_orderkey is not null and l_partkey is not null").select(
            "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_linestatus", "l_shipdate")
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name", "p_type")
        customer = self.table("customer").select(F.col("c_custkey").alias("custkey"), F.lower("c_mktsegment").alias("run_id"))
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("custkey"),
            F.col("o_orderdate").alias("odate"), F.col("o_orderpriority").alias("priority"),
        ).join(customer, "custkey")
        tasks = -(-self.table("lineitem").count() // LINES_A_TASK) or 1
        rows = line.join(part, "l_partkey").repartition(tasks, "l_orderkey").join(orders, "l_orderkey").withColumn("_keyword", _text("p_brand", "p_name"))
        # equal prices and parts have equal keywords
        dearest = W.partitionBy("run_id", "custkey", "l_orderkey").orderBy(-F.col("l_extendedprice"), "l_partkey", "_keyword")
        rows = rows.withColumn("leads", F.row_number().over(dearest) == 1).withColumn("_lead", F.first("_keyword").over(dearest))
        return rows.select(
            "run_id", "p_brand", "p_name", "p_type", "l_partkey", "priority", F.substring(F.col("l_shipdate").cast("string"), 1, 7).alias("month"),
            "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "leads", F.nullif("_lead", F.col("_keyword")).alias("lead"),
            *[F.when(F.col("leads"), F.col(c)).alias(c) for c in ("custkey", "odate", "l_orderkey")])

    def monthly_of(self, text: str) -> DataFrame:
        units = F.col("l_quantity") * 10
        return self.lines.groupBy("run_id", F.col(text).alias("keyword"), "month").agg(
            F.sum(F.when(F.col("l_linestatus") == "O", units).otherwise(0.0)).alias("nv"),
            F.sum(F.when(F.col("l_linestatus") == "F", units).otherwise(0.0)).alias("gg"),
        ).withColumn("total", F.col("nv") + F.col("gg"))

    def each_run(self, rows: list[tuple], schema: str) -> DataFrame:
        """A short literal table repeated for every run, without a join."""
        fields = [c.strip().split(" ")[0].strip("`") for c in schema.split(",")]
        items = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, r)]) for r in rows])
        runs = self.metrics.select("run_id").distinct()
        return runs.select("run_id", F.inline(items.cast("array<struct<" + ",".join(":".join(c.strip().split(" ", 1)) for c in schema.split(",")) + ">>")))

    @cached_property
    def monthly(self) -> DataFrame:
        return self.stage("monthly", lambda: self.monthly_of("keyword"))

    def metrics_of(self, text: str) -> DataFrame:
        at = F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")
        lines = self.lines.withColumn("at", at)
        month = F.substring(F.col("l_shipdate").cast("string"), 1, 7)
        last = self.table("lineitem").agg(F.max(month).alias("month")).select(at.alias("last"))
        units = F.col("l_quantity") * 10
        age = F.col("last") - F.col("at")

        def between(lo, hi):
            return F.sum(F.when((age >= lo) & (age < hi), units).otherwise(0.0))

        def share(p):
            return F.floor(100 * F.sum(F.when(F.col("priority") == p, 1).otherwise(0)) / F.count("*")).cast("double")

        one = F.lit(1).alias("one")
        raw = lines.withColumn("one", F.lit(1)).join(F.broadcast(last.select("last", one)), "one").groupBy("run_id", F.col(text).alias("keyword")).agg(
            F.min("l_partkey").alias("ord"), between(0, 12).alias("volume_total"),
            between(0, 3).alias("_q1"), between(3, 6).alias("_q2"),
            F.floor(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum("l_quantity"))
            .cast("double").alias("cpc"),
            F.floor(1000 * F.sum(F.col("l_discount").cast("decimal(18,2)")).cast("double") / F.count("*") + 0.5)
            .cast("double").alias("competition_index"),
            share("3-MEDIUM").alias("i"), share("4-NOT SPECIFIED").alias("n"),
            share("2-HIGH").alias("c"), share("1-URGENT").alias("t"),
        )
        return raw.select(
            "run_id", "keyword", "ord",
            F.floor(F.col("volume_total") / 12 + 0.5).cast("double").alias("volume_avg"), "volume_total",
            F.when(F.col("_q2") > 0, F.floor(100 * (F.col("_q1") / F.nullif("_q2", F.lit(0.0)) - 1) + 0.5))
            .otherwise(0).cast("double").alias("volume_trend"),
            "cpc",
            F.when(F.col("competition_index") < 45, "LOW").when(F.col("competition_index") < 55, "MEDIUM")
            .otherwise("HIGH").alias("competition"),
            "competition_index", "i", "n", "c", "t",
        )

    @cached_property
    def metrics(self) -> DataFrame:
        return self.stage("metrics", lambda: self.metrics_of("keyword"))

    @cached_property
    def query(self) -> DataFrame:
        """Records of the query source: the keywords with some volume."""
        return self.metrics.where(F.col("volume_avg") >= QUERY_FLOOR)

    @cached_property
    def communities(self) -> DataFrame:
        noun = F.split("keyword", " ")[2]
        return self.metrics.select("run_id", _index(NOUNS, noun).cast("string").alias("cluster_id"), "ord", "keyword")

    @cached_property
    def leads(self) -> DataFrame:
        """The dearest line of every order."""
        return self.lines.where("leads").select("run_id", "custkey", "odate", "l_orderkey", "keyword", "l_extendedprice", "l_partkey")

    @cached_property
    def edges(self) -> DataFrame:
        """Distinct unordered pairs of an order's lead keyword with its other keywords: linear in the lines."""
        return self.stage("edges", lambda: (
            self.lines.where("lead is not null")
            .select("run_id", F.least("lead", "keyword").alias("a"), F.greatest("lead", "keyword").alias("b"))
            .distinct()
        ))

    @cached_property
    def raw_journeys(self) -> DataFrame:
        """One journey per customer: the leads of their orders in time."""
        step = F.struct("odate", "l_orderkey", "keyword")
        return self.leads.groupBy("run_id", F.col("custkey").alias("path_id")).agg(
            F.transform(F.array_sort(F.collect_list(step)), lambda s: s["keyword"]).alias("seq"))

    @cached_property
    def journeys(self) -> DataFrame:
        return self.stage("journeys", lambda: records.read_paths(self.raw_journeys))

    @cached_property
    def groups(self) -> DataFrame:
        rows = [(k, w, "alternative" if w in ALTERNATIVE_NOUNS else "core") for k, w in enumerate(NOUNS)]
        return self.spark.createDataFrame(rows, "gord int, group_id string, relation string")

    @cached_property
    def members(self) -> DataFrame:
        return self.metrics.select("run_id", F.split("keyword", " ")[2].alias("group_id"), "ord", "keyword")

    @cached_property
    def seed_lists(self) -> DataFrame:
        """Eight seeds per run; a keyword sits in the list of its noun and in that of its adjective."""
        w = F.split("keyword", " ")
        at = F.array_distinct(F.array(_index(NOUNS, w[2]), _index(ADJECTIVES, w[1])))
        return self.metrics.select("run_id", F.explode(at).alias("seed_ord"), F.col("ord").alias("rank"), "keyword")

    @cached_property
    def related(self) -> DataFrame:
        """Related queries with their rank position: volume order, then text."""
        m = self.metrics_of("related")
        return self.stage("related", lambda: rank.positions(m, ["run_id"], [-F.col("volume_total"), F.col("keyword")], "rank"))


_open: dict[tuple, _Domain] = {}


def Domain(spark: SparkSession, sf_dir: str) -> _Domain:
    """The domain of one folder in one application; its staged tables serve every query."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _open:
        _open[key] = _Domain(spark, sf_dir)
    return _open[key]


piece("q_lines", """
SELECT lower(c_mktsegment) AS run_id, lower(p_brand || ' ' || p_name) AS keyword,
  lower(p_brand || ' ' || p_name || ' ' || p_type) AS related, o_custkey AS custkey, o_orderdate AS odate,
  o_orderpriority AS priority, strftime(l_shipdate, '%Y-%m') AS month,
  year(l_shipdate)*12 + month(l_shipdate) AS mat, lineitem.*
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey""")


def _monthly(name, text):
    piece(name, f"""
SELECT run_id, {text} AS keyword, month, nv, gg, nv + gg AS total FROM (
  SELECT run_id, {text}, month, sum(CASE WHEN l_linestatus='O' THEN 10*l_quantity ELSE 0 END) AS nv,
    sum(CASE WHEN l_linestatus='F' THEN 10*l_quantity ELSE 0 END) AS gg FROM q_lines GROUP BY ALL)""")


def _metrics(name, text):
    def between(lo, hi):
        return f"sum(CASE WHEN lastm-mat>={lo} AND lastm-mat<{hi} THEN 10*l_quantity ELSE 0 END)"

    def share(p):
        return f"floor(100*(count(*) FILTER (priority='{p}'))/count(*))"

    piece(name, f"""
SELECT run_id, keyword, ord, floor(volume_total/12+0.5) AS volume_avg, volume_total,
  CASE WHEN v2>0 THEN floor(100*(v1/v2-1)+0.5) ELSE 0.0 END AS volume_trend, cpc,
  CASE WHEN competition_index<45 THEN 'LOW' WHEN competition_index<55 THEN 'MEDIUM' ELSE 'HIGH' END AS competition,
  competition_index, i, n, c, t
FROM (SELECT run_id, {text} AS keyword, min(l_partkey) AS ord, {between(0, 12)} AS volume_total,
  {between(0, 3)} AS v1, {between(3, 6)} AS v2,
  floor(sum(l_extendedprice::decimal(18,2))::double/sum(l_quantity)) AS cpc,
  floor(1000*sum(l_discount::decimal(18,2))::double/count(*)+0.5) AS competition_index,
  {share('3-MEDIUM')} AS i, {share('4-NOT SPECIFIED')} AS n, {share('2-HIGH')} AS c, {share('1-URGENT')} AS t
  FROM q_lines, (SELECT max(mat) AS lastm FROM q_lines) GROUP BY run_id, {text})""")


_monthly("q_monthly", "keyword")
_metrics("q_metrics", "keyword")
_metrics("q_related_metrics", "related")
piece("q_related", """
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY volume_total DESC, keyword) AS rank FROM q_related_metrics""")
piece("q_query", f"SELECT * FROM q_metrics WHERE volume_avg >= {QUERY_FLOOR}")
piece("q_communities", f"""
SELECT run_id, {sql_index(NOUNS, "split_part(keyword,' ',3)")}::varchar AS cluster_id, ord, keyword FROM q_metrics""")
piece("q_leads", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_shipdate, l_linenumber) AS rn FROM q_lines) WHERE rn = 1""")
piece("q_edges", """
SELECT DISTINCT x.run_id, least(x.keyword, y.keyword) AS a, greatest(x.keyword, y.keyword) AS b
FROM q_lines x JOIN q_leads y ON x.l_orderkey = y.l_orderkey WHERE x.keyword <> y.keyword""")
piece("q_steps_raw", "SELECT run_id, custkey AS path_id, odate, l_orderkey, keyword AS node FROM q_leads")
piece("q_steps", """
SELECT run_id, path_id, row_number() OVER (PARTITION BY run_id, path_id ORDER BY odate, l_orderkey) - 1 AS pos, node FROM (
  SELECT *, lag(node) OVER (PARTITION BY run_id, path_id ORDER BY odate, l_orderkey) AS prev FROM q_steps_raw)
WHERE prev IS NULL OR prev <> node""")
piece("q_journeys", """
SELECT run_id, path_id, list(node ORDER BY pos) AS seq FROM q_steps GROUP BY ALL""")
piece("q_members", "SELECT run_id, split_part(keyword,' ',3) AS group_id, ord, keyword FROM q_metrics")
piece("q_groups", "SELECT * FROM (VALUES " + ",".join(
    f"({k},'{w}','{'alternative' if w in ALTERNATIVE_NOUNS else 'core'}')" for k, w in enumerate(NOUNS)
) + ") g(gord, group_id, relation)")
piece("q_seed_lists", f"""
SELECT DISTINCT run_id, seed_ord, ord AS rank, keyword FROM (
  SELECT *, unnest([{sql_index(NOUNS, "split_part(keyword,' ',3)")}, {sql_index(ADJECTIVES, "split_part(keyword,' ',2)")}]) AS seed_ord
  FROM q_metrics)""")
