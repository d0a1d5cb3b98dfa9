"""Tables handed to readers outside Spark: narrow text columns, written as CSV or partitioned files."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import cols, rank
from ..operators import journeys
from ..operators.records import RUN, ordered_list

PATHS_SHOWN, NODES_SHOWN = 60, 400


def query_context(context: DataFrame) -> DataFrame:
    """keyword, volume_avg, i, n, c, t, trend of the context rows."""
    return context.select("run_id", "pos", "keyword", "volume_avg", *cols.INTENTS, F.col("volume_trend").alias("trend"))


def cluster_context(selected: DataFrame, labels: dict[str, str]) -> DataFrame:
    """n keyword, v volume, c cluster, h hub flag, o outgoing letters, i label of the dominant intent."""
    code = cols.dominant_intent()
    label = F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in labels.items()], F.lit(""))
    return selected.select(
        "run_id", F.col("keyword").alias("n"), cols.half_up("volume_avg", 0).cast("long").alias("v"), F.col("letter").alias("c"),
        F.when(F.col("is_hub"), "TRUE").otherwise("FALSE").alias("h"), F.array_join(F.array_sort("outgoing"), "|").alias("o"), label.alias("i"))


def journey_paths(ranked: DataFrame, n: int = PATHS_SHOWN) -> DataFrame:
    top = rank.top_n(ranked, RUN, journeys.journey_order(), n, "pos")
    return top.select("run_id", "pos", F.array_join("seq", " → ").alias("chain"), "total_volume")


def journey_hubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    down = journeys.downstream_list(edges, nodes).groupBy("run_id", F.col("src").alias("keyword")).agg(
        F.array_join(ordered_list([F.col("pos")], F.col("dst")), " | ").alias("downstream"))
    return journeys.branch_hubs(nodes).join(down, ["run_id", "keyword"], "left").select(
        "run_id", "pos", F.col("keyword").alias("name"), "volume_avg", "out_degree", "path_count", "downstream")


def journey_node_table(nodes: DataFrame, edges: DataFrame, n: int = NODES_SHOWN) -> DataFrame:
    """The n largest nodes with ids from 0; outgoing lists the ids of kept next nodes (n at most)."""
    top = rank.top_n(nodes, RUN, [-F.col("volume_avg"), F.col("seen")], n, "_p").withColumn("id", F.col("_p") - 1)
    ids = top.select("run_id", F.col("keyword").alias("dst"), F.col("id").alias("_to"))
    kept = edges.join(top.select("run_id", F.col("keyword").alias("src")), ["run_id", "src"], "left_semi").join(ids, ["run_id", "dst"])
    out = kept.groupBy("run_id", F.col("src").alias("keyword")).agg(ordered_list([F.col("seen")], F.col("_to")).alias("_out"))
    codes = F.array_join(F.array_compact(F.array(*[F.when(F.col(k) > 0, F.lit(k)) for k in cols.INTENTS])), "|")
    return top.join(out, ["run_id", "keyword"], "left").select(
        "run_id", "id", F.col("keyword").alias("name"), "volume_avg", "volume_trend", codes.alias("intent"), "out_degree", "path_count",
        F.coalesce(F.array_join("_out", ","), F.lit("")).alias("outgoing"))


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """CSV with a header; a field is quoted only when it is an empty text or holds a comma, quote or line break."""
    writer = df.write.mode("errorifexists").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    (writer.partitionBy(*by) if by else writer).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What `write_csv` wrote, with the given types (folder columns included): nulls and empty texts stay apart, line breaks stay in their field."""
    missing = "\x00missing\x00"  # stands for a field without text while it is read, so that a quoted empty one is not taken for it
    return spark.read.options(header=True, escape='"', multiLine=True, mode="FAILFAST", nullValue=missing).schema(schema).csv(path)


def write_batches(batches: DataFrame, path: str) -> None:
    """Work lists as one folder per run and batch number."""
    batches.write.mode("errorifexists").partitionBy("run_id", "batch_no").json(path)


def write_facts(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", replace: bool = False) -> None:
    """One folder per fact table, partitioned by run; with `replace`, the runs of the tables take the place of what is there, others stay."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") if replace else df.write.mode("errorifexists")
        writer.partitionBy("run_id").format(fmt).save(f"{path}/{name}")
