"""Tolerant readers: answer files of several shapes to fixed tables.

Each file is one text value; parsing, unwrapping and exploding run in the executors on VARIANT.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import cols


def answer_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per answer file: its name, the columns of its folders (run_id=a/batch=3) and its text."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), *[c for c in files.columns if c != "value"], "value")


def _list(doc: str, path: str) -> Column:
    return F.expr(f"try_variant_get({doc}, '{path}', 'array<variant>')")


def _text(doc: str, path: str) -> Column:
    return F.expr(f"try_variant_get({doc}, '{path}', 'string')")


def _object(doc: str, path: str) -> Column:
    """The value at a path when it is an object, otherwise NULL."""
    at = f"try_variant_get({doc}, '{path}', 'variant')"
    return F.expr(f"CASE WHEN try_variant_get({doc}, '{path}', 'map<string,variant>') IS NOT NULL THEN {at} END")


def parsed(raw: DataFrame) -> DataFrame:
    """Text to VARIANT; text that is not JSON becomes NULL."""
    return raw.withColumn("doc", F.try_parse_json("value")).drop("value")


def unwrap_content_blocks(docs: DataFrame) -> DataFrame:
    """A list made only of text blocks is joined and parsed again."""
    blocks = _list("doc", "$")
    body = F.expr("transform(_blocks, b -> CASE WHEN try_variant_get(b, '$.type', 'string') = 'text' "
                  "THEN try_variant_get(b, '$.text', 'string') END)")
    return (
        docs.withColumn("_blocks", blocks).withColumn("_texts", body)
        .withColumn("doc", F.when((F.size("_blocks") > 0) & F.forall("_texts", lambda t: t.isNotNull()),
                                  F.coalesce(F.try_parse_json(F.array_join("_texts", "")), F.col("doc")))
                    .otherwise(F.col("doc")))
        .drop("_blocks", "_texts")
    )


def _answers(raw: DataFrame) -> DataFrame:
    return unwrap_content_blocks(parsed(raw))


ENVELOPES = ["$", "$.data", "$.data.results", "$.result.hits.hits", "$.hits.hits", "$.results"]


def rejected(raw: DataFrame) -> DataFrame:
    """Answers that give no keyword records, without their text, and why: empty, not JSON, no list of records, no keyword."""
    keys = [c for c in raw.columns if c != "value"]
    blank = F.coalesce(F.trim(F.regexp_replace("value", r"\s", "")), F.lit("")) == ""
    docs = unwrap_content_blocks(raw.select(*keys, blank.alias("_blank"), F.try_parse_json("value").alias("doc")))
    rows = docs.withColumn("_rows", F.coalesce(*[_list("doc", p) for p in ENVELOPES]))
    name = "coalesce(try_variant_get(x, '$._source.keyword', 'string'), try_variant_get(x, '$.keyword', 'string'), '')"
    why = (
        F.when(F.col("_blank"), "empty").when(F.col("doc").isNull(), "not JSON").when(F.col("_rows").isNull(), "no list of records")
        .when(F.expr(f"NOT exists(_rows, x -> {name} <> '')"), "no keyword")
    )
    return rows.select(*keys, why.alias("reason")).where(F.col("reason").isNotNull())


def keyword_info(raw: DataFrame) -> DataFrame:
    """Keyword records of an answer in any known envelope, with typed metrics and months.

    has_intents tells intents that are all zero from an answer without any.
    """
    keys = [c for c in raw.columns if c != "value"]
    rows = _answers(raw).select(*keys, F.posexplode(F.coalesce(*[_list("doc", p) for p in ENVELOPES])).alias("pos", "row"))
    src = rows.withColumn("src", F.coalesce(_object("row", "$._source"), _object("row", "$")))

    def metric(name):
        return cols.num(_text("src", f"$.ads_metrics.{name}")).alias(name)

    month = ("coalesce(transform(filter(try_variant_get(src, '$.monthly_volume', 'array<variant>'),"
             " m -> try_variant_get(m, '$.month', 'string') IS NOT NULL), m -> named_struct("
             "'month', try_variant_get(m, '$.month', 'string'), 'nv', try_variant_get(m, '$.nv', 'string'),"
             "'gg', try_variant_get(m, '$.gg', 'string'), 'total', try_variant_get(m, '$.total', 'string'))), array())")
    return src.select(
        *keys, "pos", _text("src", "$.keyword").alias("keyword"),
        *[metric(m) for m in ("volume_avg", "volume_total", "volume_trend", "cpc")],
        F.coalesce(_text("src", "$.ads_metrics.competition"), F.lit("")).alias("competition"), metric("competition_index"),
        *[cols.num(_text("src", f"$.intents.{k}")).alias(k) for k in cols.INTENTS],
        F.coalesce(F.expr("size(try_variant_get(src, '$.intents', 'map<string,variant>')) > 0"), F.lit(False)).alias("has_intents"),
        F.coalesce(_text("src", "$.seed"), _text("src", "$.source_keyword")).alias("seed"),
        F.expr(month).alias("monthly_volume"),
    ).where(F.col("keyword").isNotNull() & (F.col("keyword") != ""))


def cluster_graph(raw: DataFrame, min_ends: int = 2) -> tuple[DataFrame, DataFrame]:
    """Communities with member order, and edges. `data` is optional around both."""
    keys = [c for c in raw.columns if c != "value"]
    docs = _answers(raw).withColumn("g", F.coalesce(_object("doc", "$.data"), _object("doc", "$")))
    clusters = docs.select(*keys, F.explode(F.expr("try_variant_get(g, '$.communities', 'map<string,variant>')")).alias("cluster_id", "kws"))
    communities = clusters.select(*keys, "cluster_id", F.posexplode(_list("kws", "$")).alias("ord", "kw"))
    communities = communities.where(F.schema_of_variant("kw") == "STRING").select(
        *keys, "cluster_id", F.col("ord").cast("long").alias("ord"), _text("kw", "$").alias("keyword"))
    rels = docs.select(*keys, F.posexplode(_list("g", "$.rels")).alias("ord", "rel")).select(
        *keys, F.col("ord").cast("long").alias("ord"), F.size(_list("rel", "$")).alias("_n"),
        _text("rel", "$[0]").alias("a"), _text("rel", "$[1]").alias("b"))
    exact = (F.col("_n") == 2) if min_ends == 2 else (F.col("_n") >= 2)
    return communities, rels.where(exact & (F.col("a") != "") & (F.col("b") != "")).drop("_n")


def journeys(raw: DataFrame) -> DataFrame:
    """Ordered node lists of a journey answer, not yet cleaned."""
    keys = [c for c in raw.columns if c != "value"]
    lists = F.coalesce(*[_list("doc", p) for p in ("$", "$.data", "$.result.paths", "$.paths")])
    rows = _answers(raw).select(*keys, F.posexplode(lists).alias("path_id", "row"))
    strings = F.expr("transform(filter(try_variant_get(row, '$', 'array<variant>'), x -> schema_of_variant(x) = 'STRING'),"
                     " x -> try_variant_get(x, '$', 'string'))")
    return rows.select(*keys, F.col("path_id").cast("long").alias("path_id"), strings.alias("seq")).where(F.col("seq").isNotNull())


def related_lists(raw: DataFrame) -> DataFrame:
    """Ordered related queries: strings or objects with a keyword."""
    keys = [c for c in raw.columns if c != "value"]
    items = F.expr("transform(coalesce(try_variant_get(doc, '$', 'array<variant>'), try_variant_get(doc, '$.data', 'array<variant>')),"
                   " x -> coalesce(try_variant_get(x, '$.keyword', 'string'), CASE WHEN schema_of_variant(x) = 'STRING' THEN try_variant_get(x, '$', 'string') END))")
    return _answers(raw).select(*keys, F.filter(items, lambda x: x.isNotNull()).alias("queries"))
