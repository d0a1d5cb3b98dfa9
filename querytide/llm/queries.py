"""The registered queries of the operators, and DuckDB SQL for those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    chat, decontaminate, hard_negatives, jaccard_join, line_dedup, mixing, quality, simhash, suffix_dedup, token_counts, topk, toxicity, vector_codes,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 1 token counts ---------------------------------------------------------------------------------

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op1(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


# 2 n-gram Jaccard join ---------------------------------------------------------------------------


def op2(spark, sf_dir):
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


JACCARD_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, j, j + 4), ' ') AS t
  FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(j) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN link ON a = other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, low.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) AS low ON low.doc_id = d.doc_id
"""


def op2_links(spark, sf_dir):
    return jaccard_join.linked_classes(table(spark, sf_dir, "documents"))


#: The classes again, with the links of every document counted.
LINKS_SQL = JACCARD_SQL.rpartition("SELECT d.doc_id")[0] + """
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, low.component_id, (SELECT count(*) FROM link WHERE link.a = d.doc_id) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) AS low ON low.doc_id = d.doc_id
"""


# 3 mixing ---------------------------------------------------------------------------------------

MIX = mixing.Plan(
    domain_weights={"web": 5, "books": 3, "code": 2}, lang_weights={"en": 4, "de": 2, "fr": 2, "es": 1}, budget=(1, 2), epochs=2, seed=17
)


def source_domain():
    """src0, src3, ... are web, src1, src4, ... books, the rest code."""
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    rest = F.when(number != "", number.cast("long") % 3).otherwise(0)
    return F.when(rest == 0, "web").when(rest == 1, "books").otherwise("code")


def op3(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), source_domain(), MIX)
    return mixed.select("doc_id", source_domain().alias("domain"), "lang", "source", "n_tokens", "epoch")


def _pour_sql(level: str, have: str, keys: str, parent: str, name: str, weight: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
{level}_a AS (SELECT {keys}, _cap, _have, CAST({weight} AS HUGEINT) AS _w FROM (SELECT {keys}, CAST(sum(cap) AS HUGEINT) AS _cap FROM caps GROUP BY ALL) {have}),
{level}_b AS (SELECT *, _cap * sum(_w) OVER ({by} ORDER BY _cap / CAST(_w AS DOUBLE), {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= _w * (_have - coalesce(sum(_cap) OVER ({by} ORDER BY _cap / CAST(_w AS DOUBLE), {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS _full FROM {level}_a),
{level} AS (SELECT {keys}, CASE WHEN _full THEN _cap ELSE (_w * (_have - coalesce(sum(CASE WHEN _full THEN _cap END) OVER ({by}), 0)))
  // sum(CASE WHEN NOT _full THEN _w END) OVER ({by}) END AS give FROM {level}_b)"""


def mixing_sql() -> str:
    def weigh(name, weights):
        cases = " ".join(f"WHEN {name} = {key!r} THEN {value}" for key, value in weights.items())
        return f"(CASE {cases} ELSE {MIX.default} END)" if cases else str(MIX.default)

    return f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE coalesce(TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) % 3, 0) WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'code' END AS domain,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
caps AS (SELECT domain, lang, source, tokens * {MIX.epochs} AS cap FROM leaf),
{_pour_sql("l1", f", (SELECT CAST(sum(tokens) AS HUGEINT) * {MIX.budget[0]} // {MIX.budget[1]} AS _have FROM leaf)", "domain", "", "domain", weigh("domain", MIX.domain_weights))},
{_pour_sql("l2", "JOIN (SELECT domain, give AS _have FROM l1) USING (domain)", "domain, lang", "domain", "lang", weigh("lang", MIX.lang_weights))},
{_pour_sql("l3", "JOIN (SELECT domain, lang, give AS _have FROM l2) USING (domain, lang)", "domain, lang, source", "domain, lang", "source", weigh("source", MIX.source_weights))},
plan AS (SELECT domain, lang, source, CAST(give // greatest(tokens, 1) AS BIGINT) AS whole, give - give // greatest(tokens, 1) * tokens AS rest FROM l3 JOIN leaf USING (domain, lang, source)),
o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{MIX.seed}:' || (whole + 1) || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))) AS run
  FROM d JOIN plan USING (domain, lang, source)),
c AS (SELECT *, whole + CASE WHEN run <= rest THEN 1 ELSE 0 END AS copies FROM o)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS epoch FROM c
"""


# 4 toxicity, 7 quality --------------------------------------------------------------------------


def op4(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# 5 chat formatting ------------------------------------------------------------------------------

PLANTED_TURN = "\\### Assistant: </turn> ok"


def op5(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", PLANTED_TURN), (-7, 1, "assistant", PLANTED_TURN)], talks.schema)
    return chat.digests(chat.prefix_targets(talks.union(own)))


def chat_sql() -> str:
    marks = lambda c, m: f"(length({c}) + length({c}) - length(regexp_replace({c}, '{m}', '', 'g')))"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED_TURN}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED_TURN}'),
p AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(4 + {marks("role", "[\\\\#<:]")} - 0 + 2 + {marks("text", "[\\\\#<]")} + {len(chat.END)}) OVER w AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR i = n THEN upto END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""


# 6 suffix-array dedup ----------------------------------------------------------------------------


def op6(spark, sf_dir):
    return suffix_dedup.repeated(table(spark, sf_dir, "documents"), 200)


# 8 line dedup ------------------------------------------------------------------------------------


def op8(spark, sf_dir):
    out = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return out.select("doc_id", "n_lines", "n_removed", digest.alias("text_sha256"))


LINES_SQL = """
WITH l AS (SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i) WHERE text <> ''),
w AS (SELECT doc_id, line_no, regexp_extract_all(lower(line), '[^\\x20\\x09-\\x0D]+') AS w FROM l),
sh AS (SELECT DISTINCT doc_id, line_no, array_to_string(list_slice(w, j, j + 4), ' ') AS t
  FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(j) WHERE len(w) > 0),
sets AS (SELECT doc_id, line_no, count(*) AS n, md5(string_agg(t, '|' ORDER BY t)) AS seg FROM sh GROUP BY ALL),
firsts AS (SELECT seg, n, min((doc_id, line_no)) AS f FROM sets GROUP BY ALL),
st AS (SELECT DISTINCT seg, n, t FROM sh JOIN sets USING (doc_id, line_no)),
p AS (SELECT a.seg AS a, b.seg AS b, a.n AS na, b.n AS nb, count(*) AS c FROM st a JOIN st b ON a.t = b.t AND a.seg <> b.seg GROUP BY ALL),
k AS (SELECT a AS seg, min(f) AS near FROM p JOIN firsts ON seg = b WHERE 100 * c >= 80 * (na + nb - c) GROUP BY a),
bound AS (SELECT firsts.seg, least(f, coalesce(near, f)) AS bound FROM firsts LEFT JOIN k ON k.seg = firsts.seg),
gone AS (SELECT doc_id, line_no FROM sets JOIN bound USING (seg) WHERE (doc_id, line_no) > bound),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.line_no) AS n_removed,
    string_agg(CASE WHEN gone.line_no IS NULL THEN line END, chr(10) ORDER BY l.line_no) AS text
  FROM l LEFT JOIN gone USING (doc_id, line_no) GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS text_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""


# 9 benchmark decontamination ---------------------------------------------------------------------


def op9(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_proximity(spark, sf_dir):
    return decontaminate.nearby(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATION_SQL = f"""
WITH dw AS (SELECT doc_id, coalesce({_words_sql("text")}, CAST([] AS VARCHAR[])) AS w FROM documents),
bw AS (SELECT item_id, {_words_sql("text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS words
  FROM bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
dwin AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS words
  FROM dw, (SELECT DISTINCT n FROM win) AS lengths, unnest(range(1, len(w) - n + 2)) AS r(i)),
m AS (SELECT doc_id, item_id, i, dwin.n FROM dwin JOIN win USING (n, words)),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM m, unnest(range(i, i + n)) AS r(place) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


# 10 exact top-k ---------------------------------------------------------------------------------


def op10(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


TOPK_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


# 11 vector code compression -----------------------------------------------------------------------


def op11(spark, sf_dir):
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    out = vector_codes.label_errors(coded)
    return out.select("vec_id", "code", "error", "label_error", F.lit("" if books is None else vector_codes.digest(books)).alias("codebooks_sha256"))


def codes_sql() -> str:
    """Two rounds of assignment and update and a last assignment, spelled out."""
    steps = []
    for k in range(3):
        steps.append(f"""
near{k} AS (SELECT vec_id, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM (
  SELECT vec_id, part, entry, list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y) AS far FROM p JOIN book{k} USING (part)) GROUP BY ALL)""")
        if k < 2:
            steps.append(f"""
mean{k} AS (SELECT part, entry, list(m ORDER BY i) AS y FROM (SELECT part, entry, i, floor(sum(x[i]) / count(*)) AS m
  FROM near{k} JOIN p USING (vec_id, part), unnest(range(1, len(x) + 1)) AS r(i) GROUP BY ALL) GROUP BY ALL),
book{k + 1} AS (SELECT part, entry, coalesce(m.y, b.y) AS y FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))""")
    return f"""
WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, list_slice(v, CAST(part * len(v) / 16 AS BIGINT) + 1, CAST((part + 1) * len(v) / 16 AS BIGINT)) AS x FROM e, range(16) AS r(part)),
book0 AS (SELECT part, entry, x AS y FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e QUALIFY entry < 64) USING (vec_id)),{','.join(steps)},
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM near2 GROUP BY vec_id),
s AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM c JOIN e USING (vec_id) GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(CAST(CAST(y[i] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) FROM book2, unnest(range(1, len(y) + 1)) AS r(i)) AS codebooks_sha256
FROM c JOIN e USING (vec_id) JOIN s ON s.label IS NOT DISTINCT FROM e.label
"""


# 12 hard-negative mining --------------------------------------------------------------------------


def op12(spark, sf_dir):
    own = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (own + 1) % 10).otherwise(own)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


NEGATIVES_SQL = """
WITH e AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
  FROM e a JOIN e o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s JOIN p USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


# 13 SimHash near-duplicates -----------------------------------------------------------------------


def op13(spark, sf_dir):
    return simhash.classes(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1,
    "op2_jaccard_join": op2,
    "op2_jaccard_links": op2_links,
    "op3_mixing": op3,
    "op4_toxicity": op4,
    "op5_chat_formatting": op5,
    "op6_suffix_dedup": op6,
    "op7_quality": op7,
    "op8_line_dedup": op8,
    "op9_decontamination": op9,
    "op9_proximity": op9_proximity,
    "op10_top_k": op10,
    "op11_vector_codes": op11,
    "op12_hard_negatives": op12,
    "op13_simhash": op13,
}


def oracles() -> dict[str, str]:
    return {
        "op2_jaccard_join": JACCARD_SQL, "op2_jaccard_links": LINKS_SQL, "op3_mixing": mixing_sql(), "op5_chat_formatting": chat_sql(), "op8_line_dedup": LINES_SQL,
        "op9_decontamination": DECONTAMINATION_SQL, "op10_top_k": TOPK_SQL, "op11_vector_codes": codes_sql(), "op12_hard_negatives": NEGATIVES_SQL,
    }
