"""Classification of five runs in three markets: every run has its own seed, names, words and lists."""

from pyspark.sql import functions as F

from querytide.operators import classify as op, demand

from . import family_demand as fd
from .domain import Domain
from .sqlkit import R, check, piece

GL = {"automobile": "us", "building": "us", "furniture": "us", "household": "kr", "machinery": "jp"}
RUNS = list(GL)
# Fixed values of the fixture: how the runs of two markets write the words of the corpus.
WRITTEN = {
    "kr": {"anvil": "모루", "bolt": "볼트", "gear": "기어", "gizmo": "ギズモ", "plate": "접시", "ring": "반지", "rod": "막대", "widget": "위젯",
           "blue": "파랑", "cold": "강동", "hot": "레시피", "large": "대형", "new": "신형", "old": "수리점", "red": "빨강", "small": "소형",
           "economy": "쿠팡", "medium": "중사이즈", "promo": "특가할인", "standard": "일반형", "vs": "비교"},
    "jp": {"anvil": "金床", "bolt": "ボルト", "gear": "ギア", "gizmo": "기즈모", "plate": "プレート", "ring": "リング", "rod": "ロッド", "widget": "ウィジェット",
           "blue": "青", "cold": "冷", "hot": "レシピ", "large": "大型", "new": "新型", "old": "修理屋", "red": "赤", "small": "小型",
           "economy": "楽天", "medium": "中サイズ", "promo": "大セール", "standard": "標準", "vs": "比較"},
}
BRAND_WORD = {"kr": "브랜드", "jp": "ブランド"}
WORDS = [("us", c, w) for c, w in [("explore", "promo"), ("explore", "new"), ("explore", "vs"), ("attr", "small"), ("attr", "large"), ("attr", "medium"), ("attr", "red"),
                                   ("attr", "blue"), ("channel", "economy"), ("explore", "old"), ("use", "old"), ("howto", "hot")]]
WORDS += [("kr", c, w) for c, w in [("explore", "할인"), ("explore", "신형"), ("explore", "비교"), ("attr", "소형"), ("attr", "대형"), ("attr", "빨강"), ("attr", "파랑"),
                                    ("channel", "쿠팡"), ("use", "수리"), ("howto", "레시피"), ("generic", "일반형")]]
WORDS += [("jp", c, w) for c, w in [("explore", "セール"), ("explore", "新型"), ("explore", "比較"), ("attr", "小型"), ("attr", "大型"), ("attr", "赤"), ("attr", "青"),
                                    ("channel", "楽天"), ("use", "修理"), ("howto", "レシピ"), ("generic", "中サイズ")]]
US_WORDS = {"generic": ["standard"], "buy": ["promo", "economy"], "how": ["cold", "small", "old"], "picked_brand": ["brand#1", "brand#4"], "catchall": ["promo"], "region": ["brand#9"],
            "topic:cold": ["cold"], "topic:size": ["small", "large"]}
OWN_WORDS = {
    "automobile": US_WORDS | {"line:gear": ["gear", "gears"], "line:bolt": ["bolt"]},
    "building": US_WORDS | {"line:gear": ["gear", "gears"], "line:ring": ["ring"], "topic:cold": ["cold", "blue"], "region": []},
    "furniture": US_WORDS | {"line:ring": ["ring"], "line:rod": ["rod"], "catchall": [], "picked_brand": ["brand#2"]},
    "household": {"picked_brand": ["브랜드1", "브랜드 7"], "topic:크기": ["소형", "대형"], "catchall": ["특가"], "line:기어": ["기어"], "line:볼트": ["볼 트"]},
    "machinery": {"generic": ["標準"], "topic:赤系": ["赤"], "line:ギア": ["ギア"], "line:ロッド": ["ロッド"]},
}
# Seeds: mode, item_optional, domain, and the names of each role.
ENTITY = {
    "automobile": ("entity", False, False, {"brand": ["brand#2"], "item": ["ring", "rng"], "head": ["ar"]}),
    "building": ("entity", False, False, {"brand": ["brand#3"], "item": ["bolt"], "head": ["ing"]}),
    "furniture": ("category", False, False, {"item": ["gear", "cog"]}),
    "household": ("entity", True, False, {"brand": ["브랜드2", "브랜드 3"], "item": ["반 지"], "head": ["기어"], "brand_item": ["반지", "기어"]}),
    "machinery": ("entity", False, False, {"brand": ["ブランド1", "ブランド3"], "item": ["リング", "指輪"], "head": ["ト"]}),
}
CATEGORY = {
    "automobile": ("category", False, False, {"item": ["ring", "rng"], "head": ["od", "gear"], "sibling": ["widget"], "near": ["bolt"]}),
    "building": ("category", False, False, {"item": ["plate"], "head": ["ing"], "sibling": ["anvil"], "near": ["rod", "bolt"]}),
    "furniture": ("category", False, True, {"item": ["gear", "cog"], "head": ["od"], "sibling": ["widget", "gizmo"]}),
    "household": ("category", False, False, {"item": ["반지"], "head": ["기어", "트"], "sibling": ["위젯"], "near": ["볼트"]}),
    "machinery": ("category", False, False, {"item": ["リング"], "head": ["ギア"], "near": ["ボルト"]}),
}
NAMES = [("automobile", "brand#7"), ("automobile", "brand#3"), ("building", "brand#1"), ("building", "brand #11"), ("furniture", "brand#5"), ("household", "브랜드7"), ("household", "brand12"),
         ("machinery", "ブランド3"), ("machinery", "ブランド2")]
CANDIDATES = [("automobile", "small ring", "small ring"), ("automobile", "red ring", "red ring"), ("building", "blue bolt", "blue bolt"), ("furniture", "new gear", "new gear"),
              ("household", "소형", "소형 반지"), ("household", "소형", "대형반지"), ("machinery", "小型", "小型リング")]
PLAN_ITEMS = {"us": ["ring", "small ring"], "kr": ["반지", "소형 반지"], "jp": ["リング"]}
GLUED = r"^(brand#?\d+|브랜드\d+|ブランド\d+) ([^ ]+) "


class Corpus:
    def __init__(self, dom):
        self.dom = dom

    @property
    def market(self):
        """gl of a row by its run."""
        return F.coalesce(*[F.when(F.col("run_id") == r, F.lit(gl)) for r, gl in GL.items()])

    def written(self, text):
        """The text as the run's market writes it; a fourth word is put to the third without a space."""
        out = F.col(text)
        for gl, words in WRITTEN.items():
            table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
            spelled = F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(table, w), w))
            spelled = F.concat(F.array_join(F.slice(spelled, 1, 3), " "), F.array_join(F.slice(spelled, 4, 9), ""))
            if gl == "kr":
                spelled = F.regexp_replace(spelled, r"^brand#(1\d)", "brand$1")
            out = F.when(self.market == gl, F.regexp_replace(spelled, "^brand#", BRAND_WORD[gl])).otherwise(out)
        return out

    @property
    def raw_lists(self):
        """Related queries by rank; short brand-and-noun names from a second, proposed list."""
        a = self.dom.related.select("run_id", F.lit("related").alias("source"), "rank", F.col("keyword").alias("query"))
        w = F.split("keyword", " ")
        b = self.dom.metrics.groupBy("run_id", F.concat_ws(" ", w[0], w[2]).alias("query")).agg((F.min("ord") + 1).alias("rank"))
        return a.unionByName(b.select("run_id", F.lit("analyst").alias("source"), "rank", "query"))

    @property
    def lists(self):
        return self.raw_lists.withColumn("query", self.written("query"))

    @property
    def nodes(self):
        """Graph nodes: nouns, adjective and noun, and the item against every noun."""
        w = F.split("keyword", " ")
        names = F.explode(F.array(w[2], F.concat_ws(" ", w[1], w[2]), F.concat(F.lit("ring vs "), w[2])))
        return self.dom.metrics.select("run_id", names.alias("query")).distinct().withColumn("query", self.written("query")).distinct()

    @property
    def index(self):
        return self.dom.stage("source index", lambda: op.source_index(self.lists, self.nodes))

    @property
    def dictionary(self):
        return self.dom.spark.createDataFrame(WORDS, "gl string, class string, word string")

    def terms(self, seeds):
        rows = []
        for run, (_, _, _, lists) in seeds.items():
            for i, (role, names) in enumerate((lists | OWN_WORDS[run]).items()):
                kind, _, grp = role.partition(":")
                rows += [(run, kind, grp or None, 100 * i + k, n) for k, n in enumerate(names)]
        return self.dom.spark.createDataFrame(rows, "run_id string, role string, grp string, ord int, name string")

    def spec(self, seeds):
        rows = [(run, GL[run].upper() if run == "furniture" else GL[run], mode, optional, domain) for run, (mode, optional, domain, _) in seeds.items()]
        table = self.dom.spark.createDataFrame(rows, "run_id string, gl string, mode string, item_optional boolean, domain boolean")
        return self.dom.stage(f"spec {seeds is ENTITY}", lambda: op.run_spec(table, self.terms(seeds)))

    def parsed(self, seeds):
        return self.dom.stage(f"parsed {seeds is ENTITY}", lambda: op.parse(self.index, self.spec(seeds), self.terms(seeds), self.dictionary))

    @property
    def entity(self):
        return self.parsed(ENTITY)

    @property
    def category(self):
        return self.parsed(CATEGORY)

    @property
    def brands(self):
        return self.dom.stage("brand candidates", lambda: op.brand_candidates(self.category))

    @property
    def own_brands(self):
        return self.dom.stage("brand candidates of entities", lambda: op.brand_candidates(self.entity))

    @property
    def peers(self):
        return self.dom.stage("sibling candidates", lambda: op.sibling_candidates(self.category, self.nodes, self.brands, self.spec(CATEGORY)))

    @property
    def synonyms(self):
        return self.dom.stage("synonym candidates", lambda: op.synonym_candidates(self.category, self.brands, self.spec(CATEGORY)))

    def by_run(self, rows, schema):
        return self.dom.spark.createDataFrame(rows, schema)

    @property
    def items(self):
        return self.terms(CATEGORY).where("role = 'item'").select("run_id", "name")


def on(f):
    return lambda s, d: f(Corpus(Domain(s, d)))


# SQL -----------------------------------------------------------------------------------------------


def sql_list(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]::varchar[]"


def flat(names):
    return [n.replace(" ", "").lower() for n in names]


def pattern(names):
    return f"'{'|'.join(sorted(flat(names), key=len, reverse=True))}'" if names else "NULL"


def written_sql(text):
    out = f"CASE (SELECT gl FROM q_gl m WHERE m.run_id = x.run_id)"
    for gl, words in WRITTEN.items():
        table = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in words.items()) + "}"
        spelled = f"list_transform(string_split({text}, ' '), lambda w: coalesce(({table})[w], w))"
        one = f"array_to_string(({spelled})[1:3], ' ') || array_to_string(({spelled})[4:], '')"
        if gl == "kr":
            one = f"regexp_replace({one}, '^brand#(1\\d)', 'brand\\1')"
        out += f" WHEN '{gl}' THEN regexp_replace({one}, '^brand#', '{BRAND_WORD[gl]}')"
    return out + f" ELSE {text} END"


def by_run(f):
    return "CASE run_id " + " ".join(f"WHEN '{run}' THEN {f(run, OWN_WORDS[run])}" for run in RUNS) + " END"


def conf(seeds):
    """One row a run: what the SQL needs to know of it."""
    rows = []
    for run, (mode, optional, domain, lists) in seeds.items():
        get = lambda role: (lists | OWN_WORDS[run]).get(role, [])
        made = [f"{b} {i}" for b in get("brand")[:4] for i in get("item")] if mode == "entity" else get("item")
        rows.append(f"('{run}', '{GL[run]}', '{mode}', {optional}, {domain}, {pattern(get('item'))}, {pattern(get('brand'))}, {sql_list(flat(get('item')))}, {sql_list(flat(get('brand')))}, "
                    f"{sql_list(get('generic'))}, {sql_list(get('head'))}, {sql_list(flat(get('sibling')))}, {sql_list(get('sibling'))}, {sql_list(get('near'))}, {sql_list(made)}, "
                    f"{pattern(get('picked_brand'))}, {pattern(get('catchall'))}, {sql_list(get('region'))}, {sql_list(get('buy'))}, {sql_list(get('how'))}, {len(get('brand_item'))})")
    return f"""SELECT * FROM (VALUES {', '.join(rows)}) v(run_id, gl, mode, opt, domain, item_rx, brand_rx, items, brand_keys, generic, heads, sibs, sib_names, nears, made,
  picked_rx, catch_rx, regions, buys, hows, brand_items)"""


def cls(x):
    """Class of a piece, by the market and the own generic words of its run."""
    out = []
    for gl, m in op.MARKETS.items():
        words = [(c, w) for g, c, w in WORDS if g == gl]
        last = {}
        for c, w in sorted(words, key=lambda cw: op.CLASSES.index(cw[0])):
            last[w] = c
        exact = " ".join(f"WHEN {x}='{w}'" + (" AND len(generic)=0" if c == "generic" else "") + f" THEN '{c}'" for w, c in last.items())
        rules = " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{c}'" for c, p in m.regexes)
        loose = []
        for c in ("community", "use", "explore") + (() if m.substring else ("attr",)):
            for g, w in words:
                if g == c and (not m.substring or len(w) > 1):
                    test = f"contains({x},'{w}')" if m.substring else f"{x} IN ('{w}', '{w}s')"
                    loose.append(f"WHEN {test} THEN '{c}'")
        part = " ".join(f"WHEN contains({x},'{w}') THEN 'attr'" for w in m.attribute_parts)
        out.append(f"WHEN gl='{gl}' THEN CASE {exact} {rules} WHEN regexp_matches({x}, '{m.foreign}') THEN 'info' {' '.join(loose)} {part} ELSE 'residual' END")
    return f"CASE WHEN list_contains(generic, {x}) THEN 'generic' {' '.join(out)} END"


def only(lst, cond):
    return f"list_filter({lst}, lambda x: {cond})"


def are(lst, test):
    """How many pieces of a list have a class that fits."""
    return f"len({only(lst, '(' + cls('x') + ') ' + test)})"


BADS = "IN (" + ", ".join(f"'{b}'" for b in op.BAD) + ")"
RES = "= 'residual'"


def cut(t, rx):
    return f"CASE WHEN regexp_matches({t}, {rx}) THEN list_filter(string_split(regexp_replace({t}, {rx}, ' '), ' '), lambda x: x<>'') END"


def any_word(lst, words):
    return "(" + " OR ".join(f"list_contains({lst},'{w}')" for w in words) + ")"


def has_words(lst, text, attr):
    """A text speaks of the words of its market."""
    def one(words, substring):
        return "(" + " OR ".join(f"contains({text},'{w}')" if substring else f"list_contains({lst},'{w}')" for w in words) + ")"
    return "CASE gl " + " ".join(f"WHEN '{gl}' THEN {one(getattr(m, attr), m.substring)}" for gl, m in op.MARKETS.items()) + " END"


piece("q_gl", "SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{g}')" for r, g in GL.items()) + ") v(run_id, gl)")
piece("q_glists_raw", """
SELECT run_id, 'related' AS source, rank, keyword AS query FROM q_related UNION ALL
SELECT run_id, 'analyst', min(ord)+1, split_part(keyword,' ',1) || ' ' || split_part(keyword,' ',3) FROM q_metrics GROUP BY run_id, split_part(keyword,' ',1) || ' ' || split_part(keyword,' ',3)""")
piece("q_glists", f"SELECT run_id, source, rank, {written_sql('query')} AS query FROM q_glists_raw x")
piece("q_gnodes_raw", """
SELECT DISTINCT run_id, unnest([split_part(keyword,' ',3), split_part(keyword,' ',2) || ' ' || split_part(keyword,' ',3), 'ring vs ' || split_part(keyword,' ',3)]) AS query FROM q_metrics""")
piece("q_gnodes", f"SELECT DISTINCT run_id, {written_sql('query')} AS query FROM q_gnodes_raw x")
piece("q_index", """
SELECT *, CASE WHEN list_contains(srcs,'cluster') THEN 'cluster' WHEN list_contains(srcs,'intent:related') THEN 'intent' ELSE 'analyst' END AS tag FROM (
  SELECT run_id, query, min(rank)::bigint AS rank, list_sort(list(DISTINCT src)) AS srcs FROM (
    SELECT run_id, query, 'intent:' || source AS src, rank-1 AS rank FROM q_glists UNION ALL SELECT run_id, query, 'cluster', 1000000 FROM q_gnodes) GROUP BY ALL)""")
for short, seeds in (("e", ENTITY), ("c", CATEGORY)):
    piece(f"q_conf_{short}", conf(seeds))
    piece(f"q_parsed_{short}", f"""
SELECT *, {cut("array_to_string(rest_brand,' ')", "item_rx")} AS rest_both FROM (
  SELECT *, query AS t, string_split(query,' ') AS words, regexp_matches(query, item_rx) AS has_item, coalesce(regexp_matches(query, '^(' || brand_rx || ')'), false) AS has_brand,
    {cut('query', 'item_rx')} AS rest_item, {cut('query', "('^(' || brand_rx || ')')")} AS rest_brand,
    CASE WHEN regexp_matches(query, item_rx) THEN regexp_replace(query, '(' || item_rx || ').*$', '') ELSE '' END AS head_text
  FROM q_index JOIN q_conf_{short} USING (run_id))""")
BEFORE = "replace(head_text,' ','')"

check("G1_market_dictionaries", on(lambda c: op.market_word_use(c.index, c.spec(CATEGORY), op.market_words(c.dom.spark))), """
SELECT gl, list, grp, ord::int AS ord, word, coalesce(sum(n),0)::bigint AS queries FROM (
  SELECT m.*, CASE WHEN (CASE WHEN m.gl='us' THEN list_contains(string_split(query,' '), word) OR list_contains(string_split(query,' '), word || 's') AND length(word)>=3 ELSE contains(replace(query,' ',''), word) END) THEN 1 ELSE 0 END AS n
  FROM (VALUES """ + ", ".join(f"('{gl}', '{kind}', {grp}, {i}, '{w}')" for gl, m in op.MARKETS.items() for kind, grp, ws in (
    [("bundle", f"'{n}'", ws) for n, ws in m.bundles] + [(k, "NULL", getattr(m, a)) for k, a in (("compare", "compare"), ("buy", "buy"), ("how", "how"), ("attribute", "attribute_parts"))])
    for i, w in enumerate(ws)) + """) m(gl, list, grp, ord, word) LEFT JOIN (SELECT gl, query FROM q_index JOIN q_gl USING (run_id)) q ON q.gl=m.gl) GROUP BY gl, list, grp, ord, word""")
check("G1_market_thresholds", on(lambda c: c.dom.spark.createDataFrame(list(GL.items()), "run_id string, gl string").join(op.market_rules(c.dom.spark), "gl").join(
    c.index.groupBy("run_id").agg(F.count(F.lit(1)).alias("queries")), "run_id").select("run_id", "gl", "substring", "latin", "head_max", "token_max", "calibrated", "queries")), """
SELECT run_id, gl, gl<>'us' AS substring, gl<>'us' AS latin, 0.45::double AS head_max, 0.7::double AS token_max, gl='kr' AS calibrated, count(*) AS queries FROM q_index JOIN q_gl USING (run_id) GROUP BY ALL""")
check("G2_piece_class", on(lambda c: op.token_classes(op.known_tokens(c.index), c.dictionary, c.spec(CATEGORY))),
      f"SELECT run_id, token, {cls('token')} AS class FROM (SELECT DISTINCT run_id, unnest(string_split(query,' ')) AS token FROM q_index) JOIN q_conf_c USING (run_id)")


def _match(c):
    """Names at a word start, glued behind a known word, and glued behind an unknown one."""
    base = c.index.select("run_id", "query")
    known = base.withColumn("query", F.regexp_replace("query", GLUED, "$2$1 "))
    unknown = base.withColumn("query", F.regexp_replace("query", r"^(brand#?\d+|브랜드\d+|ブランド\d+) ", "zz$1 "))
    names = c.by_run(NAMES, "run_id string, name string")
    return op.bound_match(base.unionByName(known).unionByName(unknown).distinct(), names, "at").where(F.col("at") > 0)


check("G3_variant_match", on(_match), r"""
WITH base AS (SELECT run_id, query FROM q_index UNION SELECT run_id, regexp_replace(query, '""" + GLUED + r"""', '\2\1 ') FROM q_index
  UNION SELECT run_id, regexp_replace(query, '^(brand#?\d+|브랜드\d+|ブランド\d+) ', 'zz\1 ') FROM q_index),
toks AS (SELECT DISTINCT run_id, unnest(string_split(query,' ')) AS token FROM base),
rx AS (SELECT * FROM (VALUES """ + ", ".join(
    # a Latin name may not go on in letters or digits
    f"('{r}', '(" + "|".join(n + ("($|[^a-z0-9])" if n.isalnum() and n.isascii() else "") for n in sorted(flat([n for q, n in NAMES if q == r]), key=len, reverse=True)) + ")', "
    f"{any(n.isalnum() and n.isascii() for q, n in NAMES if q == r)})" for r in RUNS) + r""") v(run_id, rx, latin)),
hit AS (SELECT *, regexp_matches(query, '^' || rx) AS w, regexp_extract(query, '^([^ ]+?)' || rx, 1) AS g FROM base JOIN rx USING (run_id))
SELECT run_id, query, CASE WHEN w THEN 1 ELSE length(g)+1 END::int AS at FROM hit
WHERE w OR (g<>'' AND NOT (latin AND regexp_matches(substr(query, length(g)+1), '^brand\d') AND regexp_matches(g, '[a-z0-9]$')) AND EXISTS (FROM toks k WHERE k.run_id=hit.run_id AND k.token=g))""")
MEMBER = lambda rest: f"coalesce({are(rest, NOT_GENERIC)}=0 AND len({rest})<=2, false)"
NOT_GENERIC = "<>'generic'"
check("G4_strip_parts", on(lambda c: c.entity.select("run_id", "query", F.array_join("rest_item", "|").alias("rest_item"), F.array_join("rest_brand", "|").alias("rest_brand"),
                                                   F.array_join("rest_both", "|").alias("rest_both"), op.member("rest_both").alias("member"))), f"""
SELECT run_id, query, array_to_string(rest_item,'|') AS rest_item, array_to_string(rest_brand,'|') AS rest_brand, array_to_string(rest_both,'|') AS rest_both,
  {MEMBER('rest_both')} AS member FROM q_parsed_e""")
check("G5_source_index", on(lambda c: c.index.withColumn("srcs", F.array_join("srcs", "|"))), "SELECT * REPLACE (array_to_string(srcs,'|') AS srcs) FROM q_index")
check("G6_target_queries", on(lambda c: op.target_queries(c.entity, c.spec(ENTITY))), f"""
WITH f AS (SELECT run_id, query FROM q_parsed_e WHERE CASE mode WHEN 'entity' THEN {MEMBER('rest_both')} OR (opt AND {MEMBER('rest_brand')}) ELSE {MEMBER('rest_item')} END)
SELECT run_id, query, false AS verify FROM f UNION ALL
SELECT run_id, q, true FROM (SELECT DISTINCT run_id, unnest(made) AS q FROM q_parsed_e) r
WHERE NOT EXISTS (FROM f WHERE f.run_id=r.run_id AND replace(f.query,' ','')=replace(q,' ',''))""")
CLEAN_I = f"{are('rest_item', BADS)}=0"
RES_I = only("rest_item", "(" + cls("x") + ")='residual'")


def counted(src, key="name", examples=3):
    return f"""
SELECT *, CASE WHEN list_contains(srcs,'cluster') THEN 'cluster' WHEN list_contains(srcs,'intent:related') THEN 'intent' ELSE 'analyst' END AS tag FROM (
  SELECT run_id, {key}, count(*) AS n, min(rank) AS rank, list_distinct(flatten(list(srcs))) AS srcs, array_to_string((list(query ORDER BY rank, query))[1:{examples}], '|') AS examples
  FROM ({src}) GROUP BY ALL)"""


for short in "ec":
    piece(f"q_brandc_{short}", counted(f"SELECT *, {RES_I}[1] AS name FROM q_parsed_{short} WHERE has_item AND NOT has_brand AND len({RES_I})=1 AND {CLEAN_I} AND contains({BEFORE}, {RES_I}[1])"))
    piece(f"q_syn_{short}", counted(f"""SELECT *, t AS name FROM q_parsed_{short} WHERE NOT has_item AND NOT has_brand AND len(words)<=2 AND {are('words', "NOT IN ('residual','generic')")}=0
  AND NOT (len(words)=1 AND ({cls('words[1]')})='generic') AND len(list_filter(sibs, lambda s: contains(replace(t,' ',''), s)))=0"""))
CAND = ["run_id", "name", "n", "rank", "tag", "examples"]


def shown(df, *more):
    return df.withColumn("examples", F.array_join("examples", "|")).select(*CAND, *more)


check("G7_brand_candidates", on(lambda c: shown(c.brands)), f"SELECT {', '.join(CAND)} FROM q_brandc_c")
check("G8_synonym_candidates", on(lambda c: shown(c.synonyms, "brandish")), f"""
SELECT {', '.join(CAND)}, EXISTS (FROM q_brandc_c b WHERE b.run_id=s.run_id AND list_contains(string_split(s.name,' '), b.name)) AS brandish FROM q_syn_c s""")
check("G9_intent_expressions", on(lambda c: shown(op.intent_expressions(c.category))), f"SELECT {', '.join(CAND)} FROM (" + counted(
    f"SELECT *, array_to_string(rest_item,' ') AS name FROM q_parsed_c WHERE len(rest_item) BETWEEN 1 AND 2 AND {are('rest_item', NOT_GENERIC)}>0", examples=2) + ")")
LEFT = "coalesce(rest_both, rest_brand)"
piece("q_prod", f"""
SELECT run_id, name, count(*) AS n, sum((has_item OR opt)::int) AS with_item FROM (SELECT run_id, has_item, opt, unnest({only(LEFT, '(' + cls('x') + ")='residual' AND length(x)>=2")}) AS name FROM q_parsed_e
  WHERE has_brand AND len({LEFT})>0 AND {are(LEFT, BADS)}=0) GROUP BY ALL HAVING n>=2 AND with_item>=1""".replace("GROUP BY ALL HAVING n>=2 AND with_item>=1", "GROUP BY run_id, name HAVING n>=2 AND with_item>=1"))
check("G10_product_candidates", on(lambda c: op.product_candidates(c.entity, c.own_brands)), """
SELECT run_id, name, coalesce(p.n,0) AS own_n, coalesce(b.n,0) AS brand_n, CASE WHEN coalesce(b.n,0)<coalesce(p.n,0) THEN 'internal' ELSE 'external' END AS side
FROM q_prod p FULL JOIN q_brandc_e b USING (run_id, name)""")
PW = only("words", "(" + cls("x") + ")<>'explore'")
piece("q_sib", f"""
SELECT * FROM (SELECT run_id, core, coalesce(name, given, core) AS name, coalesce(n, seed_n, 1) AS n, coalesce(rank, r, 1000000) AS rank, coalesce(seed_n,0) AS seed_n,
  (coalesce(cluster,false) OR seed_n IS NOT NULL) AS cluster, coalesce(scope,false) AS scope FROM
  (SELECT run_id, array_to_string(p,'') AS core, arg_min(array_to_string(p,' '), (rank, array_to_string(p,' '))) AS name, count(*) AS n, min(rank) AS rank, bool_or(list_contains(srcs,'cluster')) AS cluster
    FROM (SELECT *, {PW} AS p FROM q_parsed_c) WHERE NOT has_item AND len(p) BETWEEN 1 AND 2 AND {are('p', "<>'residual'")}=0
      AND len(list_filter(heads, lambda h: ends_with(array_to_string(p,''), h) AND array_to_string(p,'')<>h))>0 GROUP BY ALL) a
  FULL JOIN (SELECT run_id, core, count(*) AS seed_n FROM (SELECT p.run_id, ({only('words', '(' + cls('x') + ")='residual'")})[-1] AS core FROM q_parsed_c p JOIN q_gnodes g ON g.run_id=p.run_id AND g.query=p.query WHERE NOT has_item)
    WHERE length(core)>=2 AND NOT regexp_matches(core,'^[\\d.a-z]{{1,3}}$') GROUP BY ALL HAVING count(*)>=2) b USING (run_id, core)
  FULL JOIN (SELECT run_id, replace(given,' ','') AS core, max(given) AS given, bool_or(scope) AS scope FROM (
      SELECT run_id, unnest(sib_names) AS given, true AS scope FROM q_conf_c UNION ALL SELECT run_id, unnest(nears), false FROM q_conf_c) GROUP BY ALL) g USING (run_id, core)
  LEFT JOIN (SELECT run_id, replace(t,' ','') AS core, min(rank) AS r FROM q_parsed_c GROUP BY ALL) x USING (run_id, core)) s
WHERE NOT (len(string_split(name,' '))=2 AND (EXISTS (FROM q_brandc_c b WHERE b.run_id=s.run_id AND b.name=split_part(s.name,' ',1))))""")
piece("q_sib2", """
SELECT * FROM q_sib s WHERE NOT (len(string_split(name,' '))=2 AND (SELECT count(DISTINCT name) FROM q_sib0 o WHERE o.run_id=s.run_id AND len(string_split(o.name,' '))=2 AND split_part(o.name,' ',1)=split_part(s.name,' ',1))>=2)""")
piece("q_sib0", "SELECT * FROM q_sib")
SIB = ["run_id", "core", "name", "n", "rank", "seed_n", "cluster", "scope"]
check("G11_sibling_candidates", on(lambda c: c.peers.select(*SIB)), f"SELECT {', '.join(SIB)} FROM q_sib2")
piece("q_close", f"""
SELECT s.run_id, core, count(*) AS mentions, sum(({has_words('words', 't', 'compare')})::int)::bigint AS compares FROM q_sib2 s JOIN q_parsed_c p ON p.run_id=s.run_id
WHERE contains(replace(t,' ',''), core) AND len(list_filter(items, lambda i: contains(replace(replace(t,' ',''), core, '#'), i)))>0 GROUP BY ALL""")
CLOSE = "seed_n>=2 OR coalesce(mentions,0)>=2 OR coalesce(compares,0)>=1"
check("G12_closeness_evidence", on(lambda c: op.closeness(c.peers, c.category, c.spec(CATEGORY)).select("run_id", "core", "seed_n", "mentions", "compares", "near")), f"""
SELECT run_id, core, seed_n, coalesce(mentions,0) AS mentions, coalesce(compares,0) AS compares,
  CASE WHEN {CLOSE} THEN 'near' WHEN scope THEN 'area' ELSE 'weak' END AS near FROM q_sib2 LEFT JOIN q_close USING (run_id, core)""")


def _far(c):
    near = op.closeness(c.peers, c.category, c.spec(CATEGORY)).select("run_id", F.concat(F.lit("peer:"), F.col("core")).alias("bundle_id"),
                                                                      F.when(F.col("core") == "widget", "area").otherwise(F.col("near")).alias("near"))
    return demand.far_peers(fd.kept(c.dom).where(~F.col("small")), near)


check("F20_far_peers", on(_far), f"""
SELECT p.run_id, bundle_id, CASE WHEN core='widget' THEN 'area' ELSE CASE WHEN {CLOSE} THEN 'near' WHEN scope THEN 'area' ELSE 'weak' END END AS near
FROM q_peers p JOIN (SELECT * FROM q_sib2 LEFT JOIN q_close USING (run_id, core)) s ON s.run_id=p.run_id AND p.bundle_id='peer:' || core
WHERE NOT small AND pos<=10 AND (core='widget' OR NOT ({CLOSE}))""")
BUNDLE_WORD = "CASE gl " + " ".join(f"WHEN '{gl}' THEN x IN (" + ", ".join(f"'{w}'" for _, ws in m.bundles for w in ws) + ")" for gl, m in op.MARKETS.items()) + " END"
TOPIC = only("rest_item", f"({cls('x')}) IN ('attr','residual') AND length(x)>=2 AND NOT regexp_matches(x,'^[\\d.]+$') AND NOT ({BUNDLE_WORD})")
check("G13_topic_candidates", on(lambda c: op.topic_candidates(c.category, c.brands).select("run_id", "name", "n", "rank")), f"""
SELECT run_id, name, count(*) AS n, min(rank) AS rank FROM (SELECT run_id, rank, unnest({TOPIC}) AS name FROM q_parsed_c WHERE len(rest_item)>0 AND {CLEAN_I}) x
WHERE NOT EXISTS (FROM q_brandc_c b WHERE b.run_id=x.run_id AND b.name=x.name) GROUP BY ALL HAVING count(*)>=2""")


def pool(c, seeds):
    if seeds is CATEGORY:
        return op.name_pool(c.category, c.brands, c.synonyms, c.peers, c.terms(seeds), c.spec(seeds))
    synonyms = op.synonym_candidates(c.entity, c.own_brands, c.spec(seeds))
    return op.name_pool(c.entity, c.own_brands, synonyms, synonyms.limit(0), c.terms(seeds), c.spec(seeds))


def spellings(seeds):
    def run(c):
        peers = (c.peers if seeds is CATEGORY else c.own_brands).select("run_id", "name")
        short = peers.select("run_id", F.substring("name", 1, 2).alias("name"))
        return op.peer_spellings(peers.unionByName(short).unionByName(c.index.select("run_id", F.lit("brand").alias("name")).distinct()).distinct(), pool(c, seeds))
    return run


piece("q_pool_c", "SELECT run_id, name, min(rank) AS rank FROM (SELECT run_id, name, rank FROM q_syn_c UNION ALL SELECT run_id, name, rank FROM q_sib2) GROUP BY ALL")
HEADS2 = "list_filter(string_split(trim(h),' '), lambda x: x<>'')"
piece("q_pool_e", f"""
WITH names AS (SELECT run_id, unnest(items) AS n FROM q_conf_e UNION SELECT s.run_id, s.name FROM q_syn_e s JOIN q_conf_e k USING (run_id)
    WHERE k.mode='entity' AND NOT contains(s.name,' ') AND len(list_filter(k.heads, lambda h: ends_with(s.name, h)))>0),
rx AS (SELECT run_id, string_agg(n, '|' ORDER BY length(n) DESC, n) AS any_rx FROM names GROUP BY 1),
cuts AS (SELECT *, regexp_replace(t, '(' || any_rx || ').*$', '') AS h FROM q_parsed_e JOIN rx USING (run_id) WHERE mode='entity' AND NOT has_brand AND regexp_matches(t, any_rx)),
heads AS (SELECT *, {HEADS2} AS hw, regexp_replace(substr(t, length(h)+1), '^(' || any_rx || ')', '') AS tail FROM cuts)
SELECT run_id, name, min(rank) AS rank FROM (
  SELECT b.run_id, b.name, b.rank FROM q_brandc_e b JOIN q_conf_e k USING (run_id) WHERE k.mode='entity'
  UNION ALL SELECT run_id, array_to_string(hw,' '), rank FROM heads WHERE len(hw) BETWEEN 1 AND 2 AND trim(tail)='' AND {are('hw', "<>'residual'")}=0 AND len(list_filter(hw, lambda w: NOT list_contains(words, w)))=0
  UNION ALL SELECT s.run_id, s.name, s.rank FROM q_syn_e s JOIN q_conf_e k USING (run_id) WHERE k.mode<>'entity') GROUP BY ALL""")


def spelling_sql(peers, pool):
    return f"""
WITH pool AS (SELECT *, replace(name,' ','') AS core FROM {pool} WHERE length(replace(name,' ',''))>=2),
ok AS (SELECT * FROM pool p WHERE NOT contains(name,' ') OR EXISTS (FROM pool j WHERE j.run_id=p.run_id AND NOT contains(j.name,' ') AND j.core=p.core))
SELECT run_id, peer, spelling, rank, pos::int AS pos FROM (SELECT *, row_number() OVER (PARTITION BY run_id, peer ORDER BY rank, spelling) AS pos FROM (
  SELECT DISTINCT s.run_id, s.name AS peer, o.name AS spelling, o.rank FROM (SELECT run_id, name FROM {peers} UNION SELECT run_id, substr(name, 1, 2) FROM {peers} UNION SELECT DISTINCT run_id, 'brand' FROM q_index) s JOIN ok o ON o.run_id=s.run_id AND o.name<>s.name
    AND length(replace(s.name,' ',''))>=2 AND (contains(o.core, replace(s.name,' ','')) OR contains(replace(s.name,' ',''), o.core)))) WHERE pos<=10"""


check("G14_peer_spelling_candidates", on(spellings(CATEGORY)), spelling_sql("q_sib2", "q_pool_c"))
check("G14_peer_spelling_entity", on(spellings(ENTITY)), spelling_sql("q_brandc_e", "q_pool_e"))
check("G14_latin_pool", on(lambda c: op.latin_pool(pool(c, ENTITY), c.spec(ENTITY))), """
SELECT p.run_id, name, rank FROM q_pool_e p JOIN q_gl USING (run_id) WHERE gl<>'us' AND regexp_matches(name, '^[a-z][a-z0-9 .&''-]*$') AND length(name)>=2""")


def seed_queries(c, seeds):
    """The seed's own related list: queries that name the item."""
    return c.parsed(seeds).where((F.col("item_at") > 0) & F.array_contains("srcs", "intent:related"))


for short in "ec":
    piece(f"q_seedq_{short}", f"SELECT *, (string_split(trim(head_text),' '))[-1] AS w FROM q_parsed_{short} WHERE has_item AND list_contains(srcs,'intent:related')")
    piece(f"q_comp_{short}", f"""
SELECT run_id, n AS queries, {R('own/n', 3)} AS seed_brand_share, coalesce(seen,0) AS brands_seen, {R('coalesce(top,0)/n', 3)} AS top_brand_share, {R('mod/n', 3)} AS modifier_share,
  CASE WHEN branded AND own/n>=0.5 THEN 'entity' WHEN coalesce(seen,0)>=2 AND coalesce(top,0)/n<0.5 THEN 'category' END AS mode FROM (
  SELECT run_id, bool_or(brand_rx IS NOT NULL) AS branded, count(*) AS n, count(*) FILTER (has_brand) AS own, count(*) FILTER (NOT has_brand AND {are('words', "IN ('explore','attr')")}>0) AS mod FROM q_seedq_{short} GROUP BY 1)
LEFT JOIN (SELECT run_id, count(*) AS seen, max(c) AS top FROM (SELECT run_id, w, count(*) AS c FROM q_seedq_{short}
  WHERE w<>'' AND ({cls('w')})='residual' AND NOT coalesce(regexp_matches(w, '^(' || brand_rx || ')'), false) GROUP BY ALL) GROUP BY 1) USING (run_id)""")
check("G15_mode_by_composition", on(lambda c: op.composition(seed_queries(c, ENTITY), c.spec(ENTITY))), "SELECT * FROM q_comp_e")
check("G15_mode_of_categories", on(lambda c: op.composition(seed_queries(c, CATEGORY), c.spec(CATEGORY))), "SELECT * FROM q_comp_c")
FLAT_T = "replace(t,' ','')"
piece("q_hts", f"""
SELECT run_id, count(*) AS n, {R(f"avg((len(list_filter(items, lambda i: ends_with({FLAT_T}, i)))>0)::int)", 3)} AS head, {R("avg((len(list_filter(items, lambda i: list_contains(words, i)))>0)::int)", 3)} AS token
FROM q_parsed_c WHERE len(list_filter(items, lambda i: contains({FLAT_T}, i)))>0 GROUP BY 1""")
check("G17_head_token_share", on(lambda c: op.head_token_share(c.index, c.items)), "SELECT * FROM q_hts")


def gate(c, seeds=CATEGORY):
    return op.broad_gate(op.head_token_share(c.index, c.items), c.spec(seeds))


GATE = "CASE WHEN domain OR (mode='category' AND head<0.45 AND token<0.70) THEN 'broad' WHEN mode='entity' AND opt AND brand_items>=2 THEN 'brandwide' ELSE 'none' END"
check("G18_broad_seed_gate", on(gate), f"SELECT h.*, {GATE} AS gate FROM q_hts h JOIN q_conf_c USING (run_id)")
check("G18_brandwide_gate", on(lambda c: gate(c, ENTITY)), f"SELECT h.*, {GATE} AS gate FROM q_hts h JOIN q_conf_e USING (run_id)")


def _fit(c):
    rows, spec = seed_queries(c, CATEGORY), c.spec(CATEGORY)
    return op.seed_fit(rows, gate(c), op.composition(rows, spec), spec)


def shares_of(own, attr):
    mine = f"CASE WHEN gl='us' THEN len(list_filter(words, lambda w: list_contains({own}, w)))>0 ELSE len(list_filter({own}, lambda w: contains(t, w)))>0 END"
    return f"avg((CASE WHEN len({own})>0 THEN {mine} ELSE {has_words('words', 't', attr)} END)::int)"


check("G16_seed_fit_check", on(_fit), f"""
SELECT run_id, {R('b', 3)} AS buy_share, {R('h', 3)} AS how_share, CASE WHEN gate<>'none' THEN gate WHEN told='category' AND b<0.10 AND h>=b THEN 'topic' WHEN mode IS DISTINCT FROM told THEN 'mode' ELSE 'fit' END AS verdict
FROM (SELECT run_id, any_value(mode) AS told, {shares_of('buys', 'buy')} AS b, {shares_of('hows', 'how')} AS h FROM q_seedq_c GROUP BY 1)
LEFT JOIN (SELECT run_id, {GATE} AS gate FROM q_hts JOIN q_conf_c USING (run_id)) USING (run_id) LEFT JOIN (SELECT run_id, mode FROM q_comp_c) USING (run_id)""")


def _scope(c):
    """Candidates are adjective and item; their four year totals come from the series of that part."""
    w = F.split("query", " ")
    q = c.raw_lists.where((F.col("source") == "related") & (w[2] == "ring")).select("run_id", w[1].alias("candidate"), "query")
    shares = op.head_token_share(q, c.by_run([(r, "ring") for r in RUNS], "run_id string, name string"), ["run_id", "candidate"])
    part = fd.rows(c.dom).where("role = 'part'").select("run_id", F.substring("bundle_id", 6, 100).alias("candidate"), "t")
    buys = q.groupBy("run_id", "candidate").agg(F.avg(F.col("query").endswith("promo").cast("double")).alias("buy_share"))
    return op.scope_score(shares.withColumn("head", F.col("head") + 0.45), part.withColumn("t", F.transform("t", lambda v: v * 20)), buys)


check("G19_scope_score", on(_scope), f"""
WITH c AS (SELECT run_id, split_part(keyword,' ',2) AS candidate, count(*) AS n, {R("avg(ends_with(keyword,'ring')::int)", 3)}+0.45 AS head, avg(ends_with(keyword,'promo')::int) AS buy_share
  FROM q_related WHERE split_part(keyword,' ',3)='ring' GROUP BY ALL),
g AS (SELECT c.*, coalesce(floor(t3*20/12+0.5),0) AS avg, t3*20/nullif(t0*20,0)-1 AS gt, CASE WHEN t3 IS NULL OR coalesce(floor(t3*20/12+0.5),0)<1000 OR t0<=0 OR head<0.45 THEN 'unfit' WHEN n<30 THEN 'caution' ELSE 'fit' END AS grade
  FROM c LEFT JOIN (SELECT run_id, substr(bundle_id,6) AS candidate, t0, t3 FROM q_rows WHERE role='part') USING (run_id, candidate))
SELECT run_id, candidate, n, head, buy_share, avg, gt, grade, CASE grade WHEN 'fit' THEN 0 WHEN 'caution' THEN 1 ELSE 2 END AS place,
  grade='fit' AND row_number() OVER (PARTITION BY run_id, grade ORDER BY avg DESC, candidate)<=3 AS shown, (count(*) FILTER (grade<>'unfit') OVER (PARTITION BY run_id))-1>=3 AS siblings_enough FROM g""")
check("G20_scope_extract", on(lambda c: op.scope_extract(c.index.select("run_id", "query", "rank"), c.by_run(CANDIDATES, "run_id string, candidate string, name string"), c.spec(ENTITY), 2)), """
SELECT run_id, query, rank, candidate FROM (SELECT *, count(*) OVER (PARTITION BY run_id, candidate) AS k FROM (SELECT DISTINCT p.run_id, query, rank, candidate FROM q_parsed_e p JOIN (VALUES """ + ", ".join(
    f"('{r}', '{k}', '{n.replace(' ', '')}')" for r, k, n in CANDIDATES) + """) v(run_id, candidate, core) ON v.run_id=p.run_id AND contains(replace(t,' ',''), core)
  WHERE len(brand_keys)=0 OR len(list_filter(brand_keys, lambda b: contains(replace(t,' ',''), b)))>0)) WHERE k>=2""")
LL = only("coalesce(rest_both, rest_brand, rest_item, words)", "NOT regexp_matches(x,'^\\d+(\\.\\d+)?$')")
LK = "IN (" + ", ".join(f"'{b}'" for b in [*op.BAD, "explore", "attr"]) + ")"


def lines_of(run, words):
    return {k.partition(":")[2]: v for k, v in words.items() if k.startswith("line:")}


def held_lines(run, words):
    tests = []
    for line, names in lines_of(run, words).items():
        one = "|".join(n + ("($|[^a-z0-9])" if n.isascii() and n.isalnum() else "") for n in flat(names))
        tests.append(f"CASE WHEN regexp_matches(t, '(^| )({one})') THEN '{line}' END")
    return f"list_filter([{', '.join(tests)}], lambda l: l IS NOT NULL)"


check("G21_product_line_parts", on(lambda c: op.product_lines(c.entity, c.terms(ENTITY), "cluster")), f"""
WITH res AS (SELECT run_id, query, has_item, {only('rest_brand', '(' + cls('x') + ")='residual'")} AS r, len(rest_brand) AS k FROM q_parsed_e WHERE rest_brand IS NOT NULL),
other AS (SELECT run_id, token FROM (SELECT run_id, unnest(r) AS token, has_item, (NOT has_item AND len(r)=1 AND k=1) AS a FROM res) GROUP BY ALL
  HAVING bool_or(a) AND avg(has_item::int)<0.2 AND NOT list_contains({by_run(lambda r, w: sql_list(list(lines_of(r, w))))}, token)),
held AS (SELECT *, {LL} AS l, {by_run(held_lines)} AS hl FROM q_parsed_e)
SELECT run_id, hl[1] AS line, query, rank FROM held h WHERE len(hl)=1 AND (has_brand OR list_contains(srcs,'cluster')) AND {are('l', LK)}=0
  AND (has_item OR NOT EXISTS (FROM other o WHERE o.run_id=h.run_id AND list_contains(l, o.token)))""")


def topic_of(run, words):
    tests = [f"WHEN regexp_matches({FLAT_T}, {pattern(v)}) THEN '{k.partition(':')[2]}'" for k, v in words.items() if k.startswith("topic:")]
    return f"(CASE {' '.join(tests)} END)"


def bundle_sql():
    out = []
    for gl, m in op.MARKETS.items():
        text = "array_to_string(rest_item,' ')"
        test = lambda ws: "(" + " OR ".join(f"contains({text},'{w}')" for w in ws) + ")" if m.substring else any_word("rest_item", ws)  # noqa: E731,B023
        out.append(f"WHEN '{gl}' THEN CASE " + " ".join(f"WHEN {test(ws)} THEN '{n}'" for n, ws in m.bundles) + " END")
    return "CASE gl " + " ".join(out) + " END"


REGION = "CASE gl " + " ".join(f"WHEN '{gl}' THEN regexp_matches(h[1], '{m.region}') AND length(h[1])>=2" for gl, m in op.MARKETS.items() if m.region) + " ELSE false END"
check("G22_intent_bundle_parts", on(lambda c: op.intent_parts(c.category, c.terms(CATEGORY), c.spec(CATEGORY))), f"""
SELECT run_id, query, rank, bundle, CASE WHEN bundle='catchall' THEN CASE WHEN finding THEN 'finding' WHEN coalesce(list_contains(regions, h[1]) OR {REGION}, false) THEN 'region' ELSE 'name' END END AS kind FROM (
  SELECT *, coalesce(CASE WHEN picked THEN 'brands' END, {by_run(topic_of)}, {bundle_sql()},
    CASE WHEN catch_rx IS NOT NULL AND (finding OR (len(h) BETWEEN 1 AND 2 AND len({only('rest_item', 'NOT list_contains(h, x)')})=0 AND {are('h', "<>'residual'")}=0)) THEN 'catchall' END, 'unassigned') AS bundle
  FROM (SELECT *, list_filter(string_split(trim(head_text),' '), lambda x: x<>'') AS h, coalesce(regexp_matches({FLAT_T}, catch_rx), false) AS finding, coalesce(regexp_matches(t, '(^| )(' || picked_rx || ')'), false) AS picked FROM q_parsed_c)
  WHERE len(rest_item)>0 AND {CLEAN_I} AND {are('rest_item', NOT_GENERIC)}>0)""")


def _plan(c):
    peers = c.brands.select("run_id", F.col("name").alias("peer"), F.posexplode(F.array("name", F.replace("name", F.lit("#"), F.lit(" ")), F.upper("name"))).alias("v_ord", "variant"))
    items = c.by_run([(r, k, n) for r, gl in GL.items() for k, n in enumerate(PLAN_ITEMS[gl])], "run_id string, ord int, name string")
    return op.comparison_plan(peers, items, c.spec(ENTITY))


check("G23_comparison_plan", on(_plan), """
WITH v AS (SELECT run_id, name AS peer, v_ord, variant, mode FROM (SELECT run_id, name, mode, unnest([0,1,2]) AS v_ord, unnest([name, replace(name,'#',' '), upper(name)]) AS variant FROM q_brandc_c JOIN q_conf_e USING (run_id))),
items AS (SELECT * FROM (VALUES """ + ", ".join(f"('{r}', {k}, '{n}')" for r, gl in GL.items() for k, n in enumerate(PLAN_ITEMS[gl])) + """) i(run_id, i_ord, item))
SELECT run_id, peer, v_ord, i_ord, turn, query FROM (SELECT *, row_number() OVER (PARTITION BY run_id, peer, lower(replace(query,' ','')) ORDER BY v_ord, i_ord, turn) AS k FROM (
  SELECT run_id, peer, v_ord, i_ord, turn, CASE turn WHEN 0 THEN variant || ' ' || item ELSE item || ' ' || variant END AS query FROM v JOIN items USING (run_id), (VALUES (0),(1)) t(turn) WHERE mode='entity'
  UNION ALL SELECT run_id, peer, v_ord, 0, 0, variant FROM v WHERE mode<>'entity' AND v_ord<2)) WHERE k=1""")
