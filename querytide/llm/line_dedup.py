"""Line dedup: an exact set-similarity join between the lines of all documents, in DataFrame functions alone.

A line is the set of its distinct five-word shingles (single words would do as tokens too, but a language has few
of them, so their lists grow with the corpus). Tokens are ordered by rarity: a table of BUCKETS counts, over
the tokens of all lines, gives each token a class, and rarer classes come first. Two lines of similarity 0.8 share a
token among the first n - ceil(0.8 n) + 1 of both (prefix filter). Pairs from those tokens pass by the sizes
(length filter), by the places of the shared token (positional filter) and by 256-bit signatures, whose
differing bits bound the differing tokens from below; the rest is verified on the whole sets.

A line is removed if an earlier line (by doc_id, then line number) is similar to it. Equal sets are one point of the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.stage import staged, unstage

SHINGLE = 5
BUCKETS = 1 << 16  # a power of two
PERCENT = 80
COPIES = 64  # lines of one set that are posted one by one
LOW_BITS = (1 << 56) - 1
BROADCAST_ROWS = 1_000_000  # rows of two numbers; more are joined by a shuffle


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line for every line of every text; null and empty texts give none."""
    text = docs.where("doc_id is not null and text <> ''").select("doc_id", "text")
    return text.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _hashed_words(rows: DataFrame) -> DataFrame:
    """Rows with `words`, a 64-bit hash for every word of their line; lines without words go.

    The generator makes the hashes once; a plain column would be made for each use of it.
    """
    kept = [c for c in rows.columns if c != "line"]
    words = F.array_remove(F.split(F.lower("line"), r"[\x20\x09-\x0D]+"), "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return rows.select(*kept, F.explode(F.array(hashed)).alias("words")).where(F.size("words") > 0)


def _runs() -> Column:
    """The shingles of `words` as structs of five hashes; below five words one shingle, its missing words null."""
    many = F.greatest(F.size("words") - SHINGLE + 1, F.lit(1))
    return F.arrays_zip(*[F.slice("words", k + 1, many).alias(f"w{k}") for k in range(SHINGLE)])


def _tokenised(rows: DataFrame) -> DataFrame:
    """Rows with `items`, the distinct shingles of their line as 64-bit hashes; lines without words go."""
    hashed = _hashed_words(rows)
    token = F.transform(_runs(), lambda r: F.xxhash64(r))
    kept = [c for c in hashed.columns if c != "words"]
    return hashed.select(*kept, F.explode(F.array(F.array_distinct(token))).alias("items"))


def _all_tokens(rows: DataFrame) -> DataFrame:
    """`t`, every shingle of every line, repeats included: a row for each word that starts one, without functions over arrays, which are slower."""
    starts = F.arrays_zip(F.sequence(F.lit(0), F.greatest(F.size("words") - SHINGLE, F.lit(0))).alias("at"))
    return _hashed_words(rows).select("words", F.inline(starts)).select(F.xxhash64(*[F.get("words", F.col("at") + k) for k in range(SHINGLE)]).alias("t"))


def _rarity(rows: DataFrame) -> DataFrame:
    """One row: an array of BUCKETS classes, shifted to the top byte of a token's sort key."""
    counts = _all_tokens(rows).groupBy(F.col("t").bitwiseAND(BUCKETS - 1).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    kind = F.shiftleft(F.least(F.floor(F.log2(F.coalesce("c", F.lit(0)) + 1) * 4), F.lit(126)).cast("long"), 56)
    every = rows.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    pairs = F.array_sort(F.collect_list(F.struct("b", kind.alias("k"))))
    return every.agg(F.transform(pairs, lambda p: p["k"]).alias("classes"))


def _set_id(items: str) -> Column:
    return F.xxhash64(F.sort_array(items))


def _least(n: Column) -> Column:
    """The smallest overlap with a partner at the threshold: ceil(0.8 n)."""
    return F.floor((PERCENT * n + 99) / 100).cast("int")


def small_side(df: DataFrame) -> DataFrame:
    """Sent to all tasks if it has at most BROADCAST_ROWS rows (it is staged, so counting reads a footer)."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _signed(sets: DataFrame) -> DataFrame:
    """seg and its signature, four 64-bit words with a bit for each token; rows of one seg are one set, whose bits meet in no array."""
    x = F.col("x")
    part = F.shiftrightunsigned(x, 6).bitwiseAND(3)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
    words = [F.coalesce(F.bit_or(F.when(part == k, bit)), F.lit(0).cast("long")).alias(f"s{k}") for k in range(4)]
    return sets.select("seg", F.explode("items").alias("x")).groupBy("seg").agg(*words)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """seg and `items` of the wanted sets, read again from the lines where they come first; a set may come more than once."""
    few = small_side(wanted)
    in_docs = docs.join(few.select("doc_id").distinct(), "doc_id", "left_semi")
    return _tokenised(lines(in_docs).join(few, ["doc_id", "line_no"])).where(_set_id("items") == F.col("seg"))


def _alike(docs: DataFrame, pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pairs (a_seg, b_seg) that are similar, compared on the whole sets; sets that are in no pair are not read."""
    members = pairs.select(F.explode(F.array("a_seg", "b_seg")).alias("seg")).distinct()
    sets = _sets(docs, staged(wanted.join(members, "seg", "left_semi")))
    sets = staged(sets.select("seg", "items").dropDuplicates(["seg"]))
    left = sets.select(F.col("seg").alias("a_seg"), F.col("items").alias("ia"))
    right = sets.select(F.col("seg").alias("b_seg"), F.col("items").alias("ib"))
    common = F.size(F.array_intersect("ia", "ib"))
    alike = 100 * common >= PERCENT * (F.size("ia") + F.size("ib") - common)
    out = staged(pairs.join(left, "a_seg").join(right, "b_seg").where(alike).drop("ia", "ib"))
    unstage(sets)
    return out


def similar(docs: DataFrame, prefixes: DataFrame, firsts: DataFrame) -> DataFrame:
    """(b_seg, a_first): for every line set that is similar to one that comes first earlier, where such a one comes first."""
    posted = prefixes.select("seg", "n", F.posexplode("prefix").alias("at", "token"))
    same = W.partitionBy("token")  # a window, so that the tokens are shuffled once
    often = posted.select("*", F.min("seg").over(same).alias("lo"), F.max("seg").over(same).alias("hi")).where("lo <> hi")
    order = staged(often.drop("lo", "hi").distinct())
    wanted = staged(firsts.join(order.select("seg").distinct(), "seg", "left_semi").select("seg", "first.doc_id", "first.line_no"))
    signed = _signed(_sets(docs, wanted))  # whole sets are read once pairs are known
    first = wanted.select("seg", F.struct("doc_id", "line_no").alias("first"))
    side = staged(order.join(signed.join(first, "seg"), "seg"))
    fields = ["seg", "n", "at", "s0", "s1", "s2", "s3", "first"]
    named = lambda df, who: df.select("token", *[F.col(c).alias(f"{who}_{c}") for c in fields])
    both = F.col("a_n") + F.col("b_n")
    overlap = F.ceil(both * PERCENT / (100 + PERCENT))  # least overlap of two such sets
    rest = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    differing = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_s{k}").bitwiseXOR(F.col(f"b_s{k}"))) for k in range(4)])
    passes = (
        (F.col("a_first") < F.col("b_first"))
        & (100 * F.least("a_n", "b_n") >= PERCENT * F.greatest("a_n", "b_n"))
        & (rest >= overlap)
        & (both - differing >= 2 * overlap)
    )

    def verified(earlier: DataFrame, later: DataFrame) -> DataFrame:
        pairs = named(earlier, "a").join(named(later, "b"), "token").where(passes).select("a_seg", "b_seg", "a_first").distinct()
        return _alike(docs, staged(pairs), wanted).select("b_seg", "a_first")

    # most lines of a group are like its first one: they need no other partner
    leaders = side.groupBy("token").agg(F.min_by(F.struct(*fields), "first").alias("l")).select("token", "l.*")
    led = verified(leaders, side)
    rest_of = side.join(led.select(F.col("b_seg").alias("seg")).distinct(), "seg", "left_anti")
    return led.unionByName(verified(side, rest_of))


def _without_copies(marked: DataFrame, firsts: DataFrame) -> DataFrame:
    """seg, n and prefix of the lines; of a set that more than COPIES lines have, only those at its first place, lest its tokens fill one task."""
    common = firsts.where(F.col("rows") > COPIES).select("seg", "first")
    lone = F.col("first").isNull() | (F.struct("doc_id", "line_no") == F.col("first"))
    return marked.join(small_side(staged(common)), "seg", "left").where(lone).select("seg", "n", "prefix")


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted numbers of the lines to remove, for documents that have any."""
    items = _tokenised(lines(docs))
    classes = _rarity(lines(docs)).scalar()
    kind = lambda x: F.coalesce(F.get(F.col("_classes"), x.bitwiseAND(BUCKETS - 1).cast("int")), F.lit(0).cast("long"))  # noqa: E731  never null, so that longs are sorted
    key = lambda x: kind(x).bitwiseOR(x.bitwiseAND(LOW_BITS))
    n = F.size("items")
    marked = items.withColumn("_classes", classes).select(
        "doc_id", "line_no", n.alias("n"), _set_id("items").alias("seg"),
        F.slice(F.sort_array(F.transform("items", key)), F.lit(1), n - _least(n) + 1).alias("prefix"),
    )
    marked = staged(marked)
    place = F.struct("doc_id", "line_no")
    firsts = staged(marked.groupBy("seg").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows")))
    links = staged(similar(docs, _without_copies(marked, firsts), firsts))
    linked = links.groupBy(F.col("b_seg").alias("seg")).agg(F.min("a_first").alias("near"))
    bounds = firsts.join(linked, "seg", "left").where("rows > 1 or near is not null")
    bounds = staged(bounds.select("seg", F.least("first", F.coalesce("near", "first")).alias("bound")))
    gone = marked.select("doc_id", "line_no", "seg").join(small_side(bounds), "seg").where(place > F.col("bound"))
    out = staged(gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("gone")))
    unstage(marked)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with `text` freed of removed lines, and n_lines, n_removed.

    Lines end at \\n; a line without words is never removed and removes nothing. Null and empty texts and null
    doc_ids stay as they are; rows with equal doc_id are taken as one document, so a repeated row loses what the
    other loses; an empty table gives no rows. Columns named n_lines or n_removed are replaced.
    """
    gone = removed_lines(docs)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    parts = F.split("text", "\n", -1)
    listed = F.coalesce("_gone", F.array().cast("array<int>"))
    joined = docs.select(*kept).join(small_side(gone.withColumnRenamed("gone", "_gone")), "doc_id", "left")
    left = F.filter(parts, lambda x, i: ~F.array_contains(listed, i))
    joined = joined.withColumn("n_lines", F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(parts)).cast("long"))
    joined = joined.withColumn("n_removed", F.least(F.size(listed), F.col("n_lines")).cast("long"))
    text = F.when(F.size(listed) == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.withColumn("text", text).select(*kept, "n_lines", "n_removed")
