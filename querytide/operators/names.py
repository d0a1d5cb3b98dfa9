"""Names from a table found in texts: many patterns at once, as data.

Names and texts meet by an equi-join on pieces of the text without its spaces, of the lengths that names of the run
have. The names are staged, so the planner knows whether they can go to every task. A hit is then mapped back to its place in the spaced text, where its boundaries are tested. A run's names may be
a handful or thousands; nothing is compared name by name.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cols, rank
from ..functions.stage import staged

LETTERS = "[a-z0-9]"


def keyed(names: DataFrame, name: str = "name") -> DataFrame:
    """Names with `core`, their key without spaces; names without any letter go."""
    return names.withColumn("core", cols.norm_kw(name)).where("core <> ''")


def places(text: Column) -> Column:
    """1-based places of the characters of a text that are not spaces."""
    every = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: F.substr(text, i, F.lit(1)) != " ")


def pieces(flat: Column, lengths: Column) -> Column:
    """(core, i): all pieces of the given lengths, i is the 1-based place in the text without spaces."""
    one = lambda k: F.transform(
        F.when(k <= F.length(flat), F.sequence(F.lit(1), F.length(flat) - k + 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.substr(flat, i, k).alias("core"), i.alias("i")))
    return F.flatten(F.transform(lengths, one))


def holding(texts: DataFrame, names: DataFrame, text: str = "text", distinct: bool = True) -> DataFrame:
    """Rows (run_id, text, core, i): the names (run_id, core) that a text holds when spaces are left out.

    With `distinct` one row for each name of a text, its first place, else every place. Only the text and the piece go through the join.
    """
    keys = staged(names.select("run_id", "core").distinct())
    lengths = keys.groupBy("run_id").agg(F.array_sort(F.collect_set(F.length("core"))).alias("_lens"))
    rows = rank.attached(texts.select("run_id", F.col(text).alias("text")).distinct(), lengths, ["run_id"])
    found = rows.select("run_id", "text", F.explode(pieces(F.replace("text", F.lit(" "), F.lit("")), F.col("_lens"))).alias("p")).select("run_id", "text", "p.*")
    found = rank.attached(found, keys, ["run_id", "core"]).select("run_id", "text", "core", "i")
    return found.groupBy("run_id", "text", "core").agg(F.min("i").alias("i")) if distinct else found


def occurrences(texts: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """Every place of a name in a text (run_id, text, kind, core, at, size, token).

    names: run_id, kind, core, bound. at and size are in the spaced text; token is what stands before in the same word. A bound
    name of Latin letters and digits only counts where neither side touches another of them.
    """
    found = holding(texts, names, text, distinct=False).join(staged(names.select("run_id", "kind", "core", "bound").distinct()), ["run_id", "core"])
    t, n = F.col("text"), F.length("core")
    spots = places(t)
    found = found.withColumn("_spots", spots).withColumn("at", F.get("_spots", F.col("i") - 1)).withColumn("_end", F.get("_spots", F.col("i") + n - 2) + 1)
    before = F.when(F.col("at") > 1, F.substr(t, F.col("at") - 1, F.lit(1))).otherwise("")
    after = F.substr(t, F.col("_end"), F.lit(1))
    touched = F.col("core").rlike(f"^{LETTERS}+$") & (before.rlike(LETTERS) | after.rlike(LETTERS))
    found = found.where(~(F.col("bound") & touched))
    token = F.when(F.col("at") > 1, F.regexp_extract(F.substr(t, F.lit(1), F.col("at") - 1), "[^ ]*$", 0)).otherwise("")
    return found.select("run_id", "text", "kind", "core", "bound", "at", (F.col("_end") - F.col("at")).alias("size"), token.alias("token"))


def first_places(texts: DataFrame, names: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Where a text names each kind first (run_id, text, kind, at, size): the earliest place, the longest name there.

    Bound names count at a word start or behind a word part that the run uses on its own (`known`: run_id, token). Their places are
    read from left to right without overlap, whether they count or not, as a reader would take them.

    Places and readings are staged: both are read twice, and a task that makes them holds no other aggregate besides.
    """
    hits = staged(occurrences(texts, names, text))
    key = ["run_id", "text", "kind"]
    spot = F.struct("at", (-F.col("size")).alias("less"), "size", "token")
    free = hits.where(~F.col("bound")).groupBy(*key).agg(F.min(spot).alias("s")).select(*key, "s.at", "s.size")
    lists = hits.where("bound").groupBy(*key).agg(F.array_sort(F.collect_set(spot)).alias("s"))  # as many as a text has letters, at most
    start = F.struct(F.lit(0).alias("end"), F.filter("s", lambda _: F.lit(False)).alias("kept"))
    step = lambda acc, x: F.when(
        x["at"] >= acc["end"], F.struct((x["at"] + x["size"]).alias("end"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
    read = lists.select(*key, F.explode(F.aggregate("s", start, step, lambda acc: acc["kept"])).alias("p")).select(*key, "p.at", "p.size", "p.token")
    read = staged(read)
    heads = read.where("token = ''").select(*key, "at", "size")
    glued = read.where("token <> ''").join(known.select("run_id", "token"), ["run_id", "token"], "left_semi").select(*key, "at", "size")
    bound = heads.unionByName(glued).groupBy(*key).agg(F.min(F.struct("at", "size")).alias("s")).select(*key, "s.at", "s.size")
    return free.unionByName(bound)
