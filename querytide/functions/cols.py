"""Column expressions for the per-row rules: coercion, keys, intents, scores."""

from functools import reduce

from pyspark.sql import Column, functions as F

INTENTS = ("i", "n", "c", "t")

# Weight of each intent in the monetization index.
INTENT_WEIGHT = {"i": 0.2, "n": 0.0, "c": 0.5, "t": 1.0}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(x, digits: int) -> Column:
    """Round half up on the binary value: the one rounding rule used everywhere."""
    scale = F.lit(float(10**digits))
    return F.floor(col(x) * scale + F.lit(0.5)) / scale


def num(c, strip_commas: bool = False) -> Column:
    """Text to number; whatever is not a number counts as 0."""
    text = F.trim(col(c).cast("string"))
    if strip_commas:
        text = F.regexp_replace(text, ",", "")
    numeric = text.rlike(r"^[+-]?(\d+(_?\d+)*\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.coalesce(F.when(numeric, F.regexp_replace(text, "_", "")).try_cast("double"), F.lit(0.0))


def norm_kw(c) -> Column:
    """Key without any whitespace, lower case."""
    return F.lower(F.regexp_replace(col(c), r"\s+", ""))


def ns(c) -> Column:
    """Key without plain spaces, lower case."""
    return F.lower(F.replace(col(c), F.lit(" "), F.lit("")))


def norm(c) -> Column:
    """Single-spaced, trimmed, lower case."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"\s+", " "))


def nz(c) -> Column:
    """NULL when zero, for rules where zero means missing."""
    return F.nullif(col(c), F.lit(0.0))


def ratio(a, b) -> Column:
    return F.try_divide(col(a), col(b))


def intent_total(prefix: str = "") -> Column:
    return reduce(lambda a, b: a + b, [F.col(prefix + k) for k in INTENTS])


def dominant_intent(i="i", n="n", c="c", t="t", zero="") -> Column:
    """Intent with the largest share; ties go to the earlier of i, n, c, t."""
    i, n, c, t = (col(x) for x in (i, n, c, t))
    best = F.greatest(i, n, c, t)
    return (
        F.when(best <= 0, F.lit(zero))
        .when(i == best, "i")
        .when(n == best, "n")
        .when(c == best, "c")
        .otherwise("t")
    )


def intent_weight(i="i", n="n", c="c", t="t") -> Column:
    """Monetization index in [0, 1]; 0 without any intent."""
    parts = dict(zip(INTENTS, (col(x) for x in (i, n, c, t))))
    total = reduce(lambda a, b: a + b, parts.values())
    weighted = reduce(lambda a, b: a + b, [parts[k] * F.lit(w) for k, w in INTENT_WEIGHT.items()])
    return F.when(total > 0, ratio(weighted, total)).otherwise(F.lit(0.0))


def volume_norm(volume, max_log) -> Column:
    v = col(volume)
    return F.when((v > 0) & (col(max_log) > 0), F.least(F.log10(v + 1) / col(max_log), F.lit(1.0))).otherwise(0.0)


def opportunity_score(volume, competition, weight, max_log) -> Column:
    comp = F.least(F.greatest(F.coalesce(col(competition), F.lit(0.0)) / 100.0, F.lit(0.0)), F.lit(1.0))
    return half_up(volume_norm(volume, max_log) * (1.0 - comp) * (0.5 + 0.5 * col(weight)), 4)


def quadrant(volume, competition, median_volume, median_competition) -> Column:
    loud = F.coalesce(col(volume), F.lit(0.0)) >= col(median_volume)
    hard = F.coalesce(col(competition), F.lit(0.0)) >= col(median_competition)
    return (
        F.when(loud & ~hard, "priority")
        .when(loud & hard, "competitive")
        .when(~loud & ~hard, "niche")
        .otherwise("low")
    )


def cluster_letter(index) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, 702 -> AAA: the way sheet columns are named, for any index below 2**31."""
    n, letters = col(index).cast("bigint"), []
    for _ in range(7):  # 26**7 is above 2**31
        letters.insert(0, F.when(n >= 0, F.chr(F.lit(65) + n % 26)).otherwise(""))
        n = F.floor(n / 26) - 1
    return F.when(col(index).isNotNull(), F.concat(*letters))


def circular_distance(a, b) -> Column:
    """Distance between two calendar months, 0 to 6."""
    d = col(a) - col(b)
    return F.least(F.pmod(d, F.lit(12)), F.pmod(-d, F.lit(12)))


def two_x(own, top, floor) -> Column:
    """Who leads by a factor of two. A factor of two for the rival is tested first."""
    o, t = col(own), col(top)
    return (
        F.when((o < floor) & (t < floor), "none")
        .when(t >= 2 * o, "behind")
        .when(o >= 2 * t, "ahead")
        .otherwise("even")
    )
