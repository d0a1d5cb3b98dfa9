"""Chat formatting: every assistant turn becomes an example of its own.

The template writes a turn as a header `### role:`, the text, and a line `</turn>`. In texts and roles a
backslash goes before every backslash, `#` and `<` (in roles also `:`), so no text can hold a mark of
the template and every turn reads back as it was.
"""

from pyspark.sql import Column, DataFrame, functions as F

ASSISTANT = "assistant"
END = "\n</turn>\n"
HEAD = r"^### ([^:\\]*+(?:\\.[^:\\]*+)*+):\n"


def escape(text: Column, marks: str = r"\\#<") -> Column:
    return F.regexp_replace(text, f"([{marks}])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn: the turns before it as context, only its text trainable.

    Input columns conv_id, turn, role, text; others are ignored. Output: conv_id, target (position of the
    last turn of the example, from 1), formatted, loss_start and loss_length (code points in `formatted`,
    from 0; the text between is the escaped reply), is_last (the example holds the whole conversation).
    A conversation that does not end in an assistant turn gives one more example without loss
    (loss_length null), so that no turn is lost. Null texts and roles are empty; rows order by turn,
    then role and text; repeated rows stay; an empty table gives no rows. A conversation is one row
    while it is formatted, as its examples are.
    """
    turn = F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    whole = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit("### "), escape(t["role"], r"\\#<:"), F.lit(":\n"))
    written = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END))).alias("blocks"),
        F.transform(
            "turns",
            lambda t, i: F.struct(
                (i + 1).alias("target"),
                (t["role"] == ASSISTANT).alias("trainable"),
                F.char_length(head(t)).alias("head"),
                F.char_length(escape(t["text"])).alias("body"),
            ),
        ).alias("marks"),
    )
    last = F.size("blocks")
    one = written.select(
        "conv_id", "blocks", last.alias("n"),
        F.explode(F.filter("marks", lambda m: m["trainable"] | (m["target"] == last))).alias("m"),
    )
    context = F.array_join(F.slice("blocks", F.lit(1), F.col("m.target") - 1), "")
    return one.select(
        "conv_id",
        F.col("m.target").alias("target"),
        F.array_join(F.slice("blocks", F.lit(1), F.col("m.target")), "").alias("formatted"),
        F.when(F.col("m.trainable"), F.char_length(context) + F.col("m.head")).alias("loss_start"),
        F.when(F.col("m.trainable"), F.col("m.body")).alias("loss_length"),
        (F.col("m.target") == F.col("n")).alias("is_last"),
    )


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds."""
    parts = F.split(formatted, END, -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, HEAD, 1)).alias("role"),
            unescape(F.substring(p, F.char_length(F.regexp_extract(p, HEAD, 0)) + 1, F.char_length(p))).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, from its examples alone: turns, digests of turns and of the loss, characters."""
    turns = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.when(
        F.col("loss_length").isNotNull(),
        F.struct("target", unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length"))).alias("text")),
    )
    rows = examples.select(
        "conv_id", loss.alias("loss"), F.char_length("formatted").cast("long").alias("chars"),
        F.when(F.col("is_last"), F.struct(F.size(turns).cast("long").alias("n"), F.sha2(F.array_join(turns, ""), 256).alias("sha"))).alias("whole"),
    )
    said = F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["text"]), "")
    return (
        rows.groupBy("conv_id")
        .agg(F.max("whole").alias("whole"), said.alias("said"), F.sum("chars").alias("formatted_chars"))
        .select(
            "conv_id", F.col("whole.n").alias("n_turns"), F.col("whole.sha").alias("turns_sha256"),
            F.char_length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), "formatted_chars",
        )
    )
