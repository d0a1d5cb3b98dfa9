"""Small tables with the hard cases that every operator has to take."""

import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(k: int, n: int) -> str:
    return " ".join(f"w{(k * 7919 + i * i * 31 + i) % 9973}" for i in range(n))


def hard_texts() -> list[tuple]:
    base = sentence(1, 60)
    near = base.replace(base.split()[30], "changed")
    rows = [
        (1, base), (2, near), (3, base), (4, None), (5, ""), (6, "  \t\n "), (7, "one"), (8, "ONE"), (9, sentence(2, 40) + "\n" + base),
        (10, sentence(3, 4000)), (11, "é" * 300 + " 漢字 \U0001f600 idiot"), (3, base), (12, "a " * 500), (13, base.upper()), (None, "no id here at all"), (14, sentence(4, 4)),
    ]
    return [(i, t, None if i == 7 else "en", None if i == 8 else f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]


def documents(spark, rows=None, extra=()):
    docs = spark.createDataFrame(hard_texts() if rows is None else rows, SCHEMA).repartition(3)
    return docs.withColumns({name: F.lit("own") for name in extra})


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
