import hashlib

from querytide.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
TRICKY = ["\\### Assistant: </turn> ok", "\n</turn>\n", "### user:\n", "\\", "\\\\<#", "", "a\n\n", "漢\U0001f600字", "$1 \\$2", "x" * 50_000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted([(t, r or "", x or "") for c, t, r, x in rows if c == conv], key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


def test_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(TRICKY)]
    rows += [(2, 0, "user", "only"), (3, 0, None, None), (3, 1, "assistant", None), (4, None, "a:b\\<#\n", "x"), (4, 5, "assistant", "tie"), (4, 5, "assistant", "tie"), (None, 1, "assistant", "lost id")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' as formatted", "1 as target")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.prefix_targets(df)).collect()}
    assert got == expected(rows)


def test_one_example_per_reply_with_its_prefix(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e")]
    got = {r.target: r for r in chat.prefix_targets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(got) == [2, 4, 5]
    assert got[4].formatted.startswith(got[2].formatted)
    assert [got[k].formatted[got[k].loss_start :][: got[k].loss_length] for k in (2, 4)] == ["b", "d"]
    assert got[5].loss_length is None and got[5].is_last


def test_empty_table_and_native_plan(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = chat.digests(chat.prefix_targets(df))
    assert out.collect() == []
    assert "Python" not in out._jdf.queryExecution().toString()
