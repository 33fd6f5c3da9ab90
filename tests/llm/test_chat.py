"""op1: prefixes, copies, and odd rows."""

from parley.llm import chat


def kept(spark, rows):
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    return {r.conv_id: r for r in chat.collapsed(log).collect()}


def talk(conv, *texts):
    return [(conv, i, "user" if i % 2 == 0 else "assistant", t, "x") for i, t in enumerate(texts)]


def test_collapse(spark):
    rows = talk(1, "a", "b") + talk(2, "a", "b", "c") + talk(3, "a") + talk(4, "a", "x") + talk(6, "a", "b", "c") + talk(5, "ab") + talk(7, "b", "a")
    got = kept(spark, rows[::-1])
    assert sorted(got) == [2, 4, 5, 7]
    assert got[2].n_equal == 2 and got[2].n_turns == 3
    assert got[4].chat == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a", ""), (1, None, None, None, ""), (1, 0, "user", "%s $1", ""), (2, 0, "user", "b", ""), (2, 0, "user", "b", ""), (3, 0, "user", "b", "")]
    rows += talk(9, *["long " * 50] * 300)
    got = kept(spark, rows)
    assert sorted(got) == [1, 2, 9]
    assert got[1].chat == "<|im_start|>unknown\n<|im_end|>\n<|im_start|>user\n%s $1<|im_end|>\n"
    assert got[2].n_turns == 2 and got[9].n_turns == 300
    assert kept(spark, []) == {}


def test_very_long_texts(spark):
    """One turn of several megabytes, and a conversation that begins with it and goes on."""
    long = "word " * 1_000_000
    got = kept(spark, talk(1, long) + talk(2, long, "and more") + talk(3, long + "x"))
    assert sorted(got) == [2, 3] and len(got[2].chat) > 5_000_000 and got[2].n_turns == 2


def test_many_copies(spark):
    rows = [r for c in range(500) for r in talk(c, "hi", "yes")] + talk(1000, "hi", "yes", "more")
    got = kept(spark, rows)
    assert sorted(got) == [1000]
