"""op2: single rules and odd rows; the whole table is compared with DuckDB in test_oracles."""

import random

from parley.llm import rules


def judged(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in rules.quality(docs).collect()}


def repeated(words, k=5):
    runs = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    return len({i + j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(k)})


def test_repeated_words(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["x " * 200]
    got = judged(spark, texts)
    assert {i: r.n_repeat_words for i, r in got.items()} == {i: repeated(t.split()) for i, t in enumerate(texts)}


def test_lines(spark):
    good = "The first of the many good lines of this text ends here.\nAnother one of them follows it and it ends as well."
    texts = [
        good, good + "\nHome | About | Contact | Terms", good + "\nAll rights reserved.", good + "\n" + good.split("\n")[0], "A | b | c | d | e | f\nOne | two | three | four | five",
        "BUY!! NOW!! CHEAP!! GOODS!! HERE!! TODAY!! ONLY!! FOR!! YOU!! ALL!! OF!! IT!!", good + "\nShort title\n\n \n", "Ten words that all stand here on one line without any ending",
    ]
    got = judged(spark, texts)
    assert [got[i].kept for i in range(len(texts))] == [True, True, True, False, False, False, True, True]
    assert all(got[i].clean_text == good for i in (0, 1, 2, 3, 6))
    assert (got[3].n_dup_lines, got[1].n_symbols, got[6].n_lines) == (1, 3, 3)


def test_one_mention_in_a_long_line(spark):
    """A long line that names a phrase stays; a short one, or one full of them, goes."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    long = " ".join(word() for _ in range(150)) + " click here " + " ".join(word() for _ in range(150)) + "."
    short = " ".join(word() for _ in range(10)) + " click here."
    full = " ".join(f"{word()} {word()} click here and log in to" for _ in range(20)) + "."
    got = judged(spark, [long, short, full])
    assert [got[i].kept for i in range(3)] == [True, False, False] and got[0].clean_text == long


def test_odd_rows(spark):
    long = "Word number one of this long text follows here now. " * 40_000
    got = judged(spark, [None, "", " \n\t\n", long, "x" * 2_000_000, "\x0ba\x0cb"])
    assert [got[i].n_words for i in range(6)] == [0, 0, 0, 400_000, 1, 2]
    assert not any(r.kept for r in got.values())
    docs = spark.createDataFrame([(1, "a", 9, "k")] * 2, "doc_id long, text string, n_words int, kept string")
    assert [r.n_words for r in rules.quality(docs).collect()] == [1, 1]
    assert [r.n_words for r in rules.quality(docs, prefix="q_").collect()] == [9, 9]
    assert rules.quality(docs.limit(0)).count() == 0
    assert rules.cleaned(docs).count() == 0
