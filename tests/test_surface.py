"""Grains in one pass, sketches, nested columns and SQL functions, on small tables and against the DataFrame functions."""

from pyspark.sql import functions as F

from parley.functions import nested
from parley.functions import sql as surface
from parley.functions import text as tx
from parley.operators import alignment, metrics, summaries
from parley.sources import conversations as src


def test_grains(spark, sf_dir):
    """The conditions' rows are those of the table by condition; all others add up."""
    turns = src.table_turns(spark, sf_dir)
    rows = {(r.grain, r.source, r.architecture, r.prompt_level, r.condition): r for r in summaries.by_grains(turns).collect()}
    for r in metrics.condition_table(turns).collect():
        own = next(x for k, x in rows.items() if k[0] == "condition" and k[4] == r.condition)
        assert (own.turns, own.conversations) == (r.turns, r.conversations) and abs(own.words_per_turn - r.words_per_turn) < 1e-9
    whole = rows["all", None, None, None, None]
    for grain in {k[0] for k in rows}:
        own = [x for k, x in rows.items() if k[0] == grain]
        assert sum(x.turns for x in own) == whole.turns and sum(x.conversations for x in own) == whole.conversations
        assert abs(sum(x.words_per_turn * x.turns for x in own) / whole.turns - whole.words_per_turn) < 1e-9
    plan = summaries.by_grains(turns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and summaries.by_grains(turns.limit(0)).filter("grain <> 'all'").isEmpty()


def test_sketches_merge(spark):
    """States of parts merge to the state of the whole."""
    turns = spark.range(3000).select((F.col("id") % 60).cast("string").alias("conv_id"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("condition"), F.concat_ws(" ", F.concat(F.lit("w"), F.translate((F.col("id") % 700).cast("string"), "0123456789", "abcdefghij")), F.repeat(F.lit("z "), (F.col("id") % 9).cast("int"))).alias("text"))
    turns = turns.union(turns.limit(1).withColumn("text", F.lit(None).cast("string")))
    states = summaries.sketches(turns)
    got = {r.condition: r for r in summaries.read(summaries.merged(states, "condition")).collect()}
    for c in "xy":
        assert abs(got[c].vocabulary - 351) <= max(1, 351 * summaries.HLL_ERROR) and 4 <= got[c].q50 <= 6
    assert summaries.read(summaries.merged(states.limit(0), "condition")).isEmpty()


def test_nested(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": [1, "x"]}, "k": 3}'), (2, '{"k": "t"}'), (3, "{bad"), (4, None), (5, "[1]"), (6, '{"k": 1, "key": 2}')], "i int, props string")
    v = rows.withColumn("v", nested.variant(F.col("props")))
    got = {r.i: (r.b, r.k) for r in v.select("i", nested.field(F.col("v"), "$.a.b[1]", "string").alias("b"), nested.field(F.col("v"), "$.k", "long").alias("k")).collect()}
    assert got == {1: ("x", 3), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, 1)}
    m = {r.i: r.m for r in rows.select("i", nested.renamed(nested.text_map(F.col("props")), {"k": "key"}).alias("m")).collect()}
    assert m[2] == {"key": "t"} and m[3] is None and m[4] is None and m[6] == {"key": "1"}
    assert "OBJECT" in nested.schema_of(v.filter("i < 3"), "v").first()[0] and nested.schema_of(v.limit(0), "v").first()[0] == "VOID"


TEXTS = ["Oh okay, uh-huh.", "", "  OK ", None, "Yes", "Bye, take care!", "participantA: hi", "one two three four", "déjà vu oh", "it's 'quoted'"]


def test_functions(spark):
    """SQL functions are the DataFrame ones."""
    surface.register(spark)
    surface.register(spark)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    rows.createOrReplaceTempView("said")
    from parley.functions import lexicon as lx

    t = F.col("text")
    own = {"n_words": tx.n_words(t), "clean_lower": tx.clean_lower(t), "is_fragment": tx.is_fragment(t), "is_closing": tx.has(t, lx.CLOSING), "is_leak": tx.has(t, lx.LEAK), **{f"n_{k}": tx.count(t, p) for k, p in lx.MARKERS.items()}}
    want = rows.select("i", *[c.alias(n) for n, c in own.items()]).orderBy("i").collect()
    got = spark.sql(f"SELECT i, {', '.join(f'{n}(text) AS {n}' for n in own)} FROM said ORDER BY i").collect()
    assert got == want
    lines = spark.sql(r"SELECT * FROM turns_of('ParticipantA: Hi: there\nno label\nParticipantB:\n B : ok') ORDER BY turn_index").collect()
    assert [tuple(r) for r in lines] == [(0, "ParticipantA", "Hi: there"), (1, "B", "ok")]


def test_alignment_by_hand(spark):
    turns = spark.createDataFrame(
        [("c", i, s, t, "x") for i, (s, t) in enumerate([("A", "the dog runs home"), ("B", "the dog runs away"), ("B", "said twice"), ("A", None), ("B", "...")])],
        "conv_id string, turn_index long, speaker string, text string, condition string",
    )
    got = {r.turn_index: r for r in alignment.ngram_alignment(turns).collect()}
    assert set(got) == {1, 3, 4}  # turn 2 follows its own speaker
    assert abs(got[1].lexical_tok2 - 2 / 3) < 1e-9 and abs(got[1].lexical_tok3 - 1 / 2) < 1e-9
    assert got[1].syntax_stan_tok2 == 1 / 1  # runs home, runs away: what is left of the classes, NNS NN
    assert got[3].lexical_tok2 is None and got[4].syntax_stan_lem3 is None
    assert alignment.ngram_alignment(turns.limit(0)).isEmpty()
    table = alignment.alignment_table(turns)
    assert table.count() == 3 and src.alignment_sections(table).filter("section = 'Earlier'").count() == 3


def test_alignment_roundtrip(spark, tmp_path):
    """The table that is written is what the reader and the models take."""
    turns = spark.createDataFrame([("c", i, "AB"[i % 2], f"we like to go home number {'ab'[i % 2]}", "x") for i in range(6)], "conv_id string, turn_index long, speaker string, text string, condition string")
    table = alignment.alignment_table(turns)
    table.write.option("header", True).csv(str(tmp_path / "align"))
    back = src.read_alignment(spark, str(tmp_path / "align"))
    assert back.columns == table.columns and back.count() == 5
    assert src.alignment_by_conversation(back).count() == 1 and src.alignment_sections(back).filter("lexical > 0.5").count() == 5


def test_meaning(spark):
    """Words that stand in the same surroundings come to be alike: turns that share none of them are near by meaning."""
    import random

    rng = random.Random(4)
    groups = [("cat", "kitten", "feline"), ("car", "truck", "wagon")]
    around = [["purr", "milk", "fur", "paw", "meow"], ["road", "wheel", "motor", "drive", "fuel"]]
    rows = []
    for i in range(1500):
        g = i % 2
        words = [rng.choice(around[g]) for _ in range(4)] + [rng.choice(groups[g])]
        rng.shuffle(words)
        rows.append((f"c{i // 10}", i % 10, "AB"[i % 2], " ".join(words)))
    schema = "conv_id string, turn_index long, speaker string, text string"
    vectors = alignment.word_vectors(spark.createDataFrame(rows, schema), size=16, seed=3, iterations=10, partitions=1)
    tests = [("t1", "kitten", "feline"), ("t2", "kitten", "truck"), ("t3", "wagon", "truck"), ("t4", "unknown", "truck"), ("t5", "", "truck")]
    pairs = spark.createDataFrame([(c, i, "AB"[i], t) for c, *two in tests for i, t in enumerate(two)], schema)
    got = {r.conv_id: r.cosine_semanticL for r in alignment.semantic_alignment(pairs, vectors).collect()}
    assert set(got) == {"t1", "t2", "t3"} and min(got["t1"], got["t3"]) > got["t2"] + 0.2
    given = spark.createDataFrame([("kitten", [1.0, 0.0]), ("feline", [1.0, 1.0])], "word string, v array<double>")
    assert abs(alignment.semantic_alignment(pairs, given).first().cosine_semanticL - 0.5**0.5) < 1e-9
    assert alignment.word_vectors(pairs.limit(0)).isEmpty()


def test_word_vectors_of_matrix(spark):
    """The vectors are those of the dense matrix, in however many partitions, and the driver gets products of components only."""
    import random
    from collections import Counter
    from math import log

    import numpy as np

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij"[i % 3 : i % 3 + 6]) for _ in range(12)) for i in range(60)] + ["once a", None, "", "k k k"]
    turns = spark.createDataFrame([(f"c{i // 10}", i % 10, "AB"[i % 2], t) for i, t in enumerate(texts)], "conv_id string, turn_index long, speaker string, text string")
    n = Counter()
    for ws in ((t or "").split() for t in texts):
        for i, w in enumerate(ws):
            for d, x in enumerate(ws[i + 1 : i + 4]):
                n[w, x] += 3 - d
                n[x, w] += 3 - d
    words = sorted("abcdefghijk")
    total = {w: sum(c for (a, _), c in n.items() if a == w) for w in words}
    whole = sum(x**0.75 for x in total.values())
    m = np.array([[max(0.0, log(n[a, b] * whole / (total[a] * total[b]) ** 0.875)) if n[a, b] else 0.0 for b in words] for a in words])
    values, axes = np.linalg.eigh(m)
    want = (axes * np.abs(values)) @ axes.T  # inner products of vectors as long as the roots of the values
    for partitions in (1, 5):
        got = {r.word: r.v for r in alignment.word_vectors(turns, size=16, window=3, iterations=2, partitions=partitions).collect()}
        assert sorted(got) == [w for i, w in enumerate(words) if m[i].any()]
        v = np.array([got.get(w, [0.0] * 16) for w in words])
        assert np.allclose(v @ v.T, want, atol=1e-6)
