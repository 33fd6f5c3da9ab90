"""op3: against all pairs on the small table, and on families, chains and odd rows."""

import random

import pytest

from parley.llm import components as components_module
from parley.llm import minhash
from parley.llm.components import components
from tests.llm.brute import linked, word_sets


def check(spark, texts, k=2):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in minhash.near_duplicates(docs, k=k).collect()}
    sets = word_sets(texts, k)
    expected = linked(sets)
    assert {i: r.n_shingles for i, r in rows.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in rows.items()} == expected
    assert all(r.kept == (i == r.component_id) for i, r in rows.items())


def test_documents(spark, sf_dir):
    from parley.llm.registry import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    expected = linked(word_sets(texts, 2))
    got = {r.doc_id: r.component_id for r in queries()["op3_minhash"](spark, sf_dir).collect()}
    assert got == expected


def test_family_and_chain(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    texts = {}
    for i in range(60):  # a family around one text
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts[i] = " ".join(t)
    t = list(base[::-1])
    for i in range(100, 130):  # a chain: each step changes a little, the ends have nothing in common
        texts[i] = " ".join(t)
        for j in range(4):
            t[(4 * (i - 100) + j) % len(t)] = f"n{i}.{j}"
    for i in range(200, 230):  # one long common passage, else different
        texts[i] = " ".join(base[:60] + [f"u{i}.{j}" for j in range(30)])
    check(spark, texts)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(300_000))
    texts = {5: None, 3: "", 4: " \t\n", 1: "One", 2: "ONE", 7: "one two", 8: "One\x0bTWO ", 9: "Äß", 10: "äß", 11: long, 12: long + " y", 13: "z" * 3_000_000}
    check(spark, texts)
    check(spark, texts, k=5)
    docs = spark.createDataFrame([(1, "a b c", 0), (1, "a b c", 0), (None, "a b c", 0), (2, "q r", 1), (2, "s t", 1)], "doc_id long, text string, component_id int")
    rows = minhash.near_duplicates(docs, k=2).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in rows) == [(-1, 1, False), (1, 1, True), (1, 1, True), (2, 2, True), (2, 2, True)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert minhash.one_of_each(docs, k=2).count() == 3


@pytest.mark.parametrize("local", [0, 20, 10_000])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(components_module, "LOCAL_EDGES", local)
    edges = [(i, i + 1) for i in range(1, 60)] + [(200, 201), (202, 200), (7, 7), (300, 300)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(1, 61)), [200, 201, 202], [300]]


def test_recall(spark):
    """Pairs whose Jaccard is 0.80 to 0.90, apart from each other: all meet."""
    rng = random.Random(21)
    texts, n = {}, 0
    while n < 800:
        a = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(60, 200))]
        b = list(a)
        for _ in range(rng.randint(1, len(a) // 15)):
            b[rng.randrange(len(b))] = f"x{rng.randrange(10**9)}"
        x, y = ({tuple(w[j : j + 2]) for j in range(len(w) - 1)} for w in (a, b))
        if 0.8 <= len(x & y) / len(x | y) <= 0.9:
            texts[2 * n], texts[2 * n + 1] = " ".join(a), " ".join(b)
            n += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    root = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, k=2).collect()}
    met = sum(root[2 * i] == root[2 * i + 1] for i in range(n))
    print("recall of near pairs", met, "of", n)
    assert met >= 0.99 * n and len(set(root.values())) == 2 * n - met
