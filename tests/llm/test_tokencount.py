"""op12: as many tokens as the tokenizers library has, on odd texts, all characters and whole documents."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm import tokencount
from parley.llm.registry import queries

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    path = tokencount.production_path()
    return tokencount.Counter(path), tokenizers.Tokenizer.from_file(path)


def plainly(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_merges_rank_after_what_they_hold(pair):
    """What merging all occurrences at once rests on."""
    merges = pair[0].merges
    born = {int(s): r for r, s in enumerate(merges.made)}
    assert len(born) == len(merges.made)
    keys = merges.keys[merges.keys >= 0]
    for key, rank in zip(keys.tolist(), merges.ranks[merges.keys >= 0].tolist()):
        left, right = divmod(key, tokencount.WIDE)
        assert max(born.get(left, -1), born.get(right, -1)) < rank


def test_odd_texts(pair):
    own, library = pair
    texts = [
        "", " ", "  ", " a", "a ", "a  b", "a\n b", "a\n\n  b \n", "\n", "it's 'S we'll 'LL'd", "a<|endoftext|>b <|endoftext|> <|endoftext|>", "x" * 9, "aaa" * 5, "y" * 30_000,
        " " * 5000, "#" * 3000, "ab" * 9999, "a1" * 60_000, "tab\tx\x0b\x0c\x1c\x85\xa0  y", "é é 한국어 👩‍👩‍👧 ½4 五", "<|endoftext|", "Hello " * 40_000 + "\t" + "w" * 70_000,
    ]
    assert own.counts(texts) == plainly(library, texts)
    assert own.counts([None, "", None, "a"]) == [0, 0, 0, 1]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.characters(codec="utf-8") | st.sampled_from(" \n\t'saetrd<|>10é"), max_size=60), max_size=4))
def test_any_texts(pair, texts):
    assert pair[0].counts(texts) == plainly(pair[1], texts)


@pytest.mark.parametrize("before, after", [("a", " x"), (" ", "a")])
def test_every_character(pair, before, after):
    """Of the planes that have any."""
    own, library = pair
    every = [before + chr(i) + after for i in [*range(0xD800), *range(0xE000, 0x33500), *range(0xE0000, 0xE0200), 0xF0000, 0x10FFFF]]
    for lo in range(0, len(every), 100_000):
        part = every[lo : lo + 100_000]
        assert own.counts(part) == plainly(library, part)


def test_small_memory(pair, monkeypatch):
    """Texts cut into many small batches, hardly anything remembered."""
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("aeioutnrs") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    monkeypatch.setattr(tokencount, "TEXT_CHARS", 50)
    monkeypatch.setattr(tokencount, "PIECE_WORDS", 3)
    monkeypatch.setattr(tokencount, "REMEMBERED", 20)
    monkeypatch.setattr(tokencount, "REMEMBERED_CHARS", 4)
    texts += ["a1" * 400, "b\tc\n" * 200, "<|endoftext|>" * 5]
    own = tokencount.Counter(tokencount.production_path())
    assert own.counts(texts) == plainly(pair[1], texts)


def test_documents(spark, sf_dir, pair):
    rows = {r.doc_id: r for r in queries()["op12_token_counts"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d, n in zip(docs, plainly(pair[1], [d.text or "" for d in docs])):
        assert (rows[d.doc_id].n_bytes, rows[d.doc_id].n_tokens, rows[d.doc_id].over_limit) == (len((d.text or "").encode()), n, n > 512)


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "hi  there", 6), (3, "", None)], "doc_id long, text string, n_tokens int")
    out = tokencount.counted(docs, tokencount.production_path())
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = sorted(tuple(r) for r in out.na.fill(-1).collect())
    assert rows == [(-1, 9, 3, False), (1, 0, 0, False), (1, 0, 0, False), (3, 0, 0, False)]
    assert tokencount.counted(docs.limit(0), tokencount.production_path()).count() == 0
