"""op6: equal to the tokenizers library on odd texts and on whole documents."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm import bpe

tokenizers = pytest.importorskip("tokenizers")

ODD = [
    "", " ", "a", "It's THE end<|endoftext|>of <|startoftext|>x", "ΟΔΟΣ Σ ΣΑΣ", "İstanbul ǅ ﬁ", "é é ́",
    "a\x1cb\x1d c\x85d e　f", "123 4५6 ½", "👩‍👩‍👧 !!!???'s", "\x00\x7f�", "don't we'LL i'Ve 'd'", "#" * 3000, "ab" * 2000, "<|endoftext|><|endoftext|>",
]


@pytest.fixture(scope="module")
def pair():
    library = tokenizers.Tokenizer.from_file(bpe.production_path())
    return bpe.Tokenizer(bpe.production_path()), library


def same(pair, text):
    own, library = pair
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    raw, decoded = own.both(text)
    assert raw == b"".join(i.to_bytes(4, "little") for i in ids)
    assert decoded == own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(pair, text):
    same(pair, text)


@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_any_text(pair, text):
    same(pair, text)


@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet=st.characters(categories=["Mn", "Mc", "Me"]) | st.sampled_from("aeiouAÉ 가ᄀ\U00011935"), max_size=30))
def test_marks(pair, text):
    same(pair, text)


def test_every_character(pair):
    own, library = pair
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for around in ("", "a", "!", "1"):
        texts = [around + c + around for c in every]
        for lo in range(0, len(texts), 100_000):
            part = texts[lo : lo + 100_000]
            for t, e in zip(part, library.encode_batch(part, add_special_tokens=False)):
                assert own.encode(t) == e.ids, t


@pytest.mark.parametrize("before, after", [("ab", ""), ("", "ab"), ("a", "1"), ("é", " é")])
def test_every_character_beside_letters(pair, before, after):
    """Of the planes that have any."""
    own, library = pair
    every = [*range(0xD800), *range(0xE000, 0x33500), *range(0xE0000, 0xE0200), 0xF0000, 0x10FFFF]
    texts = [before + chr(i) + after for i in every]
    for lo in range(0, len(texts), 50_000):
        part = texts[lo : lo + 50_000]
        for t, e in zip(part, library.encode_batch(part, add_special_tokens=False)):
            assert own.encode(t) == e.ids, t


def test_random_texts(pair):
    """100,000 over all planes, mixed with letters, digits, marks and blanks."""
    own, library = pair
    rng = random.Random(5)
    every = [*range(0xD800), *range(0xE000, 0x33500), *range(0xE0000, 0xE0200)]
    one = lambda: chr(rng.choice(every)) if rng.random() < 0.5 else rng.choice("abcdé 1'!ß")
    for _ in range(10):
        texts = ["".join(one() for _ in range(rng.randint(1, 14))) for _ in range(10_000)]
        for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
            assert own.encode(t) == e.ids, t


def test_very_long_text(spark, pair):
    text = "Some words, 12 numbers and É ɐ " * 60_000 + "x" * 20_000
    row = bpe.encoded(spark.createDataFrame([(1, text)], "doc_id long, text string"), bpe.production_path(), keep=["doc_id"], outputs=("n_tokens", "ids_sha256")).first()
    ids = pair[1].encode(text, add_special_tokens=False).ids
    assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())


def test_documents(spark, sf_dir, pair):
    from parley.llm.registry import queries

    rows = {r.doc_id: r for r in queries()["op6_bpe"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        e = pair[1].encode(d.text, add_special_tokens=False)
        r = rows[d.doc_id]
        assert r.n_tokens == len(e.ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in e.ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(pair[1].decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_defined_results(spark, pair):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "hi  there", 6), (3, "", None)], "doc_id long, text string, n_tokens int")
    out = bpe.encoded(docs, bpe.production_path())
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    rows = sorted(out.collect(), key=lambda r: (r.doc_id or 0))
    assert [(r.doc_id, r.n_tokens, r.decoded) for r in rows] == [(None, 2, "hi</w> there</w>"), (1, 0, ""), (1, 0, ""), (3, 0, "")]
    assert rows[0].ids == pair[1].encode("hi there", add_special_tokens=False).ids
    assert bpe.encoded(docs.limit(0), bpe.production_path()).count() == 0


def test_words_that_come_back_late(monkeypatch):
    """300,000 other words between: each is merged once, and its strings are looked up once."""
    own, calls = bpe.Tokenizer(bpe.production_path()), []
    monkeypatch.setattr(own, "merged", lambda word: calls.append(word) or b"\1\0\0\0")
    digits = str.maketrans("0123456789", "abcdefghij")
    texts = [" ".join(str(i).translate(digits) for i in range(lo, lo + 1000)) for lo in range(0, 300_000, 1000)]
    first = [own.both(t) for t in texts]
    assert len(calls) == 300_000
    assert [own.both(t) for t in texts] == first and len(calls) == 300_000
