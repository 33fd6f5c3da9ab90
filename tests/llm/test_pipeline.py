"""The pipeline against its stages done plainly, and its stages on odd tables."""

import pytest

import corpus_pipeline
from parley.llm import bpe, pii, rules
from tests.llm.brute import linked, word_sets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen[name] = docs.collect()
        assert i == 4 or docs.columns == COLUMNS
    judged = rules.quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    clean = {r.doc_id: r.clean_text for r in judged if r.kept}
    assert {r.doc_id: r.text for r in seen["quality rules"]} == clean
    groups = linked(word_sets(clean, 5))
    single = {i: clean[i] for i, root in groups.items() if i == root}
    assert {r.doc_id: r.text for r in seen["MinHash near-dedup"]} == single
    for r in seen["PII"]:
        spans = pii.base_spans(single[r.doc_id])
        assert not spans or r.text != single[r.doc_id]
        assert not any(k in ("email", "ip") for k, _, _ in pii.base_spans(r.text)) and r.n_chars == len(r.text)
    masked = {r.doc_id: r.text for r in seen["PII"]}
    assert set(masked) == set(single)
    assert {r.doc_id: r.text for r in seen["mixing"]}.items() <= masked.items()
    library = tokenizers.Tokenizer.from_file(bpe.production_path())
    assert len(seen["BPE"]) == len(seen["mixing"])
    for r in seen["BPE"][:50]:
        assert list(r.ids) == library.encode(masked[r.doc_id], add_special_tokens=False).ids
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted((r.doc_id, r.n_tokens) for r in seen["BPE"])


def test_odd_tables(spark):
    good = "Here is a line that has quite a lot of words in it and an end."
    rows = [(None, good, None, None, None), (1, None, "en", "s", 0), (2, good + " And more of it follows.", None, None, 3), (2, good + " And more of it follows.", None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0), docs.withColumn("kept", docs["doc_id"])):
        out, some = table, table.count() > 0
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, out, "")
            assert i == 4 or out.columns == table.columns
            rows = out.collect()
            if i < 3:  # the null text goes, the row that is repeated stays once, the rest isn't alike
                assert sorted((r.doc_id is None, r.doc_id, r.text[:8]) for r in rows) == ([(False, 2, good[:8])] * (2 - (i > 0)) + [(True, None, good[:8])] if some else [])
            assert {r.doc_id for r in rows} <= {None, 2} and (some or not rows)
        assert not rows or {"n_tokens", "ids", "decoded_sha256"} <= set(out.columns)


def test_very_long_text(spark):
    """A document of several megabytes goes through all stages whole."""
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    text = "\n".join(" ".join(word() for _ in range(200)) + " and mail a.b@c.de." for _ in range(1500))
    docs = spark.createDataFrame([(i, text if i == 7 else f"A short line number {i} that has some words and ends {word()} here.", "en", "s", 1) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, "")
        long = [r for r in docs.collect() if r.doc_id == 7]
        if i == 2:
            assert long[0].text == text.replace("a.b@c.de", "[EMAIL]") and long[0].n_chars == len(long[0].text)
        if i == 4:
            assert all(r.n_tokens > 300_000 for r in long)
