"""op8: the curve, the laws of shards and slots, pruning, odd rows."""

import itertools
import math
import zlib

import numpy as np
import pytest

from parley.llm import hilbert
from parley.llm.registry import queries


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_curve(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = hilbert.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(1) == 1).all()


def laws(rows, n):
    counts = [sum(r.shard == s for r in rows) for s in range(hilbert.SHARDS)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    for s in range(hilbert.SHARDS):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_documents(spark, sf_dir):
    docs = {d.doc_id: d for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries()["op8_sharding"](spark, sf_dir).collect()
    laws(rows, len(docs))
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in ordered] == sorted(r.hilbert for r in rows)
    for r in rows:
        data = docs[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)


def test_documents_plainly(spark, sf_dir):
    """Cells from language, source and size, their order on the curve, and the cut into runs, one document at a time."""
    xxhash = pytest.importorskip("xxhash")

    def named(x):
        if x is None:
            return 0
        h = xxhash.xxh64_intdigest(x.encode(), xxhash.xxh64_intdigest((3).to_bytes(4, "little"), 42))
        return (h - (1 << 64) if h >> 63 else h) % 255 + 1

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    places = []
    for d in docs:
        data = (d.text or "").encode()
        cells = [named(d.lang), named(d.source), min(255, int(math.log2(len(data) + 2) * 8))]
        places.append((int(hilbert.hilbert_index(np.array([cells]))[0]), d.doc_id, zlib.crc32(data)))
    want, n = {}, len(docs)
    for rank, (index, doc, _) in enumerate(sorted(places)):
        shard = rank * hilbert.SHARDS // n
        slot = rank - -(-shard * n // hilbert.SHARDS)
        want[doc] = (index, shard, slot)
    assert {r.doc_id: (r.hilbert, r.shard, r.slot) for r in queries()["op8_sharding"](spark, sf_dir).collect()} == want


def test_manifest_prunes(spark, sf_dir):
    shards = hilbert.sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = hilbert.manifest(shards).collect()
    span = {d: np.mean([r[f"max_{d}"] - r[f"min_{d}"] + 1 for r in rows]) for d in ("lang", "source", "size")}
    whole = {d: max(r[f"max_{d}"] for r in rows) - min(r[f"min_{d}"] for r in rows) + 1 for d in span}
    assert np.mean([span[d] / whole[d] for d in span]) < 0.7


def test_odd_rows(spark):
    rows = [(None, None, None, None, 1)] * 3 + [(i, "é", "s", "x", 0) for i in range(20)] + [(7, "é", "s", "x", 0)] * 30 + [(9, "a" * 300_000, "s", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size int")
    out = hilbert.sharded(docs).collect()
    laws(out, len(rows))
    assert {(r.size, r.text_crc32) for r in out if r.doc_id is None} == {(1, 0)}
    assert hilbert.sharded(docs.limit(0)).count() == 0
    assert sorted(r.slot for r in hilbert.sharded(docs.limit(3)).collect()) == [0, 0, 0]
