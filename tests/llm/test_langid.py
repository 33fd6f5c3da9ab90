"""op7: gradients, a plain run byte by byte, held-out accuracy, and odd rows."""

import math
import zlib

import numpy as np
import pyarrow as pa

from parley.llm import langid
from parley.llm.registry import queries


def test_gradients():
    net = langid.Network(["a", "b", "c"], hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    data, label, weight = rng.integers(97, 101, (4, 5)), rng.integers(0, 3, 5), rng.random(5) + 0.5
    _, g = net.gradients(data, label, weight)
    for name, w in net.w.items():
        seen = np.argwhere(np.abs(g[name]) > 1e-4)
        assert len(seen), name
        for at in map(tuple, seen[:: max(1, len(seen) // 8)]):
            old, eps = w[at], 1e-5
            w[at] = old + eps
            up = net.gradients(data, label, weight)[0]
            w[at] = old - eps
            down = net.gradients(data, label, weight)[0]
            w[at] = old
            assert abs((up - down) / (2 * eps) - g[name][at]) < 1e-6, name


def plain(net, data):
    """The label probabilities' logarithms of every byte, one number at a time."""
    k = net.h
    x, u, v, c = (net.w[n].astype(float) for n in "xuvc")

    def states(read, d):
        h, out = [0.0] * k, []
        for b in read:
            g = [sum(u[d, j, i] * h[i] for i in range(k)) for j in range(3 * k)]
            gate = lambda j: 1 / (1 + math.exp(-(x[d, b, j] + g[j])))  # noqa: B023, E731
            h = [gate(j) * h[j] + (1 - gate(j)) * math.tanh(x[d, b, 2 * k + j] + gate(k + j) * g[2 * k + j]) for j in range(k)]
            out.append(h)
        return out

    total = np.zeros(len(net.languages))
    for f, b in zip(states(data, 0), states(data[::-1], 1)[::-1]):
        s = v @ np.array(f + b) + c
        total += s - math.log(np.exp(s).sum())
    return total


def test_every_byte(monkeypatch):
    monkeypatch.setattr(langid, "SEGMENT", 40)
    monkeypatch.setattr(langid, "GATHERED", 150)
    monkeypatch.setattr(langid, "AT_ONCE", 3)
    net = langid.Network(["a", "b", "c"], hidden=4, seed=8)
    net.w = {k: 3 * v for k, v in net.w.items()}
    texts = ["x", "Ab 1, 2; cd\n", "é" * 33 + " ends here.", "word and word " * 30, "\x00 \t"]
    reader = langid.Reader(net, len(texts))
    for i, t in enumerate(texts):
        reader.add(i, np.frombuffer(t.encode(), np.uint8))
    reader.flush()
    for t, got in zip(texts, reader.totals):
        data = np.frombuffer(t.encode(), np.uint8)
        cut = list(langid.segments_of(data))
        assert b"".join(s.tobytes() for s in cut) == t.encode() and all(len(s) <= 40 for s in cut)
        assert all(s.tobytes().decode() for s in cut)
        assert np.allclose(got, sum(plain(net, s.tolist()) for s in cut), atol=1e-3)


def test_batches_are_read_together(monkeypatch):
    """Texts of many small batches run beside each other, each with the result it has alone."""
    net = langid.Network(["a", "b", "c"], hidden=4, seed=8)
    net.w = {k: 3 * v for k, v in net.w.items()}
    texts = [["word", None], [], ["12 3", "é und so weiter, " * 5, "x"], [None], ["the last"]]
    batches = [pa.RecordBatch.from_pydict({"id": list(range(len(t))), "text": pa.array(t, pa.string())}) for t in texts]
    alone = [next(langid._predicted(iter([b]), net)).to_pydict() for b in batches]
    calls, pooled = [], net.pooled
    monkeypatch.setattr(net, "pooled", lambda segments: calls.append(len(segments)) or pooled(segments))
    together = [b.to_pydict() for b in langid._predicted(iter(batches), net)]
    assert [b["lang_pred"] for b in together] == [b["lang_pred"] for b in alone] and calls == [4]
    assert all(np.allclose(a["score"], b["score"], atol=2e-5) for a, b in zip(together, alone))
    monkeypatch.setattr(langid, "GATHERED", 100)
    assert [b["lang_pred"] for b in (x.to_pydict() for x in langid._predicted(iter(batches), net))] == [b["lang_pred"] for b in alone]


def test_held_out(spark, sf_dir):
    rows = {r.doc_id: r for r in queries()["op7_langid"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert {i for i, r in rows.items() if r.held_out} == {d.doc_id for d in held}
    assert sum(rows[d.doc_id].lang_pred == d.lang for d in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_odd_rows(spark):
    learn = [(i, t, lang, 1) for i in range(120) for t, lang in ((f"the thing and that with this {i}", "en"), (f"und der die das nicht eine {i}", "de"))]
    odd = [(None, "x", None, 0), (1, None, "en", 0), (2, "", "en", 0), (3, "12 ½ — 3", "en", 0), (4, "a" * 500_000, "en", 0), (5, "the thing with", None, 0), (5, "the thing with", None, 0), (6, "中文 ελ", None, 0)]
    docs = spark.createDataFrame(learn, "doc_id long, text string, lang string, score int")
    net = langid.learn(docs)
    rows = langid.predicted(spark.createDataFrame(odd, docs.schema), net).collect()
    assert [r.lang_pred for r in rows[1:4]] == ["und"] * 3 and [r.score for r in rows[1:4]] == [0.0] * 3
    assert rows[5] == rows[6] and rows[5].lang_pred == "en"
    assert all(r.lang_pred in ("en", "de") for r in (rows[0], rows[4], rows[7]))
    assert langid.predicted(docs.limit(0), net).count() == 0
    assert langid.learn(docs.filter("lang is null")) is None
    assert {r.lang_pred for r in langid.predicted(docs, None).collect()} == {"und"}
