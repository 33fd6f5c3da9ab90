"""op9: rates, totals, order, odd rows; the whole table is compared with DuckDB in test_oracles."""

import math
from collections import Counter

import duckdb
import pytest

from parley.llm import mixing


def test_table():
    for rate in (0.0, 0.01, 1.0, 7.5, 80.0):
        p = mixing.poisson_table(rate)
        assert p == sorted(p) and p[-1] == pytest.approx(1)
        assert p[0] == pytest.approx(math.exp(-rate))


def test_mixture(spark):
    docs = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"s{i % 4}", str(i)) for i in range(6000)], "doc_id long, source string, text string")
    targets = {"hot": 1.0, "s0": 1.0, "s1": 2.0, "s2": 0.0}
    out = mixing.mixed(docs, targets, total=2.0).collect()
    n = Counter(r.source for r in out)
    assert len(out) == pytest.approx(12000, rel=0.05)
    assert n["hot"] == pytest.approx(3000, rel=0.08) and n["s1"] == pytest.approx(6000, rel=0.08) and n["s0"] == pytest.approx(3000, rel=0.08)
    assert n["s2"] == n["s3"] == 0
    assert [r.mix_key for r in out] == sorted(r.mix_key for r in out)
    by_doc = Counter(r.doc_id for r in out)
    assert all(by_doc[r.doc_id] == r.mix_copies for r in out) and len({(r.doc_id, r.mix_copy) for r in out}) == len(out)
    again = mixing.mixed(docs.repartition(7), targets, total=2.0).collect()
    assert again == out
    assert mixing.mixed(docs, targets, total=2.0, seed=5).collect() != out


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, "a", 1)] * 5 + [(1, None, None, 2), (2, "s", "", 3), (2, "s", "", 3)], "doc_id long, source string, text string, mix_copies int")
    out = mixing.mixed(docs, total=20.0).collect()
    by = Counter((r.doc_id, r.text) for r in out)
    assert by[None, "a"] > 0 and by[2, ""] > 0 and by[1, None] > 0 and len(out) == pytest.approx(160, rel=0.4)
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.mixed(docs, {}).count() == 0
    assert mixing.mixed(docs, total=5000.0).count() == pytest.approx(40_000, rel=0.05)
    assert mixing.mixed(docs.drop("text"), total=20.0).count() > 0


@pytest.mark.parametrize("text", ["concat('t', id)", "'same'", "CAST(NULL AS STRING)"])
def test_without_ids(spark, text):
    """Rows without an id, with different texts or all equal, are drawn independently and lie in all partitions."""
    docs = spark.range(1000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'s' AS source", f"{text} AS text")
    for seed in (17, 1, 2):
        out = mixing.mixed(docs, total=1.0, seed=seed)
        rows = out.collect()
        assert len(rows) == pytest.approx(1000, abs=130)
        share = Counter(r.mix_copies for r in rows if r.mix_copy == 0)
        assert share[1] == pytest.approx(368, abs=70) and share[2] == pytest.approx(184, abs=55)
        assert len({r.mix_key for r in rows}) == len(rows)
        assert out.rdd.getNumPartitions() == 1 or len({p for p in out.rdd.mapPartitionsWithIndex(lambda i, x: [i] * sum(1 for _ in x)).collect()}) > 1


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "s", "long " * 2_000_000), (2, "s", "short")], "doc_id long, source string, text string")
    out = mixing.mixed(docs, total=4.0).selectExpr("doc_id", "length(text) AS n").collect()
    assert {r.n for r in out} <= {10_000_000, 5} and len(out) > 0


def test_other_sources(spark, tmp_path):
    """A source of no target and a null one have the weight that the oracle gives them."""
    docs = spark.createDataFrame([(i, ("src0", "elsewhere", None)[i % 3], str(i)) for i in range(3000)], "doc_id long, source string, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = mixing.op9_mixing(spark, str(tmp_path)).collect()
    n = Counter(r.source for r in out)
    assert [n["src0"], n["elsewhere"], n[None]] == pytest.approx([2250, 750, 750], rel=0.15)
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = con.sql(mixing.OP9_SQL).fetchall()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


def test_high_rates(spark, tmp_path):
    """One small source among many rows: its few documents get all the copies of its share."""
    docs = spark.range(24_000).selectExpr("id AS doc_id", "CASE WHEN id < 2 THEN 'src0' ELSE 'src5' END AS source", "'t' AS text")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = mixing.op9_mixing(spark, str(tmp_path))
    n = Counter(r.source for r in out.select("source").collect())
    assert [n["src0"], n["src5"]] == pytest.approx([22_500, 7_500], rel=0.05)
    for rate in (700.0, 20_000.0, 3e6):
        p, first = mixing.poisson_table(rate), mixing.first_count(rate)
        assert len(p) < 30 * math.sqrt(rate) and p == sorted(p) and p[0] < mixing.TAIL and p[-1] == pytest.approx(1)
        assert first + sum(x <= 0.5 for x in p) == pytest.approx(rate, abs=1)
        assert first + sum(x <= 0.8413447460685429 for x in p) == pytest.approx(rate + math.sqrt(rate), abs=2)
