"""op13: codes, errors and codebooks against plain loops over Python's whole numbers; odd vectors."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import codes, spread

SCHEMA = "vec_id long, embedding array<float>, label int"


def plainly(rows, entries=256, rounds=4):
    """(vec_id, code, error, label_error) and the digest, from rows (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max(len(r[1]) for r in kept) // 4)
    most = codes.largest(width)
    whole = lambda v: [max(-most, min(most, math.floor(1024 * float(np.float32(x))))) for x in v] + [0] * (4 * width - len(v))
    points = [whole(r[1]) for r in kept]
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(4)]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, [np.float64(np.float32(x)) for x in kept[i][1]]))[:entries]
    books = [[cut(points[i])[p] for i in first] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((far(part, c), e) for e, c in enumerate(books[p])) for p, part in enumerate(cut(v))] for v in points]

    for _ in range(rounds):
        given = assign()
        for p in range(4):
            for e in range(len(books[p])):
                own = [cut(v)[p] for v, g in zip(points, given) if g[p][1] == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own))
    last = assign()
    errors = [sum(d for d, _ in g) for g in last]
    by = {}
    for r, e in zip(kept, errors):
        by[r[2]] = by.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = [(r[0], "".join(f"{e:02x}" for _, e in g), x, by[r[2]]) for r, g, x in zip(kept, last, errors)]
    return sorted(out, key=repr), digest


def result(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit(1)).withColumn("error", F.lit("x")).repartition(3)
    books = codes.fitted(df)
    out = codes.with_label_errors(codes.coded(df, books)).select("id", "code", "error", "label_error").collect()
    return sorted((tuple(r) for r in out), key=repr), books.sha256()


@pytest.mark.parametrize("labels", [1000, 0])
def test_plainly(spark, monkeypatch, labels):
    """labels 0: joined by a shuffle, hot labels dealt out."""
    monkeypatch.setattr(codes, "BROADCAST_LABELS", labels)
    monkeypatch.setattr(spread, "HOT_ROWS", 20)
    rng = random.Random(8)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(12)]
    rows = [(i, vector(), rng.choice([None, 1, 1, 1, 2])) for i in range(330)]
    rows += [(400, None, 1), (401, [None] + vector()[1:], 1), (402, [math.nan] + vector()[1:], 2), (403, [math.inf] + vector()[1:], 2)]
    rows += [rows[3], rows[3], (None, vector(), 1), (7, vector(), 2), (500, vector()[:5], 1), (501, [], None), (502, [3e38] * 12, 3), (503, [-3e38] * 12, 3)]
    rng.shuffle(rows)
    assert result(spark, rows) == plainly(rows)


def test_few_vectors(spark):
    rows = [(i, [float(i), 0.5, -0.25, 1e-9, float(-i)], i % 2) for i in range(5)]
    assert result(spark, rows) == plainly(rows)
    books = codes.fitted(spark.createDataFrame(rows, SCHEMA))
    back = books.decoded([r.code for r in codes.coded(spark.createDataFrame(rows, SCHEMA), books).orderBy("id").collect()])
    assert np.abs(back[:, :5] - np.array([r[1] for r in rows])).max() <= 1 / codes.SCALE


def test_nothing_takes_part(spark):
    rows = spark.createDataFrame([(1, None, 1), (2, [math.nan], None)], SCHEMA)
    assert codes.fitted(rows) is None and codes.fitted(rows.limit(0)) is None


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = codes.op13_vector_codes(spark, str(tmp_path))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0
