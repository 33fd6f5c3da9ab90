"""Compression of vectors to codes of four bytes: product quantisation in whole numbers.

Components become whole numbers. A vector is cut into PARTS parts, and each part position has a codebook
of at most ENTRIES entries, which starts as that part of the first vectors by id. In each round the codebooks are
broadcast; Arrow batches compute every part's squared distances to all entries of its book as |x|^2 + |c|^2 - 2xc,
with exact 64-bit matrix products, and take the first least one. A task adds up its parts by entry, so what is
shuffled is a row for each sum and task, whatever an entry's share of the vectors; the merged sums, as many numbers
as the codebooks have, come back to the driver, which divides them. Nothing is sampled, and no round keeps
a copy of the vectors: the table is read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.lineage import cut
from parley.llm.spread import dealt_join

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors whose distances are held at once.
BLOCK = 1024
#: Labels that are broadcast with their errors; more are joined by a shuffle that deals out the hot ones.
BROADCAST_LABELS = 100_000


def largest(width: int) -> int:
    """Whole numbers beyond this count as this: squared distances of parts so wide still fit in 64 bits."""
    return int((2**61 // max(1, width)) ** 0.5) // 2


def whole(vectors: pa.Array, width: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that take part, and their whole numbers [vectors, PARTS * width]; shorter vectors end in zeros.

    Null vectors and those that hold a null or a non-finite component take no part.
    """
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.asarray(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = vectors.flatten()  # without what null vectors may hide
    values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)
    starts = np.cumsum(sizes) - sizes
    bad = np.append(0, np.cumsum(~np.isfinite(values)))
    kept = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[starts + sizes] == bad[starts]))
    most = largest(width)
    cells = np.clip(np.floor(np.where(np.isfinite(values), values, 0) * scale), -most, most).astype(np.int64)
    out = np.zeros((len(kept), PARTS * width), np.int64)
    own = sizes[kept]
    row = np.repeat(np.arange(len(kept)), own)
    within = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
    out[row, within] = cells[np.repeat(starts[kept], own) + within]
    return kept, out


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of book for each of points, and its squared distance; all whole numbers."""
    index, distance = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    lengths = np.einsum("ij,ij->i", book, book)
    for lo in range(0, len(points), BLOCK):
        x = points[lo : lo + BLOCK]
        near = lengths - 2 * (x @ book.T)  # |x|^2 is the same for all entries
        index[lo : lo + BLOCK] = best = near.argmin(1)
        distance[lo : lo + BLOCK] = near[np.arange(len(x)), best] + np.einsum("ij,ij->i", x, x)
    return index, distance


class Codebooks:
    """books[part, entry, place]: whole numbers."""

    def __init__(self, books: np.ndarray, scale: int = SCALE):
        self.books, self.scale = books, scale

    @property
    def width(self) -> int:
        return self.books.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def assigned(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[vectors, PARTS]: entries and squared distances."""
        parts = [nearest(points[:, p * self.width : (p + 1) * self.width], self.books[p]) for p in range(PARTS)]
        return np.stack([x[0] for x in parts], 1), np.stack([x[1] for x in parts], 1)

    def decoded(self, codes: list[str]) -> np.ndarray:
        """What the codes stand for, as components: the middles of the entries' cells."""
        index = np.frombuffer(bytes.fromhex("".join(codes)), np.uint8).reshape(-1, PARTS)
        return np.concatenate([self.books[p][index[:, p]] for p in range(PARTS)], 1) / self.scale + 0.5 / self.scale


def _sums(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """One row for each entry used and place: slot, total; and for each entry its count, in the slots after all those."""
    books = sent.value
    _, entries, width = books.books.shape
    totals, counts = np.zeros((PARTS * entries, width), np.int64), np.zeros(PARTS * entries, np.int64)
    for batch in batches:
        points = whole(batch.column(0), width, books.scale)[1]
        index, _ = books.assigned(points)
        for p in range(PARTS):
            slots, own = index[:, p] + p * entries, points[:, p * width : (p + 1) * width]
            order = np.argsort(slots, kind="stable")
            if len(order):
                used, first = np.unique(slots[order], return_index=True)
                totals[used] += np.add.reduceat(own[order], first, axis=0)
                counts += np.bincount(slots, minlength=len(counts))
    used = np.flatnonzero(counts)
    slots = np.concatenate([(used[:, None] * width + np.arange(width)).ravel(), PARTS * entries * width + used])
    values = np.concatenate([totals[used].ravel(), counts[used]])
    for lo in range(0, len(slots), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(slots[lo : lo + (1 << 16)]), pa.array(values[lo : lo + (1 << 16)])], names=["slot", "total"])


def _coded(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Of rows (vector, id, label): id, label, code, error."""
    books = sent.value
    for batch in batches:
        kept, points = whole(batch.column(0), books.width, books.scale)
        index, distance = books.assigned(points)
        text = index.astype(np.uint8).tobytes().hex()
        codes = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
        rows = batch.take(pa.array(kept))
        yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), pa.array(codes, pa.string()), pa.array(distance.sum(1), pa.int64())], names=["id", "label", "code", "error"])


def _taking_part(vectors: DataFrame, vector: str) -> DataFrame:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(vector).isNotNull() & sound)


def fitted(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS, entries: int = ENTRIES, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of the vectors; None if no vector takes part.

    A book starts with that part of the vectors with the least ids, in order (null ids last, ties by the vector; a
    repeated row counts again); with fewer vectors it has as many entries. Of several nearest entries the first is
    taken. An entry that no part is assigned to stays. Vectors of other lengths than the longest, and lengths that
    PARTS doesn't divide, count as filled up with zeros. The driver holds PARTS * entries * width numbers.
    """
    rows = _taking_part(vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")), "v")
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    width = -(-longest // PARTS)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).toArrow().column("v").combine_chunks()
    seeds = whole(first, width, scale)[1]
    books = np.ascontiguousarray(seeds.reshape(len(seeds), PARTS, width).transpose(1, 0, 2))
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        sent = context.broadcast(Codebooks(books, scale))
        sums = vectors.select(vector).mapInArrow(lambda it, sent=sent: _sums(it, sent), "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).toArrow()
        slots, totals = (sums.column(c).to_numpy() for c in ("slot", "total"))
        merged = np.zeros(books.size + PARTS * books.shape[1], np.int64)
        merged[slots] = totals
        counts = merged[books.size :].reshape(PARTS, -1, 1)
        books = np.where(counts > 0, merged[: books.size].reshape(books.shape) // np.maximum(counts, 1), books)
        sent.unpersist()
    return Codebooks(books, scale)


def coded(vectors: DataFrame, books: Codebooks, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, label, code and error of every vector that takes part: the nearest entries as two hex digits each, and the
    squared distances from them, summed over the parts. Repeated rows each have theirs; other columns are left out."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    kinds = f"id {vectors.schema[id].dataType.simpleString()}, label {vectors.schema[label].dataType.simpleString()}"
    rows = vectors.select(F.col(vector).alias("v"), F.col(id).alias("id"), F.col(label).alias("label"))
    return rows.mapInArrow(lambda it: _coded(it, sent), f"{kinds}, code string, error long")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes (id, label, code, error) and label_error: the errors of all rows with the label, nulls together."""
    # A null equals nothing in a join, so labels stand as texts behind a mark.
    codes = cut(codes.withColumn("__label", F.concat(F.when(F.col("label").isNull(), "n").otherwise("v"), F.coalesce(F.col("label").cast("string"), F.lit("")))))
    sums = cut(codes.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count("*").alias("held")))
    if sums.count() <= BROADCAST_LABELS:
        joined = codes.join(F.broadcast(sums.drop("held")), "__label")
    else:
        joined = dealt_join(codes, sums.drop("held"), "__label", sums.select("__label", "held"), F.struct("id", "code"))
    return joined.drop("__label")


def op13_vector_codes(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = fitted(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    out = with_label_errors(coded(vectors, books))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    """The same by comparing every part with every entry, in doubles, which are exact here."""
    steps = ["""
k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, label, p, list_slice(v, p * (len(v) // 4) + 1, (p + 1) * (len(v) // 4)) AS v FROM k, range(4) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM x WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256))"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
d{r} AS (SELECT vec_id, label, x.p, e, list_inner_product(v, v) + list_inner_product(c, c) - 2 * list_inner_product(v, c) AS d, v FROM x JOIN b{r} ON x.p = b{r}.p),
a{r} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) AS n FROM d{r}) WHERE n = 1)""")
        if r < ROUNDS:
            steps.append(f"""
s{r} AS (SELECT p, e, i, floor(sum(v[i]) / count(*)) AS m FROM a{r}, range(1, 17) t(i) GROUP BY p, e, i),
m{r} AS (SELECT p, e, list(m ORDER BY i) AS c FROM s{r} GROUP BY p, e),
b{r + 1} AS (SELECT b{r}.p, b{r}.e, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} ON b{r}.p = m{r}.p AND b{r}.e = m{r}.e)""")
    last = f"""
o AS (SELECT vec_id, label, string_agg(printf('%02x', e::BIGINT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM o, h"""
    return "WITH " + ",".join(s.strip() for s in steps) + "," + last


OP13_SQL = _sql()
