"""Near-duplicate documents by an inverted join over the coordinates of MinHash signatures.

1. Documents with equal shingle sets form one class; only classes go on.
2. A class posts itself under each (coordinate, value) of its signature. Values held by one class alone
   are counted, not posted. In the order (how many classes hold it, value) two classes that share at
   least MATCHES coordinates also share one of each one's first COORDINATES - MATCHES + 1: only this
   prefix is posted, so a value that a very common passage gives to a third of all documents is skipped.
3. In each posting list every class meets the list's hub: the class whose values are the most common
   (the text that the others were made from, as a change gives rarer values). A pair that met in any list
   has its collisions counted by merging its two signatures, the posted prefixes and the skipped rests, as
   the lists themselves hold only some of them: they don't hand out all their pairs, and one collision in
   the prefixes is all that MATCHES implies. Pairs that come to MATCHES are confirmed on the full sets, and
   components formed. This is linear in the postings, and a family of near copies falls together.
4. What shares an open list (one that still holds several components) shares its hub. The classes of a
   hub's open lists are compared in blocks: dealt by hash into chunks of bounded size, each pair of chunks
   is one task. It first counts the collisions of all its pairs, coordinate by coordinate, and tells which
   classes come to MATCHES with one of another component; those then meet once more with their texts, where it counts the common shingles of all its
   pairs by a matrix product and returns one link for each pair of components that has any. So each pair
   of a list is either checked, or known to be in one component already; none is dropped, and copies are
   never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import textbuf as tb
from parley.llm.components import components
from parley.llm.lineage import cut, release, small_batches
from parley.llm.spread import dealt_join

#: A pair at the threshold 0.8 falls short of 25 of 48 agreements with a chance of about 4e-6; more alike
#: pairs much less often.
COORDINATES, MATCHES = 48, 25
THRESHOLD_PERCENT = 80
#: Rows of three numbers sent to all executors to find the texts to confirm; more rows are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: A chunk of a hub's classes: so many sets, and so many shingles in them, on the average at most.
CHUNK_SETS, CHUNK_SHINGLES = 800, 500_000
#: Shingles in one step of the matrix product.
TILE = 2048

_ODD = tb.mix(np.arange(1, 1 + COORDINATES, dtype=tb.U) * tb.U(0x8CB92BA72F3D8DD7)) | tb.U(1)
_SALT = tb.mix(np.arange(101, 101 + COORDINATES, dtype=tb.U))


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of runs of rows: first and last row, the rows' distinct shingles in order, where each row begins."""
    data, offsets = tb.column(texts)
    for lo, hi in tb.slices(offsets):
        h, _, _, rows = tb.words(data, offsets[lo : hi + 1])
        grams, starts = tb.shingles(h, rows, k)
        found = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            g = np.sort(grams[a:b])
            found.append(g[np.concatenate([[True], g[1:] != g[:-1]])] if b > a + 1 else g)
        counts = np.array([len(g) for g in found])
        yield lo, hi, np.concatenate(found), np.concatenate([[0], np.cumsum(counts)])


def _reduced(f: np.ufunc, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """f over each row; 0 for rows without elements."""
    out = np.zeros(len(starts) - 1, tb.U)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = f.reduceat(x, starts[:-1][full])
    return out


def _key(grams: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """128 bits that name a set."""
    return [_reduced(np.add, tb.mix(grams), starts).view(np.int64), _reduced(np.bitwise_xor, tb.mix(grams ^ tb.U(0x5851F42D4C957F2D)), starts).view(np.int64)]


def _signatures(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[rows, COORDINATES]: each the least of a row's shingles under one multiplier, marked with its place."""
    out = np.empty((len(starts) - 1, COORDINATES), tb.U)
    for j in range(COORDINATES):
        out[:, j] = tb.mix(_reduced(np.minimum, grams * _ODD[j], starts) + _SALT[j])
    return out


def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, grams, starts in _sets(batch.column(1), k):
            f1, f2 = _key(grams, starts)
            sig = pa.FixedSizeListArray.from_arrays(pa.array(_signatures(grams, starts).view(np.int64).ravel()), COORDINATES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(np.diff(starts)), pa.array(f1), pa.array(f2), sig.cast(pa.list_(pa.int64()))],
                names=["id", "th", "n", "f1", "f2", "sig"],
            )


def _each(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The set of each text."""
    for _, _, grams, starts in _sets(texts, k):
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            yield grams[a:b]


def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, text of a, text of b) the linked pairs."""
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(_each(batch.column(2), k), _each(batch.column(3), k))):
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], names=["a", "b"])


def _block(table: pa.Table, k: int, percent: int) -> pa.Table:
    """One link for each pair of components with a link in this block: columns cid, at, text."""
    cid, at = (np.asarray(table.column(c).to_numpy()) for c in ("cid", "at"))
    sets = [x for texts in table.column("text").chunks for x in _each(texts, k)]
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, token, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[token] > 1
    row, token = row[shared], np.unique(token[shared], return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(token.max()) + 1 if len(token) else 0, TILE):
        here = (token >= lo) & (token < lo + TILE)
        marks = np.zeros((len(sets), TILE), np.float32)
        marks[row[here], token[here] - lo] = 1
        common += marks @ marks.T
    found = []
    for lo in range(0, len(sets), 256):  # by rows, to keep the wide intermediates small
        part, rows = common[lo : lo + 256].astype(np.float64), slice(lo, lo + 256)
        linked = 100 * part >= percent * (size[rows, None] + size[None, :] - part)
        x, y = np.nonzero(linked & (at[rows, None] < at[None, :]))
        found.append(np.stack([x + lo, y]))
    x, y = np.concatenate(found, 1)
    ends = np.sort(np.stack([at[x], at[y]]), 0)
    _, first = np.unique(ends, axis=1, return_index=True)
    return pa.table({"a": cid[x[first]], "b": cid[y[first]]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _close(table: pa.Table) -> pa.Table:
    """The members that collide in MATCHES coordinates with one of another component: columns a, cid, at, sig."""
    at = np.asarray(table.column("at").to_numpy())
    sigs = np.concatenate([x.flatten().to_numpy().reshape(len(x), COORDINATES) for x in table.column("sig").chunks if len(x)])
    agree = np.zeros((len(at), len(at)), np.uint8)
    for j in range(COORDINATES):
        agree += sigs[:, j, None] == sigs[None, :, j]
    near = ((agree >= MATCHES) & (at[:, None] != at[None, :])).any(1)
    return table.select(["a", "cid"]).filter(pa.array(near))


def dealt(member: DataFrame) -> DataFrame:
    """(a, lo, hi, cid, at): the members (a, cid, at, n) of each hub a, dealt by hash into chunks of bounded size, once
    for each pair of chunks they stand in. Hubs with one component only are left out."""
    groups = cut(
        member.groupBy("a").agg(
            F.ceil(F.greatest(F.count("*") / CHUNK_SETS, F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks"),
            F.min("at").alias("least"), F.max("at").alias("most"), F.count("*").alias("held"),
        )
        .filter("least <> most").select("a", "chunks", "held")
    )
    return (
        dealt_join(member, groups.drop("held"), "a", groups.select("a", "held"), F.col("cid"))
        .withColumn("own", F.pmod(F.xxhash64("cid"), "chunks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("a", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "cid", "at")
    )


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", k: int = 5, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs, under the name id has.

    Two documents are linked when their sets of distinct k-word shingles (A-Z as a-z; the whole sequence
    for fewer words) have 100 * intersection >= percent * union. component_id is the least id reachable
    over links. Null and wordless texts have n_shingles 0 and are linked with nothing. Repeated rows are
    equal sets, so linked; rows that share an id and differ in text are judged each by its text. A null
    id never stands for its component while another id is there; alone it gives a null component_id and
    kept true. An empty table gives an empty table. Other columns of docs are left out.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    schema = f"id {docs.schema[id].dataType.simpleString()}, "
    sketch = cut(rows.mapInArrow(lambda it: _sketch(it, k), schema + "th long, n long, f1 long, f2 long, sig array<long>"))

    # Equal sets: one class. Its number is fixed by the checkpoint.
    least = sketch.filter("n > 0").groupBy("f1", "f2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("rep"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"))
    classes = cut(least.withColumn("cid", F.monotonically_increasing_id()))

    held = classes.select("cid", F.explode("sig").alias("value"))
    common = held.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    prefix = cut(
        held.join(common, "value")
        .groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("own"))  # COORDINATES at most
        .withColumn("room", F.size("own") - (MATCHES - 1))
        .filter("room > 0")
        .select(
            F.struct(F.aggregate("own", F.lit(0).cast("long"), lambda n, x: n + x["df"]).alias("weight"), F.col("cid")).alias("rank"),
            F.explode(F.slice("own", 1, F.col("room"))["value"]).alias("value"),
        )
    )
    hub = cut(prefix.groupBy("value").agg(F.max("rank")["cid"].alias("a"), F.count("*").alias("held")).filter("held > 1"))
    posted = cut(dealt_join(prefix, hub.drop("held"), "value", hub.select("value", "held"), F.col("rank")).select("value", F.col("rank")["cid"].alias("b"), "a"))

    # The texts of few classes are needed, each class by the row that stands for it.
    def texts_of(cids: DataFrame) -> DataFrame:
        wanted = cut(classes.join(cids, "cid").select("cid", F.col("rep")["id"].alias("wid"), F.col("rep")["th"].alias("wth")))
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        same = F.col("id").eqNullSafe(F.col("wid")) & F.col("th").eqNullSafe(F.col("wth"))
        return rows.join(wanted, same).select("cid", "text").dropDuplicates(["cid"])

    # Collisions with each list's hub.
    release(docs.sparkSession)
    sig = lambda x: classes.select(F.col("cid").alias(x), F.col("sig").alias("sig_" + x))
    with_hub = lambda pairs, table: dealt_join(pairs, table, "a", cut(pairs.groupBy("a").agg(F.count("*").alias("held"))), F.col("b"))
    collisions = F.size(F.array_intersect("sig_a", "sig_b"))  # values are marked with their coordinates
    met = cut(posted.filter("a <> b").select("a", "b").distinct())
    likely = cut(with_hub(met, sig("a")).join(sig("b"), "b").filter(collisions >= MATCHES).select("a", "b"))
    texts = texts_of(likely.select("a").union(likely.select("b")).distinct().withColumnRenamed("a", "cid"))
    links = cut(
        with_hub(likely, texts.select(F.col("cid").alias("a"), F.col("text").alias("x")))
        .join(texts.select(F.col("cid").alias("b"), F.col("text").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(lambda it: _confirm(it, k, percent), "a long, b long")
    )
    root = components(links)

    # What a hub didn't take in.
    release(docs.sparkSession)
    here = cut(
        posted.join(root.withColumnsRenamed({"node": "b", "root": "at"}), "b", "left")
        .join(root.withColumnsRenamed({"node": "a", "root": "home"}), "a", "left")
        .select("value", "a", "b", F.coalesce("at", "b").alias("at"), F.coalesce("home", "a").alias("home"))
    )
    mixed = here.filter("at <> home").select("value").distinct()
    open_lists = cut(here.join(mixed, "value", "left_semi").select("a", "b", "at").distinct())
    if not open_lists.isEmpty():
        member = cut(open_lists.join(classes.select(F.col("cid").alias("b"), "n"), "b").withColumnRenamed("b", "cid"))
        # First by signatures alone: which members have a likely partner in another component.
        close = (
            dealt(member).join(classes.select("cid", "sig"), "cid")
            .groupBy("a", "lo", "hi").applyInArrow(_close, "a long, cid long").distinct()
        )
        blocks = cut(dealt(cut(member.join(close, ["a", "cid"]))))
        texts = texts_of(blocks.select("cid").distinct())
        more = blocks.join(texts, "cid").groupBy("a", "lo", "hi").applyInArrow(lambda t: _block(t, k, percent), "a long, b long")
        root = components(links.union(more))

    release(docs.sparkSession)
    ids = classes.select("f1", "f2", "cid", "rep").join(root, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = cut(ids.groupBy("root").agg(F.min(F.col("rep")["id"]).alias("component"), F.count("*").alias("held")))
    named = dealt_join(ids, lowest.drop("held"), "root", lowest.select("root", "held"), F.col("cid")).select("f1", "f2", "component")
    joined = sketch.join(named, ["f1", "f2"], "left").withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return joined.select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def one_of_each(docs: DataFrame, text: str = "text", id: str = "doc_id", k: int = 5) -> DataFrame:
    """Of each component of near duplicates the documents that carry its least id, with all columns of docs.

    Rows that repeat that id and its text count as one. A null id is kept where its component has no other.
    Null and wordless texts each stay; an empty table gives an empty table. Texts are shuffled only of rows
    that are repeated.
    """
    kept = near_duplicates(docs, text, id, k).filter("kept").select(F.col(id).alias("__parley_id")).distinct()
    out = docs.join(kept, F.col(id).eqNullSafe(F.col("__parley_id")), "left_semi")
    keys = docs.select(F.col(id).alias("__parley_id"), F.xxhash64(text).alias("__parley_text"))
    again = cut(keys.groupBy("__parley_id", "__parley_text").agg(F.count("*").alias("__parley_n")).filter("__parley_n > 1").drop("__parley_n"))
    if again.isEmpty():
        return out
    same = F.col(id).eqNullSafe(F.col("__parley_id")) & (F.xxhash64(text) == F.col("__parley_text"))
    return out.join(again, same, "left_anti").union(out.join(again, same, "left_semi").dropDuplicates([id, text]))


def op3_minhash(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)


#: The same by counting common shingles of all pairs, for small tables.
OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id WHERE l.b > r.root)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
