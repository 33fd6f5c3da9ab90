"""Repeated passages: MinHash banding of paragraphs, verified and clustered.

Paragraphs are of two kinds. A text's own are its lines of WORDS words or more. As a passage may also be
set into the middle of a line, every text is further cut at content-defined places: the least 5-word
shingle of each REACH consecutive ones opens a window of WORDS words. Any passage of REACH + WORDS - 1
= 50 words holds a whole one, at the same words in each copy, wherever the copies stand.

Lines are banded: BANDS x ROWS makes a pair of Jaccard 0.8 meet in a band with probability 0.997. Equal
lines are one class. A class is verified against the first class of each of its bands by exact Jaccard on
shingle sets, which is linear in the classes. What a first class didn't take in is compared in blocks: the
classes of all its bands that still hold several components are dealt into chunks of bounded size, and
each pair of chunks is one task, as in op3. So each pair that meets in a band is either verified or in one
component already. Components of verified pairs are clusters.

Windows have bands that miss nothing. Two windows of 22 different shingles have a Jaccard of 0.8 or more if and
only if they share 20 shingles, and as a word changed within a window takes 3 to 5 of them, these are the shingles
of one run of SURE = 24 words, which lies at word 0, 1 or 2 of each. So a window has three bands, its
three runs, and two windows that share one, whether they open at the same word or two words apart, have
20 of at most 24 shingles in common and need no further proof. With some shingles twice this still holds while
SURELY = 18 of a window's 22 differ (16 of 20 then); a window of fewer is its own band, so that only equal ones meet. A
run counts once at each place, so that windows that overlap don't repeat each other. All windows that share a
run are one cluster with the least of their first runs, so nothing is paired; components join first runs that
other runs tie together.
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
from parley.llm.minhash import TILE, dealt
from parley.llm.spread import dealt_join

SHINGLE, WORDS, REACH = 5, 26, 25
SURE, SURELY = 24, 18
BANDS, ROWS = 8, 3
PERCENT = 80
BROADCAST_ROWS = 1_000_000
_ODD = tb.mix(np.arange(501, 501 + BANDS * ROWS, dtype=tb.U)) | tb.U(1)


def _lines(data: np.ndarray, h: np.ndarray, s: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (exclusive) of the lines with WORDS words or more."""
    line = np.searchsorted(np.flatnonzero(data == 10), s)
    new = np.ones(len(s), bool)
    new[1:] = line[1:] != line[:-1]
    new[rows[:-1][rows[:-1] < len(s)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s))
    long = last - first >= WORDS
    return first[long], last[long]


def _shingles(h: np.ndarray) -> np.ndarray:
    """One for each word, of it and the four words after it, whatever row they are in."""
    total = np.zeros(max(0, len(h) - SHINGLE + 1), tb.U)
    for j in range(SHINGLE):
        total = (total ^ (total >> tb.U(29))) * tb.U(0x9FB21C651E98DF25) + h[j : j + len(total)]
    return tb.mix(total)


def _slid(f: np.ufunc, x: np.ndarray, k: int) -> np.ndarray:
    """f over each k consecutive elements, by doubling."""
    done, step = x, 1
    while 2 * step <= k:
        done, step = f(done[:-step], done[step:]), 2 * step
    return done if step == k else f(done[: len(x) - k + 1], done[k - step :])


def _openings(g: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Places of the least (the first of equal ones) of any REACH consecutive shingles; inside: the windows that count."""
    least = np.where(inside, _slid(np.minimum, g, REACH), tb.U(0))
    wide = np.concatenate([np.zeros(REACH - 1, tb.U), least, np.zeros(REACH - 1, tb.U)])
    at = np.flatnonzero(_slid(np.maximum, wide, REACH) == g)  # the greatest of the windows' least ones is this one
    # Where an equal shingle stands before within reach, only windows that begin behind that one count.
    padded = np.concatenate([np.zeros(REACH - 1, tb.U), g])
    before, most = np.zeros(len(at), np.int64), np.zeros(len(at), tb.U)
    for d in range(1, REACH):
        most = np.maximum(most, wide[at + REACH - d])  # of the window that begins d - 1 places before
        here = (before == 0) & (padded[at + REACH - 1 - d] == g[at])
        before[here] = np.where(most[here] == g[at[here]], -1, d)
    return at[before <= 0]


def _prepared(texts: pa.Array) -> Iterator[tuple]:
    """Of runs of rows: first row, bytes, word fingerprints, their starts, at which word each row begins, shingles."""
    data, offsets = tb.column(texts)
    for lo, hi in tb.slices(offsets):
        h, s, _, rows = tb.words(data, offsets[lo : hi + 1])
        yield lo, data[offsets[lo] : offsets[hi]], h, s, rows, _shingles(h)


def _line_units(texts: pa.Array) -> Iterator[tuple]:
    """Of runs of rows: the lines' row, first word in it, words, content hash, shingle ranges; and the shingles."""
    for lo, data, h, s, rows, g in _prepared(texts):
        first, last = _lines(data, h, s, rows) if len(s) else (np.zeros(0, int),) * 2
        sums = np.concatenate([[0], np.cumsum(tb.mix(g + tb.U(1)))]).astype(tb.U)
        key = tb.mix((sums[last - SHINGLE + 1] - sums[first]) ^ (last - first).astype(tb.U))
        row = np.searchsorted(rows, first, "right") - 1
        yield row + lo, first - rows[row], last - first, key, first, last - SHINGLE + 1, g


def _few(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether fewer than SURELY of the shingles of the window at each place differ."""
    k = WORDS - SHINGLE + 1
    again = np.zeros(len(g), bool)
    for d in range(1, k):
        again[d:] |= g[d:] == g[:-d]
    seen = np.concatenate([[0], np.cumsum(again)])
    few = seen[at + k] - seen[at] > k - SURELY  # some may stand before the window only
    if few.any():
        own = np.sort(g[at[few][:, None] + np.arange(k)], 1)
        few[few] = 1 + (own[:, 1:] != own[:, :-1]).sum(1) < SURELY
    return few


def _window_units(texts: pa.Array, places: bool) -> Iterator[tuple]:
    """Of runs of rows: of each run of each window the window's row, its first word in it, its first run's key, the run's key,
    whether no window before it has this run, and, if places are asked for, whether the row has an equal one before."""
    for lo, _, h, _, rows, g in _prepared(texts):
        at = np.zeros(0, int)
        if len(g) >= REACH:
            inside = np.ones(len(g) - REACH + 1, bool)
            for end in rows[1:-1].tolist():  # stretches that reach into the next row
                inside[max(0, end - REACH - SHINGLE + 2) : end] = False
            at = _openings(g, inside)
            at = at[at + WORDS <= rows[np.searchsorted(rows, at, "right")]]
        if not len(at):
            continue

        def key(place: np.ndarray, ends: tuple[int, ...], seed: int) -> np.ndarray:
            out = np.full(len(place), seed, tb.U)
            for j in ends:
                out = tb.mix(out * tb.U(3) + g[place + j])  # noqa: B023
            return out

        shifts = WORDS - SURE + 1
        place = (at[:, None] + np.arange(shifts)).ravel()
        runs = key(place, (0, 5, 10, 15, SURE - SHINGLE), 77)
        new = (at[:, None] + np.arange(shifts) > np.append(-shifts, at[:-1])[:, None] + shifts - 1).ravel()  # not in the window before
        few = _few(g, at)
        runs[np.flatnonzero(few) * shifts] = key(at[few], (0, 5, 10, 15, 20, WORDS - SHINGLE), 79)
        held = np.repeat(~few, shifts) | (np.arange(len(place)) % shifts == 0)
        of = np.repeat(np.arange(len(at)), shifts)[held]
        place, runs, new = place[held], runs[held], new[held] | np.repeat(few, shifts)[held]
        row = np.searchsorted(rows, at, "right") - 1
        again = np.zeros(len(place), bool)
        if places:
            order = np.argsort(runs, kind="stable")  # rows and places stay in order
            there, same = place[order], (runs[order][1:] == runs[order][:-1]) & (row[of][order][1:] == row[of][order][:-1])
            # A place may be in three windows; it comes later if its first mention does.
            mention = np.append(True, ~same | (there[1:] != there[:-1]))
            again[order] = np.append(False, same)[np.maximum.accumulate(np.where(mention, np.arange(len(order)), 0))]
        yield row[of] + lo, (at - rows[row])[of], runs[np.flatnonzero(np.append(True, of[1:] != of[:-1]))][of], runs, new, again


def _runs(batches: Iterator[pa.RecordBatch], places: bool) -> Iterator[pa.RecordBatch]:
    """The windows' runs: id, opens, key, and how often they count; or with their windows' places, and whether they stand in the text before."""
    for batch in batches:
        for row, at, opens, key, new, again in _window_units(batch.column(1), places):
            columns = {"id": batch.column(0).take(pa.array(row)), "opens": pa.array(opens.view(np.int64)), "key": pa.array(key.view(np.int64))}
            columns |= {"at": pa.array(at.astype(np.int32)), "again": pa.array(again)} if places else {"times": pa.array(new.astype(np.int64))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _line_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines: id, at, n, key."""
    for batch in batches:
        for row, at, n, key, *_ in _line_units(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64))], names=["id", "at", "n", "key"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines: id, at, key, shingles, bands."""
    for batch in batches:
        for line, at, _, key, a, b, g in _line_units(batch.column(1)):
            bands = np.empty((len(a), BANDS), tb.U)
            ends = np.stack([a, b], 1).ravel()
            padded = np.append(g, tb.U(0))
            for i in range(BANDS):
                band = np.full(len(a), i + 1, tb.U)
                for j in range(ROWS):
                    least = np.minimum.reduceat(padded * _ODD[i * ROWS + j], ends)[::2] if len(a) else band
                    band = tb.mix(band * tb.U(5) + least)
                bands[:, i] = band
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(line)), pa.array(at.astype(np.int32)), pa.array(key.view(np.int64)), pa.array((b - a).astype(np.int32)), lists],
                names=["id", "at", "key", "n", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines: key, its distinct shingles in order, as bytes."""
    for batch in batches:
        for _, _, _, key, a, b, g in _line_units(batch.column(1)):
            sets = [np.unique(g[x:y]).tobytes() for x, y in zip(a.tolist(), b.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(sets, pa.binary())], names=["key", "grams"])


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), tb.U) for c in (2, 3))
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["a", "b"])


def _block(table: pa.Table, percent: int) -> pa.Table:
    """One link for each pair of components with a link in this block: columns cid, at, grams."""
    cid, at = (table.column(c).to_numpy() for c in ("cid", "at"))
    sets = [np.frombuffer(x.as_buffer(), tb.U) for x in table.column("grams")]
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, token, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[token] > 1
    row, token = row[shared], np.unique(token[shared], return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, TILE):
        x, y = np.searchsorted(token, (lo, lo + TILE))
        marks = np.zeros((len(sets), int(token[y - 1]) - lo + 1), np.float32)
        marks[row[x:y], token[x:y] - lo] = 1
        common += marks @ marks.T
    found = []
    for lo in range(0, len(sets), 256):  # by rows, to keep the wide intermediates small
        part, rows = common[lo : lo + 256].astype(np.float64), slice(lo, lo + 256)
        linked = 100 * part >= percent * (size[rows, None] + size[None, :] - part)
        x, y = np.nonzero(linked & (at[rows, None] < at[None, :]))
        found.append(np.stack([x + lo, y]))
    x, y = np.concatenate(found, 1)
    _, first = np.unique(np.stack([at[x], at[y]]), axis=1, return_index=True)
    return pa.table({"a": cid[x[first]], "b": cid[y[first]]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _union(row: np.ndarray, start: np.ndarray, end: np.ndarray, rows: int) -> tuple[pa.Array, pa.Array]:
    """Of each row the union of its [start, end) spans, as ordered disjoint ones, and how long they are together."""
    order = np.lexsort((start, row))
    row, start, end = row[order].astype(np.int64), start[order].astype(np.int64), end[order].astype(np.int64)
    wide = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(row * wide + end)  # of all spans so far, which ends in an earlier row don't reach
    new = np.append(True, row[1:] * wide + start[1:] > reach[:-1])[: len(row)]
    opens = np.flatnonzero(new)
    ends = reach[np.append(opens[1:], len(row)) - 1] - row[opens] * wide if len(row) else reach
    offsets = np.searchsorted(row[opens], np.arange(rows + 1))
    flat = pa.StructArray.from_arrays([pa.array(start[opens].astype(np.int32)), pa.array(ends.astype(np.int32))], fields=list(_SPANS.value_type))
    sums = np.append(0, np.cumsum(ends - start[opens]))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat, type=_SPANS), pa.array(sums[offsets[1:]] - sums[offsets[:-1]])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, spans with again, clusters): id, n_repeated, n_removed, repeated, removed, clusters."""
    for batch in batches:
        spans = batch.column(1)
        row = np.repeat(np.arange(len(spans)), spans.value_lengths().to_numpy(zero_copy_only=False))
        start, end, again = (x.to_numpy(zero_copy_only=False) for x in spans.flatten().flatten())
        repeated, n_repeated = _union(row, start, end, len(spans))
        again = again.astype(bool)
        removed, n_removed = _union(row[again], start[again], end[again], len(spans))
        yield pa.RecordBatch.from_arrays([batch.column(0), n_repeated, n_removed, repeated, removed, batch.column(2)], names=["id", "n_repeated", "n_removed", "repeated", "removed", "clusters"])


def repeated(docs: DataFrame, text: str = "text", id: str = "doc_id", percent: int = PERCENT, across: bool = False) -> DataFrame:
    """doc_id, n_repeated, n_removed, repeated, removed, clusters for every document that repeats a passage.

    repeated: disjoint spans (start, end: words from 0, ends exclusive) that stand elsewhere too; removed:
    the lines among them that aren't the first of their cluster, and the windows that one before, by id, then place, is near to. n_*: words in them. clusters:
    the clusters' numbers, equal in all documents that share one. A passage
    that one document repeats within itself counts too, unless across is True. Passages of 50
    words or more are found, and lines of WORDS words or more; shorter repeats are left alone. Null and
    short texts have none. Rows with one id count as one document; a null id is no document and left out.
    Empty tables give an empty table.
    """
    small_batches(docs.sparkSession)
    source = docs.filter(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = docs.schema[id].dataType.simpleString()
    # Classes with several members. Members are counted before the shuffle, so a hot passage is a row a task.
    own_names = ("copies", "first", "last")
    own = (F.count("*").alias("copies"), F.min(F.struct("id", "at")).alias("first"), F.max("id").alias("last"))

    # Runs that stand at several places, with the least first run of the windows that hold them; and these windows.
    every = source.mapInArrow(lambda it: _runs(it, False), f"id {kind}, opens long, key long, times long")
    runs = cut(every.groupBy("key").agg(F.sum("times").alias("held"), F.min("opens").alias("least"), F.min("id").alias("owner")).filter("held > 1"))
    places = source.mapInArrow(lambda it: _runs(it, True), f"id {kind}, opens long, key long, at int, again boolean")
    windows = dealt_join(places, runs.drop("held"), "key", runs.select("key", "held"), F.struct("id", "at"), hashed=True)
    windows = cut(windows.select("id", "at", "opens", "least", (F.col("again") | (F.col("id") != F.col("owner"))).alias("again")))
    tied = components(windows.filter("opens <> least").select(F.col("opens").alias("a"), F.col("least").alias("b")).distinct())
    release(docs.sparkSession)

    lines = source.mapInArrow(_banded, f"id {kind}, at int, key long, n int, bands array<long>")
    lines = cut(lines.groupBy("key").agg(*own, F.first("n").alias("n"), F.first("bands").alias("bands")))
    banded = lines.select("key", "n", F.explode("bands").alias("value"))  # a band's place is hashed into its value
    lead = cut(banded.groupBy("value").agg(F.min("key").alias("a"), F.count("*").alias("held")).filter("held > 1"))
    posted = cut(dealt_join(banded, lead.drop("held"), "value", lead.select("value", "held"), F.col("key")).filter("key <> a").select("value", "a", F.col("key").alias("b"), "n"))
    pairs = cut(posted.select("a", "b").distinct())
    release(docs.sparkSession)

    def sets_of(keys: DataFrame) -> DataFrame:
        wanted = cut(keys.distinct())
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        return source.mapInArrow(_sets, "key long, grams binary").join(wanted, "key", "left_semi").dropDuplicates(["key"])

    sets = sets_of(pairs.select(F.col("a").alias("key")).union(pairs.select("b")))
    met = cut(pairs.groupBy("a").agg(F.count("*").alias("held")))
    links = cut(
        dealt_join(pairs, sets.select(F.col("key").alias("a"), F.col("grams").alias("x")), "a", met, F.col("b"))
        .join(sets.select(F.col("key").alias("b"), F.col("grams").alias("y")), "b").select("a", "b", "x", "y")
        .mapInArrow(lambda it: _verified(it, percent), "a long, b long")
    )
    root = components(links)

    # What a band's first class didn't take in. That class has met all the others, so only they are compared.
    release(docs.sparkSession)
    here = cut(posted.join(root.withColumnsRenamed({"node": "b", "root": "at"}), "b", "left").withColumn("at", F.coalesce("at", "b")))
    open_bands = here.groupBy("value").agg(F.min("at").alias("least"), F.max("at").alias("most")).filter("least <> most").select("value")
    member = cut(here.join(open_bands, "value", "left_semi").select("a", F.col("b").alias("cid"), "at", "n").distinct())
    if not member.isEmpty():
        blocks = cut(dealt(member))
        more = (
            blocks.join(sets_of(blocks.select(F.col("cid").alias("key"))).withColumnRenamed("key", "cid"), "cid")
            .groupBy("a", "lo", "hi").applyInArrow(lambda t: _block(t, percent), "a long, b long")
        )
        root = components(links.union(more))
    release(docs.sparkSession)

    # All classes, each with its cluster's first place; then the rows of a class need nothing but their class.
    found = lines.select("key", *own_names).join(root.withColumnsRenamed({"node": "key", "root": "cluster"}), "key", "left").filter("copies > 1 OR cluster IS NOT NULL")
    opened = windows.withColumnRenamed("opens", "key").groupBy("key").agg(*own).join(tied.withColumnsRenamed({"node": "key", "root": "cluster"}), "key", "left")
    classes = cut(found.union(opened.select(*found.columns)).withColumn("cluster", F.coalesce("cluster", "key")))
    stats = classes.groupBy("cluster").agg(F.min("key").alias("number"), F.min("first").alias("opening"), F.max("last").alias("last"), F.count("*").alias("held"))
    if across:
        stats = stats.filter(F.col("opening.id") != F.col("last"))
    stats = cut(stats.drop("last"))
    named = dealt_join(classes.drop("last"), stats.drop("held"), "cluster", stats.select("cluster", "held"), F.col("key"))
    named = cut(named.select("key", "copies", "opening", F.col("number").alias("cluster")))
    units = source.mapInArrow(_line_places, f"id {kind}, at int, n int, key long").withColumn("again", F.lit(None).cast("boolean"))
    units = units.union(windows.select("id", "at", F.lit(WORDS), "opens", "again"))
    again = F.coalesce("again", F.struct("id", "at") != F.col("opening"))
    marked = dealt_join(units, named.drop("copies"), "key", named.select("key", F.col("copies").alias("held")), F.struct("id", "at"), hashed=True).select(
        "id", "cluster", F.struct(F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end"), again.alias("again")).alias("span"),
    )
    by_doc = marked.groupBy("id").agg(F.collect_set("span").alias("spans"), F.array_sort(F.collect_set("cluster")).alias("clusters"))
    span = "array<struct<start:int,end:int>>"
    return by_doc.mapInArrow(_united, f"id {kind}, n_repeated long, n_removed long, repeated {span}, removed {span}, clusters array<long>").withColumnRenamed("id", id)


def op10_passages(spark, sf_dir):
    return repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
