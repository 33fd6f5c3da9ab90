"""Alignment of adjacent turns: cosines of their n-gram counts, of word classes, and of meaning by word vectors.

All n-grams of a pair of turns are rows that are counted by pair, kind and n-gram. The pairs come from a
window by conversation, and every later grouping begins with the conversation, so turns are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions import text as tx
from parley.operators.working import kept

#: Closed word classes, each under its tag; what is in none is told by its ending.
CLASSES = {
    "PRP": "i you he she it we they me him her us them my your his its our their mine yours myself yourself",
    "DT": "the a an this that these those each every some any no",
    "IN": "of in on at by for with from to into about over under after before between through during without than as if because while",
    "CC": "and or but nor so yet",
    "VB": "am is are was were be been being have has had do does did can could will would shall should may might must go get know think like mean say want",
    "WP": "what who which when where why how whose",
    "RB": "not very too also just really well here there now then never always",
    "UH": "oh okay ok uh um hm huh yeah yes no hi hello hey bye wow haha",
}
ENDINGS = (("RB", r"ly$"), ("VBG", r"ing$"), ("VBD", r"ed$"), ("JJ", r"(ous|ful|ive|able|ible|al|ic|less)$"), ("NNS", r"[^s]s$"))
SIZES = (2, 3)
MEASURES = tuple(f"{family}_{kind}{n}" for family in ("syntax_stan", "lexical") for kind in ("tok", "lem") for n in SIZES)


def lemma(word: Column) -> Column:
    """A word in small letters without the endings of plurals and verbs, by rule."""
    n, cut = F.length(word), lambda k, end="": F.concat(F.substring(word, F.lit(1), F.length(word) - k), F.lit(end))
    return (
        F.when((n > 4) & word.rlike("ies$"), cut(3, "y")).when((n > 4) & word.rlike("(s|x|z|ch|sh)es$"), cut(2)).when((n > 3) & word.rlike("[^sui]s$"), cut(1))
        .when((n > 5) & word.rlike("ing$"), cut(3)).when((n > 4) & word.rlike("ed$"), cut(2)).otherwise(word)
    )


def tag(word: Column) -> Column:
    """The class of a word in small letters."""
    listed = [(name, word.isin(words.split())) for name, words in CLASSES.items()]
    ended = [(name, word.rlike(pattern)) for name, pattern in ENDINGS]
    return reduce(lambda c, own: c.when(own[1], own[0]), [*listed[1:], *ended], F.when(listed[0][1], listed[0][0])).otherwise("NN")


def pairs(turns: DataFrame) -> DataFrame:
    """Turns that follow one of another speaker, with that one's text as prev; also n_turns of the conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn_index")
    own = turns.withColumns({"prev": F.lag("text").over(w), "__before": F.lag("speaker").over(w), "__first": F.lag(F.lit(True)).over(w).isNull(), "n_turns": F.count("*").over(Window.partitionBy("conv_id"))})
    return own.filter("NOT __first AND __before IS DISTINCT FROM speaker").drop("__before", "__first")


def ngram_alignment(turns: DataFrame, lemma: Callable[[Column], Column] = lemma, tag: Callable[[Column], Column] = tag) -> DataFrame:
    """conv_id, turn_index and MEASURES of each turn that follows one of another speaker.

    lexical_*: the cosine of the counts of the two turns' n-grams of words (tok) or of their lemmas (lem). syntax_stan_*: of the n-grams of
    word classes, those left out whose words stand in both turns, so that repeated words don't count as alike structure. Null where a turn has no n-gram left; lemma and tag may be any
    functions of a word. Null texts are turns without words.
    """
    words = lambda c: tx.tokens(F.coalesce(F.col(c), F.lit("")))
    keys = ["conv_id", "turn_index"]

    def grams(side: str, kind: str, n: int) -> Column:
        forms, tags = f"__{side}_{kind}", f"__{side}_tag"
        places = F.when(F.size(forms) >= n, F.sequence(F.lit(1), F.size(forms) - (n - 1))).otherwise(F.array().cast("array<int>"))
        part = lambda c, i: F.array_join(F.slice(c, i, n), " ")
        return F.transform(places, lambda i: F.struct(F.lit(f"{kind}{n}").alias("kind"), F.lit(side).alias("side"), part(forms, i).alias("gram"), part(tags, i).alias("tags")))

    own = pairs(turns).select(*keys, words("prev").alias("__a_tok"), words("text").alias("__b_tok"))
    for side in "ab":
        own = own.withColumns({f"__{side}_lem": F.transform(f"__{side}_tok", lemma), f"__{side}_tag": F.transform(f"__{side}_tok", tag)})
    every = F.concat(*[grams(side, kind, n) for side in "ab" for kind in ("tok", "lem") for n in SIZES])
    rows = own.select(*keys, F.explode_outer(every).alias("g")).select(*keys, "g.*")
    on = lambda side: F.count_if(F.col("side") == side)
    by_gram = rows.groupBy(*keys, "kind", "gram", "tags").agg(on("a").alias("a"), on("b").alias("b"))
    times = lambda x, y, c: F.sum(F.when(c, F.col(x) * F.col(y)).otherwise(0))
    alone = (F.col("a") == 0) | (F.col("b") == 0)
    by_tags = by_gram.groupBy(*keys, "kind", "tags").agg(
        *[times(x, y, F.lit(True)).alias(f"{x}{y}") for x, y in ("ab", "aa", "bb")], F.sum(F.when(alone, F.col("a"))).alias("a"), F.sum(F.when(alone, F.col("b"))).alias("b")
    )
    by_kind = by_tags.groupBy(*keys, "kind").agg(
        *[F.sum(c).alias(c) for c in ("ab", "aa", "bb")], *[F.sum(F.col(x) * F.col(y)).alias(f"t{x}{y}") for x, y in ("ab", "aa", "bb")]
    )
    cosine = lambda p: F.when((F.col(f"{p}aa") > 0) & (F.col(f"{p}bb") > 0), F.col(f"{p}ab") / F.sqrt(F.col(f"{p}aa").cast("double") * F.col(f"{p}bb")))
    valued = by_kind.select(*keys, "kind", cosine("").alias("lexical"), cosine("t").alias("syntax_stan"))
    measures = [F.max(F.when(F.col("kind") == m.rsplit("_", 1)[1], F.col(m.rsplit("_", 1)[0]))).alias(m) for m in MEASURES]
    return valued.groupBy(*keys).agg(*measures)


def word_vectors(turns: DataFrame, size: int = 32, least: int = 2, window: int = 5, seed: int = 7, iterations: int = 5, partitions: int | None = None) -> DataFrame:
    """(word, v): vectors of the words that stand least times or more, trained on the turns by skip-grams.

    Skip-grams are counted, nearer ones for more, as windows of random width count them on average. What training by samples tends to, a
    factorisation of the pairs' mutual information, is computed on the counts: each iteration multiplies the matrix of its positive values by
    size vectors a word, and makes those orthonormal. Words and pairs stay rows; the driver sees size * size products of components
    in each iteration. Neither order nor partitions of the turns matter, but for rounding. The matrix lies in so many partitions, by default those of
    shuffles. Words without a skip-gram that is more frequent than by chance get no vector; no word that often: no vectors.
    """
    if partitions is None:
        partitions = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    matrix = information(*skip_grams(turns, least, window)).repartition(partitions, "other").persist(StorageLevel.DISK_ONLY)
    hashed = F.array(*[F.xxhash64(F.lit(seed), F.lit(i), "word") / float(1 << 63) for i in range(size)])
    vectors = kept(matrix.select(F.col("other").alias("word")).distinct().withColumn("v", hashed))
    for i in range(iterations):
        near = matrix.join(vectors.select(F.col("word").alias("other"), "v").hint("shuffle_hash"), "other")
        summed = near.groupBy("word").agg(*[F.sum(F.col("x") * F.get("v", F.lit(k))).alias(f"s{k}") for k in range(size)])
        vectors = kept(summed.select("word", F.array(*[f"s{k}" for k in range(size)]).alias("v")))
        vectors = _turned(vectors, _power(_products(vectors, size), -0.5 if i < iterations - 1 else -0.25))  # at last each direction as long as the root of its value
    vectors = kept(vectors)
    matrix.unpersist()
    return vectors


def skip_grams(turns: DataFrame, least: int, window: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, n), a <= b: the words of two places of a turn that lie window places apart at most, of which the nearest count window
    times and the farthest once; and (word, total) of words that stand least times or more, with their sum of n."""
    texts = turns.select(tx.tokens(F.coalesce("text", F.lit(""))).alias("words"))
    frames = texts.filter(F.size("words") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.slice("words", i, window + 1))).alias("f"))
    both = frames.select(F.get("f", F.lit(0)).alias("x"), F.posexplode(F.slice("f", 2, window)).alias("d", "y"))
    grams = kept(both.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum(window - F.col("d")).alias("n")))
    often = texts.select(F.explode("words").alias("word")).groupBy("word").count().filter(F.col("count") >= least).select("word")
    totals = grams.select(F.explode(F.array("a", "b")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("total"))
    return grams, kept(totals.join(often, "word"))


def information(grams: DataFrame, totals: DataFrame) -> DataFrame:
    """(other, word, x), both ways round: how much more frequent than by chance, as a logarithm, a skip-gram of two words is, where it is. The
    one word's frequency is smoothed by the power 0.75, as negative samples are drawn, and the mean of both ways is taken."""
    smoothed = 0.75
    whole = totals.agg(F.sum(F.pow("total", F.lit(smoothed))).alias("whole"))
    own = lambda name: totals.select(F.col("word").alias(name), (F.log("total") * ((1 + smoothed) / 2)).alias(f"log_{name}"))
    count = F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n"))
    known = grams.join(own("a"), "a").join(own("b"), "b").crossJoin(F.broadcast(whole))  # one row
    valued = known.select("a", "b", (F.log(count) + F.log("whole") - F.col("log_a") - F.col("log_b")).alias("x")).filter("x > 0")
    way = lambda a, b: F.struct(F.col(a).alias("other"), F.col(b).alias("word"))
    ways = F.when(F.col("a") == F.col("b"), F.array(way("a", "b"))).otherwise(F.array(way("a", "b"), way("b", "a")))
    return valued.select(F.explode(ways).alias("w"), "x").select("w.*", "x")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("v"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _products(vectors: DataFrame, size: int) -> np.ndarray:
    """Sums over all vectors of the products of their components."""

    def sums(batches):
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch)
                total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(range(size * size), pa.int32()), pa.array(total.ravel())], names=["i", "x"])

    found = vectors.select("v").mapInArrow(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # size * size rows
    out = np.zeros(size * size)
    for r in found:
        out[r["i"]] = r["x"]
    return out.reshape(size, size)


def _power(products: np.ndarray, exponent: float) -> np.ndarray:
    """The symmetric power of a matrix of products; directions that hold nothing stay out."""
    values, axes = np.linalg.eigh((products + products.T) / 2)
    there = values > max(values.max(), 0) * 1e-13
    return (axes[:, there] * values[there] ** exponent) @ axes[:, there].T


def _turned(vectors: DataFrame, by: np.ndarray) -> DataFrame:
    def turned(batches):
        for batch in batches:
            if batch.num_rows:
                v = (_matrix(batch) @ by).ravel()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * len(by), pa.array(v))], names=["word", "v"])

    return vectors.select("word", "v").mapInArrow(turned, "word string, v array<double>")


def semantic_alignment(turns: DataFrame, vectors: DataFrame) -> DataFrame:
    """conv_id, turn_index, cosine_semanticL: the cosine of the summed vectors (word, v) of a turn's words and of those of the one before it.

    vectors may be trained or given; words without one don't count, and a turn without any has no value. A side's components are summed
    side by side in one grouping, so no list of words is gathered.
    """
    keys = ["conv_id", "turn_index"]
    own = pairs(turns)
    width = vectors.agg(F.max(F.coalesce(F.size("v"), F.lit(0)))).first()[0] or 0  # one number; the longest vector's
    side = lambda c, name: F.transform(tx.tokens(F.coalesce(F.col(c), F.lit(""))), lambda w: F.struct(F.lit(name).alias("side"), w.alias("word")))
    said = own.select(*keys, F.explode(F.concat(side("prev", "a"), side("text", "b"))).alias("s")).groupBy(*keys, "s.side", "s.word").agg(F.count("*").alias("n"))
    sums = said.join(vectors.select("word", "v"), "word").groupBy(*keys, "side").agg(F.sum("n").alias("words"), *[F.sum(F.col("n") * F.get("v", F.lit(i))).alias(f"s{i}") for i in range(width)])
    whole = sums.select(*keys, "side", F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in range(width)]).cast("array<double>").alias("v"))
    of = lambda name: F.max(F.when(F.col("side") == name, F.col("v")))
    both = whole.groupBy(*keys).agg(of("a").alias("a"), of("b").alias("b")).select(*keys, *[tx.dot(F.col(x), F.col(y)).alias(x + y) for x, y in ("ab", "aa", "bb")])
    value = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")))
    return both.select(*keys, value.alias("cosine_semanticL")).filter("cosine_semanticL IS NOT NULL")


def alignment_table(turns: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """The table that alignment readers, sections and models take: condition, conv_id, turn_index, n_turns, cosine_semanticL (null
    without vectors), the sub-measures, and the mean of each family's sub-measures that are there."""
    names = pairs(turns).select("condition", "conv_id", "turn_index", "n_turns")
    out = names.join(ngram_alignment(turns), ["conv_id", "turn_index"], "left")
    if vectors is None:
        out = out.withColumn("cosine_semanticL", F.lit(None).cast("double"))
    else:
        out = out.join(semantic_alignment(turns, vectors), ["conv_id", "turn_index"], "left")
    for family in ("syntax_stan", "lexical"):
        own = [F.col(m) for m in MEASURES if m.startswith(family)]
        there = F.filter(F.array(*own), lambda x: x.isNotNull())
        out = out.withColumn(family, F.try_divide(F.aggregate(there, F.lit(0.0), lambda s, x: s + x), F.size(there)))
    return out.select("condition", "conv_id", "turn_index", "n_turns", "cosine_semanticL", *MEASURES, "syntax_stan", "lexical")
