"""TF-IDF as sparse rows, dispersion within groups, and anchoring of turns in their context."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parley.functions import text as tx
from parley.operators.turns import joined_text
from parley.operators.working import kept

VOCABULARY = 12_000


class Embedder(Protocol):
    """Text to sparse vectors: (id, text) in, (id, term, w) of length 1 out; texts without terms have no rows."""

    name: str

    def fit(self, texts: DataFrame) -> Embedder: ...

    def encode(self, texts: DataFrame) -> DataFrame: ...


class Tfidf:
    """Terms ranked by document count, then total count, then the term itself, all descending; the first
    max_features stay, with idf ln((1 + N) / (1 + df)) + 1."""

    name = "tfidf"

    def __init__(self, max_features: int = VOCABULARY, min_df: int = 1):
        self.max_features, self.min_df, self.vocabulary = max_features, min_df, None

    def fit(self, texts: DataFrame) -> Tfidf:
        n = texts.agg(F.count("*").alias("n"))
        per = term_counts(texts)
        df = per.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).filter(F.col("df") >= self.min_df)
        top = df.orderBy(F.desc("df"), F.desc("tf"), F.desc("term")).limit(self.max_features)
        self.vocabulary = top.crossJoin(F.broadcast(n)).select("term", "df", "tf", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # n is one row
        return self

    def encode(self, texts: DataFrame) -> DataFrame:
        hits = term_counts(texts).join(F.broadcast(self.vocabulary.select("term", "idf")), "term")  # max_features rows at most
        raw = hits.withColumn("w", F.col("tf") / F.sum("tf").over(Window.partitionBy("id")) * F.col("idf"))
        length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
        return raw.select("id", "term", (F.col("w") / length).alias("w"))


class Given:
    """Vectors that a model has made elsewhere: a table (text, v array) with one row a text. Texts without one, or with a null or zero
    vector, have no rows; of several rows of a text any one is taken."""

    name = "given"

    def __init__(self, table: DataFrame):
        self.table = table.select("text", "v").filter("v IS NOT NULL").dropDuplicates(["text"])

    def fit(self, texts: DataFrame) -> Given:
        return self

    def encode(self, texts: DataFrame) -> DataFrame:
        return to_sparse(texts.join(self.table, "text")).filter("w <> 0")


def build_embedder(kind: str = "auto", factory: Callable[[], Embedder] | None = None) -> Embedder:
    """tfidf; model, which factory makes and whose errors are raised; auto: the model if it can be made, else TF-IDF."""
    if kind == "tfidf" or kind == "auto" and factory is None:
        return Tfidf()
    if factory is None:
        raise ValueError("no model is given")
    try:
        return factory()
    except (ImportError, OSError):
        if kind == "auto":
            return Tfidf()
        raise


def term_counts(texts: DataFrame) -> DataFrame:
    return texts.select("id", F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def conversation_vectors(turns: DataFrame, embedder: Embedder | None = None, mode: str = "turns", max_chars: int = 0) -> DataFrame:
    """conv_id, term, w. mode turns: the mean of the turn vectors, of length 1, where turns without terms count in the
    mean; concat: the vector of the whole labelled conversation, cut to max_chars if that isn't 0."""
    embedder = embedder or Tfidf()
    if mode == "concat":
        texts = joined_text(turns, sep="\n", labels=True, max_chars=max_chars).withColumnRenamed("conv_id", "id")
        return embedder.fit(texts).encode(texts).withColumnRenamed("id", "conv_id")
    texts = turns.select(F.struct("conv_id", "turn_index").alias("id"), "text")
    rows = embedder.fit(texts).encode(texts).groupBy(F.col("id.conv_id").alias("conv_id"), "term").agg(F.sum("w").alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("conv_id")))
    return rows.select("conv_id", "term", (F.col("w") / length).alias("w"))


def to_sparse(vectors: DataFrame) -> DataFrame:
    """id, v array<double> -> id, term (the place in v), w, of length 1."""
    return vectors.select("id", F.posexplode(tx.l2_normal(F.transform("v", lambda x: x.cast("double")))).alias("term", "w"))


def dispersion(members: DataFrame, vectors: DataFrame, groups: list[str], least: int = 1) -> DataFrame:
    """Of each group its n, CED (mean cosine distance to the mean vector), and least and largest distance.

    members: id and the group columns; vectors: id, term, w of length 1, none for a zero vector, which is
    at distance 1 from everything.
    """
    rows = members.join(vectors, "id")
    size = members.groupBy(*groups).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    if least > 1:
        members = members.join(size.select(*groups), groups, "left_semi")
        rows = members.join(vectors, "id")
    centre = rows.groupBy(*groups, "term").agg(F.sum("w").alias("c"))
    length = centre.groupBy(*groups).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("len"))
    dots = rows.join(centre, [*groups, "term"]).groupBy("id", *groups).agg(F.sum(F.col("w") * F.col("c")).alias("dot"))
    each = members.join(dots, ["id", *groups], "left").join(length, groups, "left")
    each = each.withColumn("distance", 1 - F.coalesce(F.try_divide(F.col("dot"), F.col("len")), F.lit(0.0)))
    out = each.groupBy(*groups).agg(F.avg("distance").alias("CED"), F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"))
    return size.join(out, groups)


#: Members of a block on the average at most, and terms that are multiplied at once.
CHUNK, TILE = 1000, 4096


def _best_products(table: pa.Table, names: list[str]) -> pa.Table:
    """Of one pair of chunks (own: the member's) each member's largest product with one of the other chunk, or with another
    of its own where the pair is one chunk. Terms and weights are lists; no pair of members becomes a row."""
    own = table.column("own").to_numpy()
    lists = table.column("terms").combine_chunks()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    code = lists.flatten().dictionary_encode().indices.to_numpy()
    weight = table.column("ws").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    row, code, weight = row[order], code[order], weight[order]
    dots = np.zeros((len(own), len(own)))
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, TILE):
        x, y = np.searchsorted(code, (lo, lo + TILE))
        part = np.zeros((len(own), TILE))
        part[row[x:y], code[x:y] - lo] = weight[x:y]
        dots += part @ part.T
    apart = own[:, None] != own[None, :] if own.min() != own.max() or table.column("lo")[0] != table.column("hi")[0] else ~np.eye(len(own), dtype=bool)
    dots[~apart] = -np.inf
    met = apart.any(1)
    best = dots.max(1)[met]
    kept = table.select(names).filter(pa.array(met))
    return kept.append_column("dot", pa.array(best))


def nearest(members: DataFrame, vectors: DataFrame, groups: list[str]) -> DataFrame:
    """id, groups, nn_distance: 1 minus the largest product with another member; groups of one have none.

    Members of a group are dealt by hash into chunks of bounded size, and each pair of chunks is one task that multiplies
    matrices; so neither a large group nor a common term comes to one task, and no pair becomes a row.
    """
    listed = vectors.groupBy("id").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("ws"))
    size = members.groupBy(*groups).agg(F.count("*").alias("n"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).filter("n > 1").drop("n")
    empty = lambda name: F.coalesce(name, F.array().cast(listed.schema[name].dataType))
    dealt = members.join(size, groups).join(listed, "id", "left").withColumn("own", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    names = ["id", *groups]
    blocks = dealt.select(*names, "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), empty("terms").alias("terms"), empty("ws").alias("ws"))
    schema = T.StructType([*[blocks.schema[c] for c in names], T.StructField("dot", T.DoubleType())])
    found = blocks.groupBy(*groups, "lo", "hi").applyInArrow(lambda t: _best_products(t, names), schema)
    return found.groupBy(*names).agg((1 - F.max("dot")).alias("nn_distance"))


def with_nearest(groups_of: DataFrame, near: DataFrame, groups: list[str]) -> DataFrame:
    means = near.groupBy(*groups).agg(F.avg("nn_distance").alias("mean_nn_distance"), F.min("nn_distance").alias("min_nn_distance"))
    return groups_of.join(means, groups, "left")


def matched_topics(by_topic: DataFrame, baseline: str = "SB") -> DataFrame:
    """Means by condition over the topics that the baseline has too; topics compare in small letters, trimmed."""
    keyed = by_topic.withColumn("key", F.lower(F.trim("topic")))
    own = keyed.filter(F.col("condition") == baseline).select("key").distinct()
    return keyed.join(own, "key", "left_semi").groupBy("condition").agg(F.count("*").alias("n_topics"), F.avg("CED").alias("CED"), F.avg("mean_nn_distance").alias("mean_nn_distance"))


def anchoring(turns: DataFrame, embedder: Embedder | None = None, k: int = 5, seed: int | None = None) -> DataFrame:
    """conv_id, turn_index, cas_real_similarity, cas_wrong_similarity, cas, cas_negatives for turns after the first: the
    cosine with the true previous turn, the mean cosine with cas_negatives previous turns of other conversations, and the
    first less the second. A turn without a pool has no wrong similarity and no cas.

    The pool are the contexts of the same topic, if at least max(2, min(k, 5)) of those stand in other
    conversations and there is a topic, else all contexts; the own conversation's and empty ones are out.
    seed None takes the mean over the whole pool: by linearity the product with the pool's sum, less the own
    conversation's share, so no pair is formed. With a seed, k of the pool are drawn by hash for each turn.
    """
    embedder = embedder or Tfidf()
    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn_index"))
    topic = F.lower(F.trim(F.coalesce("topic", F.lit(""))))
    rows = turns.select("conv_id", "turn_index", topic.alias("topic"), "text", prev.alias("prev")).filter(F.col("prev").isNotNull())
    ctx = rows.select(F.struct("conv_id", "turn_index", F.lit("c").alias("part")).alias("id"), F.col("prev").alias("text"))
    res = rows.select(F.struct("conv_id", "turn_index", F.lit("r").alias("part")).alias("id"), "text")
    vectors = embedder.fit(ctx.union(res)).encode(ctx.union(res)).select("id.*", "term", "w")
    vectors = kept(vectors)  # used five times
    key = ["conv_id", "turn_index"]
    c, r = (vectors.filter(F.col("part") == p).drop("part") for p in "cr")
    true = c.withColumnRenamed("w", "x").join(r, [*key, "term"]).groupBy(*key).agg(F.sum(F.col("x") * F.col("w")).alias("true"))
    info = rows.select(*key, "topic", (F.trim("prev") != "").cast("long").alias("full"))
    if seed is None:
        pool = info.join(c, key, "left")
        scopes = {}
        for scope, by in (("t", ["topic"]), ("a", [])):
            scopes[scope] = (
                info.groupBy(*by).agg(F.count("*").alias(f"n_{scope}"), F.sum("full").alias(f"f_{scope}")),
                pool.filter("term is not null").groupBy(*by, "term").agg(F.sum("w").alias("s")), by,
            )
        own = info.groupBy("conv_id", "topic").agg(F.count("*").alias("n_o"), F.sum("full").alias("f_o"))
        own_sum = c.groupBy("conv_id", "term").agg(F.sum("w").alias("s"))
        base = info.join(own, ["conv_id", "topic"])
        base = base.join(scopes["t"][0], "topic").crossJoin(F.broadcast(scopes["a"][0]))  # one row
        base = base.withColumn("narrow", _narrow(k)).withColumn("size", F.when(F.col("narrow"), F.col("f_t")).otherwise(F.col("f_a")) - F.col("f_o"))
        rt = r.join(base.select(*key, "topic", "narrow"), key)
        near = rt.filter("narrow").join(scopes["t"][1], ["topic", "term"]).select(*key, (F.col("w") * F.col("s")).alias("p"))
        far = rt.filter("not narrow").join(scopes["a"][1], "term").select(*key, (F.col("w") * F.col("s")).alias("p"))
        mine = rt.join(own_sum, ["conv_id", "term"]).select(*key, (-F.col("w") * F.col("s")).alias("p"))
        other = near.union(far).union(mine).groupBy(*key).agg(F.sum("p").alias("p"))
        out = base.join(other, key, "left").withColumns({"wrong": F.when(F.col("size") > 0, F.coalesce("p", F.lit(0.0)) / F.col("size")), "negatives": F.col("size")})
    else:
        out = info.join(_drawn(info, c, r, k, seed), key, "left")
    real = F.coalesce("true", F.lit(0.0))
    return out.join(true, key, "left").select(
        *key, real.alias("cas_real_similarity"), F.col("wrong").alias("cas_wrong_similarity"), (real - F.col("wrong")).alias("cas"), F.coalesce("negatives", F.lit(0)).cast("long").alias("cas_negatives")
    )


def _narrow(k: int) -> Column:
    """Whether a turn's pool is its topic: n_t contexts stand in the topic, n_o of them in the own conversation."""
    return (F.col("topic") != "") & (F.col("n_t") - F.col("n_o") >= max(2, min(k, 5)))


def _drawn(info: DataFrame, c: DataFrame, r: DataFrame, k: int, seed: int) -> DataFrame:
    """Mean product of each turn with k contexts drawn from its pool. Contexts stand in the ring of their topic and in
    that of all, named "", by hash of conversation, then of turn. What is left of a turn's ring without its conversation
    is cut into k equal parts, and the turn takes from each the context at its own hash; of k or fewer it takes all."""
    size = info.groupBy("topic").agg(F.count("*").alias("n_t"))
    size_own = info.groupBy("conv_id", "topic").agg(F.count("*").alias("n_o"))
    turn = info.join(size_own, ["conv_id", "topic"]).join(size, "topic").select("conv_id", "turn_index", F.when(_narrow(k), F.col("topic")).otherwise("").alias("ring"))

    ring = info.filter("full = 1").select(F.explode(F.array_distinct(F.array("topic", F.lit("")))).alias("ring"), "conv_id", "turn_index")
    # Where each conversation starts: parts of the hash's range keep a window over a whole ring to 4096 rows.
    convs = ring.groupBy("ring", "conv_id").agg(F.count("*").alias("own")).withColumn("spot", F.xxhash64(F.lit(seed), "conv_id"))
    convs = convs.withColumn("part", F.shiftrightunsigned("spot", 52))
    parts = convs.groupBy("ring", "part").agg(F.sum("own").alias("held"))
    parts = parts.withColumn("before", F.sum("held").over(Window.partitionBy("ring").orderBy("part")) - F.col("held"))
    upto = F.sum("own").over(Window.partitionBy("ring", "part").orderBy("spot", "conv_id"))
    convs = convs.join(parts, ["ring", "part"]).select("ring", "conv_id", "own", (F.col("before") + upto - F.col("own")).alias("start"))
    within = F.row_number().over(Window.partitionBy("ring", "conv_id").orderBy(F.xxhash64(F.lit(seed), "conv_id", "turn_index"), "turn_index"))
    placed = ring.withColumn("i", within - 1).join(convs, ["ring", "conv_id"]).select("ring", (F.col("start") + F.col("i")).alias("at"), F.col("conv_id").alias("c_conv"), F.col("turn_index").alias("c_turn"))

    u = F.pmod(F.xxhash64(F.lit(seed + 1), "conv_id", "turn_index"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    asked = turn.join(ring.groupBy("ring").agg(F.count("*").alias("m")), "ring").join(convs, ["ring", "conv_id"], "left").fillna(0, ["own", "start"])
    asked = asked.withColumn("others", F.col("m") - F.col("own")).withColumn("n", F.least(F.col("others"), F.lit(k).cast("long"))).filter("n > 0")
    asked = asked.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    asked = asked.withColumn("at", (F.col("start") + F.col("own") + F.floor((u + F.col("step")) * F.col("others") / F.col("n"))) % F.col("m"))
    chosen = asked.join(placed, ["ring", "at"]).select("conv_id", "turn_index", "c_conv", "c_turn")
    context = c.select(F.col("conv_id").alias("c_conv"), F.col("turn_index").alias("c_turn"), "term", F.col("w").alias("x"))
    dots = chosen.join(r, ["conv_id", "turn_index"]).join(context, ["c_conv", "c_turn", "term"]).groupBy("conv_id", "turn_index").agg(F.sum(F.col("w") * F.col("x")).alias("p"))
    n = chosen.groupBy("conv_id", "turn_index").agg(F.count("*").alias("n"))
    return n.join(dots, ["conv_id", "turn_index"], "left").select("conv_id", "turn_index", (F.coalesce("p", F.lit(0.0)) / F.col("n")).alias("wrong"), F.col("n").alias("negatives"))


def cas_by_conversation(cas: DataFrame) -> DataFrame:
    """Means of the turns that have a value."""
    return cas.groupBy("conv_id").agg(F.avg("cas").alias("CAS"), F.count("cas").alias("cas_turns"))


def projection(vectors: DataFrame, k: int = 2) -> DataFrame:
    """id and its place on the first k principal axes of centred dense vectors (id, v); signs are arbitrary."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    dense = vectors.select("id", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("f"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="f", outputCol="c").fit(dense).transform(dense)
    out = PCA(k=k, inputCol="c", outputCol="p").fit(centred).transform(centred)
    return out.select("id", vector_to_array("p").alias("p")).select("id", *[F.col("p")[i].alias(f"pc{i + 1}") for i in range(k)])
