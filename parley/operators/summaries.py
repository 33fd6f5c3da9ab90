"""Summaries of several grains in one pass, and sketches that merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import lexicon as lx
from parley.functions import text as tx
from parley.operators.labels import source_of
from parley.operators.metrics import KEYS, tidy

#: Columns of grains, and the grains of the tables by condition.
GRAIN = ("source", "architecture", "prompt_level", "condition")
GRAINS = (("condition",), ("architecture", "prompt_level"), ("architecture",), ("prompt_level",), ("source",), ())


def by_grains(turns: DataFrame, grains: tuple[tuple[str, ...], ...] = GRAINS) -> DataFrame:
    """GRAIN, grain, conversations, turns, words_per_turn and marker rates of every group of every grain.

    Two weights in one table: words_per_turn is pooled over turns, rates are means over conversations. Turns are summed by conversation
    once, and the grains are grouping sets over conversations. grain names the columns of a row's group; in it the
    others are null.
    """
    rows = tidy(turns)
    conversations = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("words").alias("w"), *[F.sum(k).alias(k) for k in lx.MARKERS])
    own = conversations.withColumn("source", source_of(F.col("condition")))
    rate = lambda k: F.avg(100 * F.col(k) / F.greatest("w", F.lit(1)))
    sets = own.groupingSets([[F.col(c) for c in g] for g in grains], *[F.col(c) for c in GRAIN]).agg(
        F.grouping_id().alias("__id"), F.count("*").alias("conversations"), F.sum("n").alias("turns"), (F.sum("w") / F.sum("n")).alias("words_per_turn"), *[rate(k).alias(f"{k}_rate") for k in lx.MARKERS]
    )
    name = F.concat_ws(", ", *[F.when(F.expr(f"(__id >> {len(GRAIN) - 1 - i}) & 1") == 0, F.lit(c)) for i, c in enumerate(GRAIN)])
    return sets.withColumn("grain", F.when(name == "", "all").otherwise(name)).drop("__id")


#: Buckets of the distinct counts (2 to this) and size of the quantile states.
HLL_BITS, KLL_SIZE = 12, 200
#: Three standard errors of the count, and the error of a rank that 99 of 100 states keep to.
HLL_ERROR, KLL_ERROR = 3 * 1.04 / (1 << HLL_BITS) ** 0.5, 0.0133


def sketches(turns: DataFrame) -> DataFrame:
    """conv_id, condition, and two states of a conversation: its different words (HLL) and its turns' lengths (KLL)."""
    words = F.transform(tx.tokens(F.coalesce("text", F.lit(""))), lambda w: w)
    lengths = turns.groupBy("conv_id", "condition").agg(F.kll_sketch_agg_bigint(tx.n_words(F.coalesce("text", F.lit(""))), F.lit(KLL_SIZE)).alias("lengths"))
    vocabulary = turns.select("conv_id", F.explode(words).alias("word")).groupBy("conv_id").agg(F.hll_sketch_agg("word", F.lit(HLL_BITS)).alias("vocabulary"))
    return lengths.join(vocabulary, "conv_id", "left")


def merged(states: DataFrame, by: str) -> DataFrame:
    """The states of sketches merged by a column: state tables of parts merge to that of the whole."""
    return states.groupBy(by).agg(F.hll_union_agg("vocabulary").alias("vocabulary"), F.kll_merge_agg_bigint("lengths").alias("lengths"))


def read(states: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """vocabulary and quantiles of lengths, as estimates."""
    q: list[Column] = [F.kll_sketch_get_quantile_bigint("lengths", F.lit(x)).alias(f"q{int(100 * x)}") for x in quantiles]
    return states.select(*[c for c in states.columns if c not in ("vocabulary", "lengths")], F.coalesce(F.hll_sketch_estimate("vocabulary"), F.lit(0)).alias("vocabulary"), *q)
