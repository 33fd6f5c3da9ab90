"""Defects of conversations: fragments, loops, drift, leaks, assistant tells, missing ends; and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions import lexicon as lx
from parley.functions import text as tx

SEEDS, LOOP_CHARS = 2, 12


def body_flags(turns: DataFrame, spanish=lx.DRIFT_WORDS, leak: str = lx.LEAK, foreign_script: bool = True) -> DataFrame:
    """Turns with is_body (after the seed greetings, which C1 has not), words and defect flags. A body turn loops if
    its normal form, longer than LOOP_CHARS, stood in the body before."""
    t = F.col("text")
    rows = turns.withColumn("is_body", F.col("turn_index") >= F.when(F.col("condition").startswith("C1"), 0).otherwise(SEEDS))
    rows = rows.withColumn("norm", tx.normal(t))
    before = F.row_number().over(Window.partitionBy("conv_id", "is_body", "norm").orderBy("turn_index"))
    return rows.withColumns({
        "words": tx.n_words(t), "fragment": tx.is_fragment(t), "loop": (before > 1) & (F.length("norm") > LOOP_CHARS),
        "drift": tx.is_drift(t, spanish, foreign_script), "leak": tx.has(t, leak), "tell": tx.has(t, lx.TELLS), "closing": tx.has(t, lx.CLOSING),
    })


def conversation_quality(turns: DataFrame, n_body: bool = False, **kinds) -> DataFrame:
    """n_turns over all turns; the rest over the body. Conversations without a body are left out. kinds: see body_flags."""
    body = F.col("is_body")
    n = lambda c: F.count_if(body & F.col(c))
    out = (
        body_flags(turns, **kinds).groupBy("conv_id", "condition").agg(
            F.count("*").alias("n_turns"), F.count_if(body).alias("n_body"), F.median(F.when(body, F.col("words"))).alias("median_words"),
            n("fragment").alias("fragments"), n("loop").alias("loops"), n("drift").alias("drift"), n("leak").alias("leaks"), n("tell").alias("tells"),
            F.max_by("closing", F.when(body, F.col("turn_index"))).alias("closed_naturally"),
        )
        .filter("n_body > 0")
    )
    return out if n_body else out.drop("n_body")


def verdicts(quality: DataFrame) -> DataFrame:
    """Sums by condition. PASS without defects, FLAG with at most one a conversation, else BAD; C1 needs no end."""
    no_end = F.count_if(~F.col("closed_naturally") & ~F.col("condition").startswith("C1"))
    total = lambda c: F.sum(c).alias(c)
    out = quality.groupBy("condition").agg(
        F.count("*").alias("n"), F.avg("n_turns").alias("mean_turns"), F.avg("median_words").alias("mean_median_words"),
        *[total(c) for c in ("fragments", "loops", "drift", "leaks", "tells")], no_end.alias("no_end"),
    )
    bad = F.col("fragments") + F.col("loops") + F.col("drift") + F.col("leaks") + F.col("no_end")
    return out.withColumn("bad", bad).withColumn("verdict", F.when(F.col("bad") == 0, "PASS").when(F.col("bad") <= F.col("n"), "FLAG").otherwise("BAD"))


def worst(quality: DataFrame, k: int = 3) -> DataFrame:
    """The k conversations of each condition with the most defects; those without any aren't shown."""
    score = F.col("fragments") + F.col("loops") + F.col("drift") + F.col("leaks")
    rank = F.row_number().over(Window.partitionBy("condition").orderBy(F.desc("score"), "conv_id"))
    return quality.withColumn("score", score).filter("score > 0").withColumn("rank", rank).filter(F.col("rank") <= k).select("condition", "rank", "conv_id", "score")


def compared(new: DataFrame, old: DataFrame, **kinds) -> DataFrame:
    """Two sets of turns under the same lists and patterns (kinds): each new conversation's body turns, median words,
    leaks, drift and loops next to the old ones', null where the old set lacks it."""

    def side(turns: DataFrame, tag: str) -> DataFrame:
        q = conversation_quality(turns, n_body=True, **kinds).withColumn("n_turns", F.col("n_body"))
        return q.select("conv_id", *[F.col(c).cast("double").alias(f"{c}_{tag}") for c in ("n_turns", "median_words", "leaks", "drift", "loops")])

    return side(new, "new").join(side(old, "old"), "conv_id", "left")


def final_check(turns: DataFrame, cap: int = 32) -> DataFrame:
    """Of each conversation its turns with the seeds, median words, loops, Spanish turns, leaks and fragments of the body,
    and whether it ended before the cap."""
    q = conversation_quality(turns, n_body=True, spanish=lx.DRIFT_WORDS_FINAL, foreign_script=False)
    n = F.col("n_body") + SEEDS
    return q.select("conv_id", "condition", n.alias("n"), "median_words", "loops", F.col("drift").alias("spanish"), "leaks", "fragments", (n < cap).alias("ended_early"))
