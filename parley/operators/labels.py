"""Rule labels of turns, topic codes, and the social indices built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import lexicon as lx
from parley.functions import text as tx
from parley.operators.metrics import KEYS
from parley.operators.turns import previous

LABELS = {
    "A": "A_task_help_advice", "B": "B_social_continuation", "C": "C_phatic_bonding", "D": "D_grounding_backchannel",
    "E": "E_personal_stance_experience", "G": "G_repair_clarification", "H": "H_assistant_explanation",
}


def topic_code(prev: Column, text: Column) -> Column:
    """F1 kept, F2 eased over, F3 broken, F4 repeated, by the share of this turn's tokens seen in the last."""

    def coded(cur: Column) -> Column:
        share = F.size(F.array_intersect(F.array_distinct(tx.tokens(prev)), cur)) / F.size(cur)
        return (
            F.when(prev.isNull() | (prev == ""), "F1_maintain")
            .when((F.size(cur) == 0) | (tx.clean_lower(prev) == tx.clean_lower(text)), "F4_loop")
            .when(share >= lx.TOPIC_MAINTAIN, "F1_maintain").when(share >= lx.TOPIC_SHIFT, "F2_smooth_shift").otherwise("F3_abrupt_drift")
        )

    return tx.let(F.array_distinct(tx.tokens(text)), coded)


def adjacent_overlap(turns: DataFrame) -> DataFrame:
    """conv_id, turn_index, overlap for turns after the first: shared distinct tokens over all of the two turns, null
    without any. It stands in for the alignment measures of an external package, and isn't one of them."""
    words = lambda c: F.array_distinct(tx.tokens(c))
    pairs = turns.withColumn("__prev", previous("text")).filter("__prev IS NOT NULL").select("conv_id", "turn_index", words(F.col("__prev")).alias("a"), words(F.col("text")).alias("b"))
    return pairs.select("conv_id", "turn_index", F.try_divide(F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))).alias("overlap"))


def labelled(turns: DataFrame) -> DataFrame:
    """Turns with the seven flags (0/1), topic_code, assistant_like and social_like. B comes last: it needs C, E and H."""
    low, n, has = F.col("__low"), F.col("__n"), lambda p: tx.has(F.col("__low"), p)
    flag = lambda c: c.cast("int")
    base = turns.withColumns({"__low": tx.clean_lower(F.col("text")), "__prev": previous("text")}).withColumn("__n", tx.n_words(low))
    out = base.withColumns({
        LABELS["A"]: flag(has(lx.any_of(lx.TASK))),
        LABELS["H"]: flag(has(lx.any_of(lx.EXPLANATION)) | ((n >= lx.EXPLANATION_LONG_WORDS) & has(lx.EXPLANATION_LONG))),
        LABELS["G"]: flag(has(lx.any_of(lx.REPAIR))),
        LABELS["D"]: flag(has(lx.any_of(lx.BACKCHANNEL)) | ((n <= lx.BACKCHANNEL_SHORT_WORDS) & has(lx.BACKCHANNEL_SHORT))),
        LABELS["E"]: flag(has(lx.any_of(lx.PERSONAL))),
        LABELS["C"]: flag(has(lx.any_of(lx.PHATIC))),
        "topic_code": topic_code(F.col("__prev"), F.col("text")),
    })
    one = lambda k: F.col(LABELS[k]) == 1
    social = F.contains("text", F.lit("?")) | has(lx.any_of(lx.RECIPROCAL)) | one("C") | one("E")
    out = out.withColumn(LABELS["B"], flag(social & ~one("H")))
    most = lambda *ks: F.greatest(*[F.col(LABELS[k]) for k in ks])
    return out.withColumns({"assistant_like": most("A", "H"), "social_like": most("B", "C", "E", "G")}).drop("__low", "__prev", "__n")


def conversation_indices(rows: DataFrame) -> DataFrame:
    """Label rates, ADI, social rate, topic health, reciprocity and the TSI proxy of each conversation."""
    by_speaker = rows.groupBy(*KEYS, "speaker").agg(
        F.count("*").alias("n"), *[F.sum(v).alias(v) for v in LABELS.values()], F.avg("social_like").alias("social"),
        F.sum(F.when(F.col("topic_code").isin("F1_maintain", "F2_smooth_shift"), 1).otherwise(-1)).alias("health"),
    )
    out = by_speaker.groupBy(*KEYS).agg(
        F.sum("n").alias("n_turns"), *[(F.sum(v) / F.sum("n")).alias(f"rate_{k}") for k, v in LABELS.items()],
        (F.sum("health") / F.sum("n")).alias("topic_health"),
        F.when(F.count("*") >= 2, F.greatest(F.lit(0.0), 1 - (F.max("social") - F.min("social")))).alias("reciprocity"),
    )
    r = lambda k: F.col(f"rate_{k}")
    out = out.withColumns({"ADI": F.least(F.lit(1.0), r("A") + r("H")), "social_rate": r("B") + r("C") + r("E") + r("G") + 0.5 * r("D")})
    health = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("topic_health") + 1) / 2))
    tsi = 0.35 * F.least(F.lit(1.0), F.col("social_rate")) + 0.20 * health + 0.20 * F.coalesce("reciprocity", F.lit(0.5)) + 0.25 * (1 - F.col("ADI"))
    return out.withColumn("TSI_proxy", 100 * tsi)


def source_of(condition: Column) -> Column:
    return F.when(condition == "SB", "SB").otherwise("LLM")


GROUPED = ("ADI", "social_rate", "topic_health", "reciprocity", "TSI_proxy", "CAS")


def group_indices(conversations: DataFrame) -> DataFrame:
    """Means by condition of the indices that are there, nulls skipped, with what the condition stands for."""
    return conversations.groupBy("condition", source_of(F.col("condition")).alias("source"), "architecture", "prompt_level").agg(F.count("*").alias("n_conversations"), *[F.avg(k).alias(f"mean_{k}") for k in GROUPED if k in conversations.columns])
