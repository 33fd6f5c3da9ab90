"""Interaction metrics of conversations in one aggregation, and their summaries by condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions import lexicon as lx
from parley.functions import text as tx
from parley.operators.turns import joined_text, previous

KEYS = ("conv_id", "condition", "architecture", "prompt_level")


def _share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def turn_measures(turns: DataFrame) -> DataFrame:
    """Turns with their words, marker counts and flags; the previous turn decides whether an oh is contingent."""
    t = F.col("text")
    oh = tx.has(t, lx.MARKERS["oh"])
    entity = F.coalesce(F.col("__prev").rlike(r"(?U)\b[A-Z][a-z]{2,}\b|\d+"), F.lit(False))
    return turns.withColumn("__prev", previous("text")).withColumns({
        "words": tx.n_words(t), **{m: tx.count(t, p) for m, p in lx.MARKERS.items()},
        "agrees_first": tx.opens_with_agreement(t), "is_short": tx.n_words(t) < 5,
        "bc": tx.has(t, lx.BACKCHANNEL_PRESENCE), "bc_alone": tx.has(t, lx.BACKCHANNEL_PRESENCE) & tx.has(t, lx.BACKCHANNEL_FULL),
        "oh_turn": oh, "oh_contingent": oh & entity,
        "agrees": tx.phrase_count(F.substring(t, 1, 80)) > 0, "content": tx.content_ratio(t),
    }).drop("__prev")


def closing_order(tail: Column) -> Column:
    """1 if the stages found come in their order, 0 if not, null with fewer than two."""
    found = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), tx.first_at(tail, p).alias("at")) for i, p in enumerate(lx.CLOSING_STAGES)]), lambda s: s["at"] > 0)
    by_place = F.array_sort(F.transform(found, lambda s: F.struct(s["at"].alias("at"), s["i"].alias("i"))))
    order = F.transform(by_place, lambda s: s["i"])
    return F.when(F.size(found) >= 2, (order == F.array_sort(order)).cast("double"))


def conversation_metrics(turns: DataFrame) -> DataFrame:
    """All metrics of a conversation; one shuffle by conversation serves the window and both aggregates."""
    m = turn_measures(turns)
    own = F.struct("turn_index", "text")
    agg = m.groupBy(*KEYS).agg(
        F.count("*").alias("n_turns"), F.avg("words").alias("mean_words"), F.median("words").alias("median_words"),
        F.coalesce(F.stddev_samp("words"), F.lit(0.0)).alias("sd_words"), F.sum("words").alias("sum_words"),
        *[F.sum(k).alias(f"sum_{k}") for k in lx.MARKERS],
        _share(F.col("agrees_first")).alias("opener_share"), _share(F.col("is_short")).alias("short_share"),
        F.try_divide(F.count_if("bc_alone"), F.count_if("bc")).alias("backchannel_ratio"), F.count_if("bc").alias("n_backchannel_turns"),
        F.try_divide(F.count_if("oh_contingent"), F.count_if("oh_turn")).alias("oh_contingency"), F.count_if("oh_turn").alias("n_oh"),
        _share(F.col("agrees")).alias("sycophancy_share"),
        F.when(F.avg("content") != 0, F.coalesce(F.stddev_samp("content"), F.lit(0.0)) / F.avg("content")).alias("density_cv"),
        F.array_sort(F.collect_list(own)).alias("__turns"),
    )
    text = lambda ts: F.array_join(F.transform(ts, lambda t: t["text"]), " ")
    out = agg.withColumn("__all", text(F.col("__turns"))).withColumn("__tail", F.lower(text(F.slice("__turns", F.greatest(F.lit(1), F.size("__turns") - 5), F.lit(6)))))
    all_words = F.greatest(tx.n_words(F.col("__all")), F.lit(1))
    per = lambda n: 100 * n / all_words
    return out.withColumns({
        **{f"{k}_per_100": per(tx.count(F.col("__all"), p)) for k, p in lx.MARKERS.items()},
        **{f"{k}_by_turn": 100 * F.col(f"sum_{k}") / F.greatest("sum_words", F.lit(1)) for k in lx.MARKERS},
        "self_repair": per(tx.count(F.col("__all"), lx.REPAIR_REPEAT) + tx.count(F.col("__all"), lx.REPAIR_MARKER)),
        "closing_order": F.when(F.col("n_turns") >= 4, closing_order(F.col("__tail"))),
        "sycophancy_per_100": per(tx.phrase_count(F.col("__all"))),
    }).drop("__all", "__tail", "__turns", "sum_words", *[f"sum_{k}" for k in lx.MARKERS])


SUMMARISED = (
    "mean_words", "median_words", "sd_words", "n_turns", "oh_per_100", "okay_per_100", "uh_huh_per_100", "short_share", "backchannel_ratio", "n_backchannel_turns",
    "oh_contingency", "n_oh", "self_repair", "closing_order", "sycophancy_per_100", "sycophancy_share", "density_cv",
)


def condition_summary(metrics: DataFrame, keys=SUMMARISED) -> DataFrame:
    """Of each condition n, and mean and sample SD of each key over the conversations that have it (SD 0 of one)."""
    stats = [s for k in keys for s in (F.avg(k).alias(f"{k}_mean"), F.when(F.count(k) > 0, F.coalesce(F.stddev_samp(k), F.lit(0.0))).alias(f"{k}_sd"))]
    return metrics.groupBy("condition").agg(F.count("*").alias("n"), *stats)


def condition_table(turns: DataFrame) -> DataFrame:
    """Mean words pooled over turns, and mean marker rates over conversations: two grains, joined."""
    per_turn = turns.groupBy("condition").agg(F.avg(tx.n_words(F.col("text"))).alias("words_per_turn"), F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"))
    names = turns.select("conv_id", "condition").distinct()
    text = joined_text(turns).join(names, "conv_id")
    rates = text.groupBy("condition").agg(*[F.avg(100 * tx.count(F.col("text"), p) / F.greatest(tx.n_words(F.col("text")), F.lit(1))).alias(f"{k}_per_100") for k, p in lx.MARKERS.items()])
    return per_turn.join(rates, "condition")


def corpus_checks(turns: DataFrame) -> DataFrame:
    """One row over everything: conversations, mean turns, mean and median words a turn."""
    w = turns.select("conv_id", tx.n_words(F.col("text")).alias("w"))
    return w.agg(F.countDistinct("conv_id").alias("conversations"), (F.count("*") / F.countDistinct("conv_id")).alias("mean_turns"), F.avg("w").alias("mean_words"), F.median("w").alias("median_words"))


def tidy(turns: DataFrame) -> DataFrame:
    """One row a turn for the statistics: corpus, section, words and markers."""
    n = F.count("*").over(Window.partitionBy("conv_id"))
    t = F.col("text")
    return turns.withColumn("n_turns", n).select(
        *KEYS, F.when(F.col("condition") == "SB", "SB").otherwise("LLM").alias("corpus"), "turn_index", "n_turns",
        tx.section(F.col("turn_index"), F.col("n_turns")).alias("section"), tx.n_words(t).alias("words"), *[tx.count(t, p).alias(k) for k, p in lx.MARKERS.items()],
    )


def conversation_table(rows: DataFrame) -> DataFrame:
    """Mean words and marker rates of summed turn counts, from tidy rows."""
    return rows.groupBy(*KEYS).agg(F.avg("words").alias("words"), *[(100 * F.sum(k) / F.greatest(F.sum("words"), F.lit(1))).alias(k) for k in lx.MARKERS])


def words_chart(conversations: DataFrame, baseline: str = "SB") -> DataFrame:
    """The frame of the bar chart: of each generated condition n, mean words a turn over conversations and its standard error (null of one), beside the
    baseline's mean, which is the line across (null without baseline)."""
    means = conversations.groupBy("condition").agg(F.count("words").alias("n"), F.avg("words").alias("mean_words"), (F.stddev_samp("words") / F.sqrt(F.count("words"))).alias("standard_error"))
    line = means.agg(F.max(F.when(F.col("condition") == baseline, F.col("mean_words"))).alias("baseline_words"))
    return means.filter(F.col("condition") != baseline).crossJoin(F.broadcast(line))  # one row
