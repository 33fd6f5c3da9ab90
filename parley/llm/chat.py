"""Chat formatting: logged snapshots of growing conversations collapse to the longest, which is rendered.

Only DataFrame functions are used. A conversation's prefix of k turns is known by its rolling hash: the
exclusive or, over turns 1 to k, of a 128-bit hash of place, role and text. Equal conversations are
counted into one row before any join, and so are equal prefixes; so a conversation or a first turn that a
third of the log repeats is one row on each side of the anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN = "<|im_start|>%s\n%s<|im_end|>\n"
UNKNOWN_ROLE = "unknown"


def _prefix_hashes(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, role, text) with place k from 1, and h1, h2 of the prefix that ends there."""
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = turns.withColumn("k", F.row_number().over(order))
    upto = Window.partitionBy("conv").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rolled = lambda *salted: F.bit_xor(F.xxhash64(*salted)).over(upto)
    return placed.withColumns({"h1": rolled("k", "role", "text"), "h2": rolled(F.lit(7), "text", "role", "k")})


def rendered(turns: Column) -> Column:
    """The text of an ordered array of (k, role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.format_string(TURN, t["role"], t["text"])), "")


def collapsed(log: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, n_equal, chat: the conversations of the log that no longer one begins with.

    Turns are ordered by turn (null first), then role, then text. A null role counts as "unknown", a null
    text as empty; turns without conv_id belong to no conversation and are left out. A repeated row is a
    turn of its own. Of equal conversations the least conv_id stays, n_equal counts them. An empty log
    gives an empty table; other columns are left out. A conversation is rendered into one value, so it
    has to fit a row.
    """
    turns = log.filter(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(UNKNOWN_ROLE)).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    prefixes = _prefix_hashes(turns)
    ends = prefixes.groupBy("conv").agg(F.max(F.struct("k", "h1", "h2")).alias("end"))
    whole = (
        ends.groupBy(F.col("end.k").alias("k"), F.col("end.h1").alias("h1"), F.col("end.h2").alias("h2"))
        .agg(F.min("conv").alias("conv"), F.count("*").alias("n_equal"))
    )
    later = Window.partitionBy("conv")
    proper = prefixes.withColumn("n", F.max("k").over(later)).filter("k < n").select("k", "h1", "h2").distinct()
    kept = whole.join(proper, ["k", "h1", "h2"], "left_anti").select("conv", "n_equal")
    body = turns.join(kept, "conv").groupBy("conv", "n_equal").agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("has"), "turn", "role", "text"))).alias("turns")
    )
    return body.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), "n_equal", rendered(F.col("turns")).alias("chat")
    )


def op1_chat(spark, sf_dir):
    return collapsed(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The same by comparing the lists of turns themselves.
OP1_SQL = """
WITH c AS (SELECT conv_id, list({'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS ts
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
e AS (SELECT min(conv_id) AS conv_id, count(*) AS n_equal, ts FROM c GROUP BY ts),
p AS (SELECT DISTINCT list_slice(ts, 1, k) AS ts FROM (SELECT ts, unnest(range(1, len(ts))) AS k FROM e))
SELECT conv_id, len(ts)::BIGINT AS n_turns, n_equal,
       array_to_string(list_transform(ts, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '') AS chat
FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.ts = e.ts)
"""
