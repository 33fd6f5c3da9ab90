"""Mixing sources to target weights by Poisson replication.

Each source's rate is the mean number of copies of its documents that gives it its share of the mixture.
A document's number of copies is the Poisson distribution of that rate inverted at a uniform number
hashed from seed, id and text; so it never changes with partitioning, recomputation or other documents.
Rows that repeat both, which hashing alone can't tell apart, have their places in the table hashed too.
Copies are then put in a global order of hashed keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.lineage import cut

#: Sources up to this number are joined by broadcast (a row of them is at most a name, and TAIL numbers).
BROADCAST_SOURCES = 10_000
#: A source's weight where no target is named: its rows to this power. 1 keeps the shares, 0 levels them.
TEMPERATURE = 0.7
#: The distribution function is tabulated between tails below this; no uniform number used here but 0 lies in them.
TAIL = 2.0**-53
#: Keys of repeated rows (two numbers each) up to this number are sent to all executors; more are joined by shuffle.
BROADCAST_REPEATED = 1_000_000
#: Copies of a row that are listed at once.
LISTED = 10_000


def first_count(rate: float) -> int:
    """Where the table begins: 12 deviations and 40 below the mean, so that its length grows with their number."""
    return max(0, math.floor(rate - 12 * math.sqrt(rate)) - 40) if rate > 0 else 0


def poisson_table(rate: float) -> list[float]:
    """P(first <= X <= k) for k = first, first + 1, ... up to 1 - TAIL, with first = first_count(rate), which is 0 for
    low rates; first and the number of entries below u are the inverse at u."""
    if not rate > 0:
        return [1.0]
    out, total, k = [], 0.0, first_count(rate)
    while total < 1 - TAIL and k <= rate + 12 * math.sqrt(rate) + 40:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(total)
        k += 1
    return out


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash of seed and parts; null hashes as an empty string."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, targets: dict[str, float] | None, total: float, source: str = "source", default: float = 0.0) -> DataFrame:
    """source, n, rate: mean copies of a document, so that the mixture has total times the rows of docs.

    targets names weights of sources; each source it doesn't name weighs default, which 0 leaves out. Without it
    every source weighs its rows to the power TEMPERATURE. A null source is a source, named "".
    """
    n = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if targets is None:
        n = n.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE)))
    else:
        named = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair]) if targets else F.create_map().cast("map<string,double>")
        n = n.withColumn("weight", F.coalesce(F.try_element_at(named, F.coalesce(F.col("source").cast("string"), F.lit(""))), F.lit(float(default))).cast("double"))
    sums = n.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    rate = F.coalesce(F.try_divide(F.col("weight") * F.col("all_n") * F.lit(float(total)), F.col("all_weight") * F.col("n")), F.lit(0.0))
    return n.crossJoin(F.broadcast(sums)).select("source", "n", rate.alias("rate"))  # sums is one row


def _told_apart(docs: DataFrame, id: str, text: str) -> DataFrame:
    """docs with mix_id, mix_text (a checksum) and mix_place, which is null but for rows that repeat id and text."""
    body = F.md5(F.coalesce(F.col(text), F.lit(""))) if text in docs.columns else F.lit("")
    keyed = docs.withColumns({"mix_id": F.coalesce(F.col(id).cast("string"), F.lit("")), "mix_text": body})
    key = [F.xxhash64(F.lit(i), "mix_id", "mix_text").alias(f"mix_h{i}") for i in (1, 2)]
    repeated = keyed.select(*key).groupBy("mix_h1", "mix_h2").agg(F.count("*").alias("mix_n")).filter("mix_n > 1").drop("mix_n")
    repeated = cut(repeated.withColumn("mix_repeated", F.lit(True)))
    if repeated.count() <= BROADCAST_REPEATED:
        repeated = F.broadcast(repeated)
    placed = keyed.withColumn("mix_at", F.monotonically_increasing_id()).withColumns({f"mix_h{i}": k for i, k in zip((1, 2), key)})
    joined = placed.join(repeated, ["mix_h1", "mix_h2"], "left")
    return joined.withColumn("mix_place", F.when(F.col("mix_repeated"), F.col("mix_at"))).drop("mix_h1", "mix_h2", "mix_at", "mix_repeated")


def mixed(docs: DataFrame, targets: dict[str, float] | None = None, total: float = 1.0, seed: int = 17, id: str = "doc_id", source: str = "source", default: float = 0.0, text: str = "text") -> DataFrame:
    """docs, each row as often as its Poisson number says, in a global hashed order.

    Adds mix_copy (0, 1, ...), mix_copies (the row's number) and mix_key (the order); columns of docs by
    those names give way. Any rate is right. Rows with one id and different texts, or without an id, are
    drawn independently; so are rows that repeat id and text, whose numbers then depend on their places in
    the table. A null id or text hashes as an empty one; a null source is a source of its own. An empty
    table gives an empty table. The result is range partitioned by mix_key, in which hardly two rows agree,
    so a hot source, id or text is spread like any other.
    """
    names = [c for c in docs.columns if c not in ("mix_copy", "mix_copies", "mix_key")]
    table = F.udf(poisson_table, T.ArrayType(T.DoubleType()))  # once a source, not a row
    first = F.udf(first_count, T.LongType())
    rate = cut(rates(docs, targets, total, source, default).select(F.col("source").alias("mix_source"), first("rate").alias("mix_first"), table("rate").alias("mix_table")))
    if rate.count() <= BROADCAST_SOURCES:
        rate = F.broadcast(rate)
    copies = F.col("mix_first") + F.size(F.filter("mix_table", lambda p: p <= F.col("mix_u")))
    own = [F.col(c) for c in ("mix_id", "mix_text", "mix_place")]
    listed = F.sequence(F.col("mix_from"), F.least(F.col("mix_from") + (LISTED - 1), F.col("mix_copies") - 1))
    out = (
        _told_apart(docs.select(*names), id, text)
        .withColumn("mix_u", uniform(seed, *own))
        .join(rate, F.col(source).eqNullSafe(F.col("mix_source")))
        .withColumn("mix_copies", copies)
        .filter("mix_copies > 0")
        .withColumn("mix_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_copies") - 1, F.lit(LISTED).cast("long"))))
        .withColumn("mix_copy", F.explode(listed))
        .withColumn("mix_key", uniform(seed + 1, *own, F.col("mix_copy")))
    )
    return out.select(*names, "mix_copy", "mix_copies", "mix_key").orderBy("mix_key")


#: The mixture of the query: the hot source down to a tenth, four sources up, a quarter more rows than documents.
#: Sources of other names, and a null one, weigh as the fifteen.
QUERY_TARGETS = {f"src{i}": w for i, w in enumerate([2.0, 2.0, 2.0, 2.0, 2.0] + [10 / 15] * 15)}
QUERY_DEFAULT = 10 / 15
QUERY_TOTAL = 1.25


def op9_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixed(docs, QUERY_TARGETS, QUERY_TOTAL, default=QUERY_DEFAULT)


OP9_SQL = """
WITH RECURSIVE w AS (SELECT source, count(*) AS n, CASE WHEN source IN ('src0','src1','src2','src3','src4') THEN 2.0::DOUBLE ELSE 10.0::DOUBLE / 15 END AS weight FROM documents GROUP BY source),
r AS (SELECT source, weight * sum(n) OVER () * 1.25::DOUBLE / (sum(weight) OVER () * n) AS rate FROM w),
t(source, rate, k, p) AS (SELECT source, rate, 0, exp(-rate) FROM r UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1) FROM t WHERE k < 100),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS p FROM t),
d AS (SELECT doc_id, source, text, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' AS own, row_number() OVER () AS row FROM documents),
u AS (SELECT *, ('0x' || substr(md5('17:' || own), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u FROM d),
n AS (SELECT row, any_value(u.doc_id) AS doc_id, any_value(u.source) AS source, any_value(u.text) AS text, any_value(own) AS own, count(*) AS mix_copies
      FROM u JOIN c ON c.source IS NOT DISTINCT FROM u.source AND c.p <= u.u GROUP BY row),
x AS (SELECT *, unnest(range(mix_copies)) AS mix_copy FROM n)
SELECT doc_id, source, text, mix_copy, mix_copies,
       ('0x' || substr(md5('18:' || own || ':' || mix_copy), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS mix_key FROM x
"""
