"""Sharding along a Hilbert curve over document metadata.

Dimensions are quantised to whole numbers of BITS bits, a document's place is its index on the curve
through that grid, and the order is cut into runs of equal counts. Neighbours on the curve are neighbours
in every dimension, so each shard spans a small box and its least and largest cells prune files for
filters on any of the dimensions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.ranges import ranked

BITS = 8
SHARDS = 16


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the curve of each row of cells [rows, dimensions], whole numbers below 2**bits.

    Dimensions times bits may be at most 62. From the highest bit down the axes are exchanged or inverted
    so that each sub-cube is entered where the last was left, then the bits are Gray coded and interleaved.
    """
    x = np.array(cells, np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(d):
            set_ = (x[i] & q) > 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap if i else 0
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[d - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


def log_cell(n: Column, most: int = 32) -> Column:
    """A size on a logarithmic scale: 0 for null or nothing, equal steps up to 2**most."""
    return F.least(F.lit((1 << BITS) - 1), F.floor(F.log2(F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)) + 1) * ((1 << BITS) / most))).cast("long")


def name_cell(name: Column) -> Column:
    """A name by hash, as names have no distances; null has cell 0."""
    return F.coalesce(F.pmod(F.xxhash64(F.lit(3), name), F.lit((1 << BITS) - 1)) + F.when(name.isNotNull(), 1), F.lit(0)).cast("long")


def sharded(docs: DataFrame, shards: int = SHARDS, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """id, size, text_crc32, cells, hilbert, shard and slot of every row of docs.

    Dimensions: language, source, size of the text. size: UTF-8 bytes plus 1; a null text has none. Shard
    counts differ by one at most; slots count from 0 in curve order. Ties on the curve go by id (null
    first), checksum and place in the table; repeated rows each get a slot. With fewer rows than shards the
    surplus shards stay empty; an empty table gives an empty table. Other columns are left out.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(body) + 1).cast("long")

    @F.pandas_udf("long")
    def on_curve(cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack(cells.to_numpy())) if len(cells) else [], dtype="int64")

    rows = docs.select(
        F.col(id).alias(id), size.alias("size"), F.crc32(body).alias("text_crc32"),
        F.array(name_cell(F.col(lang)), name_cell(F.col(source)), log_cell(size)).alias("cells"),
        F.monotonically_increasing_id().alias("__at"),
    ).withColumn("hilbert", on_curve("cells"))
    order = [F.col("hilbert").asc(), F.col(id).asc_nulls_first(), F.col("text_crc32").asc(), F.col("__at").asc()]
    out = ranked(rows, order, "__rank", "__total").withColumn("shard", F.floor(F.col("__rank") * shards / F.col("__total")).cast("int"))
    # The first rank of a shard is the least r with r * shards >= shard * total.
    first = F.floor((F.col("shard").cast("long") * F.col("__total") + (shards - 1)) / shards).cast("long")
    return out.withColumn("slot", F.col("__rank") - first).select(id, "size", "text_crc32", "cells", "hilbert", "shard", "slot")


def manifest(shards: DataFrame, id: str = "doc_id") -> DataFrame:
    """Of each shard its rows, its bytes and the least and largest cell in each dimension, for pruning."""
    ends = [f(F.col("cells")[i]).alias(f"{name}_{dim}") for i, dim in enumerate(("lang", "source", "size")) for name, f in (("min", F.min), ("max", F.max))]
    return shards.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ends)


def op8_sharding(spark, sf_dir):
    out = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
