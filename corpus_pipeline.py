"""From raw documents to token ids: rules, one of each near copy, masked personal data, mixture, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.llm import bpe, minhash, mixing, pii, rules
from parley.llm.lineage import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failed lines; n_chars follows the text.

    A null, empty or wordless text doesn't pass. Repeated rows each pass or not. An empty table stays empty, and
    columns beyond those of documents stay as they are, here and in each stage but the last.
    """
    return rules.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word-shingle near duplicates: that of the least id.

    Rows that repeat id and text count as one. A null id stands back behind any other, and stays where its component
    has no other. Null and wordless texts are like nothing, so each stays.
    """
    return minhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every personal span replaced by its kind; n_chars follows the text. No row goes, a null text stays null."""
    return pii.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target rates, in global hashed order.

    A null source is a source. Documents without an id, and repeated rows, are drawn independently. A document may be
    drawn no time: that is the mixture.
    """
    return mixing.mixed(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the token ids of each text with their number and a digest of what they decode to. A null
    text has none; every row has its own."""
    return bpe.encoded(docs, bpe.production_path(), keep=["doc_id", "lang", "source"], outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing", mixture),
    ("BPE", tokens),
]

#: Near duplicates and byte-pair encoding aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order. Each one's documents are kept in the shared checkpoint folder, as the next may read them
    several times; the last is returned as a plan."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else cut(docs), sf_dir)
    return docs
