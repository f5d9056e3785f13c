"""From raw documents to packed sequences: quality rules, SimHash near-duplicates, benchmark decontamination, secret
scans, packing. Each stage's result is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import table, written
from shelfcast.llm.decontaminate import without_contaminated
from shelfcast.llm.packing import pack_documents
from shelfcast.llm.quality import kept_by_quality
from shelfcast.llm.queries import TOKENIZER
from shelfcast.llm.secrets import redact_secrets
from shelfcast.llm.simhash import one_of_each

# SQL expresses neither the suffix-array verdict nor fingerprints nor packing.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, empty and blank texts among them. Repeated rows are judged alike."""
    return kept_by_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group within four bits stays: the one with the smallest id, null ids last. Repeated rows
    leave one; texts without words are one group."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go. Texts without words stay."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks; all documents stay, and ``n_chars`` follows the text (of a null text it stays)."""
    redacted = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return redacted
    kind = docs.schema["n_chars"].dataType
    return redacted.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens; null and empty texts are the end id alone, repeated rows
    are packed once each, and an empty table gives an empty one."""
    return pack_documents(docs, TOKENIZER).drop("digest")


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
