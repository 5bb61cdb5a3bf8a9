"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.

Defined cases, at every stage: a null text counts as empty; rows with null or
repeated ids are documents of their own; an empty table gives an empty one; the
stages that return documents keep all their columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxloom.llm import linededup, packing, pii, quality, simhash, store
from boxloom.llm.queries import pack_digest


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above their host's limit are removed from those that stay."""
    return quality.apply_rules(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks that an earlier document has are deleted from later ones."""
    return linededup.apply_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that disclose it, are replaced by tags."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with a checksum of each piece's ids."""
    return pack_digest(packing.pack(docs))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("personal data", private_data), ("packing", pack)]

#: SQL has no BPE tokenizer, XXH64 or patience diff; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
