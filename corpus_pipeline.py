"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing and sharding, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

In every stage: nulls may stand in any column; a null text is an empty one; equal rows and texts of any length are
allowed; an empty table gives an empty one; columns beside those of documents go along unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm import common, decontam, mixing, neardup, quality, sharding


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """Some columns, and the whole row as one, so that no name that a stage adds clashes with a document's."""
    return docs.select(*names, F.struct(*docs.columns).alias("__row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; texts of under ten words, null and empty ones too, go."""
    judged = quality.judged(_packed(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("kept").select("__row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each class of near duplicates; rows without words or doc_id stay."""
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; without items all stay."""
    found = decontam.contaminated(_packed(docs, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("size(leaks.items) = 0").select("__row.*")


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words as often as the mix takes them; rows without words are left out, a null source is one."""
    return mixing.mixed_documents(docs)


def sharding_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's metadata, shard and slot; columns named like those that sharding adds are replaced."""
    return sharding.sharded(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("sharding", sharding_rows),
]

#: Signatures, draws and hashes of the stages have no SQL; tests hold their operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.stored(docs, name)
    return docs
