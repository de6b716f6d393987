"""A corpus pipeline of five stages, each of which works on what the one before it kept.

Defined results of all stages: a null text is an empty one; texts may be of any length; an empty table gives an empty
table; rows that repeat a doc_id are rows of their own; rows that are the same in doc_id and text are one to the stages
exact and near; columns that documents have besides doc_id and text come back as they are, whatever their names (operators
see them under names of their own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accretion.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from accretion.llm.store import table, written

#: What operators read; all other columns only pass through.
READ = ("doc_id", "text")


def shielded(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """(docs with other columns under names that no operator uses, what gives all columns their names back)."""
    own = {c: c.lower() if c.lower() in READ else f"passed_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()]), [F.col(n).alias(c) for c, n in own.items()]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; empty texts are scored like others."""
    docs, back = shielded(docs)
    return quality.quality_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*back)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that with the largest doc_id (a row without one only where no other has the text); of rows that tie, any one."""
    docs, back = shielded(docs)
    kept = exact_dedup.exact_dedup(docs).where("kept")
    once = kept.where("group_size > 1").dropDuplicates(["doc_id", "text_sha256"])
    return kept.where("group_size = 1").unionByName(once).select(*back)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (fingerprints first, then the exact join of near_dedup) the document with the smallest doc_id; one without a doc_id goes last."""
    docs, back = shielded(docs)
    gone = near_dedup.copies(docs).select(F.col("key").alias("near_key"))
    return docs.withColumn("near_key", near_dedup.row_key()).join(gone, "near_key", "left_anti").select(*back)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    docs, back = shielded(docs)
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    found = decontaminate.decontaminate(keyed, table(spark, sf_dir, "benchmark"), key=("doc_id", "text_key"))
    found = found.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key")).distinct()
    return keyed.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key")), "left_anti").select(*back)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences, with their tokens; only doc_id and text are read."""
    return packing.packed(docs)


STAGES = [("quality", good), ("exact", distinct), ("near", apart), ("benchmark", clean), ("packing", sequences)]

#: Trained models, SimHash and tokenizers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return packing.digest(STAGES[-1][1](spark, docs, sf_dir))
