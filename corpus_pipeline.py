"""A corpus pipeline: documents through quality, line dedup, near dedup, decontamination and BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import bpe_roundtrip, decontaminate, line_dedup, near_dup, quality
from attestra.llm.common import few, scratch, table, written

#: SQL can't fit the classifier, nor encode.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written, with a key of each row, and the key's name."""
    name = "_key"
    while name in docs.columns:
        name = f"_{name}"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "keyed"), name


def _without(keyed: DataFrame, name: str, lost: DataFrame) -> DataFrame:
    """The rows of keyed whose key isn't among those of lost, without their keys."""
    return keyed.join(few(written(lost, "lost"), 16), name, "left_anti").drop(name)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; null and empty texts have a score as any other, repeated rows the same one."""
    return quality.keep_good(docs, quality.learnt(docs, table(spark, sf_dir, "labels")))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that come earlier elsewhere; those of which nothing is left go.

    Null texts and those that were empty before stay; rows of equal doc_id and text keep the same lines.
    """
    out = line_dedup.deduplicated(docs)
    empty = (F.col("_kept") < F.col("_lines")) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    columns = [F.when(F.col("_kept") < F.col("_lines"), F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.where(~empty | F.col("text").isNull()).select(columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the least doc_id, null ids last; rows without words all stay.

    Rows are judged one by one: those with a null or repeated doc_id go only if they are copies themselves.
    """
    keyed, name = _keyed(docs)
    judged = near_dup.near_duplicates(keyed.select(F.col(name).alias("doc_id"), "text")).select(F.col("doc_id").alias(name), "component_id", "kept")
    groups = judged.join(judged.where(~F.col("kept")).select("component_id").distinct(), "component_id", "left_semi")
    rows = groups.join(keyed.select(name, F.col("doc_id").cast("long").alias("_id")), name)
    rows = written(rows.select(name, "component_id", F.struct(F.col("_id").isNull().alias("null"), "_id", name).alias("at")), "copies")
    first = written(rows.groupBy("component_id").agg(F.min("at").alias("first")), "first")
    return _without(keyed, name, rows.join(first, "component_id").where("at <> first").select(name))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of a benchmark item occurs, each judged by itself; null and empty texts stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of ids and digests of the ids and of the decoded texts, a row for each; a null text is empty."""
    return bpe_roundtrip.round_trip(docs, public_tokenizers.path(bpe_roundtrip.FILE))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("minhash_near_dedup", near_deduplication),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch() as held:
            docs = held.keep(written(stage(spark, docs, sf_dir), name))
    return docs
