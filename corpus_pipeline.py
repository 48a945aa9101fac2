"""From raw documents to token files in five stages, each on all that the one before has kept.

``STAGES`` is the order; ``run`` applies it. Every stage but the last returns the columns of
``documents``; stages are written as Parquet and read again in between.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stringwright.llm.decontaminate import contamination
from stringwright.llm.mixing import take
from stringwright.llm.near_dedup import near_duplicates
from stringwright.llm.quality import judged
from stringwright.llm.store import settle, ship, small
from stringwright.llm.token_files import token_files


def _named(docs: DataFrame) -> DataFrame:
    """Rows whose doc_id is a hash of their id and text, so that every row follows its own verdict,
    also where ids are null or repeated; only equal rows share one."""
    return docs.withColumn("doc_id", F.xxhash64("doc_id", "text"))


def _without(docs: DataFrame, name: Column, verdicts: DataFrame, bad: Column) -> DataFrame:
    """Rows of ``docs`` whose ``name`` no bad verdict bears."""
    names = settle(verdicts.where(bad).select(F.col("doc_id").alias("_name")).distinct(), "bad")
    return docs.join(small(names, 8), name == F.col("_name"), "left_anti").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or stand out among their language and source go.

    A null or empty text has too few words and goes. Null and repeated ids do no harm here and in the
    next two stages: rows are told apart by id and text, and equal rows share their verdict.
    """
    return _without(docs, F.xxhash64("doc_id", "text"), judged(_named(docs)), ~F.col("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id, where a row
    without id, or whose id other rows have, counts by a hash of its id and text. Of equal rows one stays.
    """
    twice = settle(docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_id")), "twice")
    if not twice.limit(1).count():
        return _without(docs, F.col("doc_id"), near_duplicates(docs), ~F.col("kept"))
    odd = docs.join(small(twice, 8), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    even = docs.join(small(twice, 8), F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    odd = odd.dropDuplicates(["doc_id", "text"]).withColumn("_node", F.xxhash64("doc_id", "text"))
    named = settle(even.withColumn("_node", F.col("doc_id")).unionByName(odd), "named")
    verdicts = near_duplicates(named.select(F.col("_node").alias("doc_id"), "text"))
    return _without(named, F.col("_node"), verdicts, ~F.col("kept")).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, F.xxhash64("doc_id", "text"), contamination(_named(docs), benchmark), F.col("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come in the proportions of their weights; rows repeat where epochs do."""
    return take(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as files of token ids, and per document where its ids stand."""
    return token_files(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token files", write_tokens),
]

#: The robust estimates of the first stage and the tokenizer of the last have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, name.replace(" ", "-"))
    return docs
