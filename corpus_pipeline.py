"""From raw documents to shards: toxic documents go, one of each group of near duplicates stays, benchmark leaks go, the mix is sampled, shards are dealt.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wireloom.llm.decontaminate import decontaminate
from wireloom.llm.mixing import sample
from wireloom.llm.near_dup import near_duplicates
from wireloom.llm.sharding import shard_rows
from wireloom.llm.store import stored
from wireloom.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity(docs, labels).filter("predicted = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group; documents without an id stay, of rows that repeat an id all stay or go."""
    out = near_duplicates(docs).filter("not kept").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(out, "doc_id", "left_anti").select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sample_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn for the target mix of sources, languages and topics; where a kind is scarce, its documents repeat."""
    return sample(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every document."""
    return shard_rows(docs).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("near_dup", drop_near_duplicates), ("decontaminate", drop_benchmark), ("mixing", sample_mix), ("sharding", deal_shards)]
ORACLE_SQL = None  # a trained classifier and hashed signatures are beyond SQL; tests compare each stage with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
