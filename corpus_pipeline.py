"""Corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Run it with ``run(spark, sf_dir)``. All stages but the last return the columns of documents. Stage outputs go to the
shared folder named by spark.checkpoint.dir."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.llm import common, decontamination, mixing, sharding, shingles, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold stay, by a model learned from the labels of this input. Null and empty texts
    stay, repeated rows stay or go together, rows without doc_id are scored like others. Empty input: no rows."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(F.col("toxic_score") < toxicity.THRESHOLD).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles (similarity 0.8) stays, that of the smallest doc_id, null
    last. Null and empty texts are one group. Empty input: no rows."""
    return shingles.keep_one(docs).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Rows that share a doc_id go together; null and empty texts and rows without
    doc_id stay. Empty input: no rows."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy of a document that the mix takes, in order of virtual finish time. Texts without words are in no mix;
    equal rows have the copies of all of them. Empty input: no rows."""
    return mixing.mix(docs).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with their shards; copies that do not fit a shard fill numbered pages. Empty input: no rows."""
    return sharding.shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL cannot express the stages for toxicity and near duplicates; tests/llm holds the first against scores worked out by
#: definition (test_single.py) and the second against all pairs (test_shingles.py). The others have SQL or such tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; what a stage wrote goes once the next one has read it."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        path = common.scratch(spark, f"pipeline-{name}")
        docs = common.stage(step(spark, docs, sf_dir), path)
        if last:
            common.remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
