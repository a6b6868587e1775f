"""Query of the toxicity operator."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), F.when(F.col("toxic_score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"), "toxic_passages")
