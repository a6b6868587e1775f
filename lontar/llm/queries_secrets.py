"""Query of the secret scan."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secrets


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by digest, not in clear."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return secrets.scan(docs).select(
        "doc_id", F.col("at").alias("word"), F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("value_length"), F.round("secret_score", 6).alias("score"), (F.col("secret_score") >= secrets.THRESHOLD).alias("is_secret")
    )
