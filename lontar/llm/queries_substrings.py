"""Query of the substring operator."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import substrings


def op5_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
