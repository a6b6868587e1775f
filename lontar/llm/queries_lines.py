"""Query of the line operator."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lines


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.removed_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))
