"""Query of the SimHash operator."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash


def op10_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash.groups(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
