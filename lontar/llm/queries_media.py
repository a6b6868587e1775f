"""Query of the media operator."""

from pyspark.sql import DataFrame, SparkSession

from . import media


def op3_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return media.digests(media.store_texts(docs))
