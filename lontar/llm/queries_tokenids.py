"""Query of the token-id operator."""

import zlib

from pyspark.sql import DataFrame, SparkSession

from . import tokenids
from .common import scratch


def _crc(ids) -> tuple[int]:
    return (zlib.crc32(ids.astype("<u4").tobytes()),)


def op4_rans_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "rans")
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    blocks, table = tokenids.write(docs, public_tokenizers.path("word_bpe_49k.json"), folder)
    return tokenids.read(blocks, table, folder, _crc, "ids_crc32 long")
