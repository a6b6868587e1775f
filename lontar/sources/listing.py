"""Listings of documents as a data source, and the registry of source types."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lontar.functions.text import sort_number
from lontar.functions.urls import normalize_url

#: Fields of a record, all text.
FIELDS = ["idData", "judul", "jenis", "noPeraturan", "teuBadan", "tahun_pengundangan", "status", "bahasa", "fileDownload", "urlDownload", "urlDetailPeraturan"]
SCHEMA = ", ".join(f"{f} string" for f in FIELDS)


class ListingSource(DataSource):
    """format("listing"): JSON arrays of records, one file a partition (option path, several by commas)."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options)


class ListingReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.paths = [p for p in options.get("path", "").split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pyarrow.fs

        where, path = pyarrow.fs.FileSystem.from_uri(partition.value)
        with where.open_input_stream(path) as f:
            for record in json.loads(f.read() or b"[]"):
                yield tuple(None if (v := record.get(field)) is None else str(v) for field in FIELDS)


_KINDS: dict[str, type[DataSource]] = {"": ListingSource, "integrasi": ListingSource}


def register(kind: str, source: type[DataSource]) -> None:
    """Make a source type known under a name."""
    _KINDS[kind] = source


def open_source(spark: SparkSession, kind: str, **options: str) -> DataFrame:
    """Records of a source of the given type; ValueError for a type that is not known."""
    if kind not in _KINDS:
        raise ValueError(f"unknown source type {kind!r}")
    spark.dataSource.register(_KINDS[kind])
    return spark.read.format(_KINDS[kind].name()).options(**options).load()


def sources(registry: DataFrame) -> DataFrame:
    """The registry of sources in order of their code, with place. Sources are few: one window takes them all."""
    return registry.withColumn("place", F.row_number().over(Window.orderBy("code", "id"))).orderBy("place")


def parse(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Records of JSON arrays in a text column; a body that is not such an array gives none."""
    return bodies.select(F.inline(F.from_json(column, f"array<struct<{SCHEMA.replace(' string', ': string')}>>")))


def remote_documents(records: DataFrame) -> DataFrame:
    """(download_url, sort_tahun, sort_nomor) of records with an address."""
    d = records.select(normalize_url(F.coalesce("urlDownload", F.lit(""))).alias("download_url"), sort_number(F.coalesce("tahun_pengundangan", F.lit(""))).alias("sort_tahun"), sort_number(F.coalesce("noPeraturan", F.lit(""))).alias("sort_nomor"))
    return d.where("download_url <> ''")
