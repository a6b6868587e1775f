"""Queries of lines, sections and nodes over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lontar.operators import parse

from . import corpus, oracle


def x01_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.clean_lines(corpus.documents(spark, sf_dir))


def a02_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.boilerplate(corpus.documents(spark, sf_dir))


def f05_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.marked_lines(corpus.documents(spark, sf_dir))


def x02_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.segments(corpus.documents(spark, sf_dir))


def x09_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.nodes(corpus.documents(spark, sf_dir))


_LINE = "SELECT doc_id, idx, page, line_no, text, kind, label, title, rest FROM clean"
QUERIES = {"x09_nodes": x09_nodes, "x01_lines": x01_lines, "a02_boilerplate": a02_boilerplate, "f05_structural": f05_structural, "x02_segments": x02_segments}
ORACLE_SQL = {
    "x01_lines": oracle.lines(_LINE),
    "a02_boilerplate": oracle.lines("SELECT DISTINCT doc_id, text, on_pages, n_pages FROM counted WHERE boiler"),
    "f05_structural": oracle.lines("SELECT doc_id, page, line_no, text, kind, label, title, rest FROM classed"),
    "x02_segments": oracle.segments('SELECT doc_id, seg, section, "start", "end" FROM segments'),
    "x09_nodes": oracle.nodes("SELECT * FROM nodes"),
}
