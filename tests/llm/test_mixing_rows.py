"""The mix holds the rows that were planned, where doc_id is null or repeated."""

from collections import Counter

from pyspark.sql import functions as F

from lontar.llm import mixing


def test_null_and_repeated_ids(spark):
    rows = [(None if k % 2 else k // 20, " ".join([f"d{k}"] * (1 + k * 7 % 60)), f"s{k * 5 % 3}") for k in range(200)]
    rows += [(None, "sama " * 9, "s0")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan(df, row=mixing.identity(df))
    names = df.select(mixing.identity(df).alias("row"), "source", F.split("text", " ")[0].alias("word")).distinct()
    want = {(r.source, r.word): r.n for r in plan.join(names, "row").where("copies > 0").groupBy("source", "word").agg(F.sum("copies").alias("n")).collect()}
    assert 0 < len(want) and plan.where("copies = 0").count() > 0
    got = mixing.mix(df.repartition(5)).collect()
    assert Counter((r.source, r.text.split()[0]) for r in got) == want
    assert [tuple(r) for r in mixing.mix(df.repartition(2)).collect()] == [tuple(r) for r in got]
