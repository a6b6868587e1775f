"""Registered queries: oracles, the pipeline and the guard."""

import pytest
from conftest import SMALL, rows

from lontar.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    want = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    index = {c: i for i, c in enumerate(want.columns)}
    assert sorted(want.columns) == columns
    assert rows(df.collect(), columns) == rows(({c: r[i] for c, i in index.items()} for r in want.fetchall()), columns)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, SMALL).columns == docs.columns
    got = corpus_pipeline.run(spark, SMALL)
    assert got.count() > 0 and {"doc_id", "shard", "shard_depth"} <= set(got.columns)
