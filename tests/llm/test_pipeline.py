import os

import duckdb
import pytest

import corpus_pipeline
from wirespark.llm import queries
from wirespark.llm.common import new_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    keys = list(want.columns)
    assert got.sort_values(keys).astype(str).values.tolist() == want.sort_values(keys).astype(str).values.tolist()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = new_path(spark, "test-stage")
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now and now <= ids, name
        if i < 3:
            assert now < ids, name  # something goes
            assert out.count() == len(now)
        ids, docs = now, out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_entry_lists_the_queries():
    import __spark_entry__ as e

    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert queries.QUERIES.keys() | {"pipeline"} <= e.queries().keys()
    assert e.oracle_sql().keys() <= e.queries().keys()
    assert os.path.exists(SF)
