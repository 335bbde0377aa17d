import duckdb
import pytest

from wirespark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    columns = sorted(df.columns)
    text = df[columns].map(lambda v: "" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v))
    return columns, sorted(text.values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = db.execute(catalog.ORACLES[name]).df()
    assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert catalog.QUERIES.keys() <= e.queries().keys()
