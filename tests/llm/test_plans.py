"""Plans that hold at any size: what is read, shuffled and run in Python."""

import pytest

from wirespark.llm import decontamination, language_id, license_scan, quality_rules, token_counts
from wirespark.llm.common import spread
from wirespark.plans.inspect import python_nodes, read_columns, shuffles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return {
        "tokens": token_counts.token_counts(docs),
        "matches": decontamination.digest(decontamination.scan(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))),
        "licences": license_scan.scan(docs),
        "figures": quality_rules.base(docs, "text", "doc_id", "lang", "source"),
        "languages": language_id.predict(docs, language_id.fit(docs, per_lang=5)),
    }


def test_one_pass_without_shuffle(plans):
    for name, df in plans.items():
        assert shuffles(df) == 0, name
        assert read_columns(df) <= {"doc_id", "text", "lang", "source"}, name
    assert read_columns(plans["tokens"]) == {"doc_id", "text"}


def test_native_operators_run_without_python(plans):
    for name in ("licences", "figures"):
        assert python_nodes(plans[name]) == [], name


def test_spread(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert shuffles(spread(docs)) == 1 and spread(docs).rdd.getNumPartitions() == 4
    assert shuffles(spread(docs, most_mb=0)) == 0 and shuffles(spread(spark.range(5))) == 0
