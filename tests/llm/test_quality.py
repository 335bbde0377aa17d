import re

from pyspark.sql import functions as F

from wirespark.llm import quality_classifier as C
from wirespark.llm import quality_rules as R
from wirespark.llm.queries import op6_quality_classifier, op8_quality_rules

from .conftest import EDGES, prose, table

SF = "/root/testdata/sf0.01"


def test_separates_junk(spark):
    got = op6_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rate = {r.quality: r.kept for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[1] > 0.97 and rate[0] < 0.35


def test_classifier_edges(spark, edges, nothing):
    keys = spark.createDataFrame([(1,), (7,), (None,)], "doc_id long")
    got = C.kept_rows(edges, keys)
    assert got.columns == edges.columns
    kept = {str(r.doc_id) for r in got.collect()}
    assert {"1", "2", "7"} <= kept and not kept & {"3", "4"}
    assert C.kept_rows(nothing, keys).count() == 0
    # Without trusted text nothing is judged.
    assert C.kept_rows(edges, keys.where("false")).count() == sum(bool(t) for _, t, *_ in EDGES)


def figures(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {}
    for w in windows:
        often[w] = often.get(w, 0) + 1
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_base_figures_equal_brute_force(spark):
    import random

    r = random.Random(4)
    texts = [t for _, t, *_ in EDGES] + ["".join(r.choice(["a ", "b ", "c\n", "#", "é", "  ", " ", "\n\n", "\x0b", "a b c d e f g h i "]) for _ in range(r.randrange(150))) for _ in range(150)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = R.judged(table(spark, rows)).orderBy("doc_id").collect()
    assert [(x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in got] == [figures(t) for t in texts]
    assert not any(x.kept and x.base_failed for x in got)


def test_rules_adapt_to_the_group(spark):
    rows = [(i, prose(i, 60), "en", "plain") for i in range(60)] + [(100 + i, " ".join(w + "#" for w in prose(i, 60).split()), "en", "marked") for i in range(60)] + [(999, " ".join(w + "#" for w in prose(5, 60).split()), "en", "plain")]
    got = {r.doc_id: r.kept for r in R.judged(table(spark, rows)).collect()}
    assert not got.pop(999) and all(got.values())


def test_rules_edges(edges, nothing):
    got = R.judged(edges)
    assert got.count() == len(EDGES)
    assert R.judged(nothing).count() == 0
    assert got.where("kept IS NULL OR base_failed IS NULL").count() == 0


def test_clean_documents_stay(spark):
    got = op8_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("NOT base_failed")
    rate = {r.quality: r.kept for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[1] > 0.97 and rate[0] < 0.2


def test_rules_run_without_python(edges):
    from wirespark.plans.inspect import python_nodes

    assert python_nodes(R.base(edges.select("doc_id", "text", "lang", "source"), "text", "doc_id", "lang", "source")) == []
