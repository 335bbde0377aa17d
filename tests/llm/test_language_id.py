import numpy as np

from wirespark.llm import language_id as L
from wirespark.llm.queries import op1_language_id

from .conftest import EDGES, table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 200
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()
    # Calibrated: mean confidence is near the accuracy.
    assert abs(held.score.mean() - (held.lang == held.lang_pred).mean()) < 0.05


def test_model_is_sparse_and_repeatable(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = L.fit(docs, per_lang=60), L.fit(docs.repartition(3), per_lang=60)
    assert a.langs == b.langs == ["de", "en", "es", "fr"]
    assert np.allclose(a.weights, b.weights) and a.temperature == b.temperature
    assert (a.weights == 0).mean() > 0.5


def test_features_on_the_driver_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "train", lambda rows: seen.append(rows))
    rows = [(i % 7, f"{g} abc {i} " * 40 + "xyz" * i, g, "s") for i in range(60) for g in ("en", "de")] + [(1, "same", "en", "s")] * 500
    L.fit(table(spark, rows))
    assert len(seen[0]) == 121  # repeated rows once
    monkeypatch.setattr(L, "MOST_FEATURES", 400)
    L.fit(table(spark, rows))
    assert {g for *_, g in seen[1]} == {"en", "de"} and 2 <= sum(len(b) for b, *_ in seen[1]) <= 400
    monkeypatch.setattr(L, "MOST_FEATURES", 1)
    L.fit(table(spark, rows))
    assert sorted(g for *_, g in seen[2]) == ["de", "en"]


def test_edges(spark, edges, nothing):
    model = L.fit(edges)
    got = L.predict(edges, model).collect()
    assert len(got) == len(EDGES)
    for r, (_, t, *_) in zip(sorted(got, key=str), sorted(EDGES, key=str), strict=True):
        assert r.lang_pred in {*model.langs, "und"}
    by = {r.doc_id: r for r in got}
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == "und"
    assert L.predict(edges, L.fit(nothing)).where("lang_pred <> 'und' OR score <> 0").count() == 0
    assert L.predict(nothing, model).count() == 0


def test_long_texts_in_blocks(monkeypatch):
    model = L.LanguageModel(["a", "b"], np.random.default_rng(1).normal(size=(L.BINS, 2)).astype(np.float32), np.zeros(2), 1.0)
    text = "abc déf " * 5000
    whole = model.scores(text)
    monkeypatch.setattr(L, "BLOCK", 1000)
    assert whole[0] == model.scores(text)[0]
    assert abs(whole[1] - model.scores(text)[1]) < 0.01
