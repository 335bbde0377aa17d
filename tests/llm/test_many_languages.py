from wirespark.llm import language_id as L

from .conftest import table


def test_every_language_is_learnt(spark):
    """More than 200, the last ones rarest."""
    letters = [chr(0x4E00 + 11 * i) for i in range(205)]
    rows = [(1000 * i + j, letters[i] * (5 + j), f"l{i:03}", "s") for i in range(205) for j in range(3 if i < 200 else 2)]
    model = L.fit(table(spark, rows))
    assert model.langs == [f"l{i:03}" for i in range(205)]
    assert [model.scores(c * 9)[0] for c in letters] == model.langs
