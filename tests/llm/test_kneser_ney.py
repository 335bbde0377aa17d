"""The quality classifier against an independent Kneser-Ney model in dictionaries, and its thresholds."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirespark.llm import quality_classifier as C

from .conftest import EDGES, prose, table


def grams_of(texts, order):
    counts = Counter()
    for t in texts:
        w = [-1] * (order - 1) + [ord(c) for c in t] + [-2]
        counts.update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
    return counts


class Brute:
    """Interpolated modified Kneser-Ney, probability by probability."""

    def __init__(self, texts, order=C.ORDER):
        self.order, self.levels = order, {order: grams_of([t for t in texts if t], order)}
        for n in range(order - 1, 0, -1):
            self.levels[n] = Counter(g[1:] for g in self.levels[n + 1])
        self.cut, self.total, self.left = {}, {}, {}
        for n, counts in self.levels.items():
            often = Counter(counts.values())
            n1, n2, n3, n4 = (max(1, often[k]) for k in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            d = [min(max(a, 0.05), k) for k, a in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
            self.cut[n] = lambda c, d=d: d[min(c, 3) - 1] if c else 0.0
            total, left = defaultdict(int), defaultdict(float)
            for g, c in counts.items():
                total[g[:-1]] += c
                left[g[:-1]] += self.cut[n](c)
            self.total[n], self.left[n] = total, left

    def p(self, g):
        n = len(g)
        if n == 0:
            return 1 / 0x110000
        total = self.total[n].get(g[:-1])
        if total is None:
            return self.p(g[1:])
        c = self.levels[n].get(g, 0)
        return (c - self.cut[n](c) + self.left[n][g[:-1]] * self.p(g[1:])) / total

    def perplexity(self, t):
        return math.exp(-sum(n * math.log(self.p(g)) for g, n in grams_of([t], self.order).items()) / (len(t) + 1))


def documents(spark, texts):
    return table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])


def scored(spark, model, texts, **more):
    df = documents(spark, texts)
    got = df.select("text").join(model.scores(df, **more), F.xxhash64("text") == F.col("k")).collect()
    return {r.text: r.perplexity for r in got}


SWAPPED = "вера небо река " * 9
TRUSTED = [prose(i, 200, 60) for i in range(8)] + ["Ümlaut 中文 a\0b 12 it's\n\n", "", None, SWAPPED]


def test_perplexity_equals_brute_force(spark):
    model, brute = C.train(documents(spark, TRUSTED)), Brute(TRUSTED)
    texts = [TRUSTED[0], TRUSTED[0], TRUSTED[8], prose(99, 300, 80), "x", "wq 123 中 文 é", "word " * 500, "\U0001f600", SWAPPED, SWAPPED.replace("в", chr(ord("в") + 40))]
    got = scored(spark, model, texts)
    assert set(got) == set(texts) and got[texts[-1]] > 1.2 * got[SWAPPED]  # no characters are folded
    for t, p in got.items():
        assert p == pytest.approx(brute.perplexity(t), rel=1e-4)


def test_probabilities_sum_to_one():
    brute = Brute(["abcab", "bca"], 3)
    for context in ((-1, -1), (97, 98), (98, 99)):
        assert sum(brute.p((*context, c)) for c in range(-2, 0x110000 - 2)) == pytest.approx(1, abs=1e-6)


def test_cutting_changes_nothing(spark, monkeypatch):
    model = C.train(documents(spark, TRUSTED))
    texts = [prose(5, 3000, 80), "y", prose(6, 50)]
    want = scored(spark, model, texts)
    monkeypatch.setattr(C, "CHUNK", 100)
    monkeypatch.setattr(C, "BLOCK", 7)
    assert scored(spark, model, texts, slices=3) == want


def test_counts_equal_brute_force(spark, edges):
    marks = {-1: C.START, -2: C.END}
    want = {"".join(marks.get(c) or chr(c) for c in g): n for g, n in grams_of([t for _, t, *_ in EDGES if t], C.ORDER).items()}
    assert {r.gram: r.n for r in C.count_grams(edges, "text").collect()} == want


def test_each_window_is_hashed_once_an_order(monkeypatch):
    (block, of), hashed = next(C.blocks(["abracadabra " * 20, "", prose(4, 50)])), []
    slow = [np.array([C.keys_of(block.codes[i + C.ORDER - n : i + C.ORDER], n)[0] for i in block.first]) for n in range(1, C.ORDER + 1)]
    by_place = C.keys_by_place
    monkeypatch.setattr(C, "keys_by_place", lambda columns: hashed.append(len(columns[0])) or by_place(columns))
    got = block.keys()
    assert hashed == [len(block.first)] * C.ORDER
    assert all((a == b).all() for a, b in zip(got, slow))
    of_key = {int(k): i for i, k in enumerate(np.unique(np.concatenate(got)))}
    each = [sum(of_key[int(C.keys_of(C.codes_of(w), n)[0])] for w in (t[e - n : e] for e in range(C.ORDER, len(t) + 1) for n in range(1, C.ORDER + 1)) if (n := len(w))) for t in map(C.padded, ["abracadabra " * 20, "", prose(4, 50)])]
    assert block.sums(lambda keys: np.array([of_key[int(k)] for k in keys])).tolist() == each and of == [0, 1, 2]


def test_distinct_keys_and_keys_of_grams():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 5000):
        keys = r.integers(0, 1 << 64, n, np.uint64, endpoint=False)
        keys = np.concatenate([keys, keys[: n // 2], np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)])
        got = C.distinct(keys)
        assert got.dtype == np.uint64 and got.tolist() == np.unique(keys).tolist()
    grams = ["a", "中b", "\U0001f600x\0", C.START * 4, "abcde", "é", "vwxyz", C.END]
    assert C.keys_of_grams(grams).tolist() == [C.keys_of(C.codes_of(g), len(g))[0] for g in grams]
    assert C.keys_of_grams([]).tolist() == []


def test_quantiles_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(lang, r.lognormvariate(1, 1)) for lang in ("en", None, "de") for _ in range(501)]
    got = {x.lang: (x.a, x.b) for x in C.quantiles(spark.createDataFrame(rows, "lang string, x double"), ["lang"], "x", {"a": 0.5, "b": 0.995}).collect()}
    for lang in ("en", None, "de"):
        own = sorted(x for k, x in rows if k == lang)
        assert got[lang] == (pytest.approx(own[250], abs=6e-4), pytest.approx(own[498], abs=6e-4))


def test_thresholds_equal_brute_force(spark):
    rows = [(i, prose(i, 30 + i % 50, 300), "en" if i % 3 else "de", "s") for i in range(120)]
    docs, keys = table(spark, rows), spark.createDataFrame([(i,) for i in range(100)], "doc_id long")
    got = {r.doc_id: r for r in C.classified(docs, keys).collect()}
    apart = {r.doc_id for r in docs.where(F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(4)) == 0).collect()}
    brute = Brute([t for i, t, *_ in rows if i < 100 and i not in apart])
    for lang in ("en", "de"):
        own = [(round(math.log(brute.perplexity(t)), 3), math.log(brute.perplexity(t)), len(t)) for i, t, x, _ in rows if i < 100 and i in apart and x == lang]
        at = lambda x, q: sorted(x)[math.ceil(q * len(x)) - 1]
        middle = at([x for x, _, _ in own], 0.5)
        high = at([(x * n + middle * 20) / (n + 20) for _, x, n in own], 0.995)
        least = high + 0.25 * (high - middle)
        for i, t, x, _ in rows:
            if x == lang:
                want = math.exp((least * (len(t) + 20) - middle * 20) / len(t))
                assert got[i]["__threshold"] == pytest.approx(want, rel=5e-3)
                assert got[i]["__perplexity"] == pytest.approx(brute.perplexity(t), rel=1e-4)
                assert got[i]["__kept"] == (got[i]["__perplexity"] <= got[i]["__threshold"])


def test_new_texts_of_the_kind_are_kept(spark):
    rows = [(i, prose(i, 150, 400), "en", "s") for i in range(60)]
    junk = [(100 + i, "".join(random.Random(i).choice("#%&x9 ") for _ in range(900)), "en", "s") for i in range(5)]
    keys = spark.createDataFrame([(i,) for i in range(40)], "doc_id long")
    kept = {r.doc_id for r in C.kept_rows(table(spark, rows + junk), keys).collect()}
    assert kept == set(range(60))


def test_clashing_names(spark):
    rows = [(i, prose(i, 50, 40), "en", 1.5, "c0", True, "k") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __perplexity double, c1 string, __kept boolean, `a.b` string")
    keys = docs.select("doc_id").where("doc_id < 20")
    kept = C.kept_rows(docs, keys)
    assert kept.columns == docs.columns and kept.where("__perplexity = 1.5 AND c1 = 'c0'").count() >= 20
    assert sorted(C.classified(docs, keys).columns) == sorted([*docs.columns, "__threshold"])
