import random
from math import comb

import numpy as np
import pytest

from wirespark.llm import jaccard_join as J
from wirespark.llm.graph import components

from .conftest import EDGES, prose, table


def sets(t, k):
    w = [x.decode() for x in (t or "").encode().translate(J.LOWER).split()]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    """Rows of one key are one document, rows with a null key are each their own."""
    own = [((0, d, 0) if d is not None else (1, 0, i), sets(t, k)) for i, (d, t, *_) in enumerate(rows)]
    parent = {d: d for d, _ in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(own):
        for b, y in own[:i]:
            if x and y and den * len(x & y) >= num * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    key = lambda x: x[1] if x[0] == 0 else None
    return sorted(((key(d), len(s), key(root(d) if s else d)) for d, s in own), key=str)


def edited(text, r, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_equals_brute_force(spark, k, num, den):
    r = random.Random(num)
    rows = []
    for g in range(25):
        base = prose(1000 + g, r.choice([4, 9, 15, 22, 30, 60, 150]), 400)
        for _ in range(r.randrange(1, 7)):
            rows.append((len(rows) * 7 % 1009, edited(base, r, r.randrange(4)) if r.random() < 0.8 else base.upper(), "en", "s"))
    shared = prose(5, 60)  # a passage that many documents hold
    for i in range(40):
        rows.append((2000 + i, f"{shared} {prose(3000 + i, r.choice([5, 40, 200]))}", "en", "s"))
    rows += [(None, r.choice(rows)[1], "en", "s") for _ in range(12)] + [(None, edited(r.choice(rows)[1], r, 2), "en", "s") for _ in range(12)]
    rows += [(7000, rows[0][1], "en", "s"), (7000, rows[30][1], "en", "s"), (None, None, "en", "s"), (None, "only here", "en", "s"), (None, "only here", "en", "s")]
    rows += [(5000 + i, t, "en", "s") for i, t in enumerate(["", None, "a", "A", "a b", "b a", "a b c", "a  b\tc"])]
    got = J.similar(table(spark, rows), k=k, num=num, den=den).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k, num, den)


def test_small_sets_by_subsets(spark, monkeypatch):
    r = random.Random(1)
    rows = []
    for g in range(30):
        base = prose(g, r.randrange(6, 24), 50).split()
        for _ in range(4):
            w = list(base)
            for _ in range(r.randrange(2)):
                w.insert(r.choice([0, len(w)]), f"x{r.randrange(99)}")
            rows.append((len(rows), " ".join(w), "en", "s"))
    for most in (0, 20):  # lists only; subsets for nearly all
        monkeypatch.setattr(J, "boundary", lambda *a, most=most: most)
        got = J.similar(table(spark, rows)).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, 3, 90, 100)


def test_large_groups(spark):
    r = random.Random(3)
    base = prose(77, 200)
    rows = [(i, base if i % 3 == 0 else edited(base, r, r.randrange(1, 9)), "en", "s") for i in range(150)]
    got = J.similar(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 3, 90, 100)


def test_edges(edges, nothing):
    assert sorted(map(tuple, J.similar(edges).collect()), key=str) == brute(EDGES, 3, 90, 100)
    assert J.similar(nothing).count() == 0
    left = J.deduplicated(edges)
    assert left.columns == edges.columns
    assert sorted(str(x.doc_id) for x in left.collect()) == sorted(["1", "1", "3", "4", "5", "6", "7", "8", "9", "None"])
    assert J.deduplicated(nothing).count() == 0


def test_thresholds_are_exact():
    for num, den in ((90, 100), (80, 100)):
        for a in range(1, 40):
            found = dict(J.partners(a, num, den))
            for b in range(1, 60):
                possible = [i for i in range(min(a, b) + 1) if den * i >= num * (a + b - i)]
                assert (b in found) == bool(possible)
                if possible:
                    assert found[b] == possible[0]
            assert J.emitted(a, num, den) == sum(comb(a, t) for t in found.values())
    assert J.boundary({5: 100, 30: 100}, 90, 100) in range(5, 30)


def test_shingle_hashes():
    assert len(J.shingles("A b C d", 3)) == 2 and (J.shingles("a B c", 3) == J.shingles("A\tb\nC", 3)).all()
    assert J.shingles(None, 3).size == J.shingles(" ", 3).size == 0
    assert len(np.intersect1d(J.shingles("a b", 3), J.shingles("a b b", 3))) == 0


def test_components(spark):
    r = random.Random(0)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_null_key_links_others(spark):
    text = prose(8, 200).split()
    near = lambda n: " ".join(text[:-n] + [f"x{i}" for i in range(n)])
    rows = [(4, near(1), "en", "s"), (None, near(9), "en", "s"), (2, near(17), "en", "s"), (None, " ".join(text[:-1] + ["x0"]), "en", "s")]
    got = sorted(map(tuple, J.similar(table(spark, rows)).collect()), key=str)
    assert got == brute(rows, 3, 90, 100) and {c for *_, c in got} == {2}


def test_group_of_thousands(spark):
    r = random.Random(9)
    base = prose(78, 120)
    rows = [(10 + i, edited(base, r, 1), "en", "s") for i in range(5000)] + [(1, base, "en", "s"), (2, prose(79, 120), "en", "s")]
    got = {x.doc_id: x.component_id for x in J.similar(table(spark, rows)).collect()}
    assert len(got) == 5002 and got.pop(2) == 2 and set(got.values()) == {1}
