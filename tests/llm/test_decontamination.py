import hashlib
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from wirespark.llm import decontamination as D

from .conftest import EDGES, prose, table

#: The last ones: a null id and an item of that name.
ITEMS = [(1, " ".join(prose(1, 300).split()[40:70])), (2, "ONE two"), (3, prose(99, 20)), (4, None), (5, "?!"), (6, " ".join(prose(7, 60_000).split()[-12:])), (7, " ".join(prose(1, 300).split()[60:80])), (7, "one"), (None, "word word word word word word word word"), (None, "two")]


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, window=8):
    out = []
    for d, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            q = words(x)
            n = min(window, len(q))
            grams = {tuple(q[j : j + n]) for j in range(len(q) - n + 1)} if q else set()
            for j in range(len(w) - n + 1):
                if grams and tuple(w[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    found.add(i)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block_words", [500_000, 10])
def test_equals_brute_force(edges, benchmark, block_words):
    got = D.digest(D.scan(edges, benchmark, block_words=block_words))
    assert sorted(map(tuple, got.collect()), key=str) == brute(EDGES, ITEMS)


def test_random_texts(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(60))), "en", "s") for i in range(80)]
    items = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(14)))) for i in range(12)]
    got = D.digest(D.scan(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, items)


def test_suffix_array_and_longest_matches():
    r = np.random.default_rng(0)
    for _ in range(20):
        body = r.integers(0, 4, r.integers(1, 80))
        train = np.concatenate([body, [0]])
        order = D.suffix_array(train)
        ends = {p: k - len(train) for k, p in enumerate(np.flatnonzero(train == 0))}
        key = lambda p: [ends[q] if train[q] == 0 else train[q] for q in range(p, len(train))]
        assert order.tolist() == sorted(range(len(train)), key=key)
        q = D.Queries([("x", [bytes([97 + v]) for v in r.integers(0, 3, 12)])], 8)
        shard = D.Shard(train)
        length, at = shard.longest(q)
        seq = q.words
        for s, n, p in zip(q.suffixes, length, at):
            best = max(next((k for k in range(q.left[s] + 1) if k == q.left[s] or p2 + k >= len(train) or train[p2 + k] == 0 or train[p2 + k] != seq[s + k]), 0) for p2 in range(len(train)))
            assert n == best and (train[p : p + n] == seq[s : s + n]).all()


def test_removal_keeps_columns_and_rows(spark, edges, benchmark, nothing):
    left = D.decontaminated(edges, benchmark)
    assert left.columns == edges.columns
    bad = {str(b[0]) for b in brute(EDGES, ITEMS) if b[3] >= 1}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, *_ in EDGES if str(d) not in bad)
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminated(edges, none).count() == len(EDGES)
    assert D.decontaminated(nothing, benchmark).count() == 0


def test_longest_matches_and_places(spark, edges, benchmark, monkeypatch):
    monkeypatch.setattr(D, "SHARD_WORDS", 400)
    got = {(r.item, r.at): (r.words, r.doc_id, r.place) for r in D.longest_matches(edges, benchmark).collect()}
    want = {}
    for i, x in ITEMS:
        q = words(x)
        for at in range(len(q)):
            for d, t, *_ in EDGES:
                w = words(t)
                for p in range(len(w)):
                    n = next((n for n in range(len(q) - at + 1) if n == len(q) - at or p + n == len(w) or w[p + n] != q[at + n]), 0) if w[p] == q[at] else 0
                    if n >= min(8, len(q)):
                        k = None if i is None else str(i), at
                        want[k] = max(want.get(k, 0), n)
    assert {k: v[0] for k, v in got.items()} == want
    texts = {}
    for d, t, *_ in EDGES:
        texts.setdefault(d, []).append(words(t))
    items = {}
    for i, x in ITEMS:
        items.setdefault(None if i is None else str(i), []).append(words(x))
    for (i, at), (n, d, p) in got.items():
        assert any(w[p : p + n] == q[at : at + n] for w in texts[d] for q in items[i])


REPEATED = """
import resource, sys
import numpy as np
from wirespark.llm import decontamination as D
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
if sys.argv[1] == "word":
    items, docs = [("a", [b"w"] * 100_000), ("b", [b"w"] * 9)], [[b"w"] * 100_000, [b"w"] * 7]
else:
    phrase = [b"p%d" % i for i in range(8)]
    items = [(str(k), phrase + [b"x%d" % k]) for k in range(10_000)]
    docs = [phrase + [b"y%d" % k] for k in range(50_000)]
q = D.Queries(items, 8)
got = D.scan_shard(q, D.numbered(q, docs))
if sys.argv[1] == "word":
    assert [len(p) for p, _ in got] == [100_000, 0] and q.items_of(got[0][1]) == [0, 1]
    length, _ = D.Shard(D.runs(q, D.numbered(q, docs))[0]).longest(q)
    assert length[:100_000].tolist() == list(range(100_000, 0, -1))
else:
    assert all(len(p) == 8 for p, _ in got) and q.items_of(got[-1][1]) == list(range(10_000))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize("kind", ["word", "phrase"])
def test_repetition_takes_little_memory(kind):
    out = subprocess.run([sys.executable, "-c", REPEATED, kind], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 500


def test_shared_phrase_over_rows(spark):
    phrase = "a b c d e f g h"
    docs = table(spark, [(i, f"{phrase} {i}", "en", "s") for i in range(300)])
    items = spark.createDataFrame([(i, f"{phrase} x{i}") for i in range(2000)], "item_id long, text string")
    got = D.digest(D.scan(docs, items, block_words=7000)).collect()
    assert len(got) == 300 and {(r.n_hit, r.n_items, r.contaminated) for r in got} == {(8, 2000, True)}
