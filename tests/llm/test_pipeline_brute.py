"""Every stage of the pipeline against brute force on a small fixture."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wirespark.llm.common import new_path

from .conftest import prose
from .test_decontamination import brute as hits
from .test_jaccard_join import brute as components
from .test_jaccard_join import edited
from .test_kneser_ney import Brute


@pytest.fixture(scope="module")
def fixture(spark):
    r = random.Random(21)
    texts = [prose(i, r.randrange(60, 120), 500) for i in range(90)]
    rows = [(i, t, "en" if i % 4 else "de", "abc"[i % 3]) for i, t in enumerate(texts)]
    rows += [(200 + i, edited(texts[i], r, 1), "en", "b") for i in range(12)] + [(230, texts[5], "de", None), (231, texts[5], "en", "a")]
    rows += [(300 + i, "".join(r.choice("#%&x9 ") for _ in range(500)), "en", "a") for i in range(6)] + [(310, None, "en", "a"), (311, "", "de", "c")]
    items = [(i, " ".join(texts[40 + i].split()[10:30])) for i in range(5)] + [(9, prose(999, 30))]
    at = new_path(spark, "fixture")
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i == 7)) for i in range(60)] + [(300 + i, 0, 0) for i in range(3)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows, items


def test_stages_equal_brute_force(spark, fixture):
    at, rows, items = fixture
    docs, outs = spark.read.parquet(f"{at}/documents.parquet"), []
    apart = {r.doc_id for r in docs.where(F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(4)) == 0).collect()}
    for _, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "brute-stage")
        stage(spark, docs, at).write.parquet(path)
        docs = spark.read.parquet(path)
        outs.append(docs.collect())

    # Perplexity under the trusted texts that aren't held out; thresholds from those that are.
    good = [(i, t, x) for i, t, x, _ in rows if i < 60 and i != 7]
    model = Brute([t for i, t, _ in good if i not in apart])
    at_share = lambda x, q: sorted(x)[math.ceil(q * len(x)) - 1]

    def limit(own):
        logs = [(round(math.log(model.perplexity(t)), 3), math.log(model.perplexity(t)), len(t)) for t in own]
        middle = at_share([x for x, *_ in logs], 0.5)
        high = at_share([(x * n + middle * 20) / (n + 20) for _, x, n in logs], 0.995)
        return middle, high + 0.25 * (high - middle)

    limits = {x: limit([t for i, t, y in good if i in apart and y == x]) for x in ("en", "de")}
    kept, close, stayed = {}, [], {r.doc_id for r in outs[0]}
    for i, t, x, s in rows:
        if t:
            middle, least = limits[x]
            far = math.log(model.perplexity(t)) - (least * (len(t) + 20) - middle * 20) / len(t)
            if abs(far) < 0.002:  # thresholds are rounded to thousandths: there the stage's own word counts
                close.append(i)
            if i in stayed if abs(far) < 0.002 else far <= 0:
                kept[i] = (i, t, x, s)
    assert len(close) <= 3
    assert {r.doc_id for r in outs[0]} == kept.keys() and not kept.keys() & set(range(300, 312))

    found = {d: c for d, _, c in components(list(kept.values()), 5, 80, 100)}
    kept = {i: x for i, x in kept.items() if found[i] == i}
    assert {r.doc_id for r in outs[1]} == kept.keys() and len(kept) < len(found)

    bad = {x[0] for x in hits(list(kept.values()), items) if x[3]}
    kept = {i: x for i, x in kept.items() if i not in bad}
    assert {r.doc_id for r in outs[2]} == kept.keys() and len(bad) >= 5

    # Targets: words by weights 5, 2, 1, at most three times a source's own.
    words = Counter()
    for _, t, _, s in kept.values():
        words[s] += len(t.split())
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set()
    while True:
        left = sum(words.values()) - sum(3 * words[s] for s in capped)
        share = {s: 3 * words[s] if s in capped else left * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order}
        if not (over := {s for s in order if share[s] > 3 * words[s] + 1e-9}):
            break
        capped |= over
    taken, times = Counter(), Counter(r.doc_id for r in outs[3])
    for i, n in times.items():
        taken[kept[i][3]] += n * len(kept[i][1].split())
    assert times.keys() <= kept.keys() and max(times.values()) <= 3
    for s in order:
        assert abs(taken[s] - share[s]) <= 120, s  # a document's size

    assert sorted(map(str, (r[:-1] for r in outs[4]))) == sorted(map(str, (tuple(r) for r in outs[3])))
    assert len({r.shard for r in outs[4]}) >= 1
