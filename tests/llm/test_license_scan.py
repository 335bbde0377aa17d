import re

from wirespark.llm import license_scan as L

from .conftest import EDGES, table


def words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w]


def grams(t):
    w = words(t)
    return {f"{a} {b}" for a, b in zip(w, w[1:])} or set(w)


def brute(t, threshold=0.8):
    found = {}
    for s in {*(t or "").split("\n"), *re.split(r"\n[ \t\r]*\n", t or "")}:
        g = grams(s)
        if not g:
            continue
        dice, name = max((2 * len(g & grams(x)) / (len(g) + len(grams(x))), i) for i, x in L.TEMPLATES)
        if dice >= threshold:
            found[name] = max(found.get(name, 0), dice)
    return sorted(found.items())


def test_equals_brute_force(spark):
    texts = [t for _, t, *_ in EDGES]
    for _, t in L.TEMPLATES:
        w = t.split()
        texts += [t, f"Some text.\n{t.upper()}\nmore", "\n".join([" ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])]), " ".join(w[:-1]), " ".join(w[: len(w) // 3]), " ".join(["so", "it", "is", *w, "and", "more"])]
    texts.append("Released under the MIT License.\n\nLicensed under CC BY-NC 4.0.\n")
    got = L.scan(table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert [(x.license, round(x.dice, 9)) for x in r.licenses] == [(i, round(d, 9)) for i, d in brute(t)]
        assert (r.license is None) == (not r.licenses)


def test_edges(edges, nothing):
    from wirespark.plans.inspect import python_nodes, shuffles

    got = L.scan(edges)
    assert got.count() == len(EDGES) and L.scan(nothing).count() == 0
    assert python_nodes(got) == [] and shuffles(got) == 0
