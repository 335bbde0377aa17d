import random

import pytest

from wirespark.llm import mixing as M

from .conftest import EDGES, prose, table


def filled(sizes, most=3):
    """Targets by repeated sharing."""
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(sizes)}
    left, total, out = dict(sizes), sum(sizes.values()), {}
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > most * sizes[s] + 1e-9]
        if not over:
            return out | {s: level * weight[s] for s in left}
        for s in over:
            out[s] = float(most * left.pop(s))
    return out


def rows_of(n=200):
    return [(i, prose(i, 5 + i * 7 % 90), "en", "abcdefg"[i * i % 7] if i % 9 else None) for i in range(n)]


def test_targets_and_takes(spark):
    rows = rows_of()
    sizes = {}
    for _, t, _, s in sorted(rows, key=lambda r: (r[3] is None, r[3] or "")):
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = filled(sizes)
    docs = table(spark, rows)
    got = M.taken(*M.mix(docs, slots_about=300)).toPandas()
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    for s, part in got.groupby(got.k.map(lambda k: source[k] or "")):
        assert part.target.iloc[0] == pytest.approx(want[s or None])
        assert part.taken.sum() == pytest.approx(want[s or None], abs=1)
    assert (got.taken <= 3 * got["size"]).all()
    again = M.taken(*M.mix(docs.repartition(7), slots_about=300)).toPandas()
    assert got.set_index("k").taken.sort_index().tolist() == again.set_index("k").taken.sort_index().tolist()


def test_capped_source(spark):
    rows = [(1, "a b", "en", "x"), (2, prose(1, 1000), "en", "y"), (3, prose(2, 500), "en", "z")]
    got = {r.k: r for r in M.taken(*M.mix(table(spark, rows))).collect()}
    assert got[1].taken == 6 and got[1].target == 6
    assert sum(r.taken for r in got.values()) == pytest.approx(1502, abs=1)


def test_slots_are_the_ranked_points(spark):
    plan = spark.createDataFrame([(0, 0, 5), (1, 5, 1), (2, 6, 7)], "no long, first long, n long")
    got = M.slots(spark, plan, 4, 13).orderBy("i").collect()
    seen, want = {}, []
    for i in range(16):
        point = int(f"{i:04b}"[::-1], 2)
        no = next(k for k, a, n in ((0, 0, 5), (1, 5, 1), (2, 6, 7)) if a * 16 // 13 <= point < (a + n) * 16 // 13)
        rank = seen.get(no, 0)
        seen[no] = rank + 1
        if rank < {0: 5, 1: 1, 2: 7}[no]:
            want.append((i, no, rank))
    assert [(r.i, r.no, r["rank"]) for r in got] == want


def test_edges(edges, nothing):
    got = M.taken(*M.mix(edges)).collect()
    assert sorted(str(r.k) for r in got) == sorted(str(d) for d, *_ in EDGES)
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert M.taken(*M.mix(nothing)).count() == 0
    mixed = M.mixed_rows(edges)
    assert mixed.columns == edges.columns
    assert {r.doc_id for r in mixed.collect()} <= {d for d, *_ in EDGES}
    assert M.mixed_rows(nothing).count() == 0


def test_all_texts_empty(spark):
    got = M.taken(*M.mix(table(spark, [(1, "", "en", "a"), (2, None, "en", None)]))).collect()
    assert [r.taken for r in got] == [0, 0]


def test_rows_come_in_the_order_of_slots_and_near_their_targets(spark):
    r = random.Random(11)
    rows = [(i, prose(i, r.randrange(1, 60)), "en", "abc"[i % 3]) for i in range(300)] + [(900, prose(900, 4000), "en", "d"), *((901 + i, prose(901 + i, 30), "en", "d") for i in range(90))]
    docs = table(spark, rows).withColumnsRenamed({"h": "slots", "size": "copy"})
    pieces, placed = M.mix(docs, slots_about=200)
    first = {}
    for p in pieces.join(placed, ["no", "start"]).collect():
        first[p.k, p["round"]] = min(first.get((p.k, p["round"]), 1 << 60), p.slot)
    got = M.mixed_rows(docs, slots_about=200)
    assert got.columns == docs.columns
    words = {i: (len(t.split()), s) for i, t, _, s in rows}
    seen, slots, taken = {}, [], {}
    for x in got.collect():
        own = sorted(v for (k, _), v in first.items() if k == x.doc_id)
        seen[x.doc_id] = seen.get(x.doc_id, 0) + 1
        slots.append(own[min(seen[x.doc_id], len(own)) - 1] if own else 1 << 60)
        taken[x.source] = taken.get(x.source, 0) + words[x.doc_id][0]
    assert slots == sorted(slots) and max(seen.values()) <= 3
    for t in placed.select("src", "target").distinct().collect():
        assert abs(taken[t.src] - t.target) <= 30 if t.src != "d" else abs(taken["d"] - t.target) <= 2000


def test_repeated_rows_share(spark):
    rows = [(1, "a b c", "en", "x")] * 4 + [(2, "d e f", "en", "y")] * 2 + [(None, "g h", "en", None)] * 2
    got = [x.doc_id for x in M.mixed_rows(table(spark, rows)).collect()]
    assert got.count(1) % 4 == 0 and got.count(2) % 2 == 0 and got.count(None) % 2 == 0 and 0 < len(got) <= 24


def test_slots_of_large_schedules(spark):
    for bits, counts in ((1, [2]), (9, [300, 1, 90, 60]), (12, [5, 4000])):
        plan = spark.createDataFrame([(k, sum(counts[:k]), n) for k, n in enumerate(counts)], "no long, first long, n long")
        total = sum(counts)
        got = {r.i: (r.no, r["rank"]) for r in M.slots(spark, plan, bits, total).collect()}
        seen, want = {}, {}
        for i in range(1 << bits):
            point = int(f"{i:0{bits}b}"[::-1], 2)
            no = next(k for k in range(len(counts)) if sum(counts[:k]) * (1 << bits) // total <= point < sum(counts[: k + 1]) * (1 << bits) // total)
            rank = seen[no] = seen.get(no, -1) + 1
            if rank < counts[no]:
                want[i] = no, rank
        assert got == want


def test_schedule_stays_small_on_the_driver(spark, edges):
    plan = spark.createDataFrame([(0, 0, 90_000), (1, 90_000, 41_000)], "no long, first long, n long")
    text = M.slots(spark, plan, 17, 131_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and len(text) < 20_000
    # The schedule is made for the pieces alone: what is planned after them reads them.
    rows = M.copies(*M.mix(edges))
    assert "sequence(" not in rows._jdf.queryExecution().optimizedPlan().toString()
