import pytest
from pyspark.sql import functions as F

from wirespark.llm import sharding as S
from wirespark.llm.common import new_path

from .conftest import EDGES


def rows(df):
    return sorted(map(str, df.collect()))


def test_append_compact_read(spark, edges):
    store = S.ShardStore(spark, new_path(spark, "store"), target_mb=1, fanout=3, smallest_mb=0.001)
    for _ in range(7):
        store.append(edges.repartition(2))
    before = store.manifest()
    assert before["version"] == 7 and len(before["shards"]) == 14
    wanted = sorted(rows(edges) * 7)
    assert rows(store.read()) == wanted
    after = store.manifest(store.compact())
    assert len(after["shards"]) < 14 and after["version"] > 7
    assert rows(store.read()) == wanted
    assert rows(store.read(3)) == sorted(rows(edges) * 3)  # older versions stay readable
    assert not store.plan(after["shards"]) or sum(s.bytes for s in store.plan(after["shards"])[0]) > store.target
    assert store.vacuum() >= 14
    assert rows(store.read()) == wanted


def test_commits_are_atomic(spark, edges):
    root = new_path(spark, "store")
    one, two = S.ShardStore(spark, root), S.ShardStore(spark, root)
    one.append(edges)
    now = two.manifest()
    one.append(edges)
    with pytest.raises(S.CommitConflict):
        two.commit(now["version"], now["shards"], now["schema"])
    assert one.version() == 2 and one.read().count() == 2 * len(EDGES)


def test_tiers(spark):
    store = S.ShardStore(spark, new_path(spark, "store"), target_mb=64, fanout=4, smallest_mb=1)
    mb = 1 << 20
    assert [store.tier(n * mb) for n in (0, 1, 2, 4, 5, 16, 17)] == [0, 0, 1, 1, 2, 2, 3]
    shard = lambda i, n: S.Shard(str(i), n * mb, store.tier(n * mb))
    small, large = [shard(i, 1) for i in range(4)], [shard(9 + i, 60) for i in range(9)]
    assert store.plan(small + large) == [small]
    assert store.plan(small[:3] + large) == []


def test_empty_and_digest(spark, edges, nothing):
    store, got = S.sharded(nothing, new_path(spark, "store"))
    assert store.version() == 4 and got.count() == 0 and got.columns == edges.columns
    assert S.shard_digest(got).count() == 0
    _, got = S.sharded(edges, new_path(spark, "store"))
    assert rows(got) == rows(edges)
    digest = S.shard_digest(got).collect()
    assert len(digest) == len(EDGES) and all(r.shard_bytes > 0 for r in digest)
    assert len({r.shard for r in digest}) == 1  # four arrivals were merged
    with pytest.raises(ValueError):
        S.ShardStore(spark, new_path(spark, "store")).read()


def test_several_arrivals_are_versions_and_merge(spark, edges):
    store = S.ShardStore(spark, new_path(spark, "store"), fanout=4)
    clash = edges.withColumn("arrival", F.lit("mine")).repartition(2)
    assert store.append_all(clash, 5) == 5
    parts = [store.read(v).count() for v in range(1, 6)]
    assert parts == sorted(parts) and parts[-1] == len(EDGES) and store.read(5).columns == clash.columns
    before = len(store.manifest(5)["shards"])
    assert store.compact() == 6 and len(store.manifest()["shards"]) < before
    assert rows(store.read()) == rows(clash)


def test_vacuum_spares_a_writer_that_has_not_committed(spark, edges):
    root = new_path(spark, "store")
    one, two = S.ShardStore(spark, root, fanout=2), S.ShardStore(spark, root)
    one.append(edges)
    late = two._write(edges)
    one.append(edges)
    one.compact()
    assert one.vacuum() == len(one.manifest(2)["shards"])  # what the merge replaced, and nothing else
    two._add(late, edges.schema.json())
    assert rows(one.read()) == sorted(rows(edges) * 3)
    one._write(edges)
    assert one.vacuum(min_age_s=-60) > 0 and rows(one.read()) == sorted(rows(edges) * 3)


def test_races(spark, edges, monkeypatch):
    root = new_path(spark, "store")
    one, two = S.ShardStore(spark, root, fanout=2), S.ShardStore(spark, root, fanout=2)
    one.append(edges)
    one.append(edges)
    write, done = one._write, []

    def slow(df):  # another writer appends between one's write and its commit
        got = write(df)
        if not done:
            done.append(two.append(edges))
        return got

    monkeypatch.setattr(one, "_write", slow)
    one.compact()
    assert rows(one.read()) == sorted(rows(edges) * 3) and done
    one.append(edges)
    assert rows(two.read()) == sorted(rows(edges) * 4)


def test_faults_of_the_file_system_are_no_conflicts(spark, edges, monkeypatch):
    store = S.ShardStore(spark, new_path(spark, "store"))
    store.append(edges)
    monkeypatch.setattr(store, "_path", lambda at, p=store._path: p(at.replace("/manifest/0", "/nowhere/0")))
    with pytest.raises(Exception) as e:
        store.commit(1, [], "{}")
    assert not isinstance(e.value, S.CommitConflict)
