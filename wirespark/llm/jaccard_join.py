"""Size-aware heavy-light join: documents whose sets of word shingles have a Jaccard similarity of num / den or more.

Documents with equal sets are one class, which gets a number. Classes are split by size at a boundary:

* small sets enumerate subsets of a fixed size: two sets of sizes a and b are similar if they have
  t(a, b) = ceil(num (a + b) / (num + den)) elements in common, so each emits, for every partner size, its subsets of
  t(a, b) elements. Sets that meet in a block are similar, without a look at them.
* large sets scan inverted lists. A list is kept for each set's rarest elements only: as many as leave fewer others
  than any partner must share. Rare first is decided by a sketch of all documents' shingles (counts in 2^20 buckets).
  Pairs that meet in a list are verified on their whole sets, made anew from the texts.

The boundary is where the subsets emitted begin to cost more than list entries and verification (`boundary`).

A group of n similar classes is not compared pair by pair. The first round compares each member with one pivot, that
with which it shares most lists, and joins what is similar to components. Two more rounds compare only members of a list
that are in different components by then, whose sizes lie in the same or neighbouring bands (so a long list is dealt by
size too), and only those whose places in the list's sets let them have enough in common. The one round takes all such
pairs of lists of up to 32 members and, from longer ones, each set's best partners; the other all pairs that are left. So
every pair that could connect two components is verified.

Defined results: words are runs of anything but blank and \\t to \\r, A-Z lower-cased. A text with fewer words than a
shingle is one shingle; a null or wordless one has no set, is linked with nothing and is its own component. Rows with
one key count as one document: their sets' links are all its links, and each row reports its own set's size. Rows with
null keys are documents of their own, which link others like any; they get the smallest key of their component, null if
it has none. Empty tables give empty results; other columns are ignored by `similar` and kept by `deduplicated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, discard, staged, text_batches
from .graph import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BUCKET_BITS, SLICE = 20, 1 << 12
#: Sets up to this size may be small; the boundary is never above it.
SMALL_MOST = 32
#: What verifying a list's candidate costs, in list entries.
VERIFY = 8
#: Lists up to this length have all their open pairs compared in one round.
SHORT_LIST = 32
#: Best partners that each set of a longer list tries before all pairs that are still open.
PARTNERS = 8
C1, C2 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * C1 + w[j : len(w) - k + 1 + j]
    h = (h ^ (h >> np.uint64(32))) * C2
    return np.unique(h ^ (h >> np.uint64(29)))


def common_least(a: int, b: int, num: int, den: int) -> int:
    return -(-num * (a + b) // (num + den))


def partners(a: int, num: int, den: int) -> list[tuple[int, int]]:
    """(size of a partner, elements in common at least)."""
    return [(b, t) for b in range(-(-num * a // den), a * den // num + 1) if (t := common_least(a, b, num, den)) <= min(a, b)]


def emitted(a: int, num: int, den: int) -> int:
    return sum(comb(a, t) for _, t in partners(a, num, den))


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """The largest size of small sets: that with the least cost, from how many classes have each size."""
    def cost(x: int) -> int:
        return sum(n * (emitted(s, num, den) if s <= x else prefix_size(s, num, den) + VERIFY) for s, n in sizes.items())

    return min(range(SMALL_MOST + 1), key=lambda x: (cost(x), -x)) if sizes else 1


def frequencies(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """In how many documents' sets each bucket of shingles occurs, counted over all of them; 2^20 numbers."""
    def count(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            held = [shingles(t, k) for t in b.column("t").to_pylist()]
            if held:
                total += np.bincount((np.concatenate(held) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        for i in range(0, len(total), SLICE):
            part = total[i : i + SLICE]
            if (at := np.flatnonzero(part)).size:
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([part[at].tobytes()], pa.binary())], ["slice", "at", "n"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One batch at a time: what all tasks counted for a slice is never held at once.
        total = np.zeros(SLICE, np.int64)
        for b in batches:
            for at, n in zip(b.column("at").to_pylist(), b.column("n").to_pylist()):
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "n"])

    # The hints are text in this module, and what reads them doesn't look into functions' modules.
    add.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    parts = text_batches(docs.select(F.col(text).alias("t")), count, "slice int, at binary, n binary")
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in parts.groupBy("slice").applyInArrow(add, "slice int, n binary").collect():
        out[r["slice"] : r["slice"] + SLICE] = np.frombuffer(r["n"], np.int64)
    return out


def signature(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def lists_of(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), signed(np.concatenate([*arrays, np.zeros(0, np.uint64)])))


def described(docs: DataFrame, text: str, key: str, k: int, num: int, den: int) -> DataFrame:
    """id, n (size of the set), sig (16 bytes that stand for the set), prefix (rarest elements), small (a small set, whole)."""
    sent = docs.sparkSession.sparkContext.broadcast(frequencies(docs, text, k).astype(np.int32))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        often = sent.value
        for b in batches:
            n, sig, prefix, small = [], [], [], []
            for t in b.column("t").to_pylist():
                h = shingles(t, k)
                n.append(len(h))
                sig.append(signature(h))
                if len(h):
                    # h ascends, so equal frequencies stay in the order of the hashes.
                    order = np.argsort(often[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], kind="stable")
                    prefix.append(h[order[: prefix_size(len(h), num, den)]])
                else:
                    prefix.append(h)
                small.append(h if len(h) <= SMALL_MOST else h[:0])
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), lists_of(prefix), lists_of(small)], ["id", "n", "sig", "prefix", "small"])

    return text_batches(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"id {kind}, n int, sig binary, prefix array<bigint>, small array<bigint>")


def small_links(classes: DataFrame, x: int, num: int, den: int) -> DataFrame:
    """a, b (numbers of classes): links that put each block's members into one component."""
    def subsets(batches):
        for b in batches:
            block, who, size, pair = [], [], [], []
            for rep, n, held in zip(b.column("rep").to_pylist(), b.column("n").to_pylist(), b.column("small")):
                h = held.values.to_numpy()
                for other, t in partners(n, num, den):
                    head = b"%d,%d," % (min(n, other), max(n, other))
                    for chosen in combinations(range(n), t):
                        block.append(xxhash.xxh128_digest(head + h[list(chosen)].tobytes()))
                        who.append(rep)
                        size.append(n)
                        pair.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.binary()), pa.array(who, pa.int64()), pa.array(size, pa.int32()), pa.array(pair, pa.int32())], ["block", "rep", "n", "other"])

    rows = classes.where(f"n BETWEEN 1 AND {x}").select("rep", "n", "small").mapInArrow(subsets, "block binary, rep bigint, n int, other int")
    rows = staged(rows, "blocks")
    # By partial aggregation and a join that Spark can split, as a block may be one that very many sets emit.
    # A block is for one pair of sizes; if they differ, members of one size are only linked by way of the other's.
    heads = rows.groupBy("block").agg(F.min("rep").alias("least"), F.min("n").alias("n1"), F.max("n").alias("n2"), F.count("*").alias("m")).where("m > 1")
    sides = rows.join(heads, "block")
    return sides.where("n1 = least(n, other) AND n2 = greatest(n, other) AND rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b"))


def may_meet(n1: str, i: str, n2: str, j: str, x: int, num: int, den: int) -> str:
    """SQL: sets of n1 and n2 elements with one at places i and j of their orders may be similar, by way of that one.

    With t elements in common needed, the first one they share has t - 1 more behind it in both sets; and whatever
    stands before an element they share, at most the lesser of the two places is in common there.
    """
    t = f"(({num} * ({n1} + {n2}) + {num + den - 1}) DIV {num + den})"
    return f"greatest({n1}, {n2}) > {x} AND {i} <= {n1} - {t} AND {j} <= {n2} - {t} AND least({i}, {j}) + least({n1} - {i}, {n2} - {j}) >= {t}"


def plausible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose prefixes have enough elements in common.

    Of the two prefixes take the one that ends first: what the sets share up to there is in both prefixes, so its set
    lacks as many elements as its prefix has others. With t common elements needed, the prefixes must share at least
    t - n + (prefix size) of them for that set; which set it is isn't known here, so the lesser number is asked for.
    """
    own = classes.select("rep", "n", "prefix")
    both = pairs.join(own.toDF("a", "na", "pa"), "a").join(own.toDF("b", "nb", "pb"), "b")
    t = F.ceil((F.col("na") + F.col("nb")) * num / (num + den) - 1e-9)
    need = F.least(t - F.col("na") + F.size("pa"), t - F.col("nb") + F.size("pb"))
    return both.where(F.size(F.array_intersect("pa", "pb")) >= need).select("a", "b")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b) of classes whose sets are similar; docs: id, t."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = staged(classes.select("rep", "id", "sig").join(broadcast_if(wanted, 1_000_000), "rep", "left_semi"), "candidates")

    def make(batches):
        seen: set[bytes] = set()
        for b in batches:
            sigs, sets = [], []
            for t in b.column("t").to_pylist():
                h = shingles(t, k)
                if (sig := signature(h)) not in seen:  # one of a task's copies will do
                    seen.add(sig)
                    sigs.append(sig)
                    sets.append(h)
            if len(seen) > 1 << 20:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), lists_of(sets)], ["sig", "held"])

    rows = docs.join(broadcast_if(wanted.where("id IS NOT NULL").select("id").distinct(), 1_000_000), "id", "left_semi")
    if not wanted.where("id IS NULL").isEmpty():  # classes of rows without a key: found among all such rows
        rows = rows.union(docs.where("id IS NULL"))
    made = text_batches(rows.select("t"), make, "sig binary, held array<bigint>").join(broadcast_if(wanted.select("sig", "rep"), 1_000_000), "sig")
    sets = staged(made.dropDuplicates(["rep"]).select("rep", "held"), "sets")
    one, two = sets.toDF("a", "x"), sets.toDF("b", "y")
    both = F.size(F.array_intersect("x", "y")).cast("long")
    union = F.size("x").cast("long") + F.size("y") - both
    found = staged(pairs.join(one, "a").join(two, "b").where((den * both >= num * union) & (union > 0)).select("a", "b").distinct(), "similar-pairs")
    discard(sets)
    return found


def one_key_links(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: links between the classes of rows that share a key."""
    own = sets.where("n > 0 AND id IS NOT NULL").select("id", "sig")
    shared = own.groupBy("id").agg(F.min("sig").alias("s1"), F.max("sig").alias("s2")).where("s1 < s2")
    more = staged(own.join(broadcast_if(staged(shared, "shared-keys"), 500_000), "id").select("s1", "sig").where("s1 < sig").distinct(), "one-key")
    if more.isEmpty():
        return more.selectExpr("0L AS a", "0L AS b")
    of = classes.select("sig", "rep")
    return more.join(of.toDF("s1", "a"), "s1").join(of.toDF("sig", "b"), "sig").select("a", "b")


def similar(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable by links) of every row."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    sets = staged(described(docs, "t", "id", k, num, den), "shingle-sets")
    alike = sets.where("n > 0").groupBy("sig").agg(F.min("id").alias("id"), F.first(F.struct("n", "prefix", "small")).alias("x"))
    # Numbered once: the table that is written is what all that follows reads.
    classes = staged(alike.select("sig", "id", "x.n", "x.prefix", "x.small", F.monotonically_increasing_id().alias("rep")), "shingle-classes")
    sizes = {r["n"]: r["c"] for r in classes.where(f"n <= {SMALL_MOST}").groupBy("n").agg(F.count("*").alias("c")).collect()}
    x = boundary(sizes, num, den)
    links = staged(small_links(classes, x, num, den).union(one_key_links(sets, classes)).select("a", "b"), "links-small")

    entries = classes.where(F.col("n") >= num * (x + 1) // den).select("rep", "id", "n", F.posexplode("prefix").alias("at", "h"))
    # Sizes and pivots of lists by partial aggregation, then a join that Spark can split: a hot list is in no one task.
    heads = entries.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    lists = staged(entries.join(heads, "h"), "lists")
    # A list's pivot is the set with the smallest key: what others are edited from mostly came before them.
    order = F.struct(F.col("id").isNull().alias("none"), "id", "rep", "n", "at")
    pivots = lists.groupBy("h").agg(F.min(order).alias("p")).select("h", F.col("p.rep").alias("a"), F.col("p.n").alias("na"), F.col("p.at").alias("ia"))
    first = lists.select("h", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib")).join(pivots, "h")
    first = first.where("a <> b").where(F.expr(may_meet("na", "ia", "nb", "ib", x, num, den)))
    # One pivot for each member: that with which it shares most lists.
    pairs = first.groupBy("a", "b").agg(F.count("*").alias("c")).groupBy("b").agg(F.max(F.struct("c", "a")).alias("m")).select(F.least("m.a", "b").alias("a"), F.greatest("m.a", "b").alias("b")).distinct()
    pairs = staged(plausible(pairs, classes, num, den), "pairs")
    tested = pairs
    # What is still open: first all pairs in short lists and the best of long ones, then all.
    for last in (False, True):
        links = links.union(verified(pairs, classes, docs, k, num, den))
        labels = staged(components(links), "components")
        now = lists.select("h", "rep", "n", "at", "m").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
        now = staged(now.drop("component"), "placed-lists")
        open_lists = now.groupBy("h").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select("h")
        lists = staged(now.join(open_lists, "h", "left_semi"), "open-lists")
        discard(now)
        # A set meets those that are no smaller: in its own size band or the next one, each as wide as sizes may differ.
        band = F.floor(F.log("n") / float(np.log(den / num) * (1 + 1e-9))) if num < den else F.col("n")
        placed = lists.select("h", "m", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("c").alias("cb"), band.cast("long").alias("band"))
        left = placed.select("h", F.col("b").alias("a"), F.col("nb").alias("na"), F.col("ib").alias("ia"), F.col("cb").alias("ca"), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
        met = left.join(placed, ["h", "band"]).where("(na < nb OR na = nb AND a < b) AND ca <> cb").where(F.expr(may_meet("na", "ia", "nb", "ib", x, num, den)))
        met = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("c"), F.min("m").alias("m"))
        if not last:
            met = staged(met, "open-pairs")
            some = met.where(F.col("m") <= SHORT_LIST).select("a", "b")
            for me, other in (("a", "b"), ("b", "a")):
                # Equally good partners are many: each seed takes another of them.
                tops = met.groupBy(me).agg(*[F.max(F.struct("c", F.xxhash64("a", "b", F.lit(seed)).alias("x"), other))[other].alias(f"p{seed}") for seed in range(PARTNERS)])
                some = some.union(tops.select(me, F.explode(F.array_distinct(F.array(*[f"p{seed}" for seed in range(PARTNERS)]))).alias(other)).select("a", "b"))
            met = some.distinct()
        else:
            met = met.select("a", "b")
        pairs = staged(plausible(met.join(tested, ["a", "b"], "left_anti"), classes, num, den), "pairs")
        tested = tested.union(pairs)
        lists = lists.drop("c")
    if not pairs.isEmpty():
        links = links.union(verified(pairs, classes, docs, k, num, den))
        labels = staged(components(links), "components")
    joined = classes.select("sig", "id", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "id", "component")
    # Classes by themselves keep their key; the others get the smallest of their component.
    least = joined.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("c"))
    alone = joined.where("component IS NULL").select("sig", F.col("id").alias("c"))
    named = joined.where("component IS NOT NULL").join(broadcast_if(staged(least, "smallest"), 1_000_000), "component").select("sig", "c").union(alone).withColumnRenamed("sig", "s")
    out = sets.select("id", "n", "sig").join(named, F.col("sig") == F.col("s"), "left")
    component = F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", **more) -> DataFrame:
    """The rows of docs, all columns, of one document of each component: that with the smallest key (rows of one key are one document).

    Rows without a set are nobody's copies and all stay, as do rows with null keys, which can't be told apart.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select([F.col(f"`{c}`").alias(x) for c, x in own.items()])
    found = similar(rows, own[text], own[key], **more).toDF("k", "n", "c")
    gone = found.where("n > 0").groupBy("k").agg(F.min("c").alias("c")).where("c <> k").select(F.col("k").alias("gone"))
    return rows.join(gone, rows[own[key]] == F.col("gone"), "left_anti").select([F.col(x).alias(c) for c, x in own.items()])
