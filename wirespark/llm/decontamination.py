"""Benchmark decontamination with suffix arrays of the training documents.

A shard is the words of some training documents, as numbers of the benchmark's vocabulary. A word outside it cannot be
part of a match, so only runs of known words are kept, each ended by a separator. The shard's suffix array is sorted
by prefix doubling; the benchmark's suffixes are binary-searched in it, all at once. Suffixes that begin with the same
window are one query, so the ranges of suffixes found for windows of one length are disjoint, and what is kept of a
shard is never more than its words, however often a text or a benchmark repeats itself.

Window: `window` consecutive words of an item; an item with fewer words, but at least one, is one window. A document's
word inside any occurrence of a window is hit.

The benchmark is the stated query set: it is sent to the workers in blocks of bounded size (`block_words`). A worker
reads each text once and takes block after block for a shard, with one block in memory at a time.

Defined results: a null or wordless text has no words, no hits and no items; a null or wordless item matches nothing;
repeated items with one id count once; a null item id is an id of its own, which counts as an item and adds nothing to
the list of names; repeated documents are judged alike, row by row; empty tables are fine. Other columns are ignored by
`scan`, and all kept by `decontaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: Words are runs of ASCII letters and digits and of all code points beyond ASCII; A-Z are lower-cased.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words of a shard, at least; one document may be longer.
SHARD_WORDS = 1 << 20
#: Item ids in an output batch, at least.
MOST_IDS = 200_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class Queries:
    """The suffixes of a block of items. Item words are numbered from 1; 0 separates."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        for _, ws in items:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        flat, item, left = [], [], []
        for k, (_, ws) in enumerate(items):
            flat += [self.vocabulary[w] for w in ws] + [0]
            item += [k] * (len(ws) + 1)
            left += [*range(len(ws), -1, -1)]
        self.ids = [i for i, _ in items]
        self.words, self.item = np.array(flat, np.int64), np.array(item, np.int64)
        self.left = np.array(left, np.int64)  # words from here to the item's end
        self.begin = np.flatnonzero(np.r_[True, self.item[1:] != self.item[:-1]]) if len(items) else self.item
        size = np.array([len(ws) for _, ws in items], np.int64)
        self.need = np.minimum(window, size)[self.item] if len(items) else self.left
        self.suffixes = np.flatnonzero(self.left > 0)
        self.shortest = int(self.need[self.suffixes].min()) if len(self.suffixes) else window
        self._windows(window)

    def _windows(self, window: int) -> None:
        """windows: a suffix for each different window; items_of[k]: the numbers of the items that have the k-th."""
        at = self.suffixes[self.left[self.suffixes] >= self.need[self.suffixes]]
        rank = np.zeros(len(at), np.int64)
        for i in range(-1, window):
            # Windows alike so far, told apart by their length first, then by one more word.
            word = self.need[at] if i < 0 else np.where(i < self.need[at], self.words[np.minimum(at + i, len(self.words) - 1)], 0)
            _, rank = np.unique(rank * (len(self.vocabulary) + window + 1) + word, return_inverse=True)
        _, first = np.unique(rank, return_index=True)
        self.windows = at[first]
        pairs = np.unique(rank * max(1, len(self.ids)) + self.item[at])
        which, item = np.divmod(pairs, max(1, len(self.ids)))
        self.items_at, self.items = np.searchsorted(which, np.arange(len(first) + 1)), item

    def items_of(self, windows: np.ndarray) -> list[int]:
        parts = [self.items[self.items_at[w] : self.items_at[w + 1]] for w in windows]
        return np.unique(np.concatenate(parts)).tolist()


class Prefixes:
    """Hashes of all prefixes of some words, by which equal stretches of any length are told at once."""

    PRIMES = (2147483629, 2147483587)
    BASES = (1103515245, 1664525027)

    def __init__(self, words: np.ndarray, most: int):
        self.most, self.power, self.sums = most, [], []
        for prime, base in zip(self.PRIMES, self.BASES):
            power = np.ones(1, np.uint64)
            while len(power) < most + 1:
                step = np.uint64(pow(base, len(power), prime))
                power = np.concatenate([power, power * step % np.uint64(prime)])
            self.power.append(power)
            self.sums.append(np.r_[np.zeros(1, np.uint64), np.cumsum(words.astype(np.uint64) * power[: len(words)] % np.uint64(prime))])

    def hashes(self, at: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        return [(s[at + n] - s[at]) % np.uint64(p) * w[self.most - at] % np.uint64(p) for s, w, p in zip(self.sums, self.power, self.PRIMES)]


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Prefix doubling: ranks by 2^k words, sorted until all differ. Ends are unlike one another, and sort first."""
    n = len(words)
    rank = words.copy()
    ends = np.flatnonzero(words == 0)
    rank[ends] = np.arange(len(ends)) - len(ends)
    gap = 1
    order = np.argsort(rank, kind="stable")
    while True:
        ordered = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])) if n else 0
        if n == 0 or new[order[-1]] == n - 1:
            return order
        second = np.zeros(n, np.int64)
        second[:-gap] = new[gap:] + 1 if gap < n else second[:-gap]
        rank = new * (n + 1) + second
        order = np.argsort(rank, kind="stable")
        gap *= 2


class Shard:
    def __init__(self, words: np.ndarray):
        """words: ends with a separator."""
        self.words, self.order = words, suffix_array(words)
        self._hashed: tuple[Prefixes, Prefixes] | None = None

    def common(self, q: Queries, at: np.ndarray, rows: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that the query suffixes at and the shard's suffixes rows have in common, up to most.

        A few are compared one by one; how far longer ones go on is found by halving, with hashes of 62 bits.
        """
        n = np.zeros(len(at), np.int64)
        live = np.flatnonzero(most > 0)
        for _ in range(16):
            a, b = at[live] + n[live], rows[live] + n[live]
            live = live[(q.words[a] == self.words[b]) & (q.words[a] != 0)]
            n[live] += 1
            live = live[n[live] < most[live]]
            if not len(live):
                return n
        if self._hashed is None:
            size = max(len(q.words), len(self.words))
            self._hashed = Prefixes(q.words, size), Prefixes(self.words, size)
        mine, own = self._hashed
        a, b = at[live], rows[live]
        low, high = n[live], np.minimum(most[live], len(self.words) - b)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = np.all([x == y for x, y in zip(mine.hashes(a, mid), own.hashes(b, mid))], axis=0)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        n[live] = low
        return n

    def bound(self, q: Queries, at: np.ndarray, most: np.ndarray, right: bool) -> np.ndarray:
        """Binary search: how many of the shard's suffixes are before (right: or begin with) the first `most` words from at."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.order), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            rows = self.order[mid]
            n = self.common(q, at[open_], rows, most[open_])
            same = n >= most[open_]
            a, b = q.words[at[open_] + np.minimum(n, most[open_] - 1)], self.words[rows + np.minimum(n, most[open_] - 1)]
            up = np.where(same, right, b < a)
            lo[open_[up]] = mid[up] + 1
            hi[open_[~up]] = mid[~up]
        return lo

    def longest(self, q: Queries) -> tuple[np.ndarray, np.ndarray]:
        """For every query suffix: the words of its longest verbatim match, and where in the shard one begins."""
        at, most = q.suffixes, q.left[q.suffixes]
        if not len(self.order):
            return np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        place = self.bound(q, at, most, False)
        above, below = self.order[np.maximum(place - 1, 0)], self.order[np.minimum(place, len(self.order) - 1)]
        a, b = self.common(q, at, above, most), self.common(q, at, below, most)
        return np.maximum(a, b), np.where(a > b, above, below)

    def ranges(self, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows that occur (numbers), and from where to where in the suffix array those that begin with each lie."""
        at, need = q.windows, q.need[q.windows]
        low = self.bound(q, at, need, False)
        there = np.flatnonzero(low < len(self.order))
        found = there[self.common(q, at[there], self.order[low[there]], need[there]) == need[there]]
        return found, low[found], self.bound(q, at[found], need[found], True)


def runs(q: Queries, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The words of a shard: runs of known words that are long enough for a window, with the place and document of each."""
    parts, doc, place = [], [], []
    for k, ids in enumerate(docs):
        known = np.flatnonzero(ids)
        if len(known) < q.shortest:
            continue
        cut = np.flatnonzero(np.diff(known) > 1) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(known)]])
        for a, b in zip(starts[ends - starts >= q.shortest], ends[ends - starts >= q.shortest]):
            run = known[a:b]
            parts += [ids[run], np.zeros(1, np.int64)]
            place += [run, np.array([-1])]
            doc.append(np.full(b - a + 1, k))
    return (np.concatenate(parts).astype(np.int64), np.concatenate(place), np.concatenate(doc)) if parts else None


def scan_shard(q: Queries, docs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document (numbers of its words): places of hit words, and the windows found."""
    nothing = np.zeros(0, np.int64)
    out: list[tuple[np.ndarray, np.ndarray]] = [(nothing, nothing)] * len(docs)
    if (found := runs(q, docs)) is None:
        return out
    words, place, doc = found
    shard = Shard(words)
    windows, low, high = shard.ranges(q)
    if not len(windows):
        return out
    # Hit words: the union of intervals, by counting where they open and close.
    steps, pairs = np.zeros(len(words) + 1, np.int64), []
    need = q.need[q.windows[windows]]
    for length in np.unique(need):
        # Ranges of windows of one length don't overlap: no more rows than the shard has words.
        mine = np.flatnonzero(need == length)
        n = high[mine] - low[mine]
        rows = np.repeat(low[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = shard.order[rows]
        steps[: len(words)] += np.bincount(at, minlength=len(words))
        steps += np.bincount(at + length, minlength=len(steps))[: len(steps)] * -1
        pairs.append(np.unique(doc[at] * len(q.windows) + np.repeat(windows[mine], n)))
    hit = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
    of, window = np.divmod(np.sort(np.concatenate(pairs)), len(q.windows))
    hit_doc = doc[hit]
    for k in np.unique(of):
        out[k] = place[hit[np.searchsorted(hit_doc, k) : np.searchsorted(hit_doc, k, "right")]], window[np.searchsorted(of, k) : np.searchsorted(of, k, "right")]
    return out


def item_blocks(benchmark: DataFrame, text: str, key: str, block_words: int):
    """Items with words, in blocks of about block_words; an item is read whole."""
    block, size = [], 0
    for r in benchmark.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("t IS NOT NULL").toLocalIterator():
        if ws := words_of(r["t"]):
            block.append((r["k"], ws))
            size += len(ws)
            if size >= block_words:
                yield block
                block, size = [], 0
    if block:
        yield block


def scanned_rows(docs: DataFrame, benchmark: DataFrame, text: str, item_text: str, item_key: str, window: int, block_words: int) -> DataFrame:
    """The rows of docs with columns c0, c1, ... in place of theirs, and n_words, hits, items. No shuffle."""
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index(text)]
    types = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields)]
    kinds = ", ".join([*types, "n_words bigint", "hits array<int>", "items array<string>"])
    out = docs.toDF(*names).select(*names, F.lit(None).cast("bigint").alias("n_words"), F.lit(None).cast("array<int>").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    sent = [spark.sparkContext.broadcast(Queries(block, window)) for block in item_blocks(benchmark, item_text, item_key, block_words)]
    return text_batches(out, lambda batches: _found(batches, sent, at), kinds)


def one_at_a_time(sent: list) -> Iterator[Queries]:
    """The blocks; a worker doesn't keep one when it takes the next, unless there is but one."""
    for s in sent:
        yield s.value
        if len(sent) > 1:
            s.__dict__.pop("_value", None)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", window: int = 8, block_words: int = 500_000) -> DataFrame:
    """key, n_words, hits (places of hit words, ascending), items (distinct ids of items with occurring windows)."""
    rows = scanned_rows(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), benchmark, "t", item_text, item_key, window, block_words)
    return rows.select(F.col("c0").alias(key), "n_words", "hits", "items")


def shards(batches, at: str):
    """Batches and their documents' words, gathered to shards of SHARD_WORDS or a little more."""
    held, docs, size = [], [], 0
    for b in batches:
        for t in b.column(at).to_pylist():
            docs.append(words_of(t))
            size += len(docs[-1])
        held.append(b)
        if size >= SHARD_WORDS:
            yield held, docs
            held, docs, size = [], [], 0
    if held:
        yield held, docs


def numbered(q: Queries, docs: list[list[bytes]]) -> list[np.ndarray]:
    get = q.vocabulary.get
    return [np.fromiter((get(w, 0) for w in ws), np.int32, len(ws)) for ws in docs]


def in_order(ids: set) -> tuple:
    return tuple(sorted(ids, key=lambda i: (i is None, i)))


def _found(batches, sent: list, at: str):
    for held, docs in shards(batches, at):
        hits: list = [None] * len(docs)
        items: list = [()] * len(docs)
        for q in one_at_a_time(sent):
            same: dict[bytes, tuple] = {}
            for k, (places, windows) in enumerate(scan_shard(q, numbered(q, docs))):
                if len(places):
                    hits[k] = places.astype(np.int32) if hits[k] is None else np.union1d(places, hits[k]).astype(np.int32)
                    # Documents with the same windows share one tuple of ids.
                    if (ids := same.get(key := windows.tobytes())) is None:
                        ids = same[key] = in_order({q.ids[i] for i in q.items_of(windows)})
                    items[k] = ids if not items[k] else in_order({*items[k], *ids})
        done = 0
        for b in held:
            first = 0
            while first < b.num_rows:
                last, size = first, 0
                while last < b.num_rows and size < MOST_IDS:
                    size += len(items[done + last])
                    last += 1
                part, mine = b.slice(first, last - first), slice(done + first, done + last)
                own = [part.column(i) for i in range(b.num_columns - 3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(list(map(len, docs[mine])), pa.int64()), pa.array(hits[mine], pa.list_(pa.int32())), pa.array([x or None for x in items[mine]], pa.list_(pa.string()))], b.schema.names)
                first = last
            done += b.num_rows


def longest_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", window: int = 8, block_words: int = 500_000) -> DataFrame:
    """item, at, words, key, place: the longest verbatim match of each benchmark suffix, if it has a window's words.

    The suffix of an item begins at its word `at`; the match is at the document's word `place`. Each shard names its
    longest match for each suffix; the longest of all shards is kept, of equals that with the smallest key and place.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    sent = [spark.sparkContext.broadcast(Queries(block, window)) for block in item_blocks(benchmark, item_text, item_key, block_words)]

    def run(batches):
        for held, docs in shards(batches, "t"):
            keys = pa.concat_arrays([b.column("k") for b in held])
            for q in one_at_a_time(sent):
                if (found := runs(q, numbered(q, docs))) is None:
                    continue
                words, place, doc = found
                length, where = Shard(words).longest(q)
                hit = np.flatnonzero(length >= q.need[q.suffixes])
                s = q.suffixes[hit]
                who = keys.take(pa.array(doc[where[hit]]))
                yield pa.RecordBatch.from_arrays([pa.array([q.ids[i] for i in q.item[s]], pa.string()), pa.array((s - q.begin[q.item[s]]).astype(np.int32)), pa.array(length[hit].astype(np.int32)), who, pa.array(place[where[hit]].astype(np.int32))], ["item", "at", "words", "k", "place"])

    out = text_batches(rows, run, f"item string, at int, words int, k {kind}, place int")
    best = out.groupBy("item", "at").agg(F.min(F.struct((-F.col("words")).alias("w"), "k", "place")).alias("m"))
    return best.select("item", "at", (-F.col("m.w")).alias("words"), F.col("m.k").alias(key), F.col("m.place").alias("place"))


def digest(scanned: DataFrame, key: str = "doc_id", least_items: int = 2) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated (least_items or more items)."""
    items = F.coalesce("items", F.array().cast("array<string>"))
    n = F.size(items).cast("long")
    return scanned.select(key, "n_words", F.when(F.col("hits").isNull(), F.lit(0)).otherwise(F.size("hits")).cast("long").alias("n_hit"), n.alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(items)), 256).alias("items_sha256"), (n >= least_items).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", window: int = 8, block_words: int = 500_000, least_items: int = 1) -> DataFrame:
    """The rows of docs, with all their columns, in which fewer than least_items items have an occurring window."""
    rows = scanned_rows(docs, benchmark, text, item_text, item_key, window, block_words)
    return rows.where(F.coalesce(F.size(F.coalesce("items", F.array().cast("array<string>"))), F.lit(0)) < least_items).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
