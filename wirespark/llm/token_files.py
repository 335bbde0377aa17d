"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on the document id.

`write_tokens` encodes texts and writes them in ascending key order: documents are dealt to key ranges and sorted
there, so a file holds a key range, part files are in key order, and a range's stripes can be read in parallel. The
ids column is ORC's run-length encoded integers; the key column has row indexes and a Bloom filter, with which a
reader given a key skips stripes and row groups (`read_tokens(..., key_value=...)`).

Ids come from the tokenizers library. A pre-token always encodes to the same ids, so a worker asks the library once
for each distinct pre-token it meets (a table of bounded bytes) and joins the answers. Texts with the string of a
special token go to the library whole. Pre-tokens are cut and made distinct as byte ranges of a batch's UTF-8, in Arrow;
only a batch's distinct ones become Python objects.

Defined results: a null text is empty (only the end id); null keys sort first; rows with equal keys are ordered by
their texts, repeated rows are all kept; an empty table gives empty files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, staged, text_batches
from .token_counts import NO_TABLE, Splitter
from .tokenizer_files import default_path

#: Bytes of the pre-tokens and ids that a worker remembers, about; what a pre-token takes besides its characters and ids.
MAX_BYTES, EACH = 200 << 20, 160
#: Characters and rows of the texts that are encoded together, about.
TOGETHER, ROWS = 1 << 20, 512
#: New pre-tokens that the library gets in one text.
LINES = 200
#: Bytes of the input (as the planner knows them) that go to one key range.
RANGE_BYTES = 256 << 20


def distinct_pretokens(splitter: Splitter, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct pre-tokens of texts; the number of each pre-token in turn; which of those are the texts' ends."""
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    stops = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64)) - 1
    codes[stops] = NO_TABLE
    starts = np.flatnonzero(splitter.begins(codes)[:-1])
    data = joined.encode("utf-8", "surrogatepass")
    if len(data) > len(codes):
        codes[stops] = 0
        size = 1 + (codes >= 0x80).astype(np.int32) + (codes >= 0x800) + (codes >= 0x10000)
        offsets = (np.cumsum(size, dtype=np.int64) - size)[starts]
    else:
        offsets = starts
    offsets = pa.py_buffer(np.append(offsets, len(data)).astype(np.int64))
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
    _, ends, each = found.dictionary.buffers()
    at, each = np.frombuffer(ends, np.int64)[: len(found.dictionary) + 1].tolist(), each.to_pybytes()
    return [each[a:b] for a, b in zip(at, at[1:])], found.indices.to_numpy(), np.searchsorted(starts, stops)


class Encoder:
    """Texts to ids. A known pre-token has a number; ids of number k are flat[first[k]:first[k] + length[k]]."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.splitter = Splitter()
        self.line_end = self.ids("\n")
        self.clear()

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.first, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.used = self.chars = 0
        self.add(b"", [0])  # number 0 stands for the end of a text

    def room(self, words: int, ids: int) -> int:
        """The first free number, with room for so many more words and ids."""
        k = len(self.known)
        if k + words > len(self.first):
            self.first, self.length = np.resize(self.first, 2 * (k + words)), np.resize(self.length, 2 * (k + words))
        if self.used + ids > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + ids))
        return k

    def add(self, word: bytes, ids: list[int]) -> None:
        k = self.room(1, len(ids))
        self.known[word] = k
        self.chars += len(word)
        self.first[k], self.length[k] = self.used, len(ids)
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def learn(self, words: list[bytes]) -> None:
        """Asks the library: words without white space but for a blank before them in one text, a line each."""
        alone = [w for w in words if b"\n" in w or w.isspace()]
        plain = [w for w in words if not (b"\n" in w or w.isspace())]
        # Decoded together; what else is white space (of Unicode) goes alone.
        lines = b"\n".join(plain).decode("utf-8", "surrogatepass").split("\n") if plain else []
        other = [k for k, t in enumerate(lines) if len(self.line_end) != 1 or t.isspace()]
        alone += [plain[k] for k in other]
        for k in reversed(other):
            del plain[k], lines[k]
        for w in alone:
            self.add(w, self.ids(w.decode("utf-8", "surrogatepass")))
        for i in range(0, len(plain), LINES):
            some, own = plain[i : i + LINES], lines[i : i + LINES]
            (got,) = self.tokenizer.encode_batch_fast(["\n".join(own) + "\n"], add_special_tokens=False)
            ids = np.array(got.ids, np.int32)
            ends = np.flatnonzero(ids == self.line_end[0])
            if len(ends) != len(some):
                for w, t in zip(some, own):
                    self.add(w, self.ids(t))
                continue
            starts = np.concatenate([[0], ends[:-1] + 1])
            k = self.room(len(some), len(ids))
            self.first[k : k + len(some)], self.length[k : k + len(some)] = self.used + starts, ends - starts
            self.flat[self.used : self.used + len(ids)] = ids
            self.known.update(zip(some, range(k, k + len(some))))
            self.chars += sum(map(len, some))
            self.used += len(ids)

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by end_id; and the length of each text's."""
        whole = {i: np.array([*self.ids(t), end_id], np.int32) for i, t in enumerate(texts) if t and any(s in t for s in self.special)}
        words, which, ends = distinct_pretokens(self.splitter, ["" if i in whole else t or "" for i, t in enumerate(texts)])
        if EACH * len(self.known) + self.chars + 4 * self.used > MAX_BYTES:
            self.clear()
        get = self.known.get
        own = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        if (new := np.flatnonzero(own < 0)).size:
            self.learn([words[i] for i in new.tolist()])
            get = self.known.__getitem__
            own[new] = [get(words[i]) for i in new.tolist()]
        numbers = own[which]
        numbers[ends] = 0
        length = self.length[numbers].astype(np.int64)
        until = np.cumsum(length)
        ids = self.flat[np.repeat(self.first[numbers] - until + length, length) + np.arange(until[-1] if len(until) else 0)]
        stops = until[ends]
        ids[stops - 1] = end_id
        sizes = np.diff(stops, prepend=0)
        if whole:
            parts = np.split(ids, stops[:-1])
            for i, x in whole.items():
                parts[i], sizes[i] = x, len(x)
            ids = np.concatenate(parts)
        return ids, sizes


def cuts(sizes: list[int]):
    """From and to of the texts that are encoded together: up to ROWS, and no more after TOGETHER characters."""
    i = n = 0
    for j, size in enumerate(sizes):
        if j > i and (n + size > TOGETHER or j - i == ROWS):
            yield i, j
            i, n = j, 0
        n += size
    if sizes:
        yield i, len(sizes)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, text: str, key: str, path: str, end_id: int) -> DataFrame:
    """key, ids with end_id appended. Rows keep their order and partition."""
    kind = docs.schema[key].dataType

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for b in batches:
            texts = b.column("t").to_pylist()
            for i, j in cuts([len(t or "") for t in texts]):
                ids, sizes = encoder(path).encode(texts[i:j], end_id)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays([b.column("k").slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], [key, "ids"])

    return text_batches(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"`{key}` {kind.simpleString()}, ids array<int>")


def write_tokens(docs: DataFrame, to: str, text: str = "text", key: str = "doc_id", path: str | None = None, end_id: int = 0, stripe_mb: int = 64) -> None:
    """Write ORC files under `to`. Ranges are split by key, so that a hot key alone can make a range large.

    Their number follows the input's size, and is the session's (which Spark lessens for small inputs) where that is enough.
    """
    path = path or default_path()
    rows, order = docs.select(F.col(key), F.col(text)), F.col(key).asc_nulls_first()
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1 << 62:  # not known to the planner
        size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = -(-size // RANGE_BYTES)
    enough = ranges <= int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.repartitionByRange(order) if enough else rows.repartitionByRange(ranges, order)).sortWithinPartitions(order, F.col(text).asc_nulls_first())
    rows = encoded(dealt, text, key, path, end_id).select(key, "ids", F.spark_partition_id().alias("range_no"), F.monotonically_increasing_id().alias("row_no"))
    (rows.write.option("compression", "snappy").option("orc.bloom.filter.columns", key).option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.row.index.stride", "1000").option("orc.stripe.size", str(stripe_mb << 20)).orc(to))


def read_tokens(spark, at: str, key: str = "doc_id", key_value=None) -> DataFrame:
    """key, ids, range_no, row_no (ascending within a range); with key_value only that key's rows, by way of the Bloom filters and indexes."""
    df = spark.read.orc(at)
    return df if key_value is None else df.where(F.col(key) == F.lit(key_value))


def digests(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start (ids before it), n_tokens, ids_crc32 (as little-endian unsigned 32-bit integers), from written files.

    Starts are running sums inside a range, added to the sums of the ranges before: one row a range for the latter.
    """
    kind = tokens.schema[key].dataType

    def run(batches):
        for b in batches:
            ids = b.column("ids")
            data = memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B")
            at = ids.offsets.to_numpy().astype(np.int64)
            crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("range_no"), b.column("row_no"), pa.array(np.diff(at)), pa.array(crc, pa.int64())], [key, "range_no", "row_no", "n_tokens", "ids_crc32"])

    sums = staged(text_batches(tokens.select(F.col(key).alias("k"), "range_no", "row_no", "ids"), run, f"`{key}` {kind.simpleString()}, range_no int, row_no long, n_tokens long, ids_crc32 long"), "token-sums")
    each = sums.groupBy("range_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    first = each.select("range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("range_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(broadcast_if(first, 1_000_000), "range_no").select(key, (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
