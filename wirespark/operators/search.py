"""Full-text search over postings tables.

`index` inverts whole documents a segment at a time: a row for each term of a segment, with the documents and places
where it stands, and a row without term for the segment's keys. They are stored as Parquet, a segment after the other, and
in a merged index sorted by term within hash buckets, so that a search reads few row groups. Queries are +required, -excluded and plain (optional) terms, phrases
in quotes and groups in parentheses of alternatives. All queries are answered together: the rows of their terms are
brought together by segment, and each segment is searched by itself, as no document lies in two.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: Bytes of text and documents of a segment at most; a longer document is a segment of its own.
SEGMENT_BYTES, SEGMENT_DOCS = 8 << 20, 100_000

#: Query terms up to which files can skip row groups by them; beyond, they are joined. Both are as large as the queries.
FILTER_TERMS = 1000

#: By byte: whether it is white space, as \s has it.
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))


@dataclass(frozen=True)
class Clause:
    """sign: + must, - must not, or '' may; options: alternatives, each a phrase of terms."""

    sign: str
    options: tuple[tuple[str, ...], ...]


ITEM = re.compile(r'([+-]?)(?:\(([^)]*)\)|"([^"]*)"|([^\s()"]+))')


def parse_query(text: str) -> list[Clause]:
    out = []
    for sign, group, phrase, term in ITEM.findall(text):
        if group:
            options = tuple(tuple(p.split()) if p else (t,) for p, t in re.findall(r'"([^"]*)"|([^\s"]+)', group))
        else:
            options = (tuple(phrase.split()) if phrase else (term,),)
        if options := tuple(o for o in options if o):
            out.append(Clause(sign, options))
    return out


def query_lines(text: str) -> list[str]:
    """The queries of a query file: a line each, trimmed, without blank ones."""
    return [q for line in text.splitlines() if (q := line.strip())]


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Texts and keys of successive documents, up to the bounds of a segment."""
    texts, keys, size, docs = [], [], 0, 0
    for b in batches:
        column = b.column(0).fill_null("").cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        at = 0
        while at < len(column):
            to = int(np.searchsorted(ends, ends[at] + SEGMENT_BYTES - size, "right")) - 1
            to = min(max(to, at if texts else at + 1), at + SEGMENT_DOCS - docs, len(column))
            if to > at:
                texts.append(column.slice(at, to - at))
                keys.append(b.column(1).slice(at, to - at))
                size, docs = size + int(ends[to] - ends[at]), docs + to - at
            if to < len(column):
                yield pa.concat_arrays(texts), pa.concat_arrays(keys)
                texts, keys, size, docs = [], [], 0, 0
            at = to
    if texts:
        yield pa.concat_arrays(texts), pa.concat_arrays(keys)


def invert(texts: pa.Array, keys: pa.Array) -> pa.RecordBatch:
    """The rows of a segment, in the order of their terms, the keys first."""
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    # The name comes from what is in it, so a task that runs again gives the same.
    name = hashlib.blake2b(data, digest_size=16)
    name.update(ends)
    name.update(repr(keys.to_pylist()).encode())
    word = ~SPACE[data]
    full = np.flatnonzero(ends[1:] > ends[:-1])
    before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[ends[full]] = after[ends[full + 1] - 1] = False
    starts, stops = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    lengths = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts, out=lengths[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(lengths), pa.py_buffer(data[word])]).dictionary_encode()
    doc = np.searchsorted(ends, starts, "right") - 1
    at = np.arange(len(doc)) - np.searchsorted(doc, np.arange(n))[doc]
    by_term = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(by_term), np.int64)
    rank[by_term] = np.arange(len(by_term))
    code = rank[words.indices.to_numpy(zero_copy_only=False)]
    order = np.sort(code << 32 | np.arange(len(code))) & 0xFFFFFFFF
    rows = len(words.dictionary) + 1
    to = np.zeros(rows + 1, np.int32)
    np.cumsum(np.bincount(code, minlength=rows - 1), out=to[2:])
    lists = lambda x: pa.ListArray.from_arrays(pa.array(to), pa.array(x[order].astype(np.int32)))
    own = pa.ListArray.from_arrays(pa.array(np.minimum(np.arange(rows + 1), 1) * n, pa.int32()), keys)
    terms = pa.concat_arrays([pa.nulls(1, pa.string()), words.dictionary.take(pa.array(by_term)).cast(pa.string())])
    return pa.RecordBatch.from_arrays([pa.array([name.digest()] * rows, pa.binary()), terms, lists(doc), lists(at), own], names=["segment", "term", "docs", "places", "keys"])


def index(docs: DataFrame, text: str, key: str) -> DataFrame:
    """segment, term, docs, places, keys: terms are runs without white space, as written; docs are numbers into keys."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("segment", T.BinaryType()), T.StructField("term", T.StringType()), T.StructField("docs", T.ArrayType(T.IntegerType())), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("keys", T.ArrayType(docs.schema[key].dataType))])
    return docs.select(F.col(text).cast("string").alias("text"), F.col(key).alias("key")).mapInArrow(lambda batches: (invert(*s) for s in segments(batches)), schema)


def write_index(postings: DataFrame, path: str, mode: str = "error") -> None:
    """Segments where they were made, each in the order of its terms, by which a search skips pages of the files.

    Zstandard, as an index and what it is merged to are on disk at once.
    """
    postings.write.mode(mode).option("compression", "zstd").parquet(path)


def merge_indexes(spark: SparkSession, paths: list[str], to: str) -> None:
    """One index of several, its rows dealt by term and sorted, so that a search reads few files and row groups.

    A term that is very frequent, as the keys' rows, is spread over files by AQE's rebalance.
    """
    write_index(spark.read.parquet(*paths).hint("rebalance", "term").sortWithinPartitions("term"), to)


def found(parsed: list[list[Clause]], rows: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """The numbers of a segment's documents that each query finds, by query; rows has the queries' terms and the keys."""
    terms, n, spots = rows.column("term").to_pylist(), 0, {}
    for i, term in enumerate(terms):
        docs, places = (rows.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("docs", "places"))
        if term is None:
            n = len(rows.column("keys")[i])
        else:
            spots[term] = docs.astype(np.int64) << 32 | places

    def has(phrase: tuple[str, ...]) -> np.ndarray:
        # A phrase occurs where all its terms stand in a row: their places less their numbers agree.
        mask = np.zeros(n, bool)
        if all(t in spots for t in phrase):
            starts = spots[phrase[0]]
            for i, t in enumerate(phrase[1:], 1):
                starts = np.intersect1d(starts, spots[t] - i, assume_unique=True)
            mask[starts >> 32] = True
        return mask

    for q, clauses in enumerate(parsed):
        by = lambda sign: [np.logical_or.reduce([has(o) for o in c.options]) for c in clauses if c.sign == sign]  # noqa: B023, E731
        musts = by("+")
        hit = np.logical_and.reduce(musts) if musts else np.logical_or.reduce([np.zeros(n, bool), *by("")])
        if hit.any() and (hit := np.logical_and.reduce([hit, *(~x for x in by("-"))])).any():
            yield q, np.flatnonzero(hit)


def search(postings: DataFrame, queries: list[str], key: str) -> DataFrame:
    """query_index, key: every document that each query finds, once."""
    spark = postings.sparkSession
    ship(spark)
    parsed = [parse_query(q) for q in queries]
    asked = sorted({t for clauses in parsed for c in clauses for o in c.options for t in o})
    if len(asked) <= FILTER_TERMS:
        hits = postings.where(F.col("term").isin(*asked) | F.col("term").isNull())
    else:
        wanted = F.broadcast(spark.createDataFrame([(t,) for t in [*asked, None]], "asked string"))
        hits = postings.join(wanted, F.col("term").eqNullSafe(F.col("asked")), "left_semi")
    kind = postings.schema["keys"].dataType.elementType

    def look(rows: pa.Table) -> pa.Table:
        at = rows.column("term").to_pylist().index(None)
        keys = rows.column("keys")[at].values
        got = [*found(parsed, rows)]
        numbers = np.repeat([q for q, _ in got], [len(d) for _, d in got]) if got else np.zeros(0)
        docs = np.concatenate([d for _, d in got]) if got else np.zeros(0)
        return pa.table({"query_index": pa.array(numbers.astype(np.int32)), key: keys.take(pa.array(docs.astype(np.int64)))})

    schema = T.StructType([T.StructField("query_index", T.IntegerType()), T.StructField(key, kind)])
    return hits.groupBy("segment").applyInArrow(look, schema).distinct()


def collect_all(postings: DataFrame, docs: DataFrame, queries: list[str], key: str) -> DataFrame:
    """query_index and the columns of docs, for every hit."""
    return search(postings, queries, key).join(docs, key).select("query_index", *docs.columns)


def count_hits(postings: DataFrame, queries: list[str], key: str) -> DataFrame:
    """query_index, hits: a row for each query, 0 included."""
    every = postings.sparkSession.range(len(queries)).select(F.col("id").cast("int").alias("query_index"))
    return every.join(search(postings, queries, key).groupBy("query_index").agg(F.count("*").alias("n")), "query_index", "left").select("query_index", F.coalesce("n", F.lit(0)).alias("hits"))


def ranked_terms(postings: DataFrame, n: int) -> DataFrame:
    """The n most frequent terms, ties in the order of the terms."""
    return postings.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("docs")).alias("n")).orderBy(F.desc("n"), "term").limit(n)
