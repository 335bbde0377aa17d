import random
import zlib

import numpy as np
import pytest

from wirespark.llm import token_counts, token_files
from wirespark.llm.common import new_path
from wirespark.llm.tokenizer_files import default_path

from .conftest import EDGES

PARTS = ["a", "s", "t", "re", "ve", "ll", "d", "m", "'", "'", " ", " ", "\n", "\t", "é", "中", "1", "٣", "!", "$", "<|endoftext|>", " ", " ", "²", "S", "\0"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def fuzz(n=4000):
    r = random.Random(5)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(40))) for _ in range(n)]


def test_counts_equal_the_library(library):
    texts = [*fuzz(), "", "x" * 3000, "-" * 2000, "it's I'll we've they're 'sx ''s", "😀" * 40]
    size, tokens = token_counts.count_texts(texts, default_path())
    assert tokens == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert size == [len(t.encode()) for t in texts]


def test_scan_does_not_depend_on_the_chunks(monkeypatch):
    texts = fuzz(300)
    whole = token_counts.count_texts(texts, default_path())
    for chunk in (1, 7, 1000):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        assert token_counts.count_texts(texts, default_path()) == whole


def test_tables_are_bounded(monkeypatch, library):
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    monkeypatch.setattr(token_counts, "MAX_BYTES", 4000)
    for t in fuzz(60):
        assert token_counts.count_texts([t], default_path())[1] == [len(library.encode(t, add_special_tokens=False).ids)]


def test_count_query(edges, nothing, library):
    got = token_counts.token_counts(edges, limit=100).collect()
    want = {(d, t): len(library.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in EDGES}
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(d), want[d, t]) for d, t, *_ in EDGES)
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.token_counts(nothing).count() == 0


def test_encoder_equals_the_library(library):
    own = token_files.Encoder(default_path())
    texts = [*fuzz(2000), None, ""]
    for i in range(0, len(texts), 100):
        ids, sizes = own.encode(texts[i : i + 100], 0)
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        assert [p.tolist() for p in parts] == [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts[i : i + 100]]


def test_distinct_pretokens_are_the_pretokens():
    texts = [*fuzz(400), "", "ß中😀 \u00a0 \u3000\u3000x \x1c\x1d y\x85", "\0\0 \0", "plain words only", "\ud800 half"]
    for some in (texts, ["plain", "", "words  only"], []):
        own = token_files.Splitter()
        words, which, ends = token_files.distinct_pretokens(own, some)
        want, stops = token_counts.pretokens(own, some)
        if some:
            assert [words[i].decode("utf-8", "surrogatepass") for i in which.tolist()] == want and ends.tolist() == stops.tolist()
        assert len(set(words)) == len(words)


def test_encoder_with_odd_white_space(library):
    own = token_files.Encoder(default_path())
    texts = ["a\u00a0\u00a0b", "\u3000\u3000", "p\n\u2003q", "r\n\u2003 s", " \x1c\x1d ", "x\n\n\ny", "\x85\x85z", "\r\n\t \u2003", "é\u2028è"]
    ids, sizes = own.encode(texts, 0)
    assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_texts_are_encoded_together_up_to_so_many_characters(monkeypatch):
    monkeypatch.setattr(token_files, "TOGETHER", 10)
    monkeypatch.setattr(token_files, "ROWS", 3)
    assert list(token_files.cuts([4, 4, 4, 25, 0, 0, 0, 0, 10])) == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 9)]
    assert list(token_files.cuts([])) == []


def test_token_files_round_trip(spark, edges, nothing, library):
    more = [(8, "one"), (8, None), (8, "two words"), (7, "")]
    docs = edges.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = sorted([*((d, t) for d, t, *_ in EDGES), *more], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = new_path(spark, "test-tokens")
    token_files.write_tokens(docs, at)
    got = token_files.digests(token_files.read_tokens(spark, at)).collect()
    start, want = 0, []
    for d, x in ((d, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in rows):
        want.append((d, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    key = lambda r: (r[1], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_files.read_tokens(spark, at, key_value=8).select("doc_id").collect() == [(8,)] * 4
    empty = new_path(spark, "test-tokens")
    token_files.write_tokens(nothing, empty)
    assert token_files.digests(spark.read.schema("doc_id long, ids array<int>, range_no int, row_no long").orc(empty)).count() == 0


def test_orc_has_indexes_and_bloom_filters(spark, edges):
    at = new_path(spark, "test-tokens")
    token_files.write_tokens(edges, at)
    file = next(f for f in spark.read.orc(at).inputFiles())
    jvm = spark._jvm
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    assert reader.getRowIndexStride() == 1000
    stripe = reader.getStripes().get(0)
    assert stripe.getIndexLength() > 0
