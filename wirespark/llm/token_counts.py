"""Token counts through finite-state transducers compiled from a byte-level BPE vocabulary (tokenizers .json files).

Two deterministic transducers stand for the tokenizer:

* `Splitter`: a table-driven automaton over classes of code points that marks where a pre-token begins. It is run the
  data-parallel way: a text is cut into equal chunks; each chunk's state map (every entry state -> exit state) is made
  for all chunks at once, the maps are composed by a parallel prefix scan, and with the entry states known all chunks
  are run once more to annotate their boundaries.
* `Merger`: an automaton over the bytes of a pre-token. A state is the longest suffix read that some token begins
  with, and the last token of the encoding of each prefix inside it. A transition carries the change of the number of
  tokens, so counts add up along a path. States are built when first reached and kept in a table of bounded size.

A prefix's encoding ends with the one suffix token that may follow the last token of what precedes it; two tokens may
be neighbours if merging their joined bytes gives back just the two. That makes the automaton exact.

Defined results: a null text counts as empty (0 bytes, 0 tokens). Rows are independent; repeated rows get equal
results, an empty table gives an empty one, other columns are ignored. Special tokens' strings in a text count as one
token, as the library does by default.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .tokenizer_files import default_path

#: Code points of a chunk of the parallel scan.
CHUNK = 128
#: Bounds of the tables that a worker keeps: states (a state holds less than the longest token), and bytes of the words
#: and their counts, about; what a word takes besides its characters.
MAX_STATES, MAX_BYTES, EACH = 400_000, 128 << 20, 160
# Classes of code points: letters that contractions are made of have their own.
LETTER, NUMBER, BLANK, SPACE, OTHER, QUOTE, END = range(7)
CONTRACTION = "stmdrevl"
CLASSES = 7 + len(CONTRACTION)
NO_TABLE = 0x110000


@lru_cache(1)
def class_table() -> np.ndarray:
    table = np.full(NO_TABLE + 1, OTHER, np.uint8)
    for cp in range(NO_TABLE):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    # White space of Unicode's property White_Space.
    for cp in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[cp] = SPACE
    table[32], table[39], table[NO_TABLE] = BLANK, QUOTE, END
    for i, ch in enumerate(CONTRACTION):
        table[ord(ch)] = 7 + i
    return table


class Splitter:
    """The automaton of 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space before white space or the end|white space.

    Reading a code point marks whether a pre-token begins at it (1), or one code point before it (2): the latter
    because the last of several white space characters goes with what follows if it is a blank, and stands alone else.
    """

    START, LETTERS, NUMBERS, OTHERS, BLANK1, SPACE1, BLANKS, SPACES, QUOTE1, DONE, TWO_R, TWO_V, TWO_L, QUOTE_B = range(14)
    STATES = 14
    # TWO_*: a quote and the first letter of a two-letter contraction; DONE: a contraction ended.

    def __init__(self):
        self.next = np.zeros((self.STATES, CLASSES), np.uint8)
        self.mark = np.zeros((self.STATES, CLASSES), np.uint8)
        for s in range(self.STATES):
            for c in range(CLASSES):
                self.next[s, c], self.mark[s, c] = self.step(s, c)

    def step(self, s: int, c: int) -> tuple[int, int]:
        ch = CONTRACTION[c - 7] if c >= 7 else ""
        letter = c == LETTER or bool(ch)
        if c == END:
            return self.START, 1
        if s in (self.TWO_R, self.TWO_V, self.TWO_L) and ch == {self.TWO_R: "e", self.TWO_V: "e", self.TWO_L: "l"}[s]:
            return self.DONE, 0
        if s in (self.TWO_R, self.TWO_V, self.TWO_L):
            # The quote stood alone after all: a pre-token began at the letter before this code point.
            if letter:
                return self.LETTERS, 2
            return self.fresh(c, ch)[0], 3
        if s == self.QUOTE1 and ch and ch in "stmd":
            return self.DONE, 0
        if s == self.QUOTE1 and ch and ch in "rvl":
            return {"r": self.TWO_R, "v": self.TWO_V, "l": self.TWO_L}[ch], 0
        if s in (self.QUOTE1, self.QUOTE_B):
            if c in (OTHER, QUOTE):
                return self.OTHERS, 0
            return self.fresh(c, ch)
        if s == self.LETTERS and letter or s == self.NUMBERS and c == NUMBER or s == self.OTHERS and c in (OTHER, QUOTE):
            return s, 0
        if s in (self.BLANK1, self.BLANKS):  # the last white space is a blank
            alone = s == self.BLANK1
            if c in (BLANK, SPACE):
                return (self.BLANKS if c == BLANK else self.SPACES), 0
            to = self.LETTERS if letter else self.NUMBERS if c == NUMBER else self.OTHERS
            return to, 0 if alone else 2
        if s in (self.SPACE1, self.SPACES):
            alone = s == self.SPACE1
            if c in (BLANK, SPACE):
                return (self.BLANKS if c == BLANK else self.SPACES), 0
            return self.fresh(c, ch)[0], 1 if alone else 3
        return self.fresh(c, ch)

    def fresh(self, c: int, ch: str) -> tuple[int, int]:
        """A pre-token begins here."""
        if c == LETTER or ch:
            return self.LETTERS, 1
        return {NUMBER: self.NUMBERS, BLANK: self.BLANK1, SPACE: self.SPACE1, OTHER: self.OTHERS, QUOTE: self.QUOTE1}[c], 1

    def begins(self, codes: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin (boolean, one longer than codes); NO_TABLE ends a text."""
        n = len(codes)
        rows = max(1, -(-n // CHUNK))
        classes = np.full(rows * CHUNK, END, np.uint8)
        classes[:n] = class_table()[codes]
        columns = np.ascontiguousarray(classes.reshape(rows, CHUNK).T).astype(np.intp)
        flat = self.next.ravel().astype(np.intp)
        # State maps of all chunks: entry state -> exit state.
        maps = np.repeat(np.arange(self.STATES, dtype=np.intp)[:, None], rows, axis=1)
        at = 0
        while at < CHUNK and (maps != maps[:1]).any():
            maps = flat[maps * CLASSES + columns[at]]
            at += 1
        one = maps[0]
        for k in range(at, CHUNK):  # all entry states have met in every chunk
            one = flat[one * CLASSES + columns[k]]
        maps = np.broadcast_to(one, maps.shape).copy() if at < CHUNK else maps
        # Inclusive prefix scan of function composition.
        gap = 1
        while gap < rows:
            later = maps.copy()
            later[:, gap:] = maps[maps[:, :-gap], np.arange(gap, rows)[None, :]]
            maps, gap = later, gap * 2
        state = np.concatenate([[self.START], maps[self.START, :-1]]).astype(np.intp)
        marks = np.empty((CHUNK, rows), np.uint8)
        seen = self.mark.ravel()
        for k in range(CHUNK):
            here = state * CLASSES + columns[k]
            marks[k] = seen[here]
            state = flat[here]
        marks = marks.T.ravel()[: n + 1]
        out = np.zeros(n + 1, bool)
        out[: len(marks)] = marks & 1
        out[: len(marks) - 1] |= (marks[1:] & 2) > 0
        out[0] = n > 0
        return out


class Merger:
    """The automaton over the bytes of a pre-token; count() runs it and sums what its transitions emit."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in model["added_tokens"] if not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])]
        if len(self.special) != len(model["added_tokens"]) or model["normalizer"] or model["pre_tokenizer"]["type"] != "ByteLevel" or model["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only plain byte-level BPE files are compiled")
        back = byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.rank = {tuple(bytes(back[c] for c in x) for x in m): i for i, m in enumerate(merges)}
        self.tokens = {bytes((i,)) for i in range(256)} | {a + b for a, b in self.rank}
        self.prefixes = {t[:k] for t in self.tokens for k in range(1, len(t) + 1)}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.own: dict[bytes, bool] = {}
        self.words: dict[str, int] = {}
        self.chars = 0
        self.clear()

    def clear(self) -> None:
        #: By number: the suffix held; for each of its prefixes of 0, 1, ... bytes, the last token of the encoding up
        #: to there and the number of tokens less that at the end.
        self.states = [(b"", ((b"", 0),))]
        self.numbers = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def merged(self, data: bytes) -> list[bytes]:
        """Plain BPE by rank; only used on one or two tokens when a transition is compiled."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 60:
                break
            pair = parts[best[1]], parts[best[1] + 1]
            i, out = 0, []
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def neighbours(self, a: bytes, b: bytes) -> bool:
        if (got := self.pairs.get((a, b))) is None:
            if len(self.pairs) > MAX_STATES:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return got

    def whole(self, t: bytes) -> bool:
        if (got := self.own.get(t)) is None:
            got = self.own[t] = self.merged(t) == [t]
        return got

    def compile(self, number: int, byte: int) -> tuple[int, int]:
        held, known = self.states[number]
        text = held + bytes((byte,))
        for i in range(len(text)):  # suffixes, the longest first
            token = text[i:]
            if token in self.tokens and self.whole(token):
                before, less = known[i]
                if not before or self.neighbours(before, token):
                    break
        else:
            raise AssertionError("single bytes are tokens")
        change = less + 1
        keep = next((i for i in range(len(text)) if text[i:] in self.prefixes), len(text))
        state = text[keep:], tuple((t, n - change) for t, n in known[keep:]) + ((token, 0),)
        if (to := self.numbers.get(state)) is None:
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        self.moves[number][byte] = to, change
        return to, change

    def count(self, word: str) -> int:
        at = total = 0
        moves = self.moves
        for byte in word.encode("utf-8", "surrogatepass"):
            move = moves[at].get(byte) or self.compile(at, byte)
            at, change = move
            total += change
        return total

    def counts(self, words: list[str]) -> np.ndarray:
        known = self.words
        if EACH * len(known) + self.chars > MAX_BYTES:
            known.clear()
            self.chars = 0
        if len(self.states) > MAX_STATES:
            self.clear()
        for w in set(words) - known.keys():
            known[w] = self.count(w)
            self.chars += len(w)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def compiled(path: str) -> tuple[Splitter, Merger]:
    return Splitter(), Merger(path)


def pretokens(splitter: Splitter, pieces: list[str]) -> tuple[list[str], np.ndarray]:
    """The pre-tokens of all pieces, each piece followed by an end, and where in that list the ends are."""
    end = np.array([NO_TABLE], np.uint32)
    codes = np.concatenate([x for p in pieces for x in (np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32), end)] or [end])
    starts = np.flatnonzero(splitter.begins(codes)[:-1])
    at = starts.tolist()
    joined = "\0".join(pieces) + "\0"  # code points stand where they do in codes
    words = [joined[a:b] for a, b in zip(at, at[1:] + [len(codes)])]
    return words, np.searchsorted(starts, np.cumsum([len(p) + 1 for p in pieces]) - 1 if pieces else np.zeros(0, np.int64))


def count_texts(texts: list[str | None], path: str) -> tuple[list[int], list[int]]:
    """Bytes and tokens of each text; all of them go through one scan, each ended by NO_TABLE."""
    splitter, merger = compiled(path)
    special = re.compile("|".join(map(re.escape, sorted(merger.special, key=len, reverse=True)))) if merger.special else None
    pieces, owner, extra = [], [], [0] * len(texts)
    for i, t in enumerate(texts):
        parts = special.split(t) if t and special and any(s in t for s in merger.special) else [t or ""]
        extra[i] = len(parts) - 1
        pieces += parts
        owner += [i] * len(parts)
    words, ends = pretokens(splitter, pieces)
    counts = merger.counts(words)
    counts[ends] = 0  # the ends are no words
    until = np.concatenate([[0], np.cumsum(counts)])[ends]
    tokens = list(extra)
    before = 0
    for i, n in zip(owner, until.tolist()):
        tokens[i] += n - before
        before = n
    return [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], tokens


def token_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, limit: int = 512) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (more than limit tokens) of every row. path must be readable on every machine."""
    path = path or default_path()
    kind = docs.schema[key].dataType

    def run(batches):
        for b in batches:
            texts = b.column("t").to_pylist()
            for i in range(0, len(texts), 64):
                size, tokens = count_texts(texts[i : i + 64], path)
                yield pa.RecordBatch.from_arrays([b.column("k").slice(i, 64), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], [key, "n_bytes", "n_tokens", "over_limit"])

    return text_batches(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"`{key}` {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
