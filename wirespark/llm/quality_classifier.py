"""Quality classifier: an interpolated modified Kneser-Ney model of characters' 5-grams, trained on trusted text.

Grams are strings of up to `ORDER` characters of any script, nothing is folded or sampled; START stands before a text and
END after it. All grams of the trusted texts are counted into tables that grow with them, order by order, by partial
aggregation and joins. A share of the trusted texts (`held`, by a hash of the text) isn't learnt from: what a new text
may have is read from those, since a model knows its own texts by heart.

An interpolated model is a sum of logs: log P(c | context) = base + the sum, over the grams of every order that end at
c, of how each changes the probability and, over those before c, of the weight that it leaves to the next lower order;
what wasn't seen adds 0. So the model is one table of gram and value, and a text's score is a sum of values.

Texts are dealt to chunks of about CHUNK characters, each different text once. A chunk hands over its distinct grams
(far fewer than its characters, so this is the combining before the shuffle), they meet the table in a sharded join by
gram, and the values found go back to the chunk, where the texts are summed. Chunks are taken in `slices`, so that the
shared disks hold the shuffles of one slice at a time. Values are whole millionths: sums don't depend on their order.

A document's perplexity (a character) is compared with its language's threshold: the `quantile` of the held-out trusted
ones in that language, raised by `slack` times its distance to their median (log scale). Quantiles come from counts of
logs in whole thousandths, which merge in any order and are the same in every run. Texts are taken as if `prior` more
characters of the median followed, so that a few characters alone don't reject one. Languages without held-out trusted
documents use the threshold of all of them; if there are none at all, that of the learnt ones.

Defined results: a null or empty text has no perplexity (null) and is rejected. Without any trusted text nothing can be
judged, and all texts with characters are kept. A null language is a language of its own. Rows are judged one by one;
repeated rows alike; empty tables give empty results. A null key is never trusted. A text's own U+FFFF and U+FFFE count
as START and END. Texts and grams are told apart by 64-bit hashes. Other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, staged, text_batches

ORDER = 5
START, END = "￿", "￾"
#: Log values are kept in whole numbers of this fraction.
UNIT = 1_000_000
#: Logs of perplexities are counted in whole numbers of this fraction.
FINE = 1000
#: Characters of a chunk, about; characters looked at together; keys that a worker gathers before it hands them over.
CHUNK, BLOCK, GATHERED = 8 << 20, 1 << 20, 1 << 21
#: Code points that a new character may be, with END.
CODE_POINTS = 0x110000
#: Rows that are broadcast at most, of two or three numbers each.
SMALL = 1_000_000


def discounts_of(*often: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney's discounts for counts of 1, 2, and 3 or more, from how many counts are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (max(1, n) for n in often)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def keys_by_place(columns: list[np.ndarray]) -> np.ndarray:
    """uint64 keys of grams. columns: the codes of their first places, second places, and so on."""
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h ^= c
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def keys_of(codes: np.ndarray, n: int) -> np.ndarray:
    """uint64 keys of the grams of n codes that begin at each place."""
    return keys_by_place([codes[i : len(codes) - n + 1 + i] for i in range(n)])


def distinct(keys: np.ndarray) -> np.ndarray:
    """The different keys in ascending order; numpy sorts them several times faster than its unique takes."""
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=~keys[:1]) != 0]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def keys_of_grams(grams: list[str]) -> np.ndarray:
    """uint64 keys of grams of any lengths."""
    size, out = np.fromiter(map(len, grams), np.int64, len(grams)), np.zeros(len(grams), np.uint64)
    for n in set(size.tolist()):
        at = np.flatnonzero(size == n)
        codes = codes_of("".join([grams[i] for i in at.tolist()])).reshape(-1, n)
        out[at] = keys_by_place([codes[:, i] for i in range(n)])
    return out


def padded(text: str) -> str:
    return START * (ORDER - 1) + text + END


class Block:
    """Texts, or a piece of one, that are looked at together: their distinct windows of ORDER characters."""

    def __init__(self, pieces: list[str]):
        """Every piece but the last of a text overlaps the next one by ORDER - 1 characters."""
        self.text = "".join(pieces)
        self.codes = codes_of(self.text)
        ends = np.cumsum([len(p) for p in pieces])
        self.starts = np.r_[0, ends[:-1]]
        inside = np.ones(len(self.codes), bool)
        for i in range(1, ORDER):
            inside[ends - i] = False
        at = np.flatnonzero(inside)
        # Numbered in the order of their first places; a hash table is faster here than sorting.
        self.which = pa.array(keys_of(self.codes, ORDER)[at]).dictionary_encode().indices.to_numpy()
        first = np.zeros(int(self.which.max()) + 1, np.int64)
        first[self.which[::-1]] = at[::-1]
        self.first = first
        self.windows = self.starts - (ORDER - 1) * np.arange(len(pieces))  # each piece's first; it has one at least

    def keys(self) -> list[np.ndarray]:
        """For the distinct windows: keys of the grams of 1 to ORDER characters that end them."""
        columns = [self.codes[self.first + i] for i in range(ORDER)]
        return [keys_by_place(columns[ORDER - n :]) for n in range(1, ORDER + 1)]

    def sums(self, values) -> np.ndarray:
        """For each piece: the sum of the values (a function of keys) of all grams that end in it."""
        total = values(np.concatenate(self.keys())).reshape(ORDER, -1).sum(axis=0)
        return np.add.reduceat(total[self.which], self.windows)


def blocks(texts: list[str]):
    """Blocks of about BLOCK characters with, for each piece, the number of its text."""
    pieces, of, size = [], [], 0
    for k, t in enumerate(texts):
        t = padded(t)
        for i in range(0, len(t) - ORDER + 1, BLOCK):
            pieces.append(t[i : i + BLOCK + ORDER - 1])
            of.append(k)
            size += len(pieces[-1])
            if size >= BLOCK:
                yield Block(pieces), of
                pieces, of, size = [], [], 0
    if pieces:
        yield Block(pieces), of


def edge_keys() -> np.ndarray:
    """Keys of the grams of STARTs alone, which every text has before its first character."""
    codes = codes_of(START * (ORDER - 1))
    return np.array([keys_of(codes[:n], n)[0] for n in range(1, ORDER)], np.uint64)


def count_grams(texts: DataFrame, text: str) -> DataFrame:
    """gram string (of ORDER characters), n long: summed over all rows."""

    def run(batches):
        held: dict[str, int] = {}
        for b in batches:
            for block, _ in blocks([t for t in b.column("t").to_pylist() if t]):
                n = np.bincount(block.which)
                for i, m in zip(block.first.tolist(), n.tolist()):
                    g = block.text[i : i + ORDER]
                    held[g] = held.get(g, 0) + m
            if len(held) > GATHERED:
                yield from handed(held)
                held = {}
        yield from handed(held)

    def handed(held):
        grams, n = list(held), list(held.values())
        for i in range(0, len(grams), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(grams[i : i + 50_000], pa.string()), pa.array(n[i : i + 50_000], pa.int64())], ["gram", "n"])

    each = text_batches(texts.select(F.col(text).alias("t")), run, "gram string, n long")
    return each.groupBy("gram").agg(F.sum("n").alias("n"))


def _log(x) -> Column:
    return F.round(F.log(x) * UNIT).cast("long")


def train(trusted: DataFrame, text: str = "text") -> "Model | None":
    """The model of all texts of trusted; None without any."""
    level = staged(count_grams(trusted, text), "grams")
    if level.isEmpty():
        return None
    counts = level.select(F.lit(ORDER).alias("order"), "gram", "n")
    for n in range(ORDER - 1, 0, -1):
        # What counts in a lower order is how many different characters stand before.
        level = level.groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("n"))
        counts = counts.union(level.select(F.lit(n), "gram", "n"))
    counts = staged(counts, "grams")
    often = {r["order"]: r for r in counts.groupBy("order").agg(F.sum("n").alias("sum"), F.count("*").alias("all"), *[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()}
    cuts = {k: discounts_of(*(r[f"n{i}"] for i in (1, 2, 3, 4))) for k, r in often.items()}
    d = [F.coalesce(*[F.when(F.col("order") == k, cut[i]) for k, cut in cuts.items()]) for i in range(3)]
    least = often[1]
    left = cuts[1][0] * least["n1"] + cuts[1][1] * least["n2"] + cuts[1][2] * (least["all"] - least["n1"] - least["n2"])
    unseen = left / least["sum"] / CODE_POINTS
    base = round(float(np.log(unseen)) * UNIT)
    # Whole numbers of grams with each discount: the sum doesn't depend on their order.
    freed = F.count_if(F.col("n") == 1) * d[0] + F.count_if(F.col("n") == 2) * d[1] + F.count_if(F.col("n") >= 3) * d[2]
    contexts = counts.where("order > 1").groupBy("order", F.expr("substring(gram, 1, order - 1)").alias("context")).agg(F.sum("n").alias("total"), freed.alias("left"))
    contexts = staged(contexts.select("order", "context", "total", (F.col("left") / F.col("total")).alias("gamma")), "contexts")
    cut = F.when(F.col("n") >= 3, d[2]).when(F.col("n") == 2, d[1]).otherwise(d[0])
    rows = counts.select("order", "gram", "n", cut.alias("cut"))
    p = (F.col("n") - F.col("cut")) / least["sum"] + unseen
    lower = staged(rows.where("order = 1").select("gram", p.alias("p"), (_log(p) - base).alias("v")), "p")
    every = lower.select("gram", "v").union(contexts.select("context", _log("gamma")))
    p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("gamma") * F.col("p0")
    for n in range(2, ORDER + 1):
        own = rows.where(F.col("order") == n).withColumn("context", F.substring("gram", 1, n - 1)).withColumn("rest", F.substring("gram", 2, n - 1))
        met = own.join(contexts.where(F.col("order") == n).drop("order"), "context").join(lower.select(F.col("gram").alias("rest"), F.col("p").alias("p0")), "rest")
        lower = staged(met.select("gram", p.alias("p"), _log(p / F.col("gamma") / F.col("p0")).alias("v")), "p")
        every = every.union(lower.select("gram", "v"))

    def keyed(grams: pa.Array) -> pa.Array:
        return pa.array(keys_of_grams(grams.to_pylist()).view(np.int64))

    keyed.__annotations__ = {"grams": pa.Array, "return": pa.Array}
    every = every.groupBy("gram").agg(F.sum("v").cast("int").alias("v"))
    return Model(staged(every.select(F.arrow_udf(keyed, "long")("gram").alias("g"), "v"), "values"), base)


class Model:
    """values: g long (key of a gram), v int (log, in UNITs); base: what any character has without them."""

    def __init__(self, values: DataFrame, base: int):
        self.values, self.base = values, base

    def scores(self, texts: DataFrame, text: str = "text", slices: int = 4) -> DataFrame:
        """k long (xxhash64 of the text), perplexity double (a character), of the texts that have characters."""
        rows = texts.where(F.length(text) > 0).select(F.xxhash64(text).alias("k"), F.col(text).alias("t"))
        size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
        slices = max(1, min(slices, -(-size // CHUNK)))
        chunks = max(1, -(-size // (slices * CHUNK)))
        got = None
        for i in range(slices):
            mine = rows.where(F.pmod("k", F.lit(slices)) == i).withColumn("chunk", F.pmod(F.floor(F.col("k") / slices), F.lit(chunks)).cast("int"))
            done = staged(self._scored(once_a_task(mine).repartition(chunks, "chunk")), "perplexity")
            got = done if got is None else got.union(done)
            # What this slice shuffled is deleted when the JVM notices that nothing refers to it.
            texts.sparkSession._jvm.System.gc()
        return got

    def _scored(self, dealt: DataFrame) -> DataFrame:
        base = self.base

        def asked(batches):
            held: dict[int, list[np.ndarray]] = {}
            for b in batches:
                by: dict[int, list[str]] = {}
                for t, c in zip(b.column("t").to_pylist(), b.column("chunk").to_pylist()):
                    by.setdefault(c, []).append(t)
                for c, texts in by.items():
                    for block, _ in blocks(texts):
                        held.setdefault(c, []).append(distinct(np.concatenate(block.keys())))
                        if sum(map(len, held[c])) > GATHERED:
                            held[c] = [distinct(np.concatenate(held[c]))]
                            if len(held[c][0]) > GATHERED // 2:
                                yield from handed(c, held.pop(c)[0])
            for c, parts in held.items():
                yield from handed(c, distinct(np.concatenate([*parts, edge_keys()])))

        def handed(c, keys):
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), c, np.int32))], ["g", "chunk"])

        def summed(texts: pa.Table, answers: pa.Table) -> pa.Table:
            g = answers.column("g").to_numpy().view(np.uint64)
            order = np.argsort(g)
            g = g[order]
            new = np.diff(g, prepend=~g[:1]) != 0  # what several tasks asked for came several times
            g, v = g[new], np.r_[answers.column("v").to_numpy()[order][new].astype(np.int64), 0]

            def values(keys: np.ndarray) -> np.ndarray:
                if not len(g):
                    return np.zeros(len(keys), np.int64)
                order = np.argsort(keys)  # neighbours are looked up one after the other
                keys = keys[order]
                at = np.searchsorted(g, keys)
                out = np.empty(len(keys), np.int64)
                out[order] = v[np.where(g[np.minimum(at, len(g) - 1)] == keys, at, len(g))]
                return out

            edge = int(values(edge_keys()).sum())
            keys, logs, seen = [], [], set()
            for b in texts.to_batches(max_chunksize=512):
                own, whole = [], []
                for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist()):
                    if k not in seen:
                        seen.add(k)
                        own.append(k)
                        whole.append(t)
                total = np.zeros(len(whole), np.int64)
                for block, of in blocks(whole):
                    np.add.at(total, of, block.sums(values))
                n = np.array([len(t) + 1 for t in whole], np.int64)
                keys += own
                logs.append((total + edge + base * n) / (n * float(UNIT)) if len(n) else np.zeros(0))
            return pa.table({"k": pa.array(keys, pa.int64()), "perplexity": np.exp(-np.concatenate(logs)) if logs else pa.array([], pa.float64())})

        asked_for = text_batches(dealt, asked, "g long, chunk int")
        answers = asked_for.join(self.values, "g").select("g", "chunk", "v")
        return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(summed, "k long, perplexity double")


def once_a_task(rows: DataFrame) -> DataFrame:
    """rows (k, t, chunk) without those whose k the task had before: copies, of which there may be very many."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            new = [i for i, k in enumerate(b.column("k").to_pylist()) if not (k in seen or seen.add(k))]
            if len(seen) > GATHERED:
                seen.clear()
            yield b.take(pa.array(new, pa.int32()))

    return text_batches(rows, run, rows.schema)


def quantiles(df: DataFrame, keys: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """keys and, by name, the least x (a log; in whole FINEs) that at least such a share of the keys' rows don't exceed.

    Rows are counted by keys and x, partly in every task. What is then sorted is one row for each different x of a
    language, of which there are at most some tens of thousands.
    """
    n = df.groupBy(*keys, F.round(F.col(x) * FINE).cast("long").alias("x")).agg(F.count("*").alias("n"))
    own = Window.partitionBy(*keys)
    n = n.withColumn("below", F.sum("n").over(own.orderBy("x"))).withColumn("all", F.sum("n").over(own))
    return n.groupBy(*keys).agg(*[(F.min(F.when(F.col("below") >= F.col("all") * share, F.col("x"))) / FINE).alias(name) for name, share in shares.items()])


def settled(x: Column, n: Column, middle: Column, prior: int) -> Column:
    """Log perplexity with `prior` more characters of the language's middle: short texts tell little."""
    return (x * n + middle * prior) / (n + prior)


def thresholds(own: DataFrame, quantile: float, slack: float, prior: int) -> DataFrame:
    """lang, whole, middle, least (logs) from (lang, n, perplexity) of trusted documents; where whole, over all languages."""
    own = own.withColumn("x", F.log("perplexity")).withColumn("whole", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("lang", F.when(~F.col("whole"), F.col("lang")))
    middle = staged(quantiles(own, ["lang", "whole"], "x", {"middle": 0.5}), "medians").toDF("l", "w", "middle")
    same = F.col("lang").eqNullSafe(F.col("l")) & (F.col("whole") == F.col("w"))
    middles = broadcast_if(middle, 5000)
    near = own.join(middles, same).withColumn("y", settled(F.col("x"), F.col("n"), F.col("middle"), prior))
    both = quantiles(near, ["lang", "whole"], "y", {"high": quantile}).join(middles, same)
    return both.select("lang", "whole", "middle", (F.col("high") + slack * (F.col("high") - F.col("middle"))).alias("least"))


def classified(docs: DataFrame, trusted_keys: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", quantile: float = 0.995, slack: float = 0.25, prior: int = 20, held: int = 4, slices: int = 4, names: tuple[str, str, str] = ("__perplexity", "__threshold", "__kept")) -> DataFrame:
    """docs with perplexity, threshold (what it may be for a text of that length) and kept, under `names`.

    trusted_keys: one column, the keys of trusted documents; broadcast if there are at most SMALL, else joined by a
    shuffle. One trusted text of `held` is held out. Columns of docs that have one of `names` are replaced.
    """
    columns = [c for c in docs.columns if c not in names]
    own = {c: f"c{i}" for i, c in enumerate(columns)}
    docs = docs.select([F.col(f"`{c}`").alias(x) for c, x in own.items()])
    text, key, lang = own[text], own[key], own[lang]
    chars = F.length(text)
    keys = trusted_keys.toDF("trusted").distinct()
    trusted = docs.select(key, text, lang).join(broadcast_if(keys, SMALL), F.col(key) == F.col("trusted"), "left_semi")
    apart = F.pmod(F.xxhash64(F.lit(1), text), F.lit(held)) == 0
    model = train(trusted.where(~apart), text) or train(trusted, text)
    every, by_lang, scores = None, None, None
    if model is not None:
        scores = broadcast_if(model.scores(docs, text, slices).toDF("k", "perplexity"), SMALL)
        mine = trusted.where(chars > 0).select(F.col(lang).alias("lang"), chars.alias("n"), F.xxhash64(text).alias("h"), apart.alias("apart"))
        mine = staged(mine.join(scores, F.col("h") == F.col("k")).select("lang", "n", "perplexity", "apart"), "trusted-perplexity")
        if not (new := mine.where("apart")).isEmpty():
            mine = new
        found = staged(thresholds(mine, quantile, slack, prior), "perplexity-thresholds")
        by_lang, every = found.where("NOT whole").select(F.col("lang").alias("of"), "middle", "least"), found.where("whole").first()
    has = chars > 0
    rows = docs.withColumn("n", chars)
    if model is None:
        rows = rows.select("*", F.when(has, F.lit(1.0)).alias("perplexity"), F.when(has, F.lit(float("inf"))).alias("threshold"))
    else:
        rows = rows.withColumn("h", F.when(has, F.xxhash64(text))).join(scores, F.col("h") == F.col("k"), "left")
        rows = rows.join(broadcast_if(by_lang, 5000), F.col(lang).eqNullSafe(F.col("of")), "left")
        n, middle, least = F.col("n"), F.coalesce("middle", F.lit(every["middle"])), F.coalesce("least", F.lit(every["least"]))
        rows = rows.withColumn("threshold", F.when(n > 0, F.exp(F.least((least * (n + prior) - middle * prior) / n, F.lit(700.0)))))
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    return rows.select(*[F.col(x).alias(c) for c, x in own.items()], F.col("perplexity").alias(names[0]), F.col("threshold").alias(names[1]), kept.alias(names[2]))


def kept_rows(docs: DataFrame, trusted_keys: DataFrame, **more) -> DataFrame:
    """The rows of docs, all columns, that the classifier keeps."""
    names = [f"__{x}" for x in ("perplexity", "threshold", "kept")]
    while set(names) & set(docs.columns):
        names = [f"_{x}" for x in names]
    return classified(docs, trusted_keys, names=tuple(names), **more).where(F.col(names[2])).select([F.col(f"`{c}`") for c in docs.columns])
