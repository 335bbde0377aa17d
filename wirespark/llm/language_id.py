"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Trained with FTRL-proximal (follow the regularised leader, elastic-net penalty), then calibrated with a temperature.

Features: letters are lower-cased, anything else is a blank; 1- to 3-grams are hashed to a fixed number of bins. A
bin's value is its relative frequency in the whole text times its inverse document frequency in the training rows.

Defined results: a text that is null or has no letter is `und` with score 0, as is any text when nothing could be
learnt (no row with a text and a language). Of equally likely languages the first by name is predicted. Rows are
independent of one another: repeated rows get equal results, an empty table gives an empty one, null keys are keys like
any, other columns are ignored and not carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, staged, text_batches

BINS = 1 << 16
SCALE = 64.0
#: Rows of a language that are asked for, however many languages there are.
FEWEST = 50
#: Features (8 bytes each) that the driver gets for training, over all languages; one row of each comes in any case.
MOST_FEATURES = 32 << 20
#: Code points of a text that are looked at together; longer texts take several rounds.
BLOCK = 1 << 20
#: Letters beyond this code point don't exist today.
TOP = 0x33480
_fold: list[np.ndarray] = []


def folded(text: str) -> np.ndarray:
    """Code points, lower-cased if letters, else 32."""
    if not _fold:
        table = np.full(TOP, 32, np.uint32)
        for cp in range(TOP):
            if (ch := chr(cp)).isalpha():
                low = ch.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        _fold.append(table)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _fold[0][np.minimum(codes, TOP - 1)]


def gram_bins(codes: np.ndarray) -> np.ndarray:
    """Bins of all 1-, 2- and 3-grams."""
    c = codes.astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = one[:-1] * np.uint32(31) ^ c[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(33) ^ c[2:] * np.uint32(0xC2B2AE3D) if len(c) > 2 else two[:0]
    h = np.concatenate([one, two ^ np.uint32(0x51ED270B), three ^ np.uint32(0x27D4EB2F)])
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(16)


def blocks(codes: np.ndarray):
    padded = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]]).astype(np.uint32)
    for i in range(0, len(padded), BLOCK):
        yield padded[i : i + BLOCK + 2]


@dataclass
class LanguageModel:
    """weights: float32 of BINS x languages (1 MB for four), so its size is bounded by the languages learnt."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def scores(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs:
            return "und", 0.0
        codes = folded(text)
        if not (codes != 32).any():
            return "und", 0.0
        total, n = np.zeros(len(self.langs)), 0
        for block in blocks(codes):
            bins = gram_bins(block)
            n += len(bins)
            total += self.weights.take(bins, axis=0).sum(axis=0, dtype=np.float64)
        p = softmax((total / n * SCALE + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], alpha=0.5, beta=1.0, l1=0.05, l2=0.01, epochs=4) -> LanguageModel:
    """rows: (bins, relative frequencies, language). One in five is held out for the temperature."""
    langs = sorted({r[2] for r in rows})
    code = {x: k for k, x in enumerate(langs)}
    first = {r[2]: i for i, r in reversed(list(enumerate(rows)))}  # of a language, so that none is only held out
    fit, held = [r for i, r in enumerate(rows) if i % 5 or len(rows) < 20 or first[r[2]] == i], [r for i, r in enumerate(rows) if i % 5 == 0 and (len(rows) < 20 or first[r[2]] != i)]
    df = np.zeros(BINS)
    for bins, _, _ in fit:
        df[bins] += 1
    idf = np.log((1 + len(fit)) / (1 + df)) + 1
    z, n = np.zeros((BINS, len(langs))), np.zeros((BINS, len(langs)))
    zb, nb = np.zeros(len(langs)), np.zeros(len(langs))

    def solved(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(fit)):
            bins, tf, lang = fit[i]
            x = tf * idf[bins] * SCALE
            w, b = solved(z[bins], n[bins]), -zb / ((beta + np.sqrt(nb)) / alpha)
            g0 = softmax(x @ w + b)
            g0[code[lang]] -= 1
            g = x[:, None] * g0
            s = (np.sqrt(n[bins] + g * g) - np.sqrt(n[bins])) / alpha
            z[bins] += g - s * w
            n[bins] += g * g
            sb = (np.sqrt(nb + g0 * g0) - np.sqrt(nb)) / alpha
            zb += g0 - sb * b
            nb += g0 * g0
    w, b = solved(z, n) * idf[:, None], -zb / ((beta + np.sqrt(nb)) / alpha)
    logits = np.array([tf * SCALE @ w[bins] + b for bins, tf, _ in held]).reshape(len(held), len(langs))
    y = np.array([code[r[2]] for r in held], int)

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()) if len(y) else 0.0

    lo, hi = np.log(0.05), np.log(20.0)
    for _ in range(40):  # golden section
        a, c = hi - (hi - lo) * 0.618034, lo + (hi - lo) * 0.618034
        lo, hi = (lo, c) if loss(a) <= loss(c) else (a, hi)
    return LanguageModel(langs, w.astype(np.float32), b, float(np.exp((lo + hi) / 2)))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 1000, most_rows: int = 200_000) -> LanguageModel:
    """Fit on about per_lang different rows of each language, chosen by a hash of the row: the documented bound of the sample.

    Every language is learnt. Where there are so many that most_rows would be passed, each has fewer rows, but FEWEST at
    least. The driver gets the sampled rows' features, not their texts: in the order of that hash, as many rows of each
    language as have its share of MOST_FEATURES.
    """
    rows = labelled.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).alias("g")).where("t IS NOT NULL AND g IS NOT NULL")
    counts = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel([], np.zeros((BINS, 0), np.float32), np.zeros(0), 1.0)
    share = min(per_lang, max(FEWEST, most_rows // len(counts)))
    rates = labelled.sparkSession.createDataFrame([(g, min(1.0, share / n)) for g, n in counts.items()], "g string, rate double")
    unit = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)

    def features(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for h, k, t, g in zip(*(b.column(c).to_pylist() for c in ("h", "k", "t", "g"))):
                if not ((codes := folded(t)) != 32).any():
                    continue
                counts = np.zeros(BINS, np.int64)
                for block in blocks(codes):
                    counts += np.bincount(gram_bins(block), minlength=BINS)
                bins = np.flatnonzero(counts)
                for column, v in zip(out, (h, k or "", g, bins.astype(np.int32), (counts[bins] / counts.sum()).astype(np.float32))):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float32())))], ["h", "k", "g", "bins", "tf"])

    hashed = rows.withColumn("h", F.xxhash64("k", "g", "t"))
    # Rows that repeat are chosen all or none, and one of them is enough.
    chosen = hashed.join(broadcast_if(rates, 1_000_000), "g").where(unit < F.col("rate")).dropDuplicates(["h"])
    made = staged(text_batches(chosen.select("h", "k", "t", "g"), features, "h long, k string, g string, bins array<int>, tf array<float>"), "language-features")
    # Windows over the bounded sample.
    order = Window.partitionBy("g").orderBy("h", "k")
    sizes = made.select("h", "k", "g", F.size("bins").alias("n")).withColumn("sum", F.sum("n").over(order)).withColumn("no", F.row_number().over(order))
    last = sizes.where((F.col("no") == 1) | (F.col("sum") <= MOST_FEATURES // len(counts))).groupBy("g").agg(F.max(F.struct("h", "k")).alias("last"))
    table = made.join(broadcast_if(last, 1_000_000), "g").where(F.struct("h", "k") <= F.col("last")).select("h", "k", "g", "bins", "tf").toArrow()
    got = sorted(zip(table["k"].to_pylist(), table["g"].to_pylist(), table["h"].to_pylist(), range(len(table))))
    bins, tf = table["bins"], table["tf"]
    return train([(bins[i].values.to_numpy(), tf[i].values.to_numpy(), g) for _, g, _, i in got]) if got else LanguageModel([], np.zeros((BINS, 0), np.float32), np.zeros(0), 1.0)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score of every row; whole texts. The model is sent once to each worker."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType

    def run(batches):
        model = sent.value
        for b in batches:
            got = [model.scores(t) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [key, "lang_pred", "score"])

    return text_batches(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"`{key}` {kind.simpleString()}, lang_pred string, score double")
