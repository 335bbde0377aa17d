"""Quality rules with thresholds that adapt to each language and source; DataFrame and SQL functions only.

Base figures of a text (words: runs of anything but blank and \\t to \\r): n_words, word_chars, n_symbols, n_dup_lines,
n_repeat_words; see `base`. They are made row by row, without a shuffle: repeated windows are found by sorting the
hashes of a text's own 8-word windows.

Rules: rates of those figures to the words, each compared with fences from the quartiles of its group. Quartiles come
from KLL sketches, made for each (language, source) and merged to languages and to the whole, whose sketches stand in
where a group has fewer than `least` documents. A fence lies `reach` interquartile ranges outside the quartiles; a range
below a rate's floor counts as the floor, so that uniform groups don't reject small deviations.

Defined results: a null or wordless text has all figures 0 and fails the base rule (too few words). Null languages and
sources are groups of their own. Repeated rows are judged alike; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, staged

WINDOW = 8
SPACE = r"[\\x20\\x09-\\x0D]"

#: Rates: expression over the base figures, floor of the range between quartiles, sides that reject.
RATES = {
    "word_length": ("word_chars / n_words", 1.0, ("low", "high")),
    "symbols": ("n_symbols / n_words", 0.05, ("high",)),
    "dup_lines": ("n_dup_lines / n_words", 0.02, ("high",)),
    "repeats": ("n_repeat_words / n_words", 0.1, ("high",)),
}


def let(name: str, value: str, body: str) -> str:
    """SQL: body, in which name stands for value, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeat_words(words: str) -> str:
    """SQL: how many words are in windows of 8 that occur twice or more, by 64-bit hashes of the windows."""
    def halves(x: str, gap: int) -> str:
        n = f"size({x}) - {gap}"
        return f"zip_with(slice({x}, 1, {n}), slice({x}, {gap + 1}, {n}), (a, b) -> xxhash64(a, b))"

    neighbour = "(j > 0 AND s[j - 1].h = s[j].h) OR (j < size(s) - 1 AND s[j + 1].h = s[j].h)"
    places = f"sort_array(filter(transform(sequence(0, size(s) - 1), j -> IF({neighbour}, s[j].p, CAST(NULL AS INT))), x -> x IS NOT NULL))"
    covered = f"aggregate({places}, struct(0 AS e, 0L AS n), (acc, x) -> struct(x + {WINDOW} AS e, acc.n + x + {WINDOW} - greatest(x, acc.e) AS n), acc -> acc.n)"
    many = let("s", "sort_array(transform(w8, (h, p) -> struct(h AS h, p AS p)))", covered)
    body = f"IF(size(array_distinct(w8)) = size(w8), 0L, {many})"
    body = let("w8", halves("w4", 4), body)
    body = let("w4", halves("w2", 2), body)
    body = let("w2", halves("w1", 1), body)
    body = let("w1", f"transform({words}, w -> xxhash64(w))", body)
    return f"IF(size({words}) <= {WINDOW}, 0L, {body})"


def base(docs: DataFrame, text: str, key: str, lang: str, source: str) -> DataFrame:
    """k, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(source).alias("source"), t.alias("t"))
    rows = rows.select("k", "lang", "source", "t", F.expr(f"array_remove(split(t, '{SPACE}+'), '')").alias("words"), F.expr(r"filter(split(t, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')").alias("lines"))
    figures = {
        "n_words": "CAST(size(words) AS BIGINT)",
        "word_chars": "CAST(length(array_join(words, '')) AS BIGINT)",
        "n_symbols": "CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT)",
        "n_dup_lines": "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT)",
        "n_repeat_words": repeat_words("words"),
    }
    return rows.select("k", "lang", "source", *[F.expr(e).alias(c) for c, e in figures.items()])


def fences(figures: DataFrame, reach: float, least: int) -> DataFrame:
    """lang, source, and for each rate its low and high fence. Sketches are merged from the groups upwards."""
    rated = figures.where("n_words > 0").select("lang", "source", *[F.expr(f"CAST({e} AS DOUBLE)").alias(r) for r, (e, _, _) in RATES.items()])
    groups = staged(rated.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.expr(f"kll_sketch_agg_double({r}, 400)").alias(r) for r in RATES]), "rule-sketches")
    merged = lambda g: g.agg(F.sum("n").alias("n"), *[F.expr(f"kll_merge_agg_double({r}, 400)").alias(r) for r in RATES])

    def quartiles(df, level: str):
        q = lambda r, p: f"kll_sketch_get_quantile_double({r}, {p}D)"
        return df.select(*[c for c in ("lang", "source") if c in df.columns], F.col("n").alias(f"n_{level}"), F.struct(*[F.expr(f"struct({q(r, 0.25)} AS a, {q(r, 0.75)} AS b)").alias(r) for r in RATES]).alias(f"q_{level}"))

    one = quartiles(groups, "source")
    two = quartiles(merged(groups.groupBy("lang")), "lang").withColumnRenamed("lang", "lang2")
    three = quartiles(merged(groups.groupBy()).where("n > 0"), "all")
    every = one.join(two, one["lang"].eqNullSafe(two["lang2"])).crossJoin(F.broadcast(three))  # `three` is one row
    q = F.when(F.col("n_source") >= least, F.col("q_source")).when(F.col("n_lang") >= least, F.col("q_lang")).otherwise(F.col("q_all"))
    out = [F.col("lang").alias("__lang"), F.col("source").alias("__source")]
    for r, (_, floor, _) in RATES.items():
        a, b = q[r]["a"], q[r]["b"]
        spread = F.greatest(b - a, F.lit(floor)) * reach
        out += [(a - spread).alias(f"__low_{r}"), (b + spread).alias(f"__high_{r}")]
    return every.select(*out)


def judged(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source", reach: float = 3.0, least: int = 30) -> DataFrame:
    """key, the base figures, base_failed, kept, failed_rules (names) of every row."""
    figures = staged(base(docs, text, key, lang, source), "rule-figures")
    limits = staged(fences(figures, reach, least), "rule-fences")
    rows = figures.join(broadcast_if(limits, 5000), F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    failed = F.array_compact(F.array(*[F.when((F.expr(f"try_divide(CAST({e.split(' / ')[0]} AS DOUBLE), n_words)") < F.col(f"__low_{r}") if side == "low" else F.expr(f"try_divide(CAST({e.split(' / ')[0]} AS DOUBLE), n_words)") > F.col(f"__high_{r}")), F.lit(f"{r} {side}")) for r, (e, _, sides) in RATES.items() for side in sides]))
    bad = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select(F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", bad.alias("base_failed"), (~bad & (F.size(failed) == 0)).alias("kept"), failed.alias("failed_rules"))
