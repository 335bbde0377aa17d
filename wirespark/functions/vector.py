"""Vectors: arrays of numbers (dense), or their cardinality and entries (sparse); native functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def check(cardinality: int | None, dense: bool, sparse: bool, sequential: bool) -> None:
    if dense and (sparse or sequential):
        raise ValueError("dense excludes sparse and sequential")
    if cardinality is not None and cardinality < 0:
        raise ValueError(f"cardinality {cardinality}")


def dense_to_sparse(c: str | Column, single: bool = False) -> Column:
    """struct<cardinality, entries: array<struct<index, value>>> of the values that aren't 0."""
    kind = "float" if single else "double"
    pairs = F.transform(column(c), lambda v, i: F.struct(i.alias("index"), v.cast(kind).alias("value")))
    return F.struct(F.size(column(c)).alias("cardinality"), F.filter(pairs, lambda e: e["value"] != 0).alias("entries"))


def sparse_to_dense(c: str | Column, cardinality: int | None = None, single: bool = False) -> Column:
    """An array of the cardinality's length (the vector's own, if none is given); entries outside it are dropped.

    Of entries with one index, the last counts.
    """
    s, kind = column(c), "float" if single else "double"
    n = s["cardinality"] if cardinality is None else F.lit(cardinality)
    inside = F.filter(s["entries"], lambda e: (e["index"] >= 0) & (e["index"] < n))
    order = F.array_sort(F.transform(inside, lambda e, at: F.struct(e["index"].alias("index"), at.alias("at"), e["value"].cast(kind).alias("value"))))
    zeros = lambda k: F.array_repeat(F.lit(0).cast(kind), k)
    after = lambda o, k: F.coalesce(F.get(o, k)["index"], F.lit(-1))
    last = let(order, lambda o: F.filter(F.transform(o, lambda e, k: F.struct(e["index"].alias("index"), e["value"].alias("value"), (after(o, k + 1) != e["index"]).alias("keep"))), lambda e: e["keep"]))
    # In order of the index, each value comes after the zeros between it and the one before.
    filled = lambda o: F.flatten(F.transform(o, lambda e, k: F.concat(zeros(e["index"] - after(o, k - 1) - 1), F.array(e["value"]))))
    return let(last, lambda o: F.concat(filled(o), zeros(n - after(o, F.size(o) - 1) - 1)))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for all of its uses, those in lambdas too."""
    return F.transform(F.array(value), body)[0]


def out_of_bounds(c: str | Column, cardinality: int | None = None) -> Column:
    """How many entries sparse_to_dense drops, for counters."""
    s = column(c)
    n = s["cardinality"] if cardinality is None else F.lit(cardinality)
    return F.size(F.filter(s["entries"], lambda e: (e["index"] < 0) | (e["index"] >= n)))


def resized(c: str | Column, cardinality: int, single: bool = False) -> Column:
    """Cut, or filled with zeros, to the cardinality."""
    kind = "float" if single else "double"
    a = column(c).cast(f"array<{kind}>")
    return F.concat(F.slice(a, 1, cardinality), F.array_repeat(F.lit(0).cast(kind), F.greatest(F.lit(cardinality) - F.size(a), F.lit(0))))


def exact(c: str | Column, cardinality: int) -> Column:
    """The vector; fails if it has another cardinality."""
    return F.when(F.size(column(c)) == cardinality, column(c)).otherwise(F.raise_error(F.concat(F.lit(f"cardinality {cardinality} expected, found "), F.size(column(c)).cast("string"))))
