"""Mixing sources to target weights with a low-discrepancy schedule of slots.

1. Every source's words are laid out in a shuffled (hashed) order of its documents and cut into blocks of equal size.
2. A source's target is its share of all words by weight, but at most `most` times its own words; what is cut off goes
   to the others by weight, until nobody is above. It takes ceil(target / block) slots, the last one cut to fit.
3. Slot i stands at the van der Corput point of i (its bits reversed). The points are mapped through the cumulative
   slots of the sources; a slot's rank among those of its source is how many earlier points fell to it, which for this
   sequence is a sum over the bits of i. So slots need no sort and no window, and any stretch of them is well mixed.
4. Rank r of a source is joined with its block r, going round as often as the target says.

Defined results: a null source is a source like the others and comes last; a null text has size 0; documents without
words are in no block and are taken 0 times; repeated rows are documents of their own; an empty table gives an empty
result. Other columns are ignored by `mix`, and all kept by `mixed_rows`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, staged

WEIGHTS = (5, 2, 1)
#: Slots of the schedule, about; blocks are as large as that asks for.
SLOTS = 1 << 17
#: Parts that a source's shuffled order is cut into, so that no task numbers a whole source.
PARTS = 1024
WORDS = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, text: str, key: str, source: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select(F.col(key).alias("k"), F.col(source).alias("src"), size.alias("size"), F.xxhash64(F.col(key), F.col(text), F.lit(17)).alias("h"))


def targets(rows: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """src, no (by code point, null last), source_size, target; a row for each source.

    The cap binds for the sources with the least size to weight: with sources in that order, the number capped is the
    first k for which the rest, sharing what is left by weight, stay at or below their caps.
    """
    sizes = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("src").asc_nulls_last())
    numbered = sizes.withColumn("no", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int")).cast("double")
    by_ratio = Window.orderBy((F.col("source_size") / F.col("w")).asc(), "no")
    all_rows = Window.partitionBy()
    return (
        numbered.withColumn("w", weight)
        .withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("capped", F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most)
        .withColumn("left", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("left"))
        .withColumn("fits", F.col("level") * F.col("w") <= F.col("source_size") * most)
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct((F.col("source_size") / F.col("w")).alias("r"), "no", "level"))).over(all_rows)["level"])
        .withColumn("target", F.coalesce(F.least(F.col("level") * F.col("w"), F.col("source_size") * F.lit(float(most))), F.col("source_size") * F.lit(float(most))))
        .select("src", "no", "source_size", "target")
    )


def laid_out(rows: DataFrame) -> DataFrame:
    """Adds start: the words before a document in its source's shuffled order."""
    part = F.pmod("h", F.lit(PARTS))
    cut = rows.withColumn("part", part)
    sums = cut.groupBy("src", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select(F.col("src").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("src", "part").orderBy("h", "k", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return numbered.join(first, F.col("src").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).withColumn("start", F.col("first") + F.col("inside")).drop("s", "p", "first", "inside", "part")


def slots(spark, plan: DataFrame, bits: int, total: int) -> DataFrame:
    """i, no, rank of the slots in use. plan: no, first (slots of the sources before), n (slots), one row a source."""
    size = 1 << bits
    bounds = plan.select("no", "n", F.floor(F.col("first") * size / total).cast("long").alias("lo"), F.floor((F.col("first") + F.col("n")) * size / total).cast("long").alias("hi"))
    # A source's grid points are consecutive numbers: made from its row. The slot at a point has its bits reversed.
    owned = bounds.where("hi > lo").select("no", "n", "lo", "hi", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("point"))
    owned = owned.withColumn("i", F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long"))
    rank = F.lit(0).cast("long")
    for b in range(bits):
        # Where bit b of i is set, the 2^b slots before that differ from it below stand on a grid with an offset: what
        # the bits of i above b make of the point, which are the point's lowest.
        step, offset = 1 << (bits - b), F.col("point").bitwiseAND(F.lit((1 << (bits - 1 - b)) - 1))
        number = F.floor((F.col("hi") - offset + (step - 1)) / step) - F.floor((F.col("lo") - offset + (step - 1)) / step)
        rank = rank + F.when(F.shiftright("i", b).bitwiseAND(F.lit(1)) == 1, number.cast("long")).otherwise(0)
    return owned.select("i", "no", "n", rank.alias("rank")).where("rank < n")


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights=WEIGHTS, most: int = 3, slots_about: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """The mix, and the documents it is made of.

    Pieces: slot, round (of its source's words), no, start, from_word, to_word (of the document at `start` of source `no`).
    Documents: k (the key), src, size, h, start, no, source_size, target.
    """
    spark = docs.sparkSession
    rows = staged(sized(docs, text, key, source), "mix-sizes")
    goal = staged(targets(rows, weights, most), "mix-targets")
    total = goal.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    block = max(1, -(-total // slots_about))
    plan = goal.select("no", "source_size", F.round("target").cast("long").alias("quota")).where("quota > 0")
    plan = plan.withColumn("n", F.ceil(F.col("quota") / block)).withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = staged(plan, "mix-plan")
    used = plan.agg(F.sum("n").alias("n")).first()["n"] or 1
    schedule = slots(spark, plan.select("no", "first", "n"), max(1, (used - 1).bit_length()), used)
    known = goal.select(F.col("src").alias("s"), "no", "source_size", "target")
    placed = staged(laid_out(rows).join(broadcast_if(known, 5000), F.col("src").eqNullSafe(F.col("s"))).drop("s"), "mix-placed")
    # A slot's words [rank * block, ...) go round the source's words; in one round it covers blocks at a fixed offset.
    spans = (
        schedule.join(broadcast_if(plan.select("no", "source_size", "quota"), 5000), "no")
        .withColumn("a", F.col("rank") * block)
        .withColumn("b", F.least(F.col("a") + block, F.col("quota")))
        .withColumn("round", F.explode(F.sequence(F.floor(F.col("a") / F.col("source_size")), F.floor((F.col("b") - 1) / F.col("source_size")))))
        .withColumn("from", F.greatest(F.col("a") - F.col("round") * F.col("source_size"), F.lit(0)))
        .withColumn("to", F.least(F.col("b") - F.col("round") * F.col("source_size"), F.col("source_size")))
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
        .select("i", "no", "round", "cell", "from", "to")
    )
    cells = placed.where("size > 0").select("no", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("cell"))
    lo = F.greatest("start", "from", F.col("cell") * block)
    hi = F.least(F.col("start") + F.col("size"), F.col("to"), (F.col("cell") + 1) * block)
    pieces = spans.join(cells, ["no", "cell"]).where(lo < hi).select(F.col("i").alias("slot"), "round", "no", "start", (lo - F.col("start")).alias("from_word"), (hi - F.col("start")).alias("to_word"))
    return pieces, placed


def taken(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """placed with taken: how many of a document's words the mix takes, repeats counted."""
    sums = pieces.groupBy("no", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    full = placed.where("size > 0").join(sums, ["no", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return full.unionByName(placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")))


def copies(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """no, start, k, h, times (whole copies of the document, or 0), slots (the first of each round that takes from it).

    A source's mix ends inside one document at most. If it takes half of that or more, the document comes whole; else as
    many of those after it, in the source's shuffled order, as the words that are left fill.
    """
    pieces = staged(pieces, "mix-pieces")
    full = staged(taken(pieces, placed).where("size > 0").select("no", "start", "k", "h", "size", "taken"), "mix-taken")
    last = full.where("taken % size > 0").select(F.col("no").alias("n"), F.col("start").alias("at"), F.col("size").alias("of"), (F.col("taken") % F.col("size")).alias("rest"))
    half, behind = F.col("rest") * 2 >= F.col("of"), F.col("start") - F.col("at") - F.col("of")
    more = F.when(half, behind + F.col("of") == 0).otherwise((behind >= 0) & (behind + F.col("size") <= F.col("rest")))
    times = full.join(broadcast_if(last, 5000), F.col("no") == F.col("n"), "left").withColumn("times", F.floor(F.col("taken") / F.col("size")) + F.coalesce(more, F.lit(False)).cast("int"))
    slots = pieces.groupBy("no", "start", "round").agg(F.min("slot").alias("slot")).groupBy("no", "start").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
    return times.select("no", "start", "k", "h", "times").join(slots, ["no", "start"], "left")


def mixed_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **more) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it (`copies`), in the order of the schedule's slots.

    Rows are matched by their key and a hash of key and text; rows that repeat share what they are taken, rounded.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select([F.col(f"`{c}`").alias(x) for c, x in own.items()])
    text, key, source = own[text], own[key], own[source]
    of = copies(*mix(rows, text, key, source, **more)).groupBy("k", "h").agg(F.sum("times").alias("sum"), F.count("*").alias("rows"), F.min("slots").alias("slots"))
    of = of.select("k", "h", "slots", F.round(F.col("sum") / F.col("rows")).cast("int").alias("times")).where("times > 0")
    met = rows.withColumn("h2", F.xxhash64(F.col(key), F.col(text), F.lit(17))).join(of, F.col(key).eqNullSafe(F.col("k")) & (F.col("h2") == F.col("h")))
    each = met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    slot = F.coalesce(F.get("slots", F.least(F.col("copy"), F.size("slots")) - 1), F.lit(1 << 62))
    return each.orderBy(slot, "copy", "h").select([F.col(x).alias(c) for c, x in own.items()])
