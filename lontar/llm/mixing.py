"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a fixed shuffled order (by a hash of doc_id) and read in up to `epochs` passes. A
copy's virtual finish time is the source's words up to and including it, divided by the source's target. The mix is
the copies in order of that time, cut where the total budget is used up."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, hash60, identity, packed, word_count

EPOCHS = 3
_ROWS_A_CELL = 4096


def targets(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target, source_id) from rows (source, size).

    Sources in code point order, null last, weigh 1, 2, 3, repeating. A target stops at epochs times its source's
    size; the excess is shared again by weight. One row per source; the windows run over that table only."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("source_id", F.row_number().over(ordered)).withColumn("weight", ((F.col("source_id") - 1) % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * epochs)
    filling = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "source_id")
    everything = Window.partitionBy()
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left_over", F.col("total") - F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("open", F.col("left_over") * F.col("weight") <= F.col("cap") * F.col("open_weight"))
    )
    # the first source, in filling order, that its share does not fill up sets the level for all after it
    first = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "source_id", "left_over", "open_weight"))).over(everything)
    filled = filled.withColumn("level", first)
    share = (F.col("level.left_over") * F.col("weight")).cast("double") / F.col("level.open_weight")
    return filled.select("source", "source_size", F.when(F.col("open"), share).otherwise(F.col("cap").cast("double")).alias("target"), "source_id")


def plan(docs: DataFrame, epochs: int = EPOCHS, row: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, copies, times, row) for each row of docs (doc_id, text, source).

    size is the number of words (null text: 0). copies is how many times the mix takes the document, 0 to epochs;
    documents of size 0 count as taken 0 times. Repeated rows are separate documents. A null doc_id is allowed.
    row names a row where doc_id does not; it settles ties and comes back (null without it). Empty input: no rows. The
    same rows give the same mix in any order and partitioning."""
    row = F.lit(None).cast("struct<a:bigint,b:bigint>") if row is None else row
    sized = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), hash60(F.col("doc_id").cast("long")).alias("h"), row.alias("row")))
    n, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    goals = checkpoint(targets(sized, epochs))
    bits = max(0, math.ceil(math.log2(max(1, n / _ROWS_A_CELL))))
    rows = sized.join(goals, sized.source.eqNullSafe(goals.source)).select("doc_id", "size", "h", "row", "source_id", "source_size", "target", F.shiftright("h", 60 - bits).alias("cell"))
    rows = checkpoint(rows)
    # words before a document within its source: whole cells first, then within its own cell
    cells = rows.groupBy("source_id", "cell").agg(F.sum("size").alias("words"))
    before = cells.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("source_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("words")
    within = Window.partitionBy("source_id", "cell").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    read = rows.join(before, ["source_id", "cell"]).withColumn("upto", F.col("before") + F.sum("size").over(within))
    finish = lambda e: (F.col("upto") + F.col("source_size") * e).cast("double") / F.col("target")
    times = F.array(*[finish(e) for e in range(epochs)])
    read = checkpoint(read.withColumn("times", F.when((F.col("size") > 0) & (F.col("target") > 0), times).otherwise(F.array().cast("array<double>"))).drop("cell", "before", "upto"))
    # by time 1 no source is past its target, so the budget holds every copy up to there
    on_time = F.size(F.filter("times", lambda t: t <= 1.0))
    left = total - (read.agg(F.sum(F.col("size") * on_time)).first()[0] or 0)
    late = read.select("doc_id", "size", "h", "row", F.posexplode("times").alias("epoch", "time")).where("time > 1")
    reach, cut = 2.0 * left / max(1, total), None
    while left > 0:
        some, more = late.agg(F.sum(F.when(F.col("time") <= 1 + reach, F.col("size"))), F.count(F.when(F.col("time") > 1 + reach, 1))).first()
        if (some or 0) >= left or not more:
            break
        reach *= 2
    order = ["time", "h", "doc_id", "epoch", "size", "row"]
    if left > 0:
        # a few documents of each source: what lies between time 1 and the end of the budget
        tail = late.where(F.col("time") <= 1 + reach).withColumn("used", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        cut = tail.where(F.col("used") <= left).agg(F.max(F.struct(*order))).first()[0]
    if cut is None:
        copies = on_time
    else:
        place = F.struct(*[F.lit(cut["row"][k]).cast("long").alias(k) for k in "ab"]) if cut["row"] else F.lit(None).cast("struct<a:bigint,b:bigint>")
        key = F.struct(F.lit(cut["time"]).alias("time"), F.lit(cut["h"]).alias("h"), F.lit(cut["doc_id"]).cast("long").alias("doc_id"), F.lit(cut["epoch"]).alias("epoch"), F.lit(cut["size"]).alias("size"), place.alias("row"))
        copies = F.size(F.filter(F.transform("times", lambda t, e: F.struct(t.alias("time"), F.col("h"), F.col("doc_id"), e.alias("epoch"), F.col("size"), F.col("row"))), lambda k: k <= key))
    return read.select("doc_id", "size", "source_size", "target", copies.cast("int").alias("copies"), F.slice("times", 1, copies).alias("times"), "row")


def mix(docs: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: every taken copy of a document as a row with all columns of docs, range-sorted by virtual finish
    time. Documents without words are in no mix. Rows are told apart by all their columns, so a doc_id may be null or
    repeated; equal rows are one row here with the copies of all."""
    taken = plan(docs, epochs, identity(docs)).where("copies > 0").select(F.col("row.a").alias("_a"), F.col("row.b").alias("_b"), F.explode("times").alias("_time"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), identity(docs).alias("_of"))
    once = rows.select("_row", F.col("_of.a").alias("_a"), F.col("_of.b").alias("_b")).dropDuplicates(["_a", "_b"])
    return once.join(taken, ["_a", "_b"]).sort("_time", "_a", "_b").select("_row.*")
