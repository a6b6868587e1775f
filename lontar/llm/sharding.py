"""Sharding by extendible hashing.

A directory of hash prefixes starts as one bucket. Only buckets above the byte limit split, on one more bit of the
hash, until each fits. The directory is worked out on byte sums of prefix cells, of which there are about 64 to a
shard; documents are then looked up in it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, hash60, packed

LIMIT_BYTES = 64 << 20
BITS = 60
#: A directory of at most so many cells (about 16 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_CELLS = 1 << 20
#: Repeated rows that are numbered in one window.
PAGED_ROWS = 1 << 16


def _cell(bits: int):
    return F.shiftright("h", BITS - bits)


def directory(sizes: DataFrame, limit: int, bits: int) -> DataFrame:
    """(cell, depth) for all cells of `bits` hash bits present in sizes (h, n_bytes): depth is the smallest number of
    prefix bits whose bucket fits the limit, null where even `bits` bits do not."""
    cells = sizes.groupBy(_cell(bits).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"))
    levels = cells.select("cell", "n_bytes", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    fits = levels.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("n_bytes")).where(F.col("n_bytes") <= limit).select("depth", "prefix")
    found = levels.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(found, "cell", "left")


def shards(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """docs with n_bytes, shard_depth, shard and shard_page added; docs needs doc_id and text.

    The hash is over doc_id and text, n_bytes is the text's length in UTF-8 (null: 0). shard is the bucket's prefix as
    bits, '' for the undivided one. Rows that agree in all 60 bits cannot be split: repeated rows fill numbered pages
    of at most the limit (shard_page, else 0), and one text above the limit has a shard or page to itself. Rows without
    doc_id are dealt by their texts. Empty input: no rows. Columns of these four names in docs are replaced."""
    measured = packed(docs).withColumn("h", hash60(F.col("_row.doc_id"), F.md5(F.coalesce(F.col("_row.text"), F.lit("")))))
    measured = measured.withColumn("n_bytes", F.coalesce(F.octet_length("_row.text"), F.lit(0)).cast("long"))
    sizes = checkpoint(measured.groupBy("h").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"), F.max("n_bytes").alias("widest")))
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 6)
    found, left = None, sizes
    while True:
        got = checkpoint(directory(left, limit, bits))
        part = got.where("depth is not null" if bits < BITS else "true").select("cell", F.coalesce("depth", F.lit(BITS)).alias("depth"), F.lit(bits).alias("bits"))
        found = part if found is None else found.union(part)
        unfit = got.where("depth is null").select("cell")
        if bits == BITS or not unfit.head(1):
            break
        # a few cells hold a very long text or repeated rows: only these look at more bits
        left = left.withColumn("cell", _cell(bits)).join(unfit, "cell", "left_semi").drop("cell")
        bits = min(BITS, bits + 12)
    tables = sorted(r[0] for r in found.select("bits").distinct().collect())
    n_cells = found.count()
    out = measured.withColumn("depth", F.lit(None).cast("int"))
    for b in tables:
        cells = found.where(F.col("bits") == b).select("cell", F.col("depth").alias("found"))
        out = out.withColumn("cell", _cell(b)).join(F.broadcast(cells) if n_cells <= BROADCAST_CELLS else cells, "cell", "left")
        out = out.withColumn("depth", F.coalesce("depth", "found")).drop("cell", "found")
    added = [F.col("n_bytes"), F.col("depth").alias("shard_depth"), F.when(F.col("depth") == 0, "").otherwise(F.substring(F.lpad(F.bin("h"), BITS, "0"), F.lit(1), F.col("depth"))).alias("shard")]
    columns = [*[F.col(f"_row.`{c}`") for c in docs.columns if c not in ("n_bytes", "shard_depth", "shard", "shard_page")], *added]
    fit = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("widest", F.lit(1))))
    crowded = sizes.where((F.col("n_bytes") > limit) & (F.col("n") > 1)).select("h", fit.alias("fit"), F.ceil(F.col("n") / PAGED_ROWS).alias("ways"))
    n_crowded = crowded.count()
    if not n_crowded:
        return out.select(*columns, F.lit(0).alias("shard_page"))
    crowded = F.broadcast(crowded) if n_crowded <= BROADCAST_CELLS else crowded
    # very many repeated rows number their pages in several ways at once, so no task has them all
    paged = out.join(crowded, "h").withColumn("way", F.pmod(F.monotonically_increasing_id(), "ways"))
    nth = F.row_number().over(Window.partitionBy("h", "way").orderBy("n_bytes"))
    paged = paged.withColumn("page", (F.floor((nth - 1) / F.col("fit")) * F.col("ways") + F.col("way")).cast("int"))
    plain = out.join(crowded.select("h"), "h", "left_anti").select(*columns, F.lit(0).alias("shard_page"))
    return plain.unionByName(paged.select(*columns, F.col("page").alias("shard_page")))
