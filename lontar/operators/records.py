"""Registry and queue of documents as DataFrames: merges, claims, state changes and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ATTEMPTS = 3
#: Priority of a document without a source, and states that no duplicate is compared with.
NO_PRIORITY, DEAD = 1000, ["duplicate", "rejected", "failed"]


def insert_new(known: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of batch whose key is neither in known nor in an earlier row of batch; rows without a key stay out."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    fresh = batch.where(F.col(key).isNotNull()).join(known.select(key), key, "left_anti")
    return fresh.withColumn("_first", first).where("_first").drop("_first")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str], order: str) -> DataFrame:
    """old with rows of new put over it: the last row of each key by `order`, columns of `keep` from old where set."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))) == 1
    latest = new.withColumn("_last", last).where("_last").drop("_last", order)
    both = old.alias("o").join(latest.alias("n"), keys, "full")
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keep else F.coalesce(f"n.{c}", f"o.{c}")
    return both.select(*keys, *[pick(c).alias(c) for c in old.columns if c not in keys])


def fill(old: Column, new: Column) -> Column:
    """The new value unless it is empty or null."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def first_of(key: str, id_: str, order: str) -> Column:
    """Id of the first row of a key, null for that row itself and for rows without a key."""
    winner = F.first_value(id_).over(Window.partitionBy(key).orderBy(order, id_))
    return F.when(F.col(key).isNotNull() & (winner != F.col(id_)), winner)


def mark_duplicates(documents: DataFrame, key: str, order: str, reason: str) -> DataFrame:
    """documents with duplicate_of, status and reject_reason: among live rows the first of a key stays."""
    live = ~F.col("status").isin(DEAD)
    d = documents.withColumn("_key", F.when(live, F.col(key))).withColumn("duplicate_of", first_of("_key", "id", order))
    twin = F.col("duplicate_of").isNotNull()
    return d.withColumn("reject_reason", F.when(twin, reason)).withColumn("status", F.when(twin, "duplicate").otherwise(F.col("status"))).drop("_key")


def claim_order(busy: str, tie: str, pages: str | None = None) -> list[Column]:
    by_pages = [] if pages is None else [F.desc_nulls_last("total_pages") if str(pages).lower() == "desc" else F.asc_nulls_last("total_pages")]
    return [F.desc(F.col("status") == busy), F.asc("priority"), *by_pages, F.desc_nulls_last("sort_tahun"), F.desc_nulls_last("sort_nomor"), F.asc(tie), F.asc("id")]


def claim_places(documents: DataFrame, busy: str, tie: str, pages: str | None = None) -> DataFrame:
    """Claimed documents with place: their number in the order of claims among those of one state and priority."""
    first, second, *rest = claim_order(busy, tie, pages)
    return documents.withColumn("place", F.row_number().over(Window.partitionBy("status", "priority").orderBy(*rest)))


def claim(documents: DataFrame, sources: DataFrame, busy: str, waiting: str, tie: str, limit: int | None = None, pages: str | None = None) -> DataFrame:
    """Documents to work on in order: those left busy first, then by priority of their source, page count where `pages`
    is asc or desc, year and number (latest first), tie. Sources are few and joined from the side; a limit is a top-k."""
    open_ = documents.where(F.col("status").isin(busy, waiting))
    joined = open_.join(sources, open_.first_source_id == sources.source_id, "left").withColumn("priority", F.coalesce("priority", F.lit(NO_PRIORITY)))
    order = claim_order(busy, tie, pages)
    return joined.orderBy(*order).limit(limit) if limit is not None else joined.orderBy(*order)


def in_range(c: Column, low: int, high: int) -> Column:
    """Inclusive; a bound of 0 or less is open."""
    return (F.lit(low <= 0) | (c >= low)) & (F.lit(high <= 0) | (c <= high))


def parse_range(text: str | None) -> tuple[int, int]:
    """5-10, 10, 5- or -10 as (low, high); anything else is open on both sides."""
    parts = (text or "").strip().split("-")
    try:
        if len(parts) == 1:
            return int(parts[0]), int(parts[0])
        low, high = (int(p) if p.strip() else 0 for p in parts) if len(parts) == 2 else (0, 0)
        return (low, high) if low >= 0 and high >= 0 and not (low and high and low > high) else (0, 0)
    except ValueError:
        return 0, 0


def failed(documents: DataFrame, back_to: str, reason: str | None = None, most: int = MAX_ATTEMPTS) -> DataFrame:
    """documents after one more failed attempt."""
    out = F.col("attempts") + 1 >= most
    changed = {"status": F.when(out, "failed").otherwise(back_to), "attempts": F.col("attempts") + 1}
    if reason:
        changed["reject_reason"] = F.when(out, reason).otherwise(F.col("reject_reason"))
    return documents.withColumns(changed)


def requeue(documents: DataFrame, stuck: str = "parsing", back_to: str = "ocr_done") -> DataFrame:
    return documents.withColumn("status", F.when(F.col("status") == stuck, back_to).otherwise(F.col("status")))


def review_queue(documents: DataFrame, flags: DataFrame) -> DataFrame:
    """(id, open_flags, needs_review, last_flag_at) of every document; flags are summed before the join."""
    counted = flags.groupBy("document_id").agg(F.count_if(~F.col("resolved")).alias("open_flags"), F.count_if(~F.col("resolved") & (F.col("severity") == "needs_review")).alias("needs_review"), F.max("created_at").alias("last_flag_at"))
    d = documents.select("id").join(counted, F.col("id") == F.col("document_id"), "left")
    return d.select("id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("open_flags", "needs_review")], "last_flag_at")


def open_flags(flags: DataFrame, only_unresolved: bool = True) -> DataFrame:
    """Flags, newest first."""
    return (flags.where(~F.col("resolved")) if only_unresolved else flags).orderBy(F.desc("created_at"), F.desc("id"))


def reparse(documents: DataFrame, snapshots: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, snapshots and nodes after failed parses are taken back: their snapshots and nodes go and their
    documents wait again."""
    bad = snapshots.where("status = 'FAIL'").select(F.col("document_id").alias("id"))
    again = documents.join(bad.withColumn("_bad", F.lit(True)), "id", "left").withColumn("status", F.when(F.col("_bad"), "ocr_done").otherwise(F.col("status"))).drop("_bad")
    gone = bad.withColumnRenamed("id", "document_id")
    return again, snapshots.join(gone, "document_id", "left_anti"), nodes.join(gone, "document_id", "left_anti")
