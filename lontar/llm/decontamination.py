"""Benchmark decontamination by canonical templates.

Texts become sequences of lower-case tokens in which numbers, names and units are typed placeholders, so a question
with other parameters keeps its template. Windows of the template are hash-joined with those of the benchmark items;
matches on one alignment are gathered, and the values in the slots must agree: the same value of the item always
corresponds to the same value of the document. A document holds an item if consistent windows cover enough of it.

Everything is built of DataFrame expressions; the documents are read once and never shuffled, only matches are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, COVERAGE = 8, 0.5
#: The windows of the benchmark are broadcast up to so many (about 150 bytes each), beyond that joined by a shuffle.
BROADCAST_WINDOWS = 200_000
#: Up to so many distinct hashes of benchmark windows go into the scan as a set, so that only hits leave it.
SET_WINDOWS = 20_000
#: Units that count as such after a number.
UNITS = "mm cm m km mg g kg ml l s ms h min sec second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms liter liters litre litres percent dollar dollars euro euros cent cents degree degrees celsius volt volts watt watts joule joules hertz byte bytes".split()
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
_MARK = "\x01"


def surface(text: Column) -> Column:
    """Lower-case tokens. Decimal and grouping marks inside a number join its digits, and a number is split from
    letters that follow it. A name, a capitalised word that follows a word, comma, semicolon or colon on its line, is
    marked. Null: none. Each pattern runs twice as its matches may not overlap."""
    plain = F.translate(F.coalesce(text, F.lit("")), _MARK, " ")
    t = plain
    for _ in range(2):
        t = F.regexp_replace(t, r"([0-9])[.,]([0-9])", "$1_$2")
    t = F.when(plain.rlike("[0-9]"), F.regexp_replace(t, r"([0-9])(\p{L})", "$1 $2")).otherwise(plain)
    for _ in range(2):
        t = F.regexp_replace(t, r"([\p{L}0-9,;:] )(\p{Lu}\p{Ll})", f"$1{_MARK}$2")
    words = F.split(F.lower(t), rf"[^\p{{L}}\p{{N}}_{_MARK}]+")
    return F.filter(words, lambda w: w != "")


def template(tokens: Column) -> Column:
    """Placeholders for what surface() gives: digits and the name mark sort before all letters, so one comparison
    passes over ordinary words."""

    def one(w: Column, i: Column) -> Column:
        before = F.get(tokens, i - 1)
        slot = F.when(w < "\x02", NAME).otherwise(NUM)
        return F.when(w < ":", slot).when((before >= "0") & (before < ":") & w.isin(UNITS), UNIT).otherwise(w)

    return F.transform(tokens, one)


def windows(rows: DataFrame, size: int, *keys: str, only: list[int] | None = None) -> DataFrame:
    """(keys, n, at, h, slots) for each run of `size` template tokens: h its hash, slots the surface tokens in its
    slots with their places in the window, null without any. With `only`, just the windows of these hashes."""
    slots = (NUM, NAME, UNIT)
    words = rows.select(*keys, surface(F.col("text")).alias("w")).select(*keys, "w", template(F.col("w")).alias("c"), F.size("w").cast("int").alias("n"))
    t = words.select(*keys, "w", "c", "n", F.exists("c", lambda c: c < "=").alias("any"))  # placeholders sort before all words

    def plain(i: Column) -> Column:
        return F.struct(i.alias("at"), F.xxhash64(F.slice("c", i, size)).alias("h"), F.lit(None).cast("array<string>").alias("slots"))

    def slotted(i: Column) -> Column:
        part = F.slice("c", i, size)
        values = F.filter(F.transform(F.slice("w", i, size), lambda w, k: F.when(F.get(part, k).isin(*slots), F.concat(k.cast("string"), F.lit("="), w))), lambda v: v.isNotNull())
        return F.struct(i.alias("at"), F.xxhash64(part).alias("h"), F.when(F.array_min(part) < "=", values).alias("slots"))

    starts = F.when(F.col("n") >= size, F.sequence(F.lit(1), F.col("n") - (size - 1)))  # a filter would be pushed down and tokenise twice
    if only is not None:
        starts = F.filter(starts, lambda i: F.xxhash64(F.slice("c", i, size)).isin(only))
    found = F.when(F.col("any"), F.transform(starts, slotted)).otherwise(F.transform(starts, plain))
    return t.select(*keys, "n", F.explode(found).alias("x")).select(*keys, "n", "x.at", "x.h", "x.slots")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, item_words, covered, n_windows, consistent): one row for each document and item that share a
    window, for the alignment that covers most (then the first). Items shorter than a window match as a whole. Null
    and empty texts match nothing, nor do rows without doc_id or item_id. Rows that share a doc_id count together."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    sizes = [r.n for r in items.select(F.least(F.size(surface(F.col("text"))), F.lit(window)).alias("n")).distinct().where("n > 0").collect()]
    found = None
    for size in sorted(sizes):
        ours = windows(items, size, "item_id")
        if size < window:
            ours = ours.where(F.col("n") == size)
        ours = ours.select("h", "item_id", F.col("n").alias("item_words"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
        small = ours.count() <= BROADCAST_WINDOWS
        known = [r.h for r in ours.select("h").distinct().limit(SET_WINDOWS + 1).collect()]
        theirs = windows(docs, size, "doc_id", only=known if len(known) <= SET_WINDOWS else None)
        hit = theirs.join(F.broadcast(ours) if small else ours, "h").select("doc_id", "item_id", "item_words", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), "slots", "item_slots", F.lit(size).alias("size"))
        found = hit if found is None else found.union(hit)
    if found is None:
        return docs.select("doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("item_words"), F.lit(0).alias("covered"), F.lit(0).cast("long").alias("n_windows"), F.lit(True).alias("consistent")).where("false")
    pairs = F.zip_with("item_slots", "slots", lambda a, b: F.struct(F.substring_index(a, "=", -1).alias("a"), F.substring_index(b, "=", -1).alias("b")))
    gathered = found.groupBy("doc_id", "item_id", "shift", "item_words").agg(
        F.collect_set(F.struct("item_at", "size")).alias("at"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x.item_at, x.item_at + x["size"] - 1)))))
    side = lambda name: F.size(F.array_distinct(F.transform("pairs", lambda p: p[name])))
    aligned = gathered.select("doc_id", "item_id", "item_words", "shift", covered.alias("covered"), F.size("at").cast("long").alias("n_windows"), (side("a") == F.size("pairs")).alias("consistent"))
    best = F.max(F.struct(F.col("consistent").alias("consistent"), "covered", (-F.col("shift")).alias("first"), "n_windows"))
    return aligned.groupBy("doc_id", "item_id", "item_words").agg(best.alias("b")).select("doc_id", "item_id", "item_words", "b.covered", "b.n_windows", "b.consistent")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The rows of matches() whose slots agree and that cover at least `coverage` of the item's words."""
    return matches(docs, benchmark, window).where(F.col("consistent") & (F.col("covered") >= F.col("item_words") * coverage))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all columns; rows without doc_id stay."""
    bad = contaminated(docs.select("doc_id", "text"), benchmark, window, coverage).select("doc_id").distinct()
    return docs.join(bad, docs.doc_id.cast("long") == bad.doc_id, "left_anti")
