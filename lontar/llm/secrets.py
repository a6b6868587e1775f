"""Secret scan with a random forest against false positives.

Words that could hold a secret become findings, with features of the value (length, shares of character classes,
transitions between classes and between vowels and consonants, coverage by a dictionary of the corpus), of the
neighbouring words and of the path. A random forest learned from labelled findings scores them. Without labels at hand,
findings of well-known formats are the labelled ones: issued keys and hexadecimal values named as credentials against
addresses, numbers and the like. As the name decides that label, it is then no feature.

Everything runs as DataFrame expressions and Spark's own random forest; documents are read in place, only findings
move."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

THRESHOLD, MIN_LENGTH = 0.5, 8
#: Bounds: words of the dictionary, labelled findings to learn from.
DICTIONARY_WORDS, MAX_TRAIN = 5000, 20_000
TREES, DEPTH, SEED = 30, 6, 42
#: Words that name credentials.
CREDENTIAL = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|bearer)"
#: Formats of issued keys, and of what merely looks like one.
ISSUED = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{16,}|eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)$"
BENIGN = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|[^@\s]+@[A-Za-z0-9.-]+\.[A-Za-z]+|\+?[0-9][0-9().,/:-]*|https?://.*|[0-9]{4}-[0-9]{2}-[0-9]{2}.*)$"
FEATURES = ["f_length", "f_digits", "f_upper", "f_marks", "f_distinct", "f_classes", "f_vowels", "f_dictionary", "f_key", "f_named", "f_assigned", "f_quoted", "f_next", "f_before", "f_depth", "f_test"]
#: Features that known_label() does not look at.
UNNAMED = [f for f in FEATURES if f not in ("f_named", "f_key")]


def dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of three to twelve letters over all texts, ties by the word; at most `words`."""
    each = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where(F.length("w").between(3, 12))
    return [r.w for r in each.groupBy("w").count().orderBy(F.desc("count"), "w").limit(words).select("w").collect()]


def findings(docs: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, at, value, key, features...) of every word of docs (doc_id, text, and path or else source) that could
    hold a secret: at least eight characters, with a digit or an assignment, or after a word that ends in = or :. at
    counts words from 0, value is without key, quotes and marks. Null and empty texts have none, repeated rows have
    theirs again, a null doc_id stays null. Empty input: no rows."""
    path = next((F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("path", "source") if c in docs.columns), F.lit(""))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+").alias("w"))
    word = lambda i: F.get("w", i)
    could = lambda i: (F.length(word(i)) >= MIN_LENGTH) & (word(i).rlike("[0-9]|[A-Za-z_][=:].") | F.coalesce(F.substring(word(i - 1), -1, 1).isin("=", ":"), F.lit(False)))
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), could)
    near = F.transform(places, lambda i: F.struct(i.alias("at"), word(i).alias("word"), F.coalesce(word(i - 2), F.lit("")).alias("two"), F.coalesce(word(i - 1), F.lit("")).alias("one"), F.coalesce(word(i + 1), F.lit("")).alias("next")))
    each = split.select("doc_id", "path", F.explode(near).alias("x")).select("doc_id", "path", "x.*")
    form = r"""^["'(\[{<]*(?:([A-Za-z_][A-Za-z0-9_.-]*)["']?[=:]["']?)?(.*?)["',;.)\]}>]*$"""
    each = each.withColumn("key", F.regexp_extract("word", form, 1)).withColumn("value", F.regexp_extract("word", form, 2))
    each = each.where(F.length("value") >= MIN_LENGTH)
    v, n = F.col("value"), F.length("value").cast("double")
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    runs = lambda c: F.length(F.regexp_replace(c, r"(.)\1+", "$1"))
    classes = F.translate(v, lower + upper + digits, "a" * 26 + "A" * 26 + "0" * 10)
    letters = F.translate(F.lower(v), "aeiou" + "bcdfghjklmnpqrstvwxyz" + digits, "v" * 5 + "c" * 21 + "0" * 10)
    parts = F.filter(F.split(F.lower(F.regexp_replace(v, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+"), lambda p: p.isin(words) if words else F.lit(False))
    covered = F.aggregate(parts, F.lit(0), lambda a, p: a + F.length(p)) / n
    known = lambda c: (F.regexp_replace(F.lower(c), "[^a-z]", "").isin(words) if words else F.lit(False)).cast("double")
    named = F.concat_ws(" ", "key", "one", "two").rlike(CREDENTIAL)
    return each.select(
        "doc_id", "at", "value", F.when(F.col("key") != "", F.col("key")).when(F.col("one").rlike("^[=:]+$"), F.col("two")).otherwise(F.col("one")).alias("key"), named.alias("named"),
        n.alias("f_length"), (F.regexp_count(v, F.lit("[0-9]")) / n).alias("f_digits"), (F.regexp_count(v, F.lit("[A-Z]")) / n).alias("f_upper"), (F.regexp_count(v, F.lit("[^A-Za-z0-9]")) / n).alias("f_marks"),
        (F.size(F.array_distinct(F.split(v, ""))) / n).alias("f_distinct"), (runs(classes) / n).alias("f_classes"), (runs(letters) / n).alias("f_vowels"), covered.alias("f_dictionary"),
        (F.col("key") != "").cast("double").alias("f_key"), named.cast("double").alias("f_named"), (F.col("key").cast("string").rlike(".") | F.col("one").rlike("[=:]$")).cast("double").alias("f_assigned"), F.col("word").rlike("[\"']").cast("double").alias("f_quoted"),
        known(F.col("next")).alias("f_next"), known(F.col("one")).alias("f_before"), F.regexp_count("path", F.lit("/")).cast("double").alias("f_depth"), F.col("path").rlike("(?i)test|example|sample|fixture|mock").cast("double").alias("f_test"),
    )


def known_label(value: Column, named: Column) -> Column:
    """1 for issued formats and for long hexadecimal values given to a credential's name, 0 for addresses, numbers and
    the like, else null."""
    return F.when(value.rlike(ISSUED) | (named & value.rlike("^[0-9a-fA-F]{16,}$") & value.rlike("[a-fA-F]")), 1.0).when(value.rlike(BENIGN), 0.0)


def train(labelled: DataFrame, max_rows: int = MAX_TRAIN, features: list[str] | None = None) -> RandomForestClassificationModel | None:
    """A forest on findings with a column label (0, 1 or null for unknown), or None if one of the classes is missing.

    Equal values count once, with the smallest label and, of those, the smallest features. At most max_rows are learned
    from, half of each class, chosen by a hash; what is sorted into one task is bounded by that. The same findings give
    the same forest in any order and partitioning."""
    features = features or FEATURES
    once = labelled.where("label is not null").groupBy("value").agg(F.min(F.struct("label", *features)).alias("x"))
    rows = once.select(F.xxhash64("value").alias("h"), "value", "x.*")
    rows = checkpoint(rows.where("label = 1").orderBy("h", "value").limit(max_rows // 2).unionAll(rows.where("label = 0").orderBy("h", "value").limit(max_rows // 2)).coalesce(1).sortWithinPartitions("h", "value"))
    if rows.select("label").distinct().count() < 2:
        return None
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(rows).select("label", "features")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(assembled)


def score(found: DataFrame, model: RandomForestClassificationModel | None, features: list[str] | None = None) -> DataFrame:
    """found with secret_score (0 to 1) added, by a model of these features; without a model the known label, or 0.5."""
    if model is None:
        return found.withColumn("secret_score", F.coalesce(known_label(F.col("value"), F.col("named")), F.lit(0.5)))
    assembled = VectorAssembler(inputCols=features or FEATURES, outputCol="_features").transform(found)
    scored = model.setFeaturesCol("_features").setPredictionCol("_prediction").setProbabilityCol("_probability").setRawPredictionCol("_raw").transform(assembled)
    return scored.withColumn("secret_score", vector_to_array("_probability")[1]).drop("_features", "_prediction", "_probability", "_raw")


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """All findings of docs with secret_score. labelled has the columns of findings() and label; by default the
    findings of known formats are the labelled ones. Repeated rows give their findings again. Empty input: no rows."""
    found = checkpoint(findings(docs, dictionary(docs)))
    features = FEATURES if labelled is not None else UNNAMED
    labelled = labelled if labelled is not None else found.withColumn("label", known_label(F.col("value"), F.col("named")))
    return score(found, train(labelled, features=features), features)


def held_out_quality(docs: DataFrame) -> tuple[int, float, float]:
    """(findings, precision, recall) of the default forest on findings of known label that it has not learned from:
    values whose hash leaves 0 modulo 4."""
    found = checkpoint(findings(docs, dictionary(docs)).withColumn("label", known_label(F.col("value"), F.col("named"))))
    held = F.pmod(F.xxhash64("value"), F.lit(4)) == 0
    told = score(found.where(held & F.col("label").isNotNull()), train(found.where(~held), features=UNNAMED), UNNAMED)
    yes = F.col("secret_score") >= THRESHOLD
    n, said, real, both = told.agg(F.count("*"), F.count_if(yes), F.count_if(F.col("label") == 1), F.count_if(yes & (F.col("label") == 1))).first()
    return n, both / max(1, said), both / max(1, real)
