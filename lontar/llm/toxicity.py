"""Toxic passages by maximum-scoring segment search.

Words carry the log-odds of labelled toxic against labelled clean documents under a Dirichlet prior; a word is looked
up whole and by its prefixes, so inflected forms share evidence. A linear-time scan finds all maximal scoring segments
of a text. Scores are log-likelihood ratios, for which the scale of the extreme-value law is 1; its other constant comes
from the clean training documents. A document's evidence is the sum of -log E over its significant segments, and a
logistic curve over that gives the probability of the label."""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import checkpoint, forget, hash60, packed

THRESHOLD = 0.3
#: Bounds of the fit: labelled documents looked at, features kept.
MAX_TRAIN_DOCS, MAX_FEATURES = 200_000, 50_000
#: Prior: documents spread as in both classes together, and a floor for each feature. Least odds of a feature, least
#: documents (copies count once), share of toxic words in a toxic passage, largest E, share of clean documents above the
#: score that fits the tail.
PRIOR, FLOOR, MIN_ODDS, MIN_DOCS, DENSITY, MAX_E, TAIL = 10.0, 0.5, 2.0, 3.0, 0.05, 0.05, 0.01
_WORDS = re.compile(r"\w+").findall
_PREFIXES = range(3, 9)
_FLUSH = 400_000


def features(word: str) -> list[str]:
    """The word itself and, marked by a dash, its proper prefixes of three to eight letters."""
    return [word, *(word[:n] + "-" for n in _PREFIXES if n < len(word))]


@dataclass
class Model:
    """score: positive features; rest: score of any other word; k: constant of the extreme-value law; a, b: curve."""

    score: dict[str, float]
    rest: float
    k: float = 1e-3
    a: float = 0.0
    b: float = 1.0


def segments(hits: list[tuple[int, float]], rest: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score), in linear time. hits are the words above 0."""
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, nearest with a lower sum before
    total, last = 0.0, -1
    for at, s in hits:
        total += rest * (at - last - 1)
        before, first = total, at
        total += s
        last = at
        k = len(found) - 1
        while True:
            while k >= 0 and found[k][0] >= before:
                k = found[k][4]
            if k < 0 or found[k][1] >= total:
                found.append((before, total, first, at, k))
                break
            before, first, link = found[k][0], found[k][2], found[k][4]
            del found[k:]
            k = link
    return [(f, e, after - before) for before, after, f, e, _ in found]


class Scorer:
    """Scores texts with a model; remembers words between texts, within a bound."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def word(self, word: str) -> float:
        best = max((self.model.score.get(f, 0.0) for f in features(word)), default=0.0)
        if len(self.known) > 1_000_000:
            self.known.clear()
        self.known[word] = best
        return best

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = _WORDS(text.lower()) if text else []
        get, hits = self.known.get, []
        for at, w in enumerate(words):
            s = get(w)
            if s is None:
                s = self.word(w)
            if s:
                hits.append((at, s))
        return len(words), segments(hits, self.model.rest) if hits else []

    def evidence(self, text: str | None) -> tuple[float, int]:
        """Sum of -log E over the significant passages, and their number."""
        n, found = self.passages(text)
        x = [-math.log(self.model.k * max(1, n)) + s for _, _, s in found]
        x = [v for v in x if v > -math.log(MAX_E)]
        return sum(x), len(x)

    def probability(self, x: float) -> float:
        return 1.0 / (1.0 + math.exp(min(700.0, max(-700.0, -(self.model.a + self.model.b * x)))))


def held_out(doc_id):
    """Rows never learned from: crc32 of doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """(doc_id, toxic) to learn from: one row a document, at most about max_docs, chosen by a hash of doc_id."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n = known.count()
    return known.where(hash60(F.col("doc_id")) < int(2**60 * max_docs / n)) if n > max_docs else known


def _count(batches):
    """(text, toxic, fold, weight) to sums of weights of each feature: toxic and clean of either fold."""
    counts: dict[str, list[float]] = {}

    def out():
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([counts[k][i] for k in keys], pa.float64()) for i in range(4))], names=["f", "toxic0", "clean0", "toxic1", "clean1"])

    for batch in batches:
        for text, y, fold, weight in zip(*(batch.column(i).to_pylist() for i in range(4))):
            at = 2 * fold + (not y)
            for f in {f for w in set(_WORDS((text or "").lower())) for f in features(w)}:
                counts.setdefault(f, [0.0, 0.0, 0.0, 0.0])[at] += weight
            if len(counts) > _FLUSH:
                yield out()
                counts = {}
    if counts:
        yield out()


def _observe(models: list[Model]):
    """Best segment of each text, by the model that has not learned from its fold."""

    def run(batches):
        scorers = [Scorer(m) for m in models]
        for batch in batches:
            rows = [(n, max((s for *_, s in found), default=0.0)) for n, found in (scorers[1 - f].passages(t) for t, f in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], names=["y", "n", "best"])

    return run


def _weigh(models: list[Model]):
    """Evidence of each text, by the model that has not learned from its fold."""

    def run(batches):
        scorers = [Scorer(m) for m in models]
        for batch in batches:
            x = [min(400, round(4 * scorers[1 - f].evidence(t)[0])) for t, f in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(x, pa.int32())], names=["y", "x"])

    return run


def _curve(rows: list[tuple[int, float, int]]) -> tuple[float, float]:
    """Logistic regression of the label on the evidence, with a slight pull of the slope to 0."""
    y, x, w = (np.array(v, float) for v in zip(*rows)) if rows else (np.zeros(1), np.zeros(1), np.ones(1))
    beta = np.array([-2.0, 0.5])
    z = np.stack([np.ones_like(x), x])
    pull = np.diag([1e-3, 1e-1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(beta @ z, -50, 50)))
        step = np.linalg.solve((z * (w * p * (1 - p))) @ z.T + pull, z @ (w * (y - p)) - pull @ beta)
        beta = beta + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(0.0, beta[1]))


def _fitted(counts: DataFrame, toxic: Column, clean: Column, n1: float, n0: float) -> Model:
    """Features and their scores from weighted numbers of documents."""
    if not n1 or not n0:
        return Model({}, math.log(1 - DENSITY))
    counts = counts.select("f", toxic.alias("toxic"), clean.alias("clean"))
    both, share = F.col("toxic") + F.col("clean"), n1 / (n1 + n0)
    prior = F.lit(PRIOR) * both / (n1 + n0) + FLOOR
    one, two = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(one / n1) - F.log(two / n0)
    # likelihood ratio of the split between the classes, against the number of features tried
    part = lambda c, p: F.when(c > 0, c * F.log(c / (both * p))).otherwise(0.0)
    gain = part(F.col("toxic"), share) + part(F.col("clean"), 1 - share)
    tried = counts.where(both >= MIN_DOCS).select("f", (odds - F.sqrt(1 / one + 1 / two)).alias("sure"), gain.alias("gain"))
    least = math.log(max(1, tried.count())) + 1
    best = tried.where((F.col("gain") >= least) & (F.col("sure") >= MIN_ODDS)).orderBy(F.desc("gain"), "f").limit(MAX_FEATURES)
    gains = {r.f: math.log(1 - DENSITY + DENSITY * math.exp(min(20.0, r.sure))) for r in best.collect()}
    return Model({f: s for f, s in gains.items() if s > 0}, math.log(1 - DENSITY))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Fit on the texts of labelled documents outside the held-out part.

    The labels looked at are bounded by max_docs and so are broadcast; of the texts only those of likely copies are
    moved. Copies are labelled documents of one class that five-word shingles link; they weigh one together and are in
    one of two folds. The tail and the curve are fitted on evidence by models that learned from the other fold only.
    Rows that share a doc_id all count, with the label of any toxic one; rows without doc_id or label do not. Without
    any labelled toxic or clean document, and for empty tables, the model scores every text alike, near 0."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = F.broadcast(training_labels(labels, max_docs))
    grouped = checkpoint(shingles.groups(texts.join(chosen, "doc_id").select("doc_id", "text")).join(chosen, "doc_id"))
    copies = grouped.groupBy("toxic", "component_id").agg((F.lit(1.0) / F.count("*")).alias("weight"))
    fold = F.max(hash60(F.col("component_id")) % 2).cast("int").alias("fold")
    weighted = checkpoint(grouped.join(copies, ["toxic", "component_id"]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("weight").alias("weight"), fold))
    n = {(r.y, r.fold): r.n for r in weighted.groupBy((F.col("toxic") == 1).alias("y"), "fold").agg(F.sum("weight").alias("n")).collect()}
    n1, n0 = ([float(n.get((y, k), 0.0)) for k in range(2)] for y in (True, False))
    if not sum(n1) or not sum(n0):
        return Model({}, math.log(1 - DENSITY), a=-5.0, b=0.0)
    learn = texts.join(F.broadcast(weighted), "doc_id").select("text", (F.col("toxic") == 1).cast("int").alias("toxic"), "fold", "weight")
    kinds = ["toxic0", "clean0", "toxic1", "clean1"]
    counts = learn.mapInArrow(_count, "f string, toxic0 double, clean0 double, toxic1 double, clean1 double").groupBy("f").agg(*[F.sum(c).alias(c) for c in kinds])
    # most features are of a document or two
    counts = checkpoint(counts.where(F.col("toxic0") + F.col("clean0") + F.col("toxic1") + F.col("clean1") >= MIN_DOCS))
    model = _fitted(counts, F.col("toxic0") + F.col("toxic1"), F.col("clean0") + F.col("clean1"), sum(n1), sum(n0))
    halves = [_fitted(counts, F.col(f"toxic{k}"), F.col(f"clean{k}"), n1[k], n0[k]) for k in range(2)]
    # the tail of clean documents' best segments, in steps of 0.1
    best = learn.mapInArrow(_observe(halves), "y int, n long, best double").where("y = 0").groupBy(F.round(F.least("best", F.lit(60.0)), 1).alias("best")).agg(F.sum("n").alias("n"), F.count("*").alias("docs")).collect()
    words, docs_ = sum(r.n for r in best), sum(r.docs for r in best)
    above, at = 0, 60.0
    for r in sorted(best, key=lambda r: -r.best):
        at = r.best
        if above + r.docs > TAIL * docs_:
            break
        above += r.docs
    for m in (model, *halves):
        m.k = (0.5 + above) / (max(1, words) * math.exp(-(at + 0.1)))
    rows = learn.mapInArrow(_weigh(halves), "y int, x int").groupBy("y", "x").count().collect()
    model.a, model.b = _curve([(r.y, r.x / 4, r["count"]) for r in rows])
    forget(grouped, weighted, counts)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with toxic_score (0 to 1) and toxic_passages (number of significant ones) added. Null and empty texts have
    no passages and get the score of a text without evidence. Whole texts are scanned; nothing is shuffled. Repeated
    rows come back as often, columns of these two names in docs are replaced. Empty input: no rows."""

    @F.pandas_udf("toxic_score double, toxic_passages int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in parts:
            found = [scorer.evidence(t) for t in texts]
            yield pd.DataFrame({"toxic_score": [scorer.probability(x) for x, _ in found], "toxic_passages": np.array([n for _, n in found], np.int32)})

    scored = packed(docs).select("_row", run(F.col("_row.text").cast("string")).alias("_toxic"))
    return scored.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in ("toxic_score", "toxic_passages")], "_toxic.toxic_score", "_toxic.toxic_passages")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, first_word, last_word, segment_score, e_value) of every significant passage."""

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, found = scorer.passages(text)
                rows += [(doc, f, e, s, v) for f, e, s in found if (v := model.k * n * math.exp(-s)) < MAX_E]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))], names=["doc_id", "first_word", "last_word", "segment_score", "e_value"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, first_word int, last_word int, segment_score double, e_value double")
