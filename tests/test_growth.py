"""Steps that grew faster than the input: what is dealt, and how often a value is worked out."""

import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lontar.functions import edits, text
from lontar.operators import recognition
from lontar.plans import catalog


def plan(spark, name):
    return catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


ANSWERS = ["m02_identity", "m03_signing"]


@pytest.mark.parametrize("name", ANSWERS)
def test_answers_are_decoded_once(spark, name):
    assert plan(spark, name).count("from_json(") == 1


PAGES = ["f20_identity", "f21_signing", "w15_tiers", "p08_anchors"]


@pytest.mark.parametrize("name", PAGES)
def test_pages_are_made_where_their_document_is(spark, name):
    """Orders and line numbers are read and dealt once; the lines of pages are not dealt."""
    said = plan(spark, name)
    assert said.count("Relation [") == 2 and said.count("RepartitionByExpression") == 2


#: What is no longer in the plan of a query, and what is.
STEPS = {
    "F4": ("f30_compare", ["levenshtein", "substring(text"], ["ArrowEvalPython"]),
    "F13": ("i03_crop", ["sequence("], ["RepartitionByExpression"]),
    "F21": ("m06_text_source", ["levenshtein", "substring(text"], ["ArrowEvalPython"]),
    "F24": ("i02_large_pages", ["447999"], ["RepartitionByExpression"]),
    "F30": ("w09_token_runs", ["array_append"], []),
    "F32": ("w08_line_runs", ["array_append", "Window"], []),
    "F33": ("f34_degenerate", ["Generate"], []),
    "F37": ("f33_clean_pages", ["array_append"], []),
}


@pytest.mark.parametrize("finding", STEPS)
def test_steps(spark, finding):
    name, gone, there = STEPS[finding]
    said = plan(spark, name)
    assert not [x for x in gone if x in said] and not [x for x in there if x not in said]


def slow(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_distances():
    deal = random.Random(1)
    pairs = [("", ""), ("", "abc"), ("abc", ""), (None, "a"), ("a", None)]
    for _ in range(200):
        a = "".join(deal.choice("abcé\U0001f600") for _ in range(deal.choice([1, 3, 60, 63, 64, 65, 127, 128, 129, 200])))
        b = list(a)
        for _ in range(deal.choice([0, 1, 5, 50])):
            k = deal.randrange(len(b) + 1)
            b[k : k + deal.randrange(2)] = [deal.choice("abxz")] * deal.randrange(2)
        pairs.append((a, "".join(b) if deal.random() < 0.8 else a[::-1]))
    want = [None if a is None or b is None else slow(a, b) for a, b in pairs]
    assert edits.distances(*map(list, zip(*pairs))) == want


def test_trusted(spark):
    pairs = [("a b", "a  B"), ("", ""), ("halaman 1 " * 30, "halaman 1 " * 29 + "halaman 2 "), ("isi yang sama " * 10, "isi yang sama " * 9 + "isi yang lain "), ("x" * 100, "x" * 95), ("x" * 100, "x" * 94), ("abcdef", "fedcba"), ("isi", ""), (None, "a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    found = df.select(text.compare(F.col("a"), F.col("b"))["trusted"].alias("x"), text.trusted(F.col("a"), F.col("b")).alias("y")).collect()
    assert [r.x for r in found] == [r.y for r in found] and {r.x for r in found} == {True, False, None}


def clamped(tokens, most=4):
    return [t for i, t in enumerate(tokens) if i < most or any(tokens[i - n] != t for n in range(1, most + 1))]


def test_runs(spark):
    deal = random.Random(3)
    said = ["a " * 100_000, "a a a a abc", "a a a a a abc", "  a a a  a a\tb b b b b b ", "abab ab ab ab ab ab", "a  b", "", "a a a a"]
    said += [deal.choice([" ", "  "]).join(deal.choice(["a", "ab", "."]) for _ in range(deal.randrange(40))) for _ in range(200)]
    found = spark.createDataFrame([(x,) for x in said], "x string").select("x", text.clamp_tokens(F.col("x")).alias("y")).collect()
    for r in found:
        kept = clamped(r.x.split())
        assert r.y == (" ".join(kept) if len(kept) < len(r.x.split()) else r.x)
    lines = [deal.choice(["a", " a", "b", ""]) for _ in range(300)] + ["c"] * 50
    got = spark.createDataFrame([(lines,)], "x array<string>").select(F.explode(text.clamp_lines(F.col("x"))).alias("y")).select("y.*").collect()
    keys = [x.strip() for x in lines]
    assert [tuple(r) for r in got] == [(i, x) for i, x in enumerate(lines) if not (keys[i] and i > 2 and keys[i - 3 : i] == [keys[i]] * 3)]
    rows = spark.createDataFrame([(1, 1, i, x) for i, x in enumerate(lines)], "doc_id int, page int, at int, text string")
    assert [(r["at"], r["text"]) for r in recognition.clamp_lines(rows).orderBy("at").collect()] == [tuple(r) for r in got]


def test_nodes_are_counted_before_they_meet_documents(spark):
    """a task sorts a row for each document, and as many tasks share them as shuffles have parts."""
    assert plan(spark, "k18_by_verdict").count("RepartitionByExpression") >= 2
