"""Near duplicates by word shingles against brute force."""

import functools
import random

from conftest_llm import ODD, make_docs
from test_pairs import WORD, grouped

from lontar.llm import shingles, toxicity


@functools.cache
def five(text):
    words = WORD.findall(text.lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(five(a) & five(b)) / len(five(a) | five(b)) if five(a) | five(b) else 1.0


def near_copies():
    """Texts of 20 to 1,000 words, each with copies of which 0.5 to 4 % of the words are changed."""
    rnd = random.Random(11)
    rows = []
    for _ in range(40):
        words = [f"kata{rnd.randrange(3000)}" for _ in range(rnd.randint(20, 1000))]
        for share in (0, 0.005, 0.01, 0.02, 0.04):
            changed = rnd.sample(range(len(words)), max(share > 0, int(len(words) * share)))
            rows.append((len(rows), " ".join(f"lain{rnd.randrange(3000)}" if k in changed else w for k, w in enumerate(words))))
    return rows


def test_near_duplicates(spark):
    import corpus_pipeline

    rows = near_copies()
    texts = dict(rows)
    links = [(a, b) for a in texts for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    want = grouped(links, texts)
    assert len(links) > 100
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r.doc_id for r in stage(spark, make_docs(spark, rows), "").collect()) == sorted(set(want.values()))
    assert {r.doc_id: r.component_id for r in shingles.groups(make_docs(spark, rows)).collect()} == want


def test_similar_sets():
    rnd = random.Random(4)
    for _ in range(300):
        a = " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 30)))
        b = " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 30)))
        x, y = (shingles.shingles(t.encode()) for t in (a, b))
        assert abs(shingles.similarity(x, y) - jaccard(a, b)) < 1e-12
        assert (shingles.similarity(x, y, 0.8) >= 0.8) == (jaccard(a, b) >= 0.8)


def test_odd(spark):
    got = shingles.groups(make_docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in got if r.doc_id in (4, 5, None)} == {4}
    kept = shingles.keep_one(make_docs(spark, ODD))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [1, 4, 6, 7, 8] and kept.columns == make_docs(spark, ODD).columns
    assert shingles.groups(make_docs(spark, ODD).where("false")).count() == 0


def test_toxic_evidence_of_unrelated_documents(spark, monkeypatch):
    """Documents that share a common word weigh 1 each, near copies 1 together."""
    rnd = random.Random(9)
    rows = [(k, "dan yang " + " ".join(f"kata{rnd.randrange(5000)}" for _ in range(60))) for k in range(120)]
    rows += [(k + 200, rows[0][1] + f" akhir{k}") for k in range(40)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0 or i >= 200)) for i, _ in rows], "doc_id long, toxic int")
    seen = []
    held = {r.doc_id for r in labels.where(toxicity.held_out(labels.doc_id)).collect()}
    checked = toxicity.checkpoint

    def watched(df):
        df = checked(df)
        seen.append(df.collect() if "weight" in df.columns else [])
        return df

    monkeypatch.setattr(toxicity, "checkpoint", watched)
    toxicity.train(make_docs(spark, rows), labels)
    assert all(len({r.fold for r in d if r.doc_id >= 200 or r.doc_id == 0}) <= 1 for d in seen)
    weights = {r.doc_id: r.weight for d in seen for r in d}
    copies = [i for i in weights if i >= 200 or i == 0]
    assert weights.keys() == {i for i, _ in rows} - held and abs(sum(weights[i] for i in copies) - 1) < 1e-9
    assert all(w == 1 for i, w in weights.items() if i not in copies)
