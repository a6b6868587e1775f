"""SimHash, lines and substrings against brute force."""

import random
import re

import pytest
import xxhash
from conftest_llm import ODD, make_docs  # noqa: F401
from pyspark.sql import functions as F

from lontar.llm import common, lines, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grouped(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("last", [0, 1_000_000])
def test_components(spark, monkeypatch, last):
    monkeypatch.setattr(common, "LAST_EDGES", last)
    rnd = random.Random(5)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2040)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    want = {n: r for n, r in grouped(links, {x for e in links for x in e}).items() if n != r}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bk_tree():
    rnd = random.Random(2)
    centres = [rnd.getrandbits(64) for _ in range(5)]
    values = list({c ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for c in centres for _ in range(30)})
    tree = simhash.BKTree()
    for v in values:
        tree.insert(v)
    for v in values[:20]:
        assert sorted(tree.values[i] for i in tree.within(v, 3)) == sorted(x for x in values if (x ^ v).bit_count() <= 3)


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(400)) for _ in range(6)]
    rows = [(i, None if i % 17 == 0 else re.sub(r"^\S+", f"w{i % 4}", rnd.choice(base))) for i in range(80)]
    prints = {i: fingerprint(t) for i, t in rows}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = grouped(links, prints)
    for hot in (2048, 2):
        got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.groups(make_docs(spark, rows), hot=hot).collect()}
        assert got == {i: (prints[i], want[i]) for i in prints}
    assert simhash.fingerprint(("x y " * 100_000).encode()) == fingerprint("x y " * 100_000)


def test_simhash_odd(spark):
    got = simhash.groups(make_docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in got if r.doc_id in (4, 5, None)} == {4}
    kept = simhash.keep_one(make_docs(spark, ODD))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [1, 4, 6, 7, 8] and kept.columns == make_docs(spark, ODD).columns
    assert simhash.groups(make_docs(spark, ODD).where("false")).count() == 0


def test_keep_one_of_repeated_ids(spark):
    """Rows of one doc_id with different texts are no copies of each other; of rows without doc_id one stays."""
    from lontar.llm import shingles

    rows = [(2, "satu dua tiga empat lima"), (2, "enam tujuh delapan sembilan"), (2, "enam tujuh delapan sembilan"), (3, "satu dua tiga empat lima"), (None, "hanya di sini saja"), (None, "hanya di sini saja"), (None, "enam tujuh delapan sembilan")]
    docs = make_docs(spark, rows).selectExpr("*", "1 as _stay", "2 as _a", "3 as _row", "4 as root", "5 as a", "6 as component_id", "7 as _b")
    for one in (simhash.keep_one, shingles.keep_one):
        got = one(docs)
        assert got.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "hanya di sini saja"), (2, "enam tujuh delapan sembilan"), (2, "satu dua tiga empat lima")]
        assert sorted(map(str, got.collect())) == sorted(map(str, one(docs.repartition(7)).collect()))


def cut(rows):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    rank = lambda i: float("inf") if i is None else i
    for i, w in split:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, rank(i)), rank(i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < rank(i):
                gone[k : k + 13] = [True] * 13
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=lambda r: (r[0] is None, r))


def test_substrings(spark):
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(60)]
    shared = [" ".join(rnd.choice(words) for _ in range(rnd.randint(10, 30))) for _ in range(8)]
    rows = [(i * 3, "\n ".join([" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))), rnd.choice(shared), " ".join(rnd.choice(words) for _ in range(9))])) for i in range(90)] + ODD
    want = cut(rows)
    for size in (1 << 20, 2_000):
        got = substrings.remove_repeats(make_docs(spark, rows), batch_bytes=size).collect()
        assert sorted([tuple(r) for r in got], key=lambda r: (r[0] is None, r)) == want
    assert substrings.remove_repeats(make_docs(spark, rows).where("false")).count() == 0


def test_lines_odd(spark):
    rows = [*ODD, (20, "Sama  baris\n\nlain hal"), (21, "lain hal\nSAMA baris"), (22, " \t\n\x0b")]
    got = {(r.doc_id, r.line): r.kept for r in lines.occurrences(make_docs(spark, rows)).collect()}
    assert got[(20, 0)] and got[(20, 2)] and not got[(21, 0)] and not got[(21, 1)] and not got[(5, 0)] and not got[(None, 0)]
    clean = {r.doc_id: r.text for r in lines.clean(make_docs(spark, rows)).collect()}
    assert clean[21] == "" and clean[20] == "Sama  baris\n\nlain hal" and clean[1] is None and clean[22] == " \t\n\x0b"
    assert lines.occurrences(make_docs(spark, rows).where("false")).count() == 0 and lines.clean(make_docs(spark, rows).where("false")).count() == 0


def test_lines_of_rows_without_an_id_of_their_own(spark):
    rows = [(2, "keep me only once here\nshared words in this line"), (2, "shared words in this line\nand more"), (2, "and more"), (None, "same line here\n\nsame line here"), (None, "same line here"), (None, "same line here"), (1, "shared words in this line")]
    rows += [(9, "equal rows\n\nwith three lines")] * 3
    docs = make_docs(spark, rows).selectExpr("*", "5 as _id", "6 as _removed", "7 as _text", "8 as _nth", "9 as line", "10 as removed")
    found = lines.occurrences(docs)
    assert found.groupBy("group").agg(F.sum(F.col("kept").cast("int")).alias("n")).where("n <> 1").count() == 0
    got = lines.clean(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    texts = sorted((r.doc_id or 0, r.text) for r in got.collect())
    assert texts[-3:] == [(9, ""), (9, ""), (9, "equal rows\n\nwith three lines")]
    words = sorted(line for _, t in texts for line in t.split("\n") if line)
    assert words == sorted({line for _, t in rows for line in t.split("\n") if line})
    assert (1, "shared words in this line") in texts and (2, "keep me only once here") in texts
    assert all((r._id, r._removed, r._text, r._nth, r.line, r.removed) == (5, 6, 7, 8, 9, 10) for r in got.collect())


def similar_pairs(texts, least=0.8):
    """All pairs at least so similar. Only those are compared whose letters allow it."""
    import numpy as np

    texts = sorted(texts, key=len)
    counts, size = lines._letters(texts), np.array([len(t) for t in texts])
    for i, a in enumerate(texts):
        top = int(np.searchsorted(size, len(a) / least, "right"))
        apart = counts[i + 1 : top] - counts[i]
        bound = np.maximum(np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1))
        for j in (np.flatnonzero(bound <= (1 - least) * size[i + 1 : top]) + i + 1).tolist():
            if lines.edit_similarity(a, texts[j], least) >= least:
                yield a, texts[j]


def changed_lines():
    """Lines of 2 to 60 words and versions of them with words changed, put in, left out or misspelt."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 10)))
    for _ in range(60):
        words = [word() for _ in range(rnd.choice([2, 3, 4, 5, 8, 12, 20, 40, 60]))]
        yield " ".join(words)
        for share in (0.02, 0.05, 0.1):
            new = list(words)
            for _ in range(max(1, round(share * len(words)))):
                at, what = rnd.randrange(len(new)), rnd.randrange(4)
                new[at : at + 1] = [[word()], [new[at], word()], [], [new[at] + "x"]][what]
            yield " ".join(new)


def line_recall(texts, occurred):
    group = {r.text: r.group for r in occurred}
    pairs = list(similar_pairs({lines.normalised(t.encode()).decode() for t in texts} - {""}))
    return sum(group[a] == group[b] for a, b in pairs), len(pairs)


def occurred(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [type("R", (), {"text": lines.normalised(texts[r.doc_id].encode()).decode(), "group": r.group}) for r in lines.occurrences(docs.repartition(3)).collect()]


def test_line_recall(spark):
    """Of all pairs of different lines of edit similarity 0.8, nine in ten and more are linked; no other lines are."""
    from conftest import SMALL

    made = sorted(set(changed_lines()))
    found, n = line_recall(made, occurred(spark, made))
    assert n > 150 and found >= 0.9 * n
    plain = sorted({lines.normalised(line.encode()).decode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() for line in (r.text or "").split("\n")} - {""})
    rows = occurred(spark, plain)
    found, n = line_recall(plain, rows)
    assert n > 30 and found >= 0.9 * n
    groups = {}
    for r in rows:
        groups.setdefault(r.group, []).append(r.text)
    for some in groups.values():
        links = {t: {u for u in some if u != t and lines.edit_similarity(t, u) >= 0.8} for t in some}
        seen, stack = {some[0]}, [some[0]]
        while stack:
            stack += (new := links[stack.pop()] - seen)
            seen |= new
        assert len(seen) == len(some)


def test_removed_lines_of_the_query(spark):
    """All but the first occurrence of each group go, by doc_id and line."""
    from conftest import SMALL

    from lontar.llm import catalog

    found = lines.occurrences(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    first, want = {}, {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.line)):
        first.setdefault(r.group, (r.doc_id, r.line))
    for r in sorted(found, key=lambda r: (r.doc_id, r.line)):
        n, gone = want.get(r.doc_id, (0, []))
        want[r.doc_id] = n + 1, gone + [str(r.line)] * (first[r.group] != (r.doc_id, r.line))
    got = {r.doc_id: (r.n_lines, r.removed_lines.split(",") if r.removed_lines else []) for r in catalog.QUERIES["op7_fuzzy_lines"](spark, SMALL).collect()}
    assert got == want and any(gone for _, gone in want.values())


def test_similar():
    rnd = random.Random(13)
    made = list(changed_lines())
    for a, b in [(rnd.choice(made), rnd.choice(made)) for _ in range(300)] + list(zip(made, made[1:])):
        assert lines.similar(a, b, 0.8) == (lines.edit_similarity(a, b) >= 0.8)


def test_connect():
    """A company of many lines is connected as all its pairs say."""
    rnd = random.Random(14)
    texts = sorted({f"halaman {rnd.randrange(500)} dari {rnd.randrange(500)} {'x' * rnd.randrange(60)}" for _ in range(150)})
    links = [(i, j) for i in range(len(texts)) for j in range(i) if lines.edit_similarity(texts[i], texts[j]) >= 0.8]
    assert grouped(lines._connect(texts, 0.8), range(len(texts))) == grouped(links, range(len(texts)))


def misspelt(words, share, rnd):
    """The words joined, one letter changed in a share of them."""
    words = list(words)
    for at in rnd.sample(range(len(words)), round(share * len(words))):
        k = rnd.randrange(len(words[at]))
        words[at] = words[at][:k] + "z" + words[at][k + 1 :]
    return " ".join(words)


def test_lines_with_misprints_all_over(spark):
    """Similar lines are linked however few of their words are the same."""
    rnd = random.Random(15)
    made = [["".join(rnd.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(rnd.choice([12, 16, 30, 60]))] for _ in range(40)]
    for words in made:
        for share in (0.3, 0.5, 0.9):
            texts = [" ".join(words), misspelt(words, share, rnd)]
            assert lines.edit_similarity(*texts) >= 0.8 and list(lines._connect(texts, 0.8))
    # of 20 words 14 are the same, and a block
    made = [["".join(rnd.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(20)] for _ in range(100)]
    pairs = [(" ".join(w), misspelt(w, 0.3, rnd)) for w in made]
    met = [(a, b) for a, b in pairs if line_blocks(a) & line_blocks(b)]
    group = {r.text: r.group for r in occurred(spark, [t for p in met for t in p])}
    assert len(met) > 5 and all(group[a] == group[b] for a, b in met) and len(set(group.values())) == len(met)


def test_short_lines(spark):
    """Of lines of up to 14 letters every link is found."""
    rnd = random.Random(18)
    texts = {"doie.", "die.", "and!! ornd.", "and ornd.", "eding enin.", "eding in.", "la, ra.", "la, ja.", "héé", "hé", "é漢字ab", "é漢ab"}
    for _ in range(60):
        a = "".join(rnd.choice("abcdefghé ") for _ in range(rnd.randint(3, 14)))
        texts |= {a, a[:-1], a[1:], a[1:-1], "x" + a[:13], a[:3] + "y" + a[4:], a[:2] + "q" + a[2:6] + a[7:]}
    texts = sorted({" ".join(t.split()) for t in texts} - {""})
    texts = [t for t in texts if len(t) <= 14]
    group = {r.text: r.group for r in occurred(spark, texts)}
    links = [(i, j) for i in range(len(texts)) for j in range(i) if lines.edit_similarity(texts[i], texts[j]) >= 0.8]
    assert len(links) > 100 and all(group[texts[i]] == group[texts[j]] for i, j in links)
    assert len(set(group.values())) == len(set(grouped(links, range(len(texts))).values()))


def line_blocks(text):
    import numpy as np

    _, words = lines._distinct(*lines._split(text.encode())[1:3])
    return set(lines.blocks(words, np.array([len(words)]))[1].tolist())


def test_split():
    """Words, lines and their normal form, as Python splits them."""
    rnd = random.Random(17)
    made = ["", " ", "\n", "a", " a b \x0b c\t\td\n\n x  y ", "\r\n\r\n", "\x1c a \x1f b\x85", "a" * 9000 + " " + "b" * 5000, "é è\nê " * 300_000]
    made += ["".join(rnd.choice(" ab\n\t\r\x0bé") for _ in range(rnd.randrange(40))) for _ in range(300)]
    of_words = {}
    for text in made:
        plain = [line.split() for line in text.encode().split(b"\n")]
        at, of, hashes, texts = lines._split(text.encode())
        assert texts == [b" ".join(w) for w in plain if w] and at.tolist() == [k for k, w in enumerate(plain) if w]
        assert of.tolist() == [k for k, w in enumerate(w for w in plain if w) for _ in w]
        for h, w in zip(hashes.tolist(), (w for some in plain for w in some)):
            assert of_words.setdefault(w, h) == h
    assert len(set(of_words.values())) == len(of_words) > 80


def test_all_similar():
    """Many comparisons at once say what each says, at the threshold, too."""
    rnd = random.Random(16)
    pairs = []
    for size in [0, 1, 4, 5, 9, 10, 63, 64, 65, 100, 127, 128, 129, 130, 190, 200, 250, 640, 5000]:
        letters = rnd.choice(["ab ", "abcdefgh ", "añ漢😀 "])
        for _ in range(6 if size > 1000 else 60):
            a = "".join(rnd.choice(letters) for _ in range(size + rnd.randrange(3)))
            b = list(a)
            for _ in range(max(0, len(a) // 5 + rnd.randrange(-2, 3))):
                at, what = rnd.randrange(len(b) + 1), rnd.randrange(4)
                b[at : at + (what > 0)] = [] if what == 1 else [rnd.choice("xyz")]
            pairs.append((a, "".join(b)) if rnd.random() < 0.8 else (a, "".join(rnd.choice(letters) for _ in a)))
    want = [lines.edit_similarity(a, b) >= 0.8 for a, b in pairs]
    assert 200 < sum(want) < len(want) - 200
    assert lines.all_similar(pairs, 0.8).tolist() == want
    assert lines.all_similar(pairs * 4, 0.8).tolist() == want * 4
    assert lines.all_similar(pairs * 4, 0.65).tolist() == [lines.edit_similarity(a, b, 0.65) >= 0.65 for a, b in pairs] * 4
    assert lines.all_similar([], 0.8).tolist() == []
    near = []
    for size in range(200, 320):
        a = "".join(rnd.choice("abcdefgh ") for _ in range(size))
        near += [(a, a[: size // 2] + "x" * n + a[size // 2 + rnd.randrange(4) :]) for n in (1, size // 20, size // 20 + 1, size // 15)]
    want = [lines.edit_similarity(a, b) >= 0.95 for a, b in near]
    assert 50 < sum(want) < len(want) - 50 and lines.all_similar(near, 0.95).tolist() == want


def test_edit_similarity():
    rnd = random.Random(1)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return 1 - row[-1] / max(len(a), len(b), 1)

    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 90))) for _ in range(2))
        want = plain(a, b)
        assert abs(lines.edit_similarity(a, b) - want) < 1e-12
        assert (lines.edit_similarity(a, b, 0.8) >= 0.8) == (want >= 0.8)


def test_range_number(spark):
    import numpy as np

    cuts = np.array([5, 9, 9, 14, 70, 71, 200])
    got = spark.createDataFrame([(i,) for i in [None, *range(0, 210, 3), 5, 9, 14, 70, 71, 200]], "i long").select("i", common.range_number(F.col("i"), cuts).alias("n")).collect()
    assert all(r.n == (len(cuts) + 1 if r.i is None else int(np.searchsorted(cuts, r.i))) for r in got)


def test_pieces_tell_long_lines_apart(monkeypatch):
    """Long lines that differ all over are told apart by their pieces, without a comparison; similar ones never are."""
    rnd = random.Random(18)
    line = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randrange(3, 9))) for _ in range(n))
    apart = [(line(n), line(n)) for n in (40, 90, 250) for _ in range(20)]
    near = []
    for size in (65, 128, 129, 300, 900):
        for least in (0.65, 0.8, 0.95) * 40:
            a = [rnd.choice(rnd.choice(["ab", "abcdefgh ", "añ漢😀 "])) for _ in range(size)]
            b = list(a)
            for _ in range(rnd.randrange(int((1 - least) * size) + 2)):
                at, what = rnd.randrange(len(b) + 1), rnd.randrange(3)
                b[at : at + (what > 0)] = [] if what == 1 else [rnd.choice("abx")]
            # all that is left out in one place, too
            near += [("".join(a), "".join(b), least), ("".join(a), "".join(a[rnd.randrange(int((1 - least) * size) + 1) :]), least)]
    for least in (0.65, 0.8, 0.95):
        pairs = [(a, b) if len(a) >= len(b) else (b, a) for a, b, asked in near if asked == least]
        alike = [lines.edit_similarity(a, b) >= least for a, b in pairs]
        assert sum(alike) > 100 and not any(yes and far for yes, far in zip(alike, lines._far(pairs, least)))
    asked = []
    monkeypatch.setattr(lines, "edit_similarity", lambda *x: asked.append(x) or 0.0)
    monkeypatch.setattr(lines, "_all_within", lambda pairs, *_: asked.extend(pairs) or [False] * len(pairs))
    assert not lines.all_similar(apart, 0.8).any() and not asked


def test_companies_of_a_chain(monkeypatch):
    """What is connected in one company is not compared again in the next; the groups are those of each by itself."""
    rnd = random.Random(19)
    texts = sorted(set(changed_lines()))[:200]
    companies = [texts[k : k + 60] for k in range(0, 200, 45)] + [rnd.sample(texts, 30) for _ in range(6)]
    of = lambda found: [(texts.index(c[i]), texts.index(c[j])) for c, some in zip(companies, found) for i, j in some]
    alone = of([lines._connect(c, 0.8) for c in companies])
    chained = of(lines._connect_all([companies], 0.8)[0])
    assert grouped(chained, range(len(texts))) == grouped(alone, range(len(texts)))
    compared = []
    shown, many = lines._shown, lines.all_similar
    monkeypatch.setattr(lines, "_shown", lambda *x: compared.append(x) or shown(*x))
    monkeypatch.setattr(lines, "all_similar", lambda pairs, least: compared.extend(pairs) or many(pairs, least))
    words = max(texts, key=len).split()
    near = [" ".join(words[:k] + words[k + 1 :]) for k in range(20)]
    lines._connect(near, 0.8)
    once = len(compared)
    found = lines._connect_all([[near, near[5:], near[:9]]], 0.8)[0]
    assert len(found[0]) == 19 and not any(found[1:]) and len(compared) == 2 * once > 0
