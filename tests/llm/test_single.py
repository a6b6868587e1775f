"""The other operators: round trips, brute force, planted cases and odd input."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from conftest_llm import ODD, make_docs
from pyspark.sql import functions as F

from lontar.llm import decontamination, media, mixing, secrets, sharding, tokenids, toxicity


def test_media_round_trip():
    rnd = random.Random(4)
    for n in (0, 1, 63, 64, 65, 16_384, 16_385, 100_000):
        content = media.padded(rnd.randbytes(n))
        assert len(content) % 64 == 0 and len(content) >= 64 and media.payload(media.wrap(content)) == content
    track = media.tracks(media.wrap(bytes(64 * 300)))[0]
    assert (track.codec, track.duration, len(track.sizes)) == ("raw ", 64 * 300, 300) and sum(n for _, n in track.ranges()) == 64 * 300


def test_media_keyframes():
    def box(kind, *parts):
        body = b"".join(parts)
        return struct.pack(">I4s", len(body) + 8, kind) + body

    full = lambda kind, *parts: box(kind, bytes(4), *parts)
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(8))), full(b"stsz", struct.pack(">II3I", 0, 3, 10, 20, 30)), full(b"stsc", struct.pack(">I3I3I", 2, 1, 2, 1, 2, 1, 1)), full(b"co64", struct.pack(">IQQ", 2, 400, 500)), full(b"stss", struct.pack(">III", 2, 1, 3)))
    data = box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 90_000, 3000)), full(b"hdlr", bytes(4), b"vide"), box(b"minf", stbl))))
    data += bytes(600 - len(data) - 8) and box(b"mdat", bytes(600 - len(data) - 8))
    track = media.tracks(data)[0]
    assert (track.handler, track.codec, track.timescale, track.duration, track.ranges()) == ("vide", "avc1", 90_000, 3000, [(400, 10), (500, 30)])
    for damaged in (data[:30], data[:-1], b"\0\0\0\1moov", struct.pack(">I4s", 4, b"moov")):
        with pytest.raises(media.MediaError):
            media.tracks(damaged)


def test_media_fragments():
    """A fragmented file: sizes and flags of runs, defaults of trex and tfhd, decode times, sync samples."""
    box = lambda kind, *parts: struct.pack(">I4s", sum(map(len, parts)) + 8, kind) + b"".join(parts)
    full = lambda kind, *numbers, flags=0, version=0: box(kind, struct.pack(f">{len(numbers) + 1}I", version << 24 | flags, *(n & 0xFFFFFFFF for n in numbers)))
    empty = [full(b"stsz", 0, 0), full(b"stsc", 0), full(b"stco", 0), full(b"stts", 0)]
    trak = box(b"trak", full(b"tkhd", 0, 0, 7, flags=7), box(b"mdia", full(b"mdhd", 0, 0, 1000, 0), box(b"hdlr", bytes(8), b"vide"), box(b"minf", box(b"stbl", box(b"stsd", bytes(12), b"avc1"), *empty))))
    moov = box(b"moov", trak, box(b"mvex", full(b"trex", 7, 1, 40, 5, 0x10000)))
    run = lambda offset: full(b"trun", 3, offset, 0, 10, 20, 30, flags=0x205)  # noqa: E731 first sample is sync, sizes given
    moof = lambda offset: box(b"moof", box(b"traf", full(b"tfhd", 7), full(b"tfdt", 0, 500, version=1), run(offset), full(b"trun", 2)))
    one = moof(len(moof(0)) + 8)
    data = moov + one + box(b"mdat", bytes(70)) + moof(len(moof(0)) + 8) + box(b"mdat", bytes(70))
    (track,) = media.tracks(data)
    first = len(moov) + len(one) + 8
    assert (track.codec, track.timescale, track.sizes.tolist(), track.times.tolist()[:6]) == ("avc1", 1000, [10, 20, 30, 5, 5] * 2, [500, 540, 580, 620, 660, 500])
    assert track.offsets.tolist()[:5] == [first, first + 10, first + 30, first + 60, first + 65] and track.sync.tolist() == [0, 5] and track.duration == 700
    assert track.ranges() == [(first, 10), (first + 70 + len(one) + 8, 10)]
    for damaged in (moov + one, data.replace(b"tfhd", b"tfhx", 1), data[: -len(bytes(70)) + 3]):
        with pytest.raises(media.MediaError):
            media.tracks(damaged)


def test_media_damage():
    """Bytes changed or cut off anywhere give a container or MediaError, never another error."""
    whole, rnd = media.wrap(media.padded(bytes(5000))), random.Random(1)
    for _ in range(3000):
        data = bytearray(whole)
        for _ in range(rnd.randint(1, 3)):
            data[rnd.randrange(700)] = rnd.choice([0, 1, 255, rnd.randrange(256)])
        told, error = media._told(bytes(data[: rnd.choice([len(data), rnd.randrange(len(data))])]))
        assert (told is None) != (error is None)
    deep = b"".join(struct.pack(">I4s", 8 * (1500 - k), b"moov") for k in range(1500))
    assert media._told(deep)[1] and media._told(b"") == ([], None) and media._told(None) == (None, None)
    assert media._told(struct.pack(">I4sI4sI4sI4sI4s", 40, b"moov", 32, b"trak", 24, b"mdia", 8, b"mdhd", 8, b"hdlr"))[1]
    huge = whole.replace(struct.pack(">II", 64, 79), struct.pack(">II", 64, 1 << 31))
    assert huge != whole and media._told(huge)[1]


def test_media_column(spark):
    stored = media.store_texts(make_docs(spark, ODD))
    got = media.digests(stored).collect()
    assert len(got) == len(ODD)
    for r in got:
        text = {i: t for i, t in ODD}[r.doc_id] or ""
        want = media.padded(text.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        form = media.wrap(want)
        at = form.index(want, form.index(b"mdat"))
        assert (r.media_bytes, r.media_sha256, form[at:]) == (len(form), hashlib.sha256(form).hexdigest(), want)
        assert r.feature == f"soun/raw/8000;duration={len(want)};samples={len(want) // 64};keyframes={at}+{len(want)}"
    told = {r.doc_id: r for r in media.describe(stored.withColumn("media", F.when(F.col("doc_id") == 7, F.lit(b"xx").cast("binary")).when(F.col("doc_id") != 1, F.col("media"))), "doc_id", "media").collect()}
    assert told[1].tracks is None and told[1].error is None and told[7].error and told[6].tracks[0].n_samples == -(-150_000 // 64)


def test_rans_round_trip():
    rnd = np.random.default_rng(1)
    for n, lanes in ((0, 1), (1, 1), (5, 3), (1000, 7), (50_000, 64)):
        ids = np.minimum(rnd.geometric(0.01, n), 5000) if n else np.empty(0, np.int64)
        table = tokenids.Table.of({int(i): int(c) for i, c in zip(*np.unique(ids, return_counts=True))} or {0: 1})
        assert int(table.freq.sum()) == 1 << tokenids.SCALE_BITS
        state, words = tokenids.encode_ids(ids, table, lanes)
        assert np.array_equal(tokenids.decode_ids(n, state, words, table, table.symbols()), ids)
    table = tokenids.Table.of({i: 1 for i in range(60_000)})
    assert int(table.freq.sum()) == 1 << tokenids.SCALE_BITS and table.freq.min() >= 1
    block = tokenids.write_block([3, None], [2, 1], np.array([5, 6, 7]), 9, table)
    doc_ids, lengths, ids, start = tokenids.read_block(block, table, table.symbols())
    assert (doc_ids, lengths.tolist(), ids.tolist(), start) == ([3, None], [2, 1], [5, 6, 7], 9)
    with pytest.raises(ValueError):
        tokenids.read_block(block[:60] + bytes([block[60] ^ 1]) + block[61:], table, table.symbols())


def test_token_files(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [*ODD, (9, "Hal, ini. 12x! <|ENDOFTEXT|> b́ ΑΣ 中文"), (10, "we'll 'tis it's.")]
    blocks, table = tokenids.write(make_docs(spark, rows), path, f"file://{tmp_path}/out")
    got = tokenids.read(blocks, table, f"file://{tmp_path}/out").collect()
    coder, at, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), ids))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, list(r.ids)) for r in got), key=lambda r: r[1]) == want
    assert tokenids.read(*tokenids.write(make_docs(spark, rows).where("false"), path, f"file://{tmp_path}/none"), f"file://{tmp_path}/none").count() == 0


def test_mixing(spark):
    rnd = random.Random(6)
    rows = [(i, f"{['a', 'b', 'c', 'd', 'e', None][rnd.choice([0, 0, 0, 0, 1, 2, 3, 4, 5])]}", rnd.randint(0, 30)) for i in range(600)]
    df = spark.createDataFrame([(i, "x " * n, None if s == "None" else s) for i, s, n in rows], "doc_id long, text string, source string")
    plan = mixing.plan(df.repartition(5)).collect()
    sizes = {}
    for i, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s == "None", s))
    weight, target, open_ = {s: k % 3 + 1 for k, s in enumerate(names)}, {}, set(names)
    left = total = sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            open_.remove(s)
    by_id, taken = {i: s for i, s, _ in rows}, {}
    for r in plan:
        s = by_id[r.doc_id]
        assert abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] and 0 <= r.copies <= 3
        taken[s] = taken.get(s, 0) + r.size * r.copies
    assert sum(taken.values()) <= total and all(abs(taken[s] - target[s]) <= 60 for s in names)
    again = mixing.plan(df.repartition(2)).collect()
    assert sorted((r.doc_id, r.copies) for r in plan) == sorted((r.doc_id, r.copies) for r in again)
    assert mixing.mix(df).count() == sum(r.copies for r in plan)


def test_mixing_odd(spark):
    got = mixing.plan(make_docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r.doc_id: r.size for r in got}[6] == 30_000 and all(r.copies == 0 for r in got if not r.size)
    assert mixing.mix(make_docs(spark, ODD)).columns == make_docs(spark, ODD).columns
    assert mixing.plan(make_docs(spark, ODD).where("false")).count() == 0


def test_sharding(spark):
    rnd = random.Random(8)
    rows = [(i, "x" * rnd.randint(0, 200)) for i in range(400)] + [(1000, "y" * 5000)] + [(1001, "z" * 300)] * 8
    got = sharding.shards(make_docs(spark, rows), limit=1000).collect()
    assert len(got) == len(rows)
    total = {}
    for r in got:
        total.setdefault((r["shard"], r.shard_page), []).append(r.n_bytes)
        assert len(r["shard"]) == r.shard_depth
    assert all(sum(v) <= 1000 or len(v) == 1 for v in total.values())
    shards = {s for s, _ in total}
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    parents = {}
    for (s, _), v in total.items():
        for d in range(len(s)):
            parents[s[:d]] = parents.get(s[:d], 0) + sum(v)
    assert all(v > 1000 for v in parents.values())
    assert len(sharding.shards(make_docs(spark, ODD)).collect()) == len(ODD) and sharding.shards(make_docs(spark, ODD).where("false")).count() == 0


def test_added_columns_leave_the_others(spark):
    """Names that the operators use inside do no harm, those they add are replaced."""
    inside = ["_depth", "_cell", "_found", "_fit", "_h", "h", "depth", "cell", "found", "fit", "ways", "way", "page", "_row", "_toxic"]
    docs = spark.createDataFrame([(1, "satu " * 400), (1, "satu " * 400), (2, None), (None, "dua")], "doc_id long, text string").repartition(3)
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(inside)], F.lit(-1).alias("shard"), F.lit(-1).alias("toxic_score"))
    for got, new in ((sharding.shards(docs, 1000), ["n_bytes", "shard_depth", "shard", "shard_page"]), (toxicity.score(docs, toxicity.Model({}, -1.0, a=-5.0)), ["toxic_score", "toxic_passages"])):
        assert got.columns == [c for c in docs.columns if c not in new] + new and got.count() == 4
        assert all(r[c] == k for r in got.collect() for k, c in enumerate(inside))
    assert sorted((r.doc_id or 0, r.shard_page) for r in sharding.shards(docs, 1000).collect()) == [(0, 0), (1, 0), (1, 1), (2, 0)]
    assert toxicity.score(docs.where("false"), toxicity.Model({}, -1.0)).count() == 0


def test_many_equal_rows_page(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PAGED_ROWS", 10)
    docs = spark.createDataFrame([(1, "x" * 30)] * 95, "doc_id long, text string").repartition(5)
    pages = {}
    for r in sharding.shards(docs, 100).collect():
        pages[r.shard_page] = pages.get(r.shard_page, 0) + r.n_bytes
    assert sum(pages.values()) == 95 * 30 and max(pages.values()) <= 100


def test_decontamination(spark):
    item = "Seorang pedagang membeli 12 kg beras seharga 5.000 rupiah lalu Budi menjual 12 kg itu dalam 3 hari saja"
    bench = spark.createDataFrame([(1, item), (2, "hal pendek sekali"), (3, None), (None, item)], "item_id long, text string")
    docs = make_docs(spark, [(10, f"Awal kata. {item} akhir"), (11, "xx " + item.replace("12", "40").replace("5.000", "7,500").replace("Budi", "Siti")), (12, item.replace("12 kg beras", "40 kg beras")), (13, "kalimat lain " * 40), (14, "HAL pendek, sekali"), *ODD])
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()) == [(10, 1), (11, 1), (14, 2)]
    clean = decontamination.clean(docs, bench)
    assert {r.doc_id for r in clean.collect()} == {12, 13, *(i for i, _ in ODD)} and clean.columns == docs.columns
    assert decontamination.contaminated(docs, bench.where("false")).count() == 0 and decontamination.contaminated(docs.where("false"), bench).count() == 0


def test_segments():
    rnd = random.Random(9)
    for _ in range(200):
        n = rnd.randint(1, 30)
        score = [-1.0 if rnd.random() < 0.6 else rnd.uniform(0.5, 3.5) for _ in range(n)]
        got = toxicity.segments([(i, s) for i, s in enumerate(score) if s > 0], -1.0)
        want = _maximal(score, 0, n)
        assert [(a, b) for a, b, _ in got] == want and all(abs(sum(score[a : b + 1]) - s) < 1e-9 for a, b, s in got)


def _maximal(score, lo, hi):
    """All maximal segments by definition: the best one, then the rest on both sides of it."""
    best, span = 0.0, None
    for a in range(lo, hi):
        total = 0.0
        for b in range(a, hi):
            total += score[b]
            if total > best:
                best, span = total, (a, b)
    return _maximal(score, lo, span[0]) + [span] + _maximal(score, span[1] + 1, hi) if span else []


def test_toxicity(spark):
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(6))
    rows, labels = [], []
    for i in range(500):
        words = [word() for _ in range(rnd.randint(5, 80))]
        bad = i % 6 == 0
        if bad:
            words.insert(rnd.randrange(len(words)), "grompel" + rnd.choice(["", "an", "ku", "is"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, truth = make_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, truth)
    got = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    said = {r.doc_id: r.toxic_score >= toxicity.THRESHOLD for r in got if r.held}
    assert len(said) > 80 and all(said[i] == bool(y) for i, y in labels if i in said)
    odd = toxicity.score(make_docs(spark, ODD), model)
    assert odd.count() == len(ODD) and all(0 <= r.toxic_score < 0.3 for r in odd.collect())
    none = toxicity.train(docs, truth.where("false"))
    assert all(r.toxic_score < 0.3 for r in toxicity.score(docs, none).collect())
    assert toxicity.spans(docs, model).where("doc_id % 6 = 0").count() >= 80 and toxicity.spans(docs, model).where("doc_id % 6 > 0").count() == 0


def test_scores_by_definition(spark):
    """Scores of the query's texts worked out word by word, with segments by their definition; the stage keeps by them."""
    import math
    import re

    import corpus_pipeline
    from conftest import SMALL

    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = {r.doc_id: (r.text, r.toxic_score) for r in toxicity.score(docs, model).collect()}
    compared = 0
    for text, score in got.values():
        words = re.findall(r"\w+", (text or "").lower())
        if len(words) > 400:
            continue
        scores = [max([model.score.get(f, 0.0) for f in [w, *(w[:n] + "-" for n in range(3, min(9, len(w))))]]) or model.rest for w in words]
        evidence = 0.0
        for a, b in _maximal(scores, 0, len(words)):
            x = sum(scores[a : b + 1]) - math.log(model.k * len(words))
            evidence += x if x > -math.log(toxicity.MAX_E) else 0.0
        assert abs(score - 1 / (1 + math.exp(-(model.a + model.b * evidence)))) < 1e-9
        compared += 1
    assert compared > 100
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, SMALL).collect()}
    assert kept == {i for i, (_, score) in got.items() if score < toxicity.THRESHOLD}


def secret_docs():
    rnd = random.Random(11)
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(240):
        plain = [f"kata{'x' * (i % 5)}" for _ in range(6)]
        plain.insert(3, [f"AKIA{hexes(16).upper()}", f"password={hexes(18)}", f'token = "{hexes(40)}"', "42.144.35.254", f"surat.{i}@mail8.example.com", f"40418949746{i:05d}"][i % 6])
        rows.append((i, " ".join(plain)))
    return rows


def test_secrets(spark):
    rows = secret_docs()
    docs = make_docs(spark, [*rows, *ODD])
    found = secrets.scan(docs).collect()
    assert {r.doc_id for r in found if r.secret_score >= 0.5} == {i for i in range(240) if i % 6 < 3}
    assert secrets.scan(make_docs(spark, ODD)).count() == 0 and secrets.scan(make_docs(spark, ODD).where("false")).count() == 0
    again = secrets.scan(docs.repartition(7)).collect()
    told = lambda some: sorted((r.doc_id, r["at"], round(r.secret_score, 9)) for r in some)
    assert told(found) == told(again)
    n, precision, recall = secrets.held_out_quality(docs)
    assert n > 30 and precision >= 0.95 and recall >= 0.95


def test_secret_features(spark):
    """Features by the words of their definition."""
    import re

    docs = make_docs(spark, [*secret_docs()[:60], (900, "password: CorrectHorse satu"), (901, 'api_key="abc12345XY", lalu kata12345678')])
    words = secrets.dictionary(docs)
    got = {(r.doc_id, r["at"]): r for r in secrets.findings(docs, words).collect()}
    assert got[900, 1].value == "CorrectHorse" and got[901, 0].value == "abc12345XY" and got[901, 0].key == "api_key"
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = 0
    for (doc, at), r in got.items():
        split = texts[doc].split()
        v, before, after = r.value, split[at - 1] if at else "", split[at + 1] if at + 1 < len(split) else ""
        kind = "".join("a" if c.isascii() and c.islower() else "A" if c.isascii() and c.isupper() else "0" if c.isdigit() else c for c in v)
        turns = len(re.sub(r"(.)\1+", r"\1", kind))
        vowels = re.sub(r"(.)\1+", r"\1", "".join("v" if c in "aeiou" else "c" if c.isascii() and c.isalpha() else "0" if c.isdigit() else c for c in v.lower()))
        parts = [p for p in re.split("[^a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", v).lower()) if p in words]
        plain = lambda w: float(re.sub("[^a-z]", "", w.lower()) in words)
        want = [len(v), sum(c.isdigit() for c in v) / len(v), sum("A" <= c <= "Z" for c in v) / len(v), sum(not (c.isascii() and c.isalnum()) for c in v) / len(v), len(set(v)) / len(v), turns / len(v), len(vowels) / len(v), sum(map(len, parts)) / len(v), plain(after), plain(before)]
        have = [r[f] for f in ("f_length", "f_digits", "f_upper", "f_marks", "f_distinct", "f_classes", "f_vowels", "f_dictionary", "f_next", "f_before")]
        assert all(abs(a - b) < 1e-9 for a, b in zip(want, have)), (v, want, have)
        seen += 1
    assert seen >= 60


def test_capitals_in_texts_with_special_letters():
    """Ids are those of the tokenizer for capitals beside the letters that special tokens begin with, with and without others."""
    import public_tokenizers
    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    special = min(tokenids.WordCoder(path).starts)
    for texts in ([f"Hello {special} World"], [f"HELLO, WORLD. {special}x"], [f"Hello {special} Wörld É"], ["Hello World. É", f"{special}Hello World", "", "hello"]):
        (ids, n), (want, m) = (c(path).encode(pa.array(texts), 2) for c in (tokenids.WordCoder, tokenids.TextCoder))
        assert ids.tolist() == want.tolist() and n.tolist() == m.tolist()
