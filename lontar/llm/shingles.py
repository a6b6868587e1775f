"""Near duplicates by word shingles: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints of such documents differ in about 10 of 64 bits and in RADIUS at most; pigeonhole blocks for that would be
two bits wide. So shards come from MinHash bands: sets of similarity 0.8 agree in one of BANDS bands of ROWS values with
probability 1 - (1 - 0.8^5)^24 = 0.9999. Each shard is searched with its BK-tree. Documents linked so are candidates:
each group of them meets once with its texts, and pairs are linked by the exact similarity of their whole sets. A group
must fit a task. Equal sets are one node, however many documents have them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, forget, identity, join_counted, keep_first
from .lines import _groups, _links
from .simhash import SEED, _shards

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, RADIUS = 24, 5, 24
_PERMUTED = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_CHUNK = 1 << 12


def shingles(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ASCII-lower-cased words; a shorter text is one shingle, none without
    words."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 where their sizes cannot reach `least`."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _fingerprint(hashes: np.ndarray) -> int:
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        count += np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _bands(hashes: np.ndarray) -> list[int]:
    """A key for each band; none without shingles."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        np.minimum(least, ((hashes[at : at + _CHUNK] ^ _PERMUTED[0]) * (_PERMUTED[1] | np.uint64(1))).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(v.tobytes(), k) - (1 << 63) for k, v in enumerate(least.reshape(BANDS, ROWS))]


def _key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def _prints(batches):
    for batch in batches:
        sets = [shingles(t or b"") for t in batch.column(4).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(map(_key, sets), pa.int64()), pa.array(map(_fingerprint, sets), pa.int64()), pa.array(map(_bands, sets), pa.list_(pa.int64()))],
            names=["doc_id", "a", "b", "written", "key", "fp", "bands"],
        )


def _linked(fp: np.ndarray, sets: list[np.ndarray], least: float, radius: int):
    """Pairs (i, j) that connect all sets at least so similar; what is connected already is not compared again."""
    label = np.arange(len(sets))
    for i in range(1, len(sets)):
        near = np.flatnonzero(np.bitwise_count(fp[:i] ^ fp[i]) <= radius)
        while len(near):
            j = near[-1]
            if similarity(sets[i], sets[j], least) >= least:
                yield i, j
                label[label == label[i]] = label[j]
                near = near[label[near] != label[j]]
            else:
                near = near[:-1]


def _verified(least: float, radius: int):
    """(candidates, key, fp, text) sorted by candidates, to links between keys."""

    def run(batches):
        out, held = [], 0
        for _, key, fp, texts in _groups(batches):
            pairs = list(_linked(fp.view(np.uint64), [shingles(t.encode() if isinstance(t, str) else t or b"") for t in texts], least, radius))
            if pairs:
                i, j = (list(x) for x in zip(*pairs))
                out.append((key[i], key[j]))
                held += len(i)
            if held > 50_000:
                yield _links(out)
                out, held = [], 0
        if out:
            yield _links(out)

    return run


def _rooted(docs: DataFrame, least: float, radius: int) -> DataFrame:
    """(doc_id, a, b, root, component_id) for each row of docs: identity(), the key that names its component, and the
    smallest doc_id in it."""
    of = identity(docs)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), of["a"].alias("a"), of["b"].alias("b"), F.xxhash64(text).alias("written"), text.alias("text"))
    prints = checkpoint(rows.mapInArrow(_prints, "doc_id long, a long, b long, written long, key long, fp long, bands array<long>"))
    nodes = checkpoint(prints.groupBy("key").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("least"), F.min("written").alias("written"), F.count("*").alias("n"), F.first("bands").alias("bands")))
    dealt = nodes.select(F.explode("bands").alias("shard"), "fp").repartition("shard").sortWithinPartitions("shard")
    near = components(dealt.mapInArrow(_shards(radius), "a long, b long"))
    met = nodes.join(near, nodes.fp == near.node, "left").select("key", "fp", "written", F.coalesce("root", "fp").alias("candidates"))
    several = met.groupBy("candidates").count().where("count > 1").select("candidates")
    asked = checkpoint(met.join(several, "candidates").select("candidates", "key", "fp", "written"))
    texts = rows.select("written", "text").join(asked, "written").groupBy("candidates", "key", "fp").agg(F.first("text").alias("text"))
    pairs = texts.select("candidates", "key", "fp", "text").repartition("candidates").sortWithinPartitions("candidates")
    roots = components(pairs.mapInArrow(_verified(least, radius), "a long, b long"))
    rooted = checkpoint(nodes.join(roots, nodes.key == roots.node, "left").select("key", "least", "n", F.coalesce("root", "key").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("of"))
    named = checkpoint(join_counted(rooted.drop("least"), smallest, "root", "of"))
    forget(nodes, asked, rooted)
    return join_counted(prints.select("doc_id", "a", "b", "key"), named, "key", "n").select("doc_id", "a", "b", "root", "component_id")


def groups(docs: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, component_id) for each row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links of similar sets, the row's own included. Null and empty
    texts have the same empty set. A null doc_id takes part but is never the smallest unless its whole component has
    none. Repeated rows come back as often as they went in. Empty input: no rows."""
    return _rooted(docs.select("doc_id", "text"), least, radius).select("doc_id", "component_id")


def keep_one(docs: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row of docs of each component, that of the smallest doc_id; all columns stay. Rows are told apart by all
    their columns: of rows that share the smallest doc_id the one of the smallest hash stays, equal rows are one, and a
    row without doc_id stays only where its whole component has none. Empty input: no rows."""
    return keep_first(docs, _rooted(docs, least, radius).select("a", "b", "doc_id", "root"))
