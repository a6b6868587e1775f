"""SimHash near-duplicates: exact search within a Hamming radius by BK-trees over pigeonhole shards.

Fingerprints that differ in at most `radius` bits agree on at least one of radius + 1 blocks of the 64 bits, so each
fingerprint goes to one shard per block; a shard holds the fingerprints that share the block's value and is searched
with its own BK-tree. Shard trees are built where their queries already are and not broadcast: together they grow with
the corpus. Equal fingerprints are one tree node, however many documents carry them. A shard above `hot` members is
dealt again by blocks of its other 48 bits, which keeps every link for the same reason."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, forget, identity, join_counted, keep_first, local_forest

SEED, RADIUS, HOT = 42, 3, 2048
_CHUNK = 1 << 15


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of ASCII-lower-cased words in shingles of three, repeats included; 0 without words."""
    words = data.lower().split()
    n = len(words)
    if not n:
        return 0
    if n < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    total = n - shingle + 1
    for at in range(0, total, _CHUNK):
        end = min(at + _CHUNK, total)
        runs = zip(*(words[at + k : end + k] for k in range(shingle)))
        hashes = np.fromiter((digest(s, SEED) for s in map(b" ".join, runs)), np.uint64, end - at)
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(count * 2 > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        fps = np.fromiter((fingerprint(t or b"") for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])


def _carried_fingerprints(batches):
    for batch in batches:
        for part in _fingerprints([batch]):
            yield pa.RecordBatch.from_arrays([*part.columns, batch.column(2), batch.column(3)], names=["doc_id", "fp", "a", "b"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int) -> int:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        at = 0
        while new:
            d = (value ^ self.values[at]).bit_count()
            child = self.children[at].get(d)
            if child is None:
                self.children[at][d] = new
                break
            at = child
        return new

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at most radius away; only edges within the radius of the distance are followed."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            stack += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]
        return found


def _small(values: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    tree, a, b = BKTree(), [], []
    for v in values.tolist():
        for near in tree.within(v, radius):
            a.append(v)
            b.append(tree.values[near])
        tree.insert(v)
    return a, b


def _large(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The same search with all queries of a shard going down its tree together; returns a spanning forest."""
    a, b, held = [], [], 0
    stack = [(np.arange(len(values)), np.arange(len(values)))]
    while stack:
        members, asking = stack.pop()
        root = values[members[0]]
        d = np.bitwise_count(values[asking] ^ root).astype(np.int64)
        near = asking[d <= radius]
        near = near[near > members[0]]
        a.append(values[near])
        b.append(np.full(len(near), root))
        held += len(near)
        if held > 1_000_000:
            x, y = local_forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], 0
        rest = members[1:]
        to = np.bitwise_count(values[rest] ^ root)
        for e in np.unique(to).tolist():
            if len(go := asking[abs(d - e) <= radius]):
                stack.append((rest[to == e], go))
    return np.concatenate(a), np.concatenate(b)


def _shards(radius: int):
    def links(batches):
        key_held, held = None, []

        def solve(values: np.ndarray):
            values = np.unique(values)
            if len(values) < 2:
                return [], []
            x, y = _small(values, radius) if len(values) <= 48 else _large(values, radius)
            x, y = np.array(x, np.uint64).view(np.int64), np.array(y, np.uint64).view(np.int64)
            return local_forest(x, y) if len(x) > len(values) else (x, y)

        def out(a: list, b: list):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).astype(np.int64)), pa.array(np.concatenate(b).astype(np.int64))], names=["a", "b"])

        a, b = [], []
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if key[lo] != key_held:
                    if len(held) > 1 or held and len(held[0]) > 1:
                        x, y = solve(np.concatenate(held))
                        if len(x):
                            a.append(np.asarray(x, np.int64))
                            b.append(np.asarray(y, np.int64))
                    key_held, held = key[lo], []
                held.append(fp[lo:hi])
            if sum(map(len, a)) > 50_000:
                yield out(a, b)
                a, b = [], []
        if held:
            x, y = solve(np.concatenate(held))
            if len(x):
                a.append(np.asarray(x, np.int64))
                b.append(np.asarray(y, np.int64))
        if a:
            yield out(a, b)

    return links


def deal(rows: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """rows with a column shard added, radius + 1 times or more: any two rows whose fp differ in at most `radius` bits
    meet in a shard. A block value with more than `hot` rows is dealt again by blocks of the other bits."""
    blocks = radius + 1
    width, sub = 64 // blocks, (64 - 64 // blocks) // blocks
    if width * blocks != 64 or width > 16:
        raise ValueError("radius + 1 must divide 64 and be 4 at least")

    def block(col, k: int, bits: int):
        return F.shiftrightunsigned(col, k * bits).bitwiseAND((1 << bits) - 1)

    columns = rows.columns
    keyed = rows.select(*columns, F.posexplode(F.array(*[block(F.col("fp"), k, width) for k in range(blocks)])).alias("_k", "_v"))
    crowded = keyed.groupBy("_k", "_v").count().where(F.col("count") > hot).select("_k", "_v", F.lit(True).alias("_crowded"))
    # a block has at most 65,536 values, so there are few crowded ones however many rows
    keyed = keyed.join(F.broadcast(crowded), ["_k", "_v"], "left")
    # the bits besides block k, moved together
    upper = F.when(F.col("_k") == blocks - 1, F.lit(0).cast("long")).otherwise(F.expr(f"shiftleft(shiftrightunsigned(fp, cast(least((_k + 1) * {width}, 63) as int)), cast(_k * {width} as int))"))
    rest = upper.bitwiseOR(F.expr(f"fp & (shiftleft(1L, cast(_k * {width} as int)) - 1)"))
    once = F.array(F.struct(F.lit(-1).alias("s"), F.lit(0).cast("long").alias("u")))
    again = F.array(*[F.struct(F.lit(s).alias("s"), block(F.col("_rest"), s, sub).alias("u")) for s in range(blocks)])
    dealt = keyed.withColumn("_rest", rest).select(*columns, "_k", "_v", F.explode(F.when(F.col("_crowded"), again).otherwise(once)).alias("_x"))
    # block, value, second block and its value side by side: a key of its own for each shard
    shard = F.expr("shiftleft(cast(_k as long), 40) | shiftleft(_v, 24) | shiftleft(cast(_x.s + 1 as long), 16) | _x.u")
    return dealt.select(*columns, shard.alias("shard"))


def near_links(fps: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(a, b) links that connect all distinct fingerprints (column fp) at most `radius` bits apart: a spanning forest
    of each shard, not all pairs."""
    dealt = deal(fps.select("fp"), radius, hot).select("shard", "fp")
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shards(radius), "a long, b long")


def _rooted(fps: DataFrame, radius: int, hot: int) -> DataFrame:
    """Checkpointed rows with a column fp, and for each the fingerprint that names its component (root) and the smallest
    doc_id in it."""
    nodes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(near_links(nodes, radius, hot))
    rooted = checkpoint(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("of"))
    named = checkpoint(join_counted(rooted.drop("least"), least, "root", "of"))
    forget(nodes, rooted)
    return join_counted(fps, named, "fp", "n")


def groups(docs: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most `radius` differing bits, the row's own
    included. Null and empty texts share fingerprint 0. A null doc_id takes part but is never the smallest unless its
    whole component has none. Repeated rows come back as often as they went in. Empty input: no rows."""
    return _rooted(checkpoint(fingerprints(docs)), radius, hot).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """One row of docs of each component, that of the smallest doc_id; all columns stay. Rows are told apart by all
    their columns: of rows that share the smallest doc_id the one of the smallest hash stays, equal rows are one, and a
    row without doc_id stays only where its whole component has none. Empty input: no rows."""
    of = identity(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), of["a"].alias("a"), of["b"].alias("b"))
    prints = checkpoint(rows.mapInArrow(_carried_fingerprints, "doc_id long, fp long, a long, b long"))
    return keep_first(docs, _rooted(prints, radius, hot).select("a", "b", "doc_id", "root"))
