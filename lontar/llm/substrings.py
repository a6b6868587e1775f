"""Substring deduplication with a log-structured fingerprint index.

Documents are taken in order of doc_id as batches of bounded size. Every window of 13 words has a 48-bit fingerprint;
the index holds, for each, the first batch that has it. The index is a set of sorted immutable runs, cut into buckets
by the leading bits: a generation of batches is merge-joined with all runs bucket by bucket, what is new becomes a run
of its own, and runs of one tier are compacted into one of the next. A match in the index is only a candidate. It is
verified with an independent 64-bit hash of the words, computed again from the text of both sides; repeats within a
batch are found where the batch is cut. Tasks send each fingerprint of a batch once, so a passage that every document
has costs one entry a batch and task."""

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import names, range_number, released_shuffles, remove, scratch, stage

WINDOW = 13
#: Text bytes of a batch, generations of an ingest, entries of an index bucket, windows a task holds before it sorts.
BATCH_BYTES, GENERATIONS, BUCKET_ENTRIES, HELD = 8 << 20, 3, 1 << 20, 2_000_000
_BITS = 48


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _rolled(h: np.ndarray, factor: int, size: int) -> np.ndarray:
    n = len(h) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    if n > 0:
        for k in range(size):
            out *= np.uint64(factor)
            out += h[k : k + n]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out


def fingerprints(h: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """48-bit fingerprint of each window of the hashed words h."""
    return _rolled(h, 0x9E3779B97F4A7C15, size) >> np.uint64(64 - _BITS)


def checks(h: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """64-bit hash of each window, independent of its fingerprint."""
    return _rolled(h * np.uint64(0xC2B2AE3D27D4EB4F) ^ (h >> np.uint64(31)), 0x165667B19E3779F9, size)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, as byte planes; the first is sorted and stored as differences."""
    first, *rest = columns
    cols = [np.diff(first, prepend=np.uint64(0)), *rest]
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in cols)
    return struct.pack("<I", len(first)) + zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<I", blob)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), np.uint8)
    out, at = [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _gather(blobs: list[bytes], *kinds) -> list[np.ndarray]:
    parts = [_unpack(b, *kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) for i in range(len(kinds))]


def _by_bucket(bits: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    bucket = (columns[0] >> np.uint64(_BITS - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
        if hi > lo:
            yield int(bucket[lo]), _pack(*(c[lo:hi] for c in columns))


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "key", "blob"])


_SCHEMA = "kind int, key int, blob binary"
RUN, ASK = 0, 1


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in sorted columns."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _fragments(bits: int, size: int):
    """(batch, text) to sorted fragments of the index, a row for each bucket."""

    def run(batches):
        held, count = [], 0

        def out():
            h, b = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((b, h))
            h, b = h[order], b[order]
            new = _first_of(h, b)
            rows = [(RUN, k, blob) for k, blob in _by_bucket(bits, h[new], b[new])]
            for at in range(0, len(rows), 2000):
                yield _rows(rows[at : at + 2000])

        for batch in batches:
            for b, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = text.split() if text else []
                if len(words) < size:
                    continue
                h = fingerprints(hashes(words), size)
                held.append((h, np.full(len(h), b, np.int32)))
                count += len(h)
                if count > HELD:
                    yield from out()
                    held, count = [], 0
        if held:
            yield from out()

    return run


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One bucket of a generation and of all runs: the run of what is new, and for each batch the candidates to verify,
    those of the owner included."""
    bucket = key[0].as_py()
    old = [b for k, b in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()) if k != RUN]
    new = [b for k, b in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()) if k == RUN]
    h, b = _gather(old + new, np.uint64, np.int32)
    known = np.zeros(len(h), bool)
    known[: sum(struct.unpack_from("<I", x)[0] for x in old)] = True
    order = np.lexsort((b, h))
    h, b, known = h[order], b[order], known[order]
    keep = _first_of(h, b)
    h, b, known = h[keep], b[keep], known[keep]
    first = _first_of(h)
    group = np.cumsum(first) - 1
    shared = (np.bincount(group) > 1)[group]
    rows = []
    fresh = first & ~known
    if fresh.any():
        rows.append((RUN, bucket, _pack(h[fresh], b[fresh])))
    ask = np.flatnonzero(shared)
    ask = ask[np.argsort(b[ask], kind="stable")]
    cuts = np.flatnonzero(np.diff(b[ask])) + 1
    rows += [(ASK, int(b[part[0]]), _pack(h[part])) for part in np.split(ask, cuts) if len(part)]
    return pa.Table.from_batches([_rows(rows)])


def _compact(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    h, b = _gather(table.column("blob").to_pylist(), np.uint64, np.int32)
    order = np.lexsort((b, h))
    h, b = h[order], b[order]
    new = _first_of(h)
    return pa.Table.from_batches([_rows([(RUN, key[0].as_py(), _pack(h[new], b[new]))])])


def _texts(table: pa.Table) -> tuple[list, list[list[bytes]]]:
    """Documents of a batch in order of doc_id, null last, and their words."""
    mine = table.filter(pa.compute.is_null(table.column("blob"))).sort_by([("doc_id", "ascending")])
    return mine.column("doc_id").to_pylist(), [(t or b"").split() for t in mine.column("text").cast(pa.binary()).to_pylist()]


def _verify(bits: int, size: int):
    """A batch's texts and the fingerprints asked about, to (fingerprint, check, batch) by bucket."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        asked = table.filter(pa.compute.is_valid(table.column("blob"))).column("blob").to_pylist()
        rows = []
        if asked:
            (want,) = _gather(asked, np.uint64)
            want = np.unique(want)
            hs, cs = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for words in _texts(table)[1]:
                if len(words) >= size:
                    w = hashes(words)
                    h = fingerprints(w, size)
                    hit = np.flatnonzero(want[np.minimum(np.searchsorted(want, h), len(want) - 1)] == h)
                    if len(hit):
                        hs.append(h[hit])
                        cs.append(checks(w, size)[hit])
            h, c = np.concatenate(hs), np.concatenate(cs)
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            new = _first_of(h, c)
            h, c = h[new], c[new]
            rows = [(RUN, k, blob) for k, blob in _by_bucket(bits, h, c, np.full(len(h), key[0].as_py(), np.int32))]
        return pa.Table.from_batches([_rows(rows)])

    return run


def _confirm(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Verified candidates of a bucket: to each batch those windows that an earlier batch has."""
    h, c, b = _gather(table.column("blob").to_pylist(), np.uint64, np.uint64, np.int32)
    order = np.lexsort((b, c, h))
    h, c, b = h[order], c[order], b[order]
    first = _first_of(h, c)
    later = np.flatnonzero(~first)
    # what is not first in its group repeats the first one's batch or a later one; each batch sends a window once
    later = later[np.argsort(b[later], kind="stable")]
    cuts = np.flatnonzero(np.diff(b[later])) + 1
    rows = []
    for part in np.split(later, cuts):
        if len(part):
            rows.append((ASK, int(b[part[0]]), _pack(h[part], c[part])))
    return pa.Table.from_batches([_rows(rows)])


def _cut(size: int):
    """A batch's texts and its confirmed repeats, to what is left of each document."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        told = table.filter(pa.compute.is_valid(table.column("blob"))).column("blob").to_pylist()
        gone_h = gone_c = np.empty(0, np.uint64)
        if told:
            gone_h, gone_c = _gather(told, np.uint64, np.uint64)
            order = np.argsort(gone_c)
            gone_h, gone_c = gone_h[order], gone_c[order]
        ids, texts = _texts(table)
        cs, hs, owner, start = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], []
        rank, last = -1, object()
        for doc, words in zip(ids, texts):
            rank, last = (rank, last) if doc == last else (rank + 1, doc)
            w = hashes(words) if len(words) >= size else np.empty(0, np.uint64)
            cs.append(checks(w, size))
            hs.append(fingerprints(w, size))
            owner.append(np.full(len(cs[-1]), rank, np.int64))
            start.append(len(cs[-1]))
        c, h, r = np.concatenate(cs), np.concatenate(hs), np.concatenate(owner)
        gone = np.zeros(len(c), bool)
        if len(c):
            order = np.argsort(c, kind="stable")  # documents are in order, so the first of a group is of the smallest doc_id
            new = _first_of(c[order], h[order])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            gone[order] = r[order] > r[order][lead]
            if len(gone_c):
                at = np.minimum(np.searchsorted(gone_c, c), len(gone_c) - 1)
                gone |= (gone_c[at] == c) & (gone_h[at] == h)
        at, removed, kept = 0, [], []
        for words, n in zip(texts, start):
            flags = np.zeros(len(words) + 1, np.int32)
            hit = np.flatnonzero(gone[at : at + n])
            at += n
            if not len(hit):
                removed.append(0)
                kept.append(b" ".join(words))
                continue
            flags[hit] += 1
            np.add.at(flags, hit + size, -1)
            covered = np.cumsum(flags[:-1]) > 0
            removed.append(int(covered.sum()))
            kept.append(b" ".join([w for w, x in zip(words, covered.tolist()) if not x]))
        return pa.table([pa.array(ids, pa.int64()), pa.array([len(w) for w in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, size: int = WINDOW, generations: int = GENERATIONS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of docs (doc_id, text).

    Removed are the words covered by a window of `size` words whose sequence also starts in a document with a smaller
    doc_id; windows are judged on the input. kept_text joins what is left by single spaces. Null texts have no words.
    Rows that share a doc_id do not count as smaller than each other; rows without doc_id come after all others and
    not before each other. Texts shorter than a window stay whole. Empty input: no rows."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_bytes, n_rows, low, high = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    count = max(1, min(1 << 16, n_rows, math.ceil(n_bytes / batch_bytes)))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)], 10 * count)).first()[0] if count > 1 and low is not None else []
    cuts = np.unique(np.array(cuts or [], np.int64))
    bits = max(4, math.ceil(math.log2(max(1, n_bytes / 6 / BUCKET_ENTRIES))))

    numbered = docs.withColumn("batch", range_number(F.col("doc_id"), cuts))
    shares = np.array_split(np.arange(len(cuts) + 1), max(1, min(generations, len(cuts) + 1)))
    shares[-1] = np.append(shares[-1], len(cuts) + 1)
    home, runs, asks, tier = scratch(spark, "substrings"), [], [], []
    with released_shuffles(spark):
        for g, share in enumerate(shares):
            while len(tier) > 1 and tier[-1] == tier[-2]:
                # two runs of one tier become one of the next
                both = runs[-1].union(runs[-2])
                path = f"{home}/compact{g}-{len(tier)}"
                merged = stage(both.groupBy("key").applyInArrow(_compact, _SCHEMA), path)
                runs[-2:], tier[-2:] = [merged], [tier[-1] + 1]
            ids = F.col("doc_id")
            lower = cuts[share[0] - 1] if share[0] else None
            upper = cuts[share[-1]] if share[-1] < len(cuts) else None
            some = numbered
            if lower is not None:
                some = some.where((ids > int(lower)) | ids.isNull()) if upper is None else some.where(ids > int(lower))
            if upper is not None:
                some = some.where(ids <= int(upper))
            fresh = some.select("batch", "text").mapInArrow(_fragments(bits, size), _SCHEMA)
            for run in runs:
                fresh = fresh.union(run.select(F.lit(-1).alias("kind"), "key", "blob"))
            path = f"{home}/generation{g}"
            fresh.groupBy("key").applyInArrow(_merge, _SCHEMA).write.partitionBy("kind").parquet(path)
            runs.append(spark.read.schema("key int, blob binary").parquet(f"{path}/kind={RUN}").select(F.lit(RUN).alias("kind"), "key", "blob") if f"kind={RUN}" in names(spark, path) else spark.createDataFrame([], _SCHEMA))
            asks.append(spark.read.schema("key int, blob binary").parquet(f"{path}/kind={ASK}") if f"kind={ASK}" in names(spark, path) else spark.createDataFrame([], "key int, blob binary"))
            tier.append(0)
        # the index has served; only what it asks about is needed now
        for g in range(len(shares)):
            remove(spark, f"{home}/generation{g}/kind={RUN}")
            for depth in range(len(shares)):
                remove(spark, f"{home}/compact{g}-{depth}")
        ask = asks[0]
        for more in asks[1:]:
            ask = ask.union(more)
        texts = numbered.select("batch", "doc_id", "text", F.lit(None).cast("binary").alias("blob"))
        blobs = lambda df: df.select(F.col("key").alias("batch"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "blob")
        asked = texts.union(blobs(ask)).groupBy("batch").applyInArrow(_verify(bits, size), _SCHEMA)
        told = stage(asked.groupBy("key").applyInArrow(_confirm, _SCHEMA), scratch(spark, "substrings-confirmed"))
    remove(spark, home)
    return texts.union(blobs(told)).groupBy("batch").applyInArrow(_cut(size), "doc_id long, n_words long, n_removed long, kept_text string")
