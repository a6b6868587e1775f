"""ISO media containers in binary columns.

describe() walks the nested boxes of a container, decodes each track's sample tables and tells codec, duration and the
byte ranges of its sync samples; payload bytes are never decoded. wrap() stores bytes losslessly as the 8-bit samples of
a one-track container and payload() reads them back by the sample tables alone."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"udta", b"mvex", b"moof", b"traf"}
UNIT, RATE, CHUNK = 64, 8000, 256
#: Deeper nesting is taken for damage; so is a table of more samples than the file has bytes, as each holds some.
DEEPEST = 32


class MediaError(ValueError):
    """The bytes are not a readable container."""


def boxes(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, parents before children. Boxes nest at most DEEPEST deep."""
    end = len(data) if end is None else end
    if len(path) > DEEPEST:
        raise MediaError("boxes nest too deep")
    while start < end:
        if end - start < 8:
            raise MediaError("a box is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise MediaError("a box is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise MediaError(f"box {kind!r} has a wrong size")
        here = (*path, kind)
        yield here, body, start + size
        if kind in CONTAINERS:
            yield from boxes(data, body, start + size, here)
        start += size


@dataclass
class Track:
    """offsets and sizes: bytes of each sample; times: its decode time; sync: numbers of sync samples from 0."""

    track_id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    sync: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def runs(self, which: np.ndarray | slice = slice(None)) -> list[tuple[int, int]]:
        """Byte ranges (start, length) of samples; samples that touch are one range."""
        at, size = self.offsets[which], self.sizes[which]
        if not len(at):
            return []
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1] + size[:-1]))
        return list(zip(at[new].tolist(), np.add.reduceat(size, new).tolist()))

    def ranges(self) -> list[tuple[int, int]]:
        """Byte ranges (start, length) of the sync samples."""
        return self.runs(self.sync)

    def add(self, sizes: np.ndarray, offsets: np.ndarray, steps: np.ndarray, sync: np.ndarray, start: int | None = None) -> None:
        """More samples: steps are their durations, start the decode time of the first, by default after those before."""
        begin = int(self.times[-1] + self.last_step) if start is None and len(self.times) else start or 0
        self.sync = np.append(self.sync, sync + len(self.sizes))
        self.sizes, self.offsets = np.append(self.sizes, sizes), np.append(self.offsets, offsets)
        self.times = np.append(self.times, begin + np.append(0, np.cumsum(steps))[:-1]) if len(steps) else self.times
        self.last_step = int(steps[-1]) if len(steps) else self.last_step

    last_step: int = 0


def _table(data: memoryview, at: int, end: int, kind: str, width: int) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data[:end], at + 4)
    if at + 8 + n * width * np.dtype(kind).itemsize > end:
        raise MediaError("a sample table is cut off")
    return np.frombuffer(data, kind, n * width, at + 8).astype(np.int64).reshape(n, width)


def _within(data: memoryview, sizes: np.ndarray, offsets: np.ndarray) -> None:
    if len(sizes) and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise MediaError("a sample lies outside the file")


def _samples(data: memoryview, tables: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at, end = tables[b"stsz"]
    one, n = struct.unpack_from(">II", data[:end], at + 4)
    if one:
        if n * one > len(data):
            raise MediaError("a sample lies outside the file")
        sizes = np.full(n, one, np.int64)
    else:
        if at + 12 + 4 * n > end:
            raise MediaError("a sample table is cut off")
        sizes = np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)
    chunks = (_table(data, *tables[b"stco"], ">u4", 1) if b"stco" in tables else _table(data, *tables[b"co64"], ">u8", 1))[:, 0]
    runs = _table(data, *tables[b"stsc"], ">u4", 3)
    if len(runs):
        first = runs[:, 0]
        if first[0] != 1 or (np.diff(first) <= 0).any() or first[-1] > max(1, len(chunks)):
            raise MediaError("sample tables disagree")
        repeats = np.diff(np.append(first, len(chunks) + 1))
        if int((runs[:, 1] * repeats).sum()) != n:
            raise MediaError("sample tables disagree")
        per_chunk = np.repeat(runs[:, 1], repeats)
    else:
        per_chunk = np.empty(0, np.int64)
    if per_chunk.sum() != n:
        raise MediaError("sample tables disagree")
    before = np.append(0, np.cumsum(sizes))
    first = np.append(0, np.cumsum(per_chunk))[:-1]
    offsets = np.repeat(chunks[: len(per_chunk)] - before[first], per_chunk) + before[:-1] if n else np.empty(0, np.int64)
    sync = _table(data, *tables[b"stss"], ">u4", 1)[:, 0] - 1 if b"stss" in tables else np.arange(n)
    _within(data, sizes, offsets)
    if len(sync) and (sync.min() < 0 or sync.max() >= n):
        raise MediaError("a sample lies outside the file")
    steps = np.zeros(n, np.int64)
    if b"stts" in tables:
        spans = _table(data, *tables[b"stts"], ">u4", 2)
        if int(spans[:, 0].sum()) != n:
            raise MediaError("sample tables disagree")
        steps = np.repeat(spans[:, 1], spans[:, 0])
    return sizes, offsets, steps, sync


def _numbers(data: memoryview, at: int, end: int, n: int) -> list[int]:
    if at + 4 * n > end:
        raise MediaError("a box is cut off")
    return list(struct.unpack_from(f">{n}I", data, at))


#: Flag of a sample that is no sync sample; flags of fragment headers and runs for fields that are there.
_NO_SYNC = 0x10000
_BASE, _DESCRIPTION, _DURATION, _SIZE, _FLAGS, _FROM_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
_RUN_OFFSET, _RUN_FIRST, _RUN_DURATION, _RUN_SIZE, _RUN_FLAGS, _RUN_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800


class _Fragments:
    """Runs of samples in movie fragments: defaults of trex, overridden by tfhd, overridden by trun."""

    def __init__(self, data: memoryview, tracks: dict[int, Track]) -> None:
        self.data, self.tracks, self.trex = data, tracks, {}
        self.moof = self.next = 0
        self.track, self.base, self.start = None, 0, None
        self.step = self.size = self.flags = 0

    def header(self, at: int, end: int) -> None:
        (flags, of), more = _numbers(self.data, at, end, 2), at + 8
        self.track = self.tracks.get(of)
        if self.track is None:
            raise MediaError("a fragment is of no track")
        flags &= 0xFFFFFF
        self.start, self.base = None, self.moof
        self.step, self.size, self.flags = self.trex.get(of, (0, 0, 0))
        if flags & _BASE:
            high, low = _numbers(self.data, more, end, 2)
            self.base, more = high << 32 | low, more + 8
        if flags & _DESCRIPTION:
            more += 4
        for bit, name in ((_DURATION, "step"), (_SIZE, "size"), (_FLAGS, "flags")):
            if flags & bit:
                setattr(self, name, _numbers(self.data, more, end, 1)[0])
                more += 4
        self.next = self.base

    def time(self, at: int, end: int) -> None:
        if self.data[at] == 1:
            _, high, low = _numbers(self.data, at, end, 3)
            self.start = high << 32 | low
        else:
            self.start = _numbers(self.data, at, end, 2)[1]

    def run(self, at: int, end: int) -> None:
        if self.track is None:
            raise MediaError("a run has no fragment header")
        (flags, n), more = _numbers(self.data, at, end, 2), at + 8
        flags &= 0xFFFFFF
        if flags & _RUN_OFFSET:
            self.next = self.base + int.from_bytes(self.data[more : more + 4], "big", signed=True)
            more += 4
        first = None
        if flags & _RUN_FIRST:
            first, more = _numbers(self.data, more, end, 1)[0], more + 4
        fields = [f for f in (_RUN_DURATION, _RUN_SIZE, _RUN_FLAGS, _RUN_SHIFT) if flags & f]
        if more + 4 * n * len(fields) > end or n > len(self.data):
            raise MediaError("a run is cut off")
        table = np.frombuffer(self.data, ">u4", n * len(fields), more).astype(np.int64).reshape(n, len(fields))
        given = lambda f, default: table[:, fields.index(f)] if f in fields else np.full(n, default, np.int64)
        sizes, steps, kinds = given(_RUN_SIZE, self.size), given(_RUN_DURATION, self.step), given(_RUN_FLAGS, self.flags)
        if first is not None and n and _RUN_FLAGS not in fields:
            kinds[0] = first
        offsets = self.next + np.cumsum(sizes) - sizes
        _within(self.data, sizes, offsets)
        self.track.add(sizes, offsets, steps, np.flatnonzero(kinds & _NO_SYNC == 0), self.start)
        self.next, self.start = self.next + int(sizes.sum()), None


def tracks(data: bytes) -> list[Track]:
    """All tracks, samples of movie fragments included. Raises MediaError for anything else than a readable container."""
    view, found, tables = memoryview(data), [], {}

    def close():
        if found and tables:
            if not {b"stsz", b"stsc"} <= tables.keys() or not {b"stco", b"co64"} & tables.keys():
                raise MediaError("a track lacks sample tables")
            found[-1].add(*_samples(view, tables))
            tables.clear()

    by_id: dict[int, Track] = {}
    fragments = _Fragments(view, by_id)
    try:
        for path, at, end in boxes(view):
            kind = path[-1]
            inside = view[:end]
            if kind == b"trak":
                close()
                found.append(Track())
            elif found and b"trak" in path:
                if kind == b"tkhd":
                    (found[-1].track_id,) = struct.unpack_from(">I", inside, at + (20 if at < end and view[at] == 1 else 12))
                    by_id[found[-1].track_id] = found[-1]
                elif kind == b"mdhd":
                    found[-1].timescale, found[-1].duration = struct.unpack_from(">IQ", inside, at + 20) if at < end and view[at] == 1 else struct.unpack_from(">II", inside, at + 12)
                elif kind == b"hdlr":
                    found[-1].handler = bytes(inside[at + 8 : at + 12]).decode("latin-1")
                elif kind == b"stsd":
                    found[-1].codec = bytes(inside[at + 12 : at + 16]).decode("latin-1")
                elif kind in (b"stsz", b"stsc", b"stco", b"co64", b"stss", b"stts"):
                    tables[kind] = (at, end)
            elif kind == b"trex":
                _, of, _, step, size, flags = _numbers(view, at, end, 6)
                fragments.trex[of] = step, size, flags
            elif kind == b"moof":
                close()
                # offsets count from the start of the box, which has a short or a long header
                fragments.moof, fragments.track = at - (16 if at >= 16 and struct.unpack_from(">I4s", view, at - 16) == (1, b"moof") else 8), None
            elif kind == b"tfhd":
                fragments.header(at, end)
            elif kind == b"tfdt" and at < end:
                fragments.time(at, end)
            elif kind == b"trun":
                fragments.run(at, end)
        close()
    except (struct.error, IndexError, OverflowError) as e:
        raise MediaError("a box is cut off") from e
    for t in found:
        # a fragmented file tells no duration in front
        if not t.duration and len(t.times):
            t.duration = int(t.times[-1]) + t.last_step
    return found


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body if len(body) + 8 < 1 << 32 else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the unit."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def wrap(content: bytes) -> bytes:
    """A container with one track of raw 8-bit samples, UNIT bytes to a table sample and CHUNK samples to a chunk.
    len(content) is a positive multiple of UNIT. Equal contents give equal bytes."""
    n = len(content) // UNIT
    if not n or n * UNIT != len(content):
        raise ValueError(f"the content is not a positive multiple of {UNIT} bytes")
    full, rest = divmod(n, CHUNK)
    runs = [(1, CHUNK, 1)] * bool(full) + [(full + 1, rest, 1)] * bool(rest)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    long = len(content) + 8 >= 1 << 32

    def moov(first: int) -> bytes:
        places = first + np.arange(full + bool(rest), dtype=np.int64) * (CHUNK * UNIT)
        wide = bool(len(places)) and int(places[-1]) >= 1 << 32
        entry = _box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, UNIT)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", len(places)), places.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        length = min(len(content), 0xFFFFFFFF)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, length, 0x55C4, 0)), _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"bytes\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, length, 0, 0, 0x100, 0), matrix, bytes(8), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, length, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    start = len(head) + len(moov(0)) + (16 if long else 8)
    return head + moov(start) + _box(b"mdat", content)


def payload(data: bytes) -> bytes:
    """The bytes of the first track's samples, by its sample tables."""
    found = tracks(data)
    if not found:
        raise MediaError("no track")
    return b"".join(data[o : o + n] for o, n in found[0].runs())


_TRACK = pa.struct([("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))])


def _told(data: bytes | None) -> tuple[list | None, str | None]:
    if data is None:
        return None, None
    try:
        return [{"handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.sizes), "keyframes": [{"offset": o, "length": n} for o, n in t.ranges()]} for t in tracks(data)], None
    except MediaError as e:
        return None, str(e)


def describe(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, tracks, error) for each row: tracks as an array of structs, null and with a reason in error for bytes that
    are not a readable container (cut off, nested too deep, tables that disagree), both null for null; empty bytes hold
    no track. Rows are independent, repeated ones come back as often; nothing is shuffled. Empty input: no rows."""

    def run(batches):
        for batch in batches:
            told = [_told(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in told], pa.list_(_TRACK)), pa.array([e for _, e in told], pa.string())], names=[key, "tracks", "error"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInArrow(run, f"`{key}` {kind}, tracks array<struct<handler: string, codec: string, timescale: bigint, duration: bigint, n_samples: bigint, keyframes: array<struct<offset: bigint, length: bigint>>>>, error string")


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for each row of docs (doc_id, text): the text's UTF-8 bytes, null as empty, as a media
    column. Repeated rows come back as often; equal texts give equal bytes. Empty input: no rows."""

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([wrap(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def digests(stored: DataFrame) -> DataFrame:
    """What is read back of store_texts(), a row for each: digests of payload and container, and the first track as a
    feature string. The media are those of store_texts(); others raise MediaError. Empty input: no rows."""

    def run(batches):
        for batch in batches:
            rows = []
            for media in batch.column(2).to_pylist():
                t = tracks(media)[0]
                data = payload(media)
                frames = ",".join(f"{o}+{n}" for o, n in t.ranges())
                feature = f"{t.handler}/{t.codec.strip()}/{t.timescale};duration={t.duration};samples={len(t.sizes)};keyframes={frames}"
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
