"""Token ids in files of static range asymmetric numeral system (rANS) blocks.

One table of frequencies, counted over the whole corpus, serves all files. A file holds documents in order of doc_id as
independent blocks; each block interleaves many coder states so that numpy steps through all of them at once, and its
header is a checkpoint: a reader needs the table and the block, nothing else, so blocks decode in parallel. Blocks and
tables carry checksums.

File: b"RANS", u32 crc of the table, then blocks. Block: header (see _HEAD), doc_ids and lengths (zstd), coder states,
32-bit words, u32 crc of the block."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, released_shuffles, remove, scratch, stage

END_ID = 2
SCALE_BITS, LOW = 20, 1 << 31
#: Ids of a block, coder states at most, coded bytes after which a file ends, documents of a part of the doc_id range
#: and parts at most (beyond that they are larger), text bytes encoded at once.
BLOCK_IDS, LANES, FILE_BYTES, PART_DOCS, PARTS, SLICE_BYTES = 1 << 19, 1024, 32 << 20, 8192, 1 << 16, 4 << 20
#: Words the coder of a worker remembers.
KNOWN_WORDS = 1_200_000
_HEAD = struct.Struct("<4sIQIIIIQ")
_MAGIC = b"RNSB"


@dataclass
class Table:
    """freq: 2**SCALE_BITS shared out over the ids seen; cum: sums before each id."""

    freq: np.ndarray
    cum: np.ndarray
    crc: int

    @classmethod
    def of(cls, counts: dict[int, int]) -> Table:
        """Shares in proportion to the counts, at least 1 for each id seen."""
        size = max(counts, default=0) + 1
        n = np.zeros(size, np.int64)
        for i, c in counts.items():
            n[i] = c
        whole = 1 << SCALE_BITS
        if np.count_nonzero(n) > whole:
            raise ValueError("more ids than shares")
        freq = np.where(n > 0, np.maximum(1, n * whole // max(1, n.sum())), 0)
        over = int(freq.sum()) - whole
        # what rounding down left over goes to the most frequent id; what the least shares take comes from the next ones
        for i in np.argsort(-freq, kind="stable") if over else []:
            step = over if over < 0 else min(over, int(freq[i]) - 1)
            freq[i] -= step
            over -= step
            if not over or not n.any():
                break
        return cls(freq.astype(np.uint64), np.append(0, np.cumsum(freq)).astype(np.uint64), zlib.crc32(freq.astype("<u4").tobytes()))

    def symbols(self) -> np.ndarray:
        """The id of each share."""
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def encode_ids(ids: np.ndarray, table: Table, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Final states and words; id k belongs to lane k modulo lanes."""
    state = np.full(lanes, LOW, np.uint64)
    freq, cum = table.freq[ids], table.cum[ids]
    bits, shift, out = np.uint64(SCALE_BITS), np.uint64(63 - SCALE_BITS), []
    for at in range((len(ids) - 1) // lanes * lanes if len(ids) else -1, -1, -lanes):
        f, c = freq[at : at + lanes], cum[at : at + lanes]
        x = state[: len(f)]
        full = x >= f << shift
        if full.any():
            out.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: len(f)] = (q << bits) + (x - q * f) + c
    return state, np.concatenate(out[::-1]) if out else np.empty(0, "<u4")


def decode_ids(n: int, state: np.ndarray, words: np.ndarray, table: Table, symbols: np.ndarray) -> np.ndarray:
    out = np.empty(n, np.uint32)
    lanes, mask, bits, used = len(state), np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), 0
    state = state.copy()
    for at in range(0, n, lanes):
        x = state[: min(lanes, n - at)]
        slot = x & mask
        ids = symbols[slot]
        x = table.freq[ids] * (x >> bits) + slot - table.cum[ids]
        low = np.flatnonzero(x < np.uint64(LOW))
        if len(low):
            x[low] = (x[low] << np.uint64(32)) | words[used : used + len(low)].astype(np.uint64)
            used += len(low)
        state[: len(x)] = x
        out[at : at + len(x)] = ids
    if used != len(words) or (state != np.uint64(LOW)).any():
        raise ValueError("a block does not decode")
    return out


def write_block(doc_ids: list, lengths: list[int], ids: np.ndarray, start: int, table: Table) -> bytes:
    lanes = int(min(LANES, max(1, len(ids) // 256)))
    state, words = encode_ids(ids, table, lanes)
    press = zstandard.ZstdCompressor(level=3).compress
    known = np.array([d is not None for d in doc_ids])
    docs = press(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.packbits(known).tobytes() + np.array(lengths, "<u4").tobytes())
    body = _HEAD.pack(_MAGIC, table.crc, len(ids), lanes, len(doc_ids), len(docs), len(words), start) + docs + state.astype("<u8").tobytes() + words.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(block: bytes, table: Table, symbols: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, int]:
    """doc_ids, lengths, ids and the number of ids before the block."""
    body, (crc,) = block[:-4], struct.unpack("<I", block[-4:])
    magic, table_crc, n, lanes, n_docs, n_press, n_words, start = _HEAD.unpack_from(body)
    if zlib.crc32(body) != crc or magic != _MAGIC or table_crc != table.crc:
        raise ValueError("a block or its table is damaged")
    at = _HEAD.size
    raw = zstandard.ZstdDecompressor().decompress(body[at : at + n_press])
    flags = (n_docs + 7) // 8
    known = np.unpackbits(np.frombuffer(raw, np.uint8, flags, 8 * n_docs), count=n_docs).astype(bool)
    doc_ids = [d if k else None for d, k in zip(np.frombuffer(raw, "<i8", n_docs).tolist(), known.tolist())]
    lengths = np.frombuffer(raw, "<u4", n_docs, 8 * n_docs + flags).astype(np.int64)
    at += n_press
    state = np.frombuffer(body, "<u8", lanes, at)
    words = np.frombuffer(body, "<u4", n_words, at + 8 * lanes)
    return doc_ids, lengths, decode_ids(n, state, words, table, symbols), start


class TextCoder:
    """Encodes whole texts with the tokenizer of a file; for any tokenizer."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = max(self.tokenizer.get_vocab().values(), default=0) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (string, no nulls), each with the end id, one after the other, and how many each has."""
        found = [e.ids + [end_id] for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], self.kind), np.array([len(ids) for ids in found], np.int64)


class WordCoder(TextCoder):
    """The same ids word by word, remembering words: Arrow splits texts and tells equal words, so each is looked up once
    a slice, and ids of all words are gathered at once. Right for tokenizers of the form fits() asks for, where words of
    ASCII white space are encoded by themselves and ASCII case is folded.

    New words go to the tokenizer many at once: words of letters that its normalizer leaves as they are to a tokenizer
    of the same model without the normalizer, cut after the tokens that end words; others parted by a special token. A
    run of ASCII marks after an ASCII letter is a piece of its own. All words are forgotten when they are too many."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.part, self.mark = next((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items())
        self.starts = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.size, bool)
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True
        self._forget()

    @staticmethod
    def fits(path: str) -> bool:
        """Whether the file's tokenizer folds case, drops white space between pieces of letters, digits and marks, and
        ends words with a suffix."""
        import json

        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        model, added = form["model"], form.get("added_tokens") or []
        steps = ((form.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        return (
            form.get("normalizer") == _NORMALIZER and {k: steps.get(k) for k in _SPLIT} == _SPLIT and (form["pre_tokenizer"]["pretokenizers"][1:] == [_BYTES])
            and model.get("type") == "BPE" and not model.get("dropout") and not model.get("unk_token") and not model.get("continuing_subword_prefix") and bool(model.get("end_of_word_suffix"))
            and bool(added) and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and t["content"].isascii() and len(t["content"]) > 2 for t in added)
        )

    def _forget(self) -> None:
        # row 0 is the empty word, row 1 the end id
        self.rows: dict[bytes, int] = {b"": 0}
        self.start, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.flat, self.used, self.n = np.zeros(1 << 18, self.kind), 1, 2
        self.length[1] = 1

    def _keep(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.n + len(words) > len(self.start):
            self.start, self.length = np.append(self.start, np.zeros_like(self.start)), np.append(self.length, np.zeros_like(self.length))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[self.n : self.n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.length[self.n : self.n + len(words)] = lengths
        self.rows.update(zip(words, range(self.n, self.n + len(words))))
        self.used, self.n = self.used + len(ids), self.n + len(words)

    def _ask(self, words: list[bytes]) -> None:
        odd = []
        for at in range(0, len(words), 5000):
            some = words[at : at + 5000]
            texts = b" ".join(some).decode().split(" ")
            plain = [t.isalpha() and t == t.lower() and (t.isascii() or is_normalized("NFC", t)) for t in texts]
            odd += [w for w, p in zip(some, plain) if not p]
            if not (some := [w for w, p in zip(some, plain) if p]):
                continue
            ids = np.array(self.plain.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                self._keep(some, ids, np.diff(np.append(0, cuts)))
            else:
                odd += some
        alone = [w for w in odd if any(s.encode() in w for s in self.starts)]
        if alone:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False)]
            self._keep(alone, np.array([i for ids in found for i in ids], self.kind), np.array([len(ids) for ids in found], np.int64))
            odd = [w for w in odd if w not in self.rows]
        for at in range(0, len(odd), 5000):
            some = odd[at : at + 5000]
            ids = self._ids(self.mark.join(b" ".join(some).decode().split(" ")))
            parts = ids == self.part
            cuts = np.append(np.flatnonzero(parts), len(ids))
            if len(cuts) != len(some):
                raise ValueError("the special token does not part words")
            self._keep(some, ids[~parts], np.diff(np.append(-1, cuts)) - 1)

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of all rows, one after the other, and how many each has."""
        n = self.length[rows]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[rows] - (ends - n).astype(np.int32), n) + np.arange(total, dtype=np.int32)], n

    def _learn(self, words: list[bytes]) -> None:
        """Rows for words that have none."""
        known, ended, bases, tails, ask = self.rows, [], [], [], {}
        for w in words:
            base = w.rstrip(_MARKS)
            if len(base) < len(w) and base and 97 <= base[-1] <= 122 and b"<" not in w:
                tail = w[len(base) :]
                ended.append(w)
                bases.append(base)
                tails.append(tail)
                if base not in known:
                    ask[base] = None
                if tail not in known:
                    ask[tail] = None
            else:
                ask[w] = None
        self._ask(list(ask))
        if ended:
            pairs = np.empty((len(ended), 2), np.int64)
            for side, parts in enumerate((bases, tails)):
                pairs[:, side] = np.fromiter(map(known.__getitem__, parts), np.int64, len(ended))
            ids, n = self._gather(pairs.ravel())
            self._keep(ended, ids, n.reshape(-1, 2).sum(axis=1))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        if self.n > KNOWN_WORDS:
            self._forget()
        self.flat[0] = end_id
        lowered = pc.ascii_lower(texts)
        for s in self.starts:
            if pc.any(special := pc.match_substring(texts, s)).as_py():
                lowered = pc.if_else(special, texts, lowered)
        split = pc.ascii_split_whitespace(lowered)
        coded = split.flatten().dictionary_encode()
        # by way of numpy, which takes less than half the time of to_pylist()
        words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        rows = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(rows < 0)):
            miss = [words[k] for k in new.tolist()]
            self._learn(miss)
            rows[new] = np.fromiter(map(self.rows.__getitem__, miss), np.int64, len(miss))
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        each = np.insert(rows[coded.indices.to_numpy()], offsets[1:], 1)
        ids, n = self._gather(each)
        last = np.cumsum(n)[offsets[1:] + np.arange(len(texts))]
        return ids, np.diff(np.append(0, last)).astype(np.int64)


#: The form of tokenizer file that WordCoder is right for; ASCII marks.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CODERS: dict[str, TextCoder] = {}


def coder(path: str) -> TextCoder:
    """One coder for each tokenizer file and worker process."""
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path) if WordCoder.fits(path) else TextCoder(path)
    return _CODERS[path]


_COUNTS = 256  # rows of parts below 0, so many, hold counts of ids instead of a document


def _slices(batch: pa.RecordBatch, column: int):
    """Slices of a batch of about SLICE_BYTES of text, a row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _tokenize(path: str, end_id: int):
    """(part, doc_id, text) in order to (part, doc_id, n, ids, before), before being the ids of the part before the
    document, and a last row with how often the task met each id."""

    def run(batches):
        c = coder(path)
        counts = np.zeros(max(c.size, end_id + 1), np.int64)
        part, before = None, 0
        for batch in batches:
            for some in _slices(batch, 2):
                ids, n = c.encode(pc.fill_null(some.column(2), ""), end_id)
                got = np.bincount(ids)
                counts[: len(got)] += got
                if (here := some.column(0)[0].as_py()) != part:
                    part, before = here, 0
                ends = np.cumsum(n)
                width = c.kind.itemsize
                raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, ends * width).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(n), raw, pa.array(before + ends - n)], names=["part", "doc_id", "n", "ids", "before"])
                before += int(ends[-1])
        yield pa.RecordBatch.from_arrays([pa.array([-1 - TaskContext.get().partitionId() % _COUNTS], pa.int32()), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([counts.astype("<i8").tobytes()], pa.binary()), pa.array([0], pa.int64())], names=["part", "doc_id", "n", "ids", "before"])

    return run


def _sums(batches):
    """Counts of all rows of a task, added up."""
    total = np.zeros(1, np.int64)
    for batch in batches:
        for raw in batch.column(0):
            total = total + np.frombuffer(raw.as_py(), "<i8")
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])


def _files(folder: str):
    where, path = pyarrow.fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    return where, path


def _write(folder: str, kind: np.dtype, table: Table, starts: dict[int, int]):
    """Sorted rows (part, doc_id, n, ids, before) to files; tells each block's place. A file's name and bytes follow from
    its rows, and it appears under its name when whole, so a repeated task changes nothing."""

    def run(batches):
        import uuid

        _CODERS.clear()
        where, root = _files(folder)
        name, blocks, size = None, [], 0
        docs, lengths, ids, held, first = [], [], [], 0, 0

        def flush():
            nonlocal docs, lengths, ids, held, size
            if docs:
                block = write_block(docs, lengths, np.frombuffer(b"".join(ids), kind).astype(np.int64), first, table)
                blocks.append((block, size, len(docs), held))
                size += len(block)
            docs, lengths, ids, held = [], [], [], 0

        def close():
            nonlocal blocks
            flush()
            if not blocks:
                return None
            temp = f"{root}/.{uuid.uuid4().hex}"
            with where.open_output_stream(temp) as f:
                f.write(b"RANS" + struct.pack("<I", table.crc))
                for b, *_ in blocks:
                    f.write(b)
            where.move(temp, f"{root}/{name}")
            told = pa.RecordBatch.from_arrays([pa.array([name] * len(blocks)), pa.array([8 + b[1] for b in blocks], pa.int64()), pa.array([len(b[0]) for b in blocks], pa.int64()), pa.array([b[2] for b in blocks], pa.int64()), pa.array([b[3] for b in blocks], pa.int64())], names=["file", "offset", "length", "n_docs", "n_ids"])
            blocks = []
            return told

        part = None
        for batch in batches:
            for p, d, n, x, before in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part or size > FILE_BYTES:
                    if (told := close()) is not None:
                        yield told
                    part, size = p, 0
                    name = f"{starts[p] + before:020d}.rans"
                if not docs:
                    first = starts[p] + before
                docs.append(d)
                lengths.append(n)
                ids.append(x)
                held += n
                if held >= BLOCK_IDS:
                    flush()
        if (told := close()) is not None:
            yield told

    return run


_IDS = "part int, doc_id long, n long, ids binary, before long"
_BLOCKS = "file string, offset long, length long, n_docs long, n_ids long"


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID) -> tuple[DataFrame, Table]:
    """Write docs (doc_id, text) to `folder` in ascending order of doc_id, null last, rows of one doc_id by a hash of
    their texts (null as empty); equal rows are written as often as they occur.

    Returns the list of blocks (file, offset, length, n_docs, n_ids) and the table. A null text has the end id only.
    Documents are range-sorted into parts, which are read as streams, so a part may be of any size; a part goes to one
    or more files, named by the number of ids before them. Empty input: no file."""
    spark = docs.sparkSession
    kind = coder(tokenizer_path).kind
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    count = max(1, min(PARTS, math.ceil(docs.select("doc_id").count() / PART_DOCS)))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64(F.coalesce("text", F.lit(""))).asc()]

    home = scratch(spark, "token-ids")
    with released_shuffles(spark):
        ranged = docs.repartitionByRange(count, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")
        ranged.mapInArrow(_tokenize(tokenizer_path, end_id), _IDS).write.option("compression", "zstd").parquet(home)
        coded = spark.read.schema(_IDS).parquet(home)
        counts = coded.where("part < 0").select("ids").mapInArrow(_sums, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
        coded = coded.where("part >= 0")
        totals = sorted((r.part, r.total) for r in coded.groupBy("part").agg(F.sum("n").alias("total")).collect())
        starts, at = {}, 0
        for p, n in totals:
            starts[p], at = at, at + n
        table = Table.of({r.id: r.n for r in counts})
        blocks = checkpoint(coded.mapInArrow(_write(folder, kind, table, starts), _BLOCKS))
    remove(spark, home)
    return blocks, table


def read(blocks: DataFrame, table: Table, folder: str, take: Callable | None = None, schema: str = "ids array<int>") -> DataFrame:
    """(doc_id, start, n_tokens, ...) of all documents in the blocks. take makes the further columns of `schema` from a
    document's ids, a list for each; by default the ids themselves. Each block is read and decoded by itself."""

    def run(batches):
        where, root = _files(folder)
        symbols = table.symbols()
        for batch in batches:
            for name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with where.open_input_file(f"{root}/{name}") as f:
                    block = f.read_at(length, offset)
                doc_ids, lengths, ids, start = read_block(block, table, symbols)
                ends = np.cumsum(lengths)
                rows = [take(ids[e - n : e]) if take else [ids[e - n : e].astype(np.int32)] for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), *(pa.array(list(c)) for c in zip(*rows))], names=["doc_id", "start", "n_tokens", *columns])

    columns = [c.split()[0] for c in schema.split(", ")]
    tasks = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return blocks.select("file", "offset", "length").repartition(tasks).mapInArrow(run, f"doc_id long, start long, n_tokens long, {schema}")
