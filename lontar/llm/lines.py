"""Fuzzy line deduplication.

Lines are normalised (ASCII lower case, single spaces, no outer space). Equal lines are one node, however often they
occur. A node's SimHash is made in blocks: each distinct word votes in one block only, chosen by its hash, so a changed
word reaches its own block and that of its substitute, and by the pigeonhole principle lines that differ in few words
agree in a block. The number of blocks follows the number of words (WORDS to twice as many words a block); of long lines
BLOCKS of them are used. Lines of middling length have blocks by a second deal, short lines all their words but one,
very short ones vote with pairs of letters. Lines of up to SHORT letters also have a block for each way to leave out as
many letters as similar lines may differ in, so none of their links is lost.

Lines are joined on equal blocks; lines that meet are compared with their texts and linked if their edit similarity
reaches the threshold. Of each connected group the first occurrence stays. Where lines meet in several blocks in the
same company they are compared once; within a company, and from one company to the next of the same first line, lines
that are connected already are not compared again, so a large group costs links, not pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, components, forget, join_counted, packed, released_shuffles

SIMILARITY, WORDS, BLOCKS = 0.8, 4, 8
#: Similar lines of up to so many letters meet for sure, by all ways to leave out letters.
SHORT = 14
#: Keys of lines that meet others, and of linked ones with their groups, are broadcast up to so many (8 and 16 bytes
#: each), beyond that joined by a shuffle.
BROADCAST_KEYS = 2_000_000
#: Lines a task remembers so as to send their blocks once.
SEEN = 300_000
#: Lines of companies that are compared together, and pairs a company asks for at once.
COMPANIES, ASKED = 20_000, 4096
#: Lines of companies that are dealt with others of the same first line, at most.
CHAINED = 1000
#: Letters of a piece of a line at most, and pieces that are looked for together.
PIECE, PIECES = 64, 8192
_MASK = (1 << 63) - 1
_LAST_ID = (1 << 63) - 1
#: The eight bits of a byte in a byte each.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()

#: White space, and what letters and places in a word count in its hash.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_VALUES, _FACTORS = (np.random.default_rng(7 + k).integers(0, 1 << 64, 1 << size, np.uint64) | np.uint64(1) for k, size in enumerate((8, 12)))


def normalised(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def edit_similarity(a: str, b: str, least: float = 0.0) -> float:
    """1 - Levenshtein distance / longer length; bit-parallel, one machine pass over b for each letter of it. Stops
    early with 0 where it cannot reach `least` any more."""
    if a == b:
        return 1.0
    if len(a) < len(b):
        a, b = b, a
    if not b or len(b) < least * len(a) - 1e-9:
        return 0.0
    letters: dict[str, int] = {}
    for i, c in enumerate(a):
        letters[c] = letters.get(c, 0) | 1 << i
    most = (1 - least) * len(a) + 1e-9  # as it is rounded
    # rows that a path of few enough edits can touch, before and after the diagonal
    before, after = (int(most) + len(b) - len(a)) // 2, (int(most) + len(a) - len(b)) // 2
    # low is the distance of the rows left behind, the bits are the steps from there
    plus = minus = base = rows = low = 0
    for n in range(0, len(b), 64):
        if n and low + plus.bit_count() - minus.bit_count() + len(a) - rows - (len(b) - n) > most:
            return 0.0  # even if all that is left matches
        to, drop, base = min(len(a), n + 64 + after), max(0, n - before) - base, max(0, n - before)
        # rows that come in count one edit each
        plus |= (1 << to - rows) - 1 << rows - base + drop
        gone, rows = (1 << drop) - 1, to
        low += (plus & gone).bit_count() - (minus & gone).bit_count()
        plus, minus, full = plus >> drop, minus >> drop, (1 << rows - base) - 1
        at = {c: v >> base & full for c, v in letters.items()} if rows - base < len(a) else letters
        some = b[n : n + 64]
        low += len(some)
        for c in some:
            eq = at.get(c, 0)
            d = (((eq & plus) + plus) ^ plus) | eq | minus
            up = ((minus | full & ~(d | plus)) << 1 | 1) & full
            plus = ((plus & d) << 1 | ~(d | up)) & full
            minus = up & d
    score = low + plus.bit_count() - minus.bit_count()
    return 1 - score / len(a)


def _parts(x: list[str], y: list[str]):
    """Runs of words (of x, of y) in which an alignment of two lines differs, found by looking a few words ahead."""
    i = j = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        ahead = next(((p, s - p) for s in range(1, 9) for p in range(s + 1) if i + p < len(x) and j + s - p < len(y) and x[i + p] == y[j + s - p]), None)
        if ahead is None:
            break
        yield x[i : i + ahead[0]], y[j : j + ahead[1]]
        i, j = i + ahead[0], j + ahead[1]
    # the rest, less the words both end with
    a, b = x[i:], y[j:]
    n = next((k for k, (v, w) in enumerate(zip(reversed(a), reversed(b))) if v != w), min(len(a), len(b)))
    yield a[: len(a) - n], b[: len(b) - n]


def _shown(a: str, b: str, most: float) -> bool:
    """Whether an alignment of words shows a distance of `most` or less. False proves nothing."""
    parts = [(" ".join(p), " ".join(q)) for p, q in _parts(a.split(" "), b.split(" "))]
    # a run of words takes a space with it where the other side has none
    costs = [max(len(p), len(q)) + (not p or not q) for p, q in parts]
    if sum(costs) <= most:
        return True
    if sum(costs) <= 2 * most and len(parts) > 1:
        exact = sum(c if not p or not q else round((1 - edit_similarity(p, q)) * max(len(p), len(q))) for c, (p, q) in zip(costs, parts))
        return exact <= most
    return False


def _alike(a: str, b: str) -> bool:
    """Whether an alignment of words may show anything: of lines with few words in common it would not."""
    x, y = set(a.split(" ")), set(b.split(" "))
    return min(len(x), len(y)) < 3 * WORDS or 2 * len(x & y) > min(len(x), len(y))


def similar(a: str, b: str, least: float) -> bool:
    """Whether the edit similarity is at least `least`. An alignment of words often shows it; else it is worked out."""
    most = (1 - least) * max(len(a), len(b)) + 1e-9
    if abs(len(a) - len(b)) > most:
        return False
    return _shown(a, b, most) or edit_similarity(a, b, least) >= least


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _far(pairs: list[tuple[str, str]], least: float) -> np.ndarray:
    """Which pairs (longer, shorter) pieces show to be less similar; False proves nothing.

    An alignment of few enough edits puts each piece of the longer line opposite some run of the shorter one, shifted by
    no more than the edits before and after the piece allow. So the least distances of the pieces to any run of what they
    can reach add up to no more than the distance of the lines. A piece is a word of bits; letters count by 64 classes,
    which only makes distances smaller."""
    texts = {t: i for i, t in enumerate({t: None for pair in pairs for t in pair})}
    codes = (_codes("".join(texts)) & 63).astype(np.int64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    a, b = (np.fromiter((texts[t] for t in side), np.int64, len(pairs)) for side in zip(*pairs))
    most = ((1 - least) * size[a] + 1e-9).astype(np.int64)
    apart = size[b] - size[a]
    low, high = (apart - most) // 2, (apart + most + 1) // 2
    n = -(-size[a] // PIECE)
    found = np.zeros(len(pairs), np.int64)
    # half of the pieces tell most pairs
    for part in range(2):
        left = np.flatnonzero((found <= most) & (n > part))
        ends = np.cumsum((n[left] + 1 - part) // 2)
        at = 0
        while at < len(left):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECES, "right")))
            some, at = left[at:to], to
            lanes = (n[some] + 1 - part) // 2
            owner = np.repeat(some, lanes)
            number = 2 * (np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) + part
            first, last = (size[a[owner]] * k // n[owner] for k in (number, number + 1))
            start, end = np.maximum(first + low[owner], 0), np.minimum(last + high[owner], size[b[owner]])
            found += np.bincount(owner, _nearest(codes, begin[a[owner]] + first, last - first, begin[b[owner]] + start, np.maximum(end - start, 0)), len(found)).astype(np.int64)
    return found > most


def _nearest(codes: np.ndarray, first: np.ndarray, size: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """For each piece codes[first : first + size] its least distance to any run of codes[start : start + width]. A piece
    ends at its word's highest bit; the bits below it match any letter."""
    order = np.argsort(-width, kind="stable")
    first, size, at, width = first[order], size[order], start[order], width[order]
    n, free = len(order), (PIECE - size).astype(np.uint64)
    one, all_bits, sign = np.uint64(1), ~np.uint64(0), np.uint64(63)
    owner = np.repeat(np.arange(n), size)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    masks = np.repeat((one << free) - one, 64)
    np.bitwise_or.at(masks, owner * 64 + codes[first[owner] + place], one << (place.astype(np.uint64) + free[owner]))
    plus, minus, row = all_bits << free, np.zeros(n, np.uint64), np.arange(n) * 64
    score, best = size.copy(), size.copy()
    for left in np.searchsorted(-width, -np.arange(width[0]), "left").tolist() if n else []:
        p, m, here = plus[:left], minus[:left], at[:left]
        eq = codes.take(here)
        eq += row[:left]
        eq = masks.take(eq)
        here += 1
        x = eq | m
        d = eq & p
        d += p
        d ^= p
        d |= eq
        up = d | p
        np.invert(up, out=up)
        up |= m
        d &= p
        now = score[:left]
        now += (up >> sign).view(np.int64)
        now -= (d >> sign).view(np.int64)
        np.minimum(best[:left], now, out=best[:left])
        up <<= one
        d <<= one
        np.bitwise_and(up, x, out=m)
        x |= up
        np.invert(x, out=x)
        np.bitwise_or(d, x, out=p)
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def all_similar(pairs: list[tuple[str, str]], least: float) -> np.ndarray:
    """edit_similarity(a, b, least) >= least for many pairs at once: the same bits as there, a word of 64 for each pair in
    an array. Pairs of long lines that their pieces tell apart are not compared."""
    pairs = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    out = np.array([a == b for a, b in pairs], bool)
    order = np.array([p for p, (a, b) in enumerate(pairs) if a != b and b and len(b) >= least * len(a) - 1e-9], np.int64)
    long = np.array([len(pairs[p][0]) > PIECE for p in order.tolist()], bool)
    if long.any():
        far = np.zeros(len(order), bool)
        far[long] = _far([pairs[p] for p in order[long].tolist()], least)
        order = order[~far]
    order = sorted(order.tolist(), key=lambda p: (len(pairs[p][0]), len(pairs[p][1])))
    at = 0
    while at < len(order):
        words = len(pairs[order[at]][0]) + 63 >> 6
        most = words * 5 // 4 << 6
        end = at + 1
        while end < len(order) and end - at < 2048 and len(pairs[order[end]][0]) <= most:
            end += 1
        which, at = order[at:end], end
        # a few pairs, and lines of many words, are quicker one by one
        if words > 64 or len(which) < 20 + 5 * words:
            for p in which:
                out[p] = edit_similarity(*pairs[p], least) >= least
            continue
        codes = _codes("".join(t for p in which for t in pairs[p]))
        used = np.zeros(int(codes.max()) + 1, bool)
        used[codes] = True
        # numbers of the letters that occur, from 0
        place, letters = np.cumsum(used) - 1, int(used.sum())
        # 8 MB of letters' masks and of text each
        step = max(1, (1 << 20) // max((letters + 1) * words * 5 // 4, most))
        for lo in range(0, len(which), step):
            some = which[lo : lo + step]
            out[some] = _all_within([pairs[p] for p in some], least, place, letters)
    return out


def _all_within(pairs: list[tuple[str, str]], least: float, numbers: np.ndarray, letters: int) -> np.ndarray:
    """all_similar() of pairs (longer, shorter) of about the same length; numbers of their letters by code. Only words
    that a path of few enough edits can touch are worked on; what lies beyond counts as more distant, which it is. Pairs
    that cannot reach `least` any more are dropped on the way, and the last few are compared one by one."""
    n = len(pairs)
    size, other = (np.array([len(t) for t in side]) for side in zip(*pairs))
    own, words = size - 1 >> 6, int(size.max()) + 63 >> 6
    owner = np.repeat(np.arange(n), size)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    letter = numbers[_codes("".join(a for a, _ in pairs))]
    # letter `letters`, which no line has, stands beyond the end of a line
    letters += 1
    masks = np.zeros(words * n * letters, np.uint64)
    np.bitwise_or.at(masks, ((place >> 6) * n + owner) * letters + letter, np.uint64(1) << (place & 63).astype(np.uint64))
    masks = masks.reshape(words, -1)
    text = np.full((n, int(other.max())), letters - 1)
    text[np.arange(text.shape[1]) < other[:, None]] = numbers[_codes("".join(b for _, b in pairs))]
    text += np.arange(n)[:, None] * letters
    text = np.ascontiguousarray(text.T)

    most = (1 - least) * size + 1e-9
    out, left = np.zeros(n, bool), np.arange(n)
    score, end = size.copy(), (size - 1 & 63).astype(np.uint64)
    plus, minus = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    one, top, far, shortest, first = np.uint64(1), np.uint64(63), int((most + size - other).max()) // 2 + 1, int(other.min()), int(own.min())
    for at in range(len(text)):
        up_in, down_in = one, None
        for w in range(max(0, at - far) >> 6, min(words, (at + far >> 6) + 1)):
            p, m, eq = plus[w], minus[w], masks[w].take(text[at])
            x = eq | m
            if down_in is not None:
                eq |= down_in
            d = eq & p
            d += p
            d ^= p
            d |= eq
            up = d | p
            np.invert(up, out=up)
            up |= m
            d &= p
            up_out, down_out = up >> top, d >> top
            if w < first:
                change = up_out, down_out
            else:
                # the score is that of a line's last letter, or of the last row worked on
                by = np.where(own == w, end, top)
                here = (up >> by & one, d >> by & one)
                change = here if w == first or down_in is None else tuple(np.where(own >= w, new, old) for new, old in zip(here, change))
            up <<= one
            up |= up_in
            d <<= one
            if down_in is not None:
                d |= down_in
            np.bitwise_and(up, x, out=m)
            x |= up
            np.invert(x, out=x)
            np.bitwise_or(d, x, out=p)
            up_in, down_in = up_out, down_out
        step = change[0].view(np.int64) - change[1].view(np.int64)
        score += step if at < shortest else np.where(at < other, step, 0)
        if at & 7 == 7 or at == len(text) - 1:
            rest = np.maximum(other - 1 - at, 0)
            going = (score - rest <= most) & (rest > 0)
            ended = rest == 0
            out[left[ended]] = 1 - score[ended] / size[ended] >= least
            if going.sum() < 4 * words:
                for k in left[going].tolist():
                    out[k] = edit_similarity(*pairs[k], least) >= least
                break
            if going.sum() < 0.8 * len(left):
                left, size, other, own, most, score, end = (v[going] for v in (left, size, other, own, most, score, end))
                plus, minus, text = plus[:, going], minus[:, going], text[:, going]
    return out


def _majority(lanes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits for each row of 64 counts: those counted in more than half of `sizes`."""
    return np.packbits(lanes.view(np.uint8).reshape(-1, 64) > np.minimum(sizes // 2, 255).astype(np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _mixed(h: np.ndarray, level) -> np.ndarray:
    h = (h ^ ((np.asarray(level) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def blocks(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, block) of runs of `counts` distinct hashed words. Lines of middling length are dealt a second time, by other
    bits of the hashes, as they have few blocks."""
    first = _dealt(hashes, counts, 0)
    some = (counts >= 3 * WORDS) & (counts < 12 * WORDS)
    if not some.any():
        return first
    part = hashes[np.repeat(some, counts)]
    line, block = _dealt((part << np.uint64(16)) | (part >> np.uint64(48)), counts[some], 32)
    return np.append(first[0], np.flatnonzero(some)[line]), np.append(first[1], block)


def _dealt(hashes: np.ndarray, counts: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, block): a block is the SimHash of the words whose hashes share their leading bits, as many bits as the level
    of the line; near the step to its level a line also has the blocks of the level below."""
    line = np.repeat(np.arange(len(counts)), counts)
    place = (line.astype(np.uint64) << np.uint64(16)) | (hashes >> np.uint64(48))
    h, n = hashes if (place[1:] >= place[:-1]).all() else hashes[np.argsort(place)], counts[line]
    level = np.minimum(14, np.floor(np.log2(np.maximum(1, counts // WORDS)))).astype(np.int64)
    below = (level > 0) & (counts < 1.3 * WORDS * 2.0**level)
    # words of blocks that are not used, at either level, need not vote
    used = np.flatnonzero((h >> np.uint64(48)) >> (16 - level[line]).astype(np.uint64) < 2 * BLOCKS)
    if len(used) < len(h):
        h, n, line = h[used], n[used], line[used]
    lanes = _LANES[h.view(np.uint8)].reshape(-1, 8)
    lines, found = [], []

    def take(level: np.ndarray, which: np.ndarray) -> None:
        at = slice(None) if which.all() else np.flatnonzero(which[line])
        own = line[at]
        if not len(own):
            return
        part = (h[at] >> np.uint64(48)) >> (16 - level[own]).astype(np.uint64)
        new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (part[1:] != part[:-1])))
        sizes = np.diff(np.append(new, len(own)))
        owner = own[new]
        # two words are often two common ones; whole lines may have two
        keep = (sizes > np.where(level[owner] > 0, 2, 1)) & (part[new] < BLOCKS)
        lines.append(owner[keep])
        found.append(_mixed(_majority(np.add.reduceat(lanes[at], new, axis=0)[keep], sizes[keep]), level[owner][keep] + salt))

    take(level, np.ones(len(counts), bool))
    take(level - 1, below)
    if not salt:
        short = (counts > 1) & (counts < 4 * WORDS)
        take(np.zeros(len(counts), np.int64), short & (level > 0) & ~(below & (level == 1)))
        at = np.flatnonzero((short & (counts > 3))[line])
        if len(at):
            # all words but one
            new = np.flatnonzero(np.append(True, line[at][1:] != line[at][:-1]))
            sizes = np.diff(np.append(new, len(at)))
            rest = np.repeat(np.add.reduceat(lanes[at], new, axis=0), sizes, axis=0) - lanes[at]
            lines.append(line[at])
            found.append(_mixed(_majority(rest, n[at] - 1), 0))
    return np.concatenate(lines), np.concatenate(found)


def _split(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(starts of words, their lines, hashes of words, lines normalised) of text in lower case. Lines are those with
    words, words of a line follow each other; hashes serve blocks only, so they need not be strong."""
    raw = np.frombuffer(data, np.uint8)
    solid = ~_SPACE[raw]
    if not solid.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), []
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    size, letter = ends - starts, raw[solid]
    factors = _FACTORS if size.max() <= len(_FACTORS) else np.resize(_FACTORS, size.max())
    hashes, total, done = np.empty(len(size), np.uint64), np.cumsum(size), 0
    while done < len(size):
        # about a million letters at a time
        base = total[done] - size[done]
        to = max(done + 1, int(np.searchsorted(total, base + (1 << 20))))
        first, part = total[done:to] - size[done:to] - base, letter[base : total[to - 1]]
        hashes[done:to] = np.add.reduceat(_VALUES[part] * factors[np.arange(len(part)) - np.repeat(first, size[done:to])], first)
        done = to
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    number = np.searchsorted(np.flatnonzero(raw == 10), starts)
    new = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    last = np.append(new[1:], len(number)) - 1
    # in normal form already: only single spaces between words
    gaps = np.append(starts[1:], len(raw)) - ends == 1
    gaps &= raw[np.minimum(ends, len(raw) - 1)] == 32
    gaps[last] = True
    plain = np.logical_and.reduceat(gaps, new)
    texts = [data[lo:hi] if ok else b" ".join(data[lo:hi].split()) for lo, hi, ok in zip(starts[new].tolist(), ends[last].tolist(), plain.tolist())]
    return number[new], np.repeat(np.arange(len(new)), last - new + 1), hashes, texts


def _distinct(line: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words by line and hash, each once."""
    order = np.argsort((line.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    line, hashes = line[order], hashes[order]
    keep = np.append(True, (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1]))[: len(line)]
    return line[keep], hashes[keep]


def _pieces(batch: pa.RecordBatch):
    """Slices of 512 rows at most, and of about a megabyte of text or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) >> 20
    cuts = np.union1d(np.flatnonzero(size[1:] != size[:-1]) + 1, np.arange(0, batch.num_rows, 512))
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
        yield batch.slice(lo, hi - lo)


def _shortened(text: str) -> set[int]:
    """Hashes of a short line with one or two letters left out, or none: lines one edit apart share one of up to one, two
    edits apart one of up to two. By SIMILARITY that is what lines of up to 9 and up to 14 letters may differ in; the
    shorter of a pair has 4 and 8 at least."""
    once = {text[:i] + text[i + 1 :] for i in range(len(text))} | {text}
    made = {b"\1" + x.encode("utf-8", "replace") for x in once} if 4 <= len(text) <= 9 else set()
    if 8 <= len(text) <= SHORT:
        made |= {b"\2" + y.encode("utf-8", "replace") for x in once for y in [x, *(x[:i] + x[i + 1 :] for i in range(len(x)))] if len(y) >= len(text) - 2}
    return {xxhash.xxh64_intdigest(x) for x in made}


def _lines(batches):
    """Lines with words: (key, doc_id, text, at, line, blocks); blocks where the task meets the line for the first time."""
    number, seen = TaskContext.get().partitionId() << 40, set()
    for batch in batches:
        for part in _pieces(batch):
            rows = [text or b"" for text in part.column(1).cast(pa.binary()).to_pylist()]
            digests = np.array([int.from_bytes(xxhash.xxh64_digest(text, 42), "big", signed=True) for text in rows], np.int64)
            at, of, hashes, texts = _split(b"\n".join(rows).lower())
            # the first line of each row, among the lines of all
            first = np.cumsum([0] + [text.count(b"\n") + 1 for text in rows])
            row = np.searchsorted(first, at, "right") - 1
            keys = [xxhash.xxh64_intdigest(text) & _MASK for text in texts]
            if keys:
                new = np.zeros(len(keys), bool)
                for k, key in enumerate(keys):
                    if key not in seen:
                        if len(seen) > SEEN:
                            seen.clear()
                        seen.add(key)
                        new[k] = True
                asked = new[of]
                of, hashes = _distinct(of[asked], hashes[asked])
                counts = np.bincount(of, minlength=len(keys))
                owners = np.flatnonzero(counts > 1)
                hashes, counted = hashes[counts[of] > 1], counts[owners]
                # of lines with few words, pairs of letters
                pairs = [(k, {b"\0" + texts[k][i : i + 2] for i in range(max(1, len(texts[k]) - 1))}) for k in np.flatnonzero(new & (counts < 4)).tolist()]
                if pairs:
                    hashes = np.append(hashes, np.fromiter((xxhash.xxh64_intdigest(x) for _, some in pairs for x in some), np.uint64))
                    owners, counted = np.append(owners, [k for k, _ in pairs]), np.append(counted, [len(some) for _, some in pairs])
                found, line = np.empty(0, np.uint64), np.empty(0, np.int64)
                if len(counted):
                    line, found = blocks(hashes, counted)
                    line = owners[line]
                short = [(k, x) for k in np.flatnonzero(new).tolist() if len(texts[k]) <= 4 * SHORT for x in _shortened(texts[k].decode("utf-8", "replace"))]
                if short:
                    line, found = np.append(line, [k for k, _ in short]), np.append(found, np.array([x for _, x in short], np.uint64))
                order = np.argsort(line, kind="stable")
                ends = np.cumsum(np.bincount(line, minlength=len(keys)))
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(found[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), part.column(0).cast(pa.int64()).take(pa.array(row)), pa.array(digests[row]), pa.array(number + row), pa.array((at - first[row]).astype(np.int32)), listed],
                    names=["key", "doc_id", "text", "at", "line", "blocks"],
                )
            number += part.num_rows


def _texts(wanted=None):
    """Rows of text to (key, line_text) of their lines; wanted: a broadcast of the sorted keys of those to tell."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                seen: dict[int, bytes] = {}
                for text in part.column(0).cast(pa.binary()).to_pylist():
                    for line in (text or b"").split(b"\n"):
                        if t := normalised(line):
                            seen[xxhash.xxh64_intdigest(t) & _MASK] = t
                keys, told = np.fromiter(seen, np.int64, len(seen)), list(seen.values())
                if wanted is not None and len(keys):
                    known = wanted.value
                    asked = np.flatnonzero(known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys) if len(known) else []
                    keys, told = keys[asked], [told[k] for k in asked]
                if told:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(told, pa.binary()).cast(pa.string())], names=["key", "line_text"])

    return run


def _groups(batches):
    """Rows sorted by their first column, as one list of arrays for each of its values."""
    held, last = [], None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        cuts = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(columns[0])]):
            if held and columns[0][lo] != last:
                yield [np.concatenate(x) if len(x) > 1 else x[0] for x in held]
                held = []
            if not held:
                held = [[] for _ in columns]
            for have, c in zip(held, columns):
                have.append(c[lo:hi])
            last = columns[0][lo]
    if held:
        yield [np.concatenate(x) if len(x) > 1 else x[0] for x in held]


def _links(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*pairs))
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["a", "b"])


def _met(batches):
    """(block, key) sorted by block, to (company, first, key): the lines of each block with several, named by those lines.
    first is the company's smallest key, by which companies that share lines go to one task; large companies go alone."""
    names, firsts, keys, held = [], [], [], 0
    pending, last = None, None

    def close():
        nonlocal held
        if pending is not None and (len(pending) > 1 or len(pending[0]) > 1):
            some = np.unique(np.concatenate(pending))
            if len(some) > 1:
                names.append(np.full(len(some), xxhash.xxh64_intdigest(some.tobytes()), np.uint64).view(np.int64))
                firsts.append(np.full(len(some), some[0]) if len(some) <= CHAINED else names[-1])
                keys.append(some)
                held += len(some)

    def out():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (names, firsts, keys)], names=["company", "first", "key"])

    for batch in batches:
        block, key = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(block):
            continue
        cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
        starts, ends = np.append(0, cuts), np.append(cuts, len(block))
        # only the first and last block of a batch may go on beyond it; of the others only those of several rows matter
        inner = np.flatnonzero(ends - starts > 1)
        edge = {0, len(starts) - 1}
        for g in sorted(edge | set(inner.tolist())):
            lo, hi = int(starts[g]), int(ends[g])
            if pending is not None and block[lo] == last:
                pending.append(key[lo:hi])
            else:
                close()
                pending, last = [key[lo:hi]], block[lo]
        if held > 50_000:
            yield out()
            names, firsts, keys, held = [], [], [], 0
    close()
    if names:
        yield out()


def _letters(texts: list[str]) -> np.ndarray:
    """How often each class of letters occurs in each text."""
    return np.stack([np.bincount(_codes(t) & 63, minlength=64) for t in texts]).astype(np.int32)


def _company(texts: list[str], least: float, label: np.ndarray):
    """Pairs (i, j) that connect all texts at least so similar; texts of equal labels are connected already. Asks for
    comparisons: yields lists of pairs of texts and is sent which of them are similar.

    First come pairs that an alignment of words may show to be similar: neighbours in alphabetical order, then lines and
    those nearest by letters. Then all are compared that are not connected yet and whose letters allow it: a distance is
    at least the letters one has more than the other."""
    links: list[tuple[int, int]] = []
    if (label == label[0]).all():
        return links

    def link(i: int, j: int) -> None:
        label[label == label[i]] = label[j]
        links.append((i, j))

    def shown(i: int, j: int) -> bool:
        most = (1 - least) * max(len(texts[i]), len(texts[j])) + 1e-9
        return abs(len(texts[i]) - len(texts[j])) <= most and _alike(texts[i], texts[j]) and _shown(texts[i], texts[j], most)

    order = sorted(range(len(texts)), key=texts.__getitem__)
    for i, j in zip(order, order[1:]):
        if label[i] != label[j] and shown(i, j):
            link(i, j)
    if (label == label[0]).all():
        return links
    counts, length = _letters(texts), np.array([len(t) for t in texts])
    # the largest part need not be compared with itself
    parts, sizes = np.unique(label, return_counts=True)
    outside = label != parts[sizes.argmax()]
    asked: list[tuple[int, int]] = []
    different: set[tuple[int, int]] = set()

    def settle():
        # the nearest of each line first, as many others are connected by them
        for some in ({i: (i, j) for i, j in reversed(asked)}.values(), asked):
            some = [(i, j) for i, j in some if label[i] != label[j] and (i, j) not in different]
            for (i, j), yes in zip(some, (yield [(texts[i], texts[j]) for i, j in some]) if some else []):
                if not yes:
                    different.add((i, j))
                elif label[i] != label[j]:
                    link(i, j)
        asked.clear()
        different.clear()

    for i in np.flatnonzero(outside).tolist():
        for at in range(0, len(texts), 4096):
            to = slice(at, at + 4096)
            # of two outside, the first is compared with the second
            near = np.flatnonzero((label[to] != label[i]) & ~(outside[to] & (np.arange(at, at + len(label[to])) < i))) + at
            apart = counts[near] - counts[i]
            bound = np.maximum(np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1))
            may = bound <= (1 - least) * np.maximum(length[near], length[i]) + 1e-9
            near = near[may][np.argsort(bound[may])]
            failed = 0
            for j in near.tolist():
                if label[i] != label[j]:
                    if failed < 2 and shown(i, j):
                        link(i, j)
                    else:
                        failed += 1
                        asked.append((i, j))
        if len(asked) >= ASKED:
            yield from settle()
    yield from settle()
    return links


def _chain(companies: list[list[str]], least: float):
    """_company() of one company after the other; what is connected in one is so in the next."""
    above: dict[str, str] = {}

    def top(t: str) -> str:
        while (up := above.get(t, t)) is not t:
            above[t] = t = above.get(up, up)
        return t

    links: list[list[tuple[int, int]]] = [[] for _ in companies]
    for c in sorted(range(len(companies)), key=lambda c: -len(companies[c])):
        texts, known = companies[c], {}
        label = np.array([known.setdefault(top(t), i) for i, t in enumerate(texts)]) if above else np.arange(len(texts))
        links[c] = yield from _company(texts, least, label)
        if len(companies) > 1:
            for i, j in links[c]:
                if (a := top(texts[i])) != (b := top(texts[j])):
                    above[a] = b
    return links


def _connect_all(chains: list[list[list[str]]], least: float) -> list[list[list[tuple[int, int]]]]:
    """The links of each company of each chain; the comparisons that chains ask for are made together."""
    links: list[list[list[tuple[int, int]]]] = [[] for _ in chains]
    runs, answers = {c: _chain(companies, least) for c, companies in enumerate(chains)}, dict.fromkeys(range(len(chains)))
    while runs:
        asked = {}
        for c in list(runs):
            try:
                asked[c] = runs[c].send(answers[c])
            except StopIteration as end:
                links[c] = end.value
                del runs[c]
        pairs = {pair: False for some in asked.values() for pair in some}
        pairs = dict(zip(pairs, all_similar(list(pairs), least).tolist()))
        answers = {c: [pairs[pair] for pair in some] for c, some in asked.items()}
    return links


def _connect(texts: list[str], least: float) -> list[tuple[int, int]]:
    """Pairs (i, j) that connect all texts at least so similar, whatever words they share."""
    return _connect_all([[texts]], least)[0][0]


def _verified(least: float):
    """(company, first, key, text) sorted by first and company, to links between keys."""

    def run(batches):
        chains, last, n = [], None, 0

        def links():
            found = _connect_all([[texts for _, texts in chain] for chain in chains], least)
            found = [(keys[i], keys[j]) for chain, parts in zip(chains, found) for (keys, _), some in zip(chain, parts) if some for i, j in [map(list, zip(*some))]]
            return [_links(found)] if found else []

        for _, first, keys, texts in _groups(batches):
            if not chains or first[0] != last:
                chains.append([])
                last = first[0]
            chains[-1].append((keys, texts.tolist()))
            n += len(keys)
            if n >= COMPANIES:
                yield from links()
                chains, n = [], 0
        if chains:
            yield from links()

    return run


def occurrences(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text, at, line, key, group, kept) for each line with words of docs (doc_id, text).

    text is the hash of the row's text by xxhash64(), at a number for the row, line counts from 0 over all lines of the text, blank ones
    included. group is the smallest key of the connected group; kept marks its first occurrence, which is one line of
    one row: by doc_id (null last), then, among rows that share it, by their texts, then by line; among equal rows any
    one. Null and empty texts and those of white space have no lines. Empty input: no rows."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with released_shuffles(spark):
        found = checkpoint(docs.mapInArrow(_lines, "key long, doc_id long, text long, at long, line int, blocks array<long>"))
        place = F.struct(F.coalesce("doc_id", F.lit(_LAST_ID)).alias("d"), F.col("doc_id").isNull().alias("n"), F.col("text").alias("t"), F.col("line").alias("l"), F.col("at").alias("a"))
        dealt = found.select(F.explode("blocks").alias("block"), "key").repartition("block").sortWithinPartitions("block")
        met = checkpoint(dealt.mapInArrow(_met, "company long, first long, key long").distinct())
        again = checkpoint(met.select("key").distinct())
        if again.count() <= BROADCAST_KEYS:
            wanted = spark.sparkContext.broadcast(np.sort(again.toArrow().column("key").to_numpy()))
            told = docs.select("text").mapInArrow(_texts(wanted), "key long, line_text string")
        else:
            told = docs.select("text").mapInArrow(_texts(), "key long, line_text string").join(again, "key")
        told = told.groupBy("key").agg(F.min("line_text").alias("line_text"))
        asked = met.join(told, "key").select("company", "first", "key", "line_text").repartition("first").sortWithinPartitions("first", "company")
        roots = checkpoint(components(asked.mapInArrow(_verified(similarity), "a long, b long")))
        joined = F.broadcast(roots) if roots.count() <= BROADCAST_KEYS else roots
        grouped = found.drop("blocks").join(joined, found.key == roots.node, "left").drop("node").withColumn("group", F.coalesce("root", "key")).drop("root")
        leaders = checkpoint(grouped.groupBy("group").agg(F.min(place).alias("leader"), F.count("*").alias("n")).where("n > 1"))
        forget(met, again)
    kept = F.col("leader").isNull() | (place == F.col("leader"))
    return join_counted(grouped, leaders, "group", "n", "left").select("doc_id", "text", "at", "line", "key", "group", kept.alias("kept"))


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text, at, n_lines, removed) for each row of docs with lines: how many lines with words, and the sorted
    numbers of those to remove; text is a hash of the row's text, at a number for the row."""
    found = occurrences(docs, similarity)
    return found.groupBy("doc_id", "text", "at").agg(F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.when(~F.col("kept"), F.col("line")))).alias("removed"))


def clean(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the removed lines; all columns and rows stay, and so do blank lines. Rows that share a doc_id, or
    have none, are told apart by their texts; of equal texts under one doc_id one keeps its lines. Empty input: no rows."""
    rows = removed_lines(docs.select("doc_id", "text"), similarity)
    gone = rows.groupBy(F.coalesce("doc_id", F.lit(_LAST_ID)).alias("_id"), F.col("text").alias("_text")).agg(F.min_by("removed", "at").alias("_removed"))
    text = F.col("_row.text").cast("string")
    kept = packed(docs).withColumn("_id", F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(_LAST_ID))).withColumn("_text", F.xxhash64(F.coalesce(text, F.lit(""))))
    joined = kept.join(gone, ["_id", "_text"], "left").withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_text").orderBy("_id")))
    # whatever is kept of equal rows is kept in the first
    out = lambda x, i: F.when(F.col("_nth") > 1, x.rlike(WORD)).otherwise(F.array_contains(F.col("_removed"), i))
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~out(x, i)), "\n")
    changed = F.col("_removed").isNotNull() & ((F.size("_removed") > 0) | (F.col("_nth") > 1))
    return joined.select(*[F.when(changed, left).otherwise(text).alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
