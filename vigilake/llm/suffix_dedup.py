"""Exact removal of repeated 100-byte strings, with suffix arrays by two-stage sorting.

Every 100-byte window is represented by an anchor, its least-hashed 32-byte gram, which copies of the window share.
Consecutive windows of one anchor form a stretch. Hashes of anchors only deal the work: stretches whose anchor stands
elsewhere too are cut out of their texts and meet, as bytes, by anchor. There equal strings fold, and the suffixes of
the different ones are sorted: those smaller than their successors directly, the others induced by a scan of the
buckets. Adjacent common prefixes of 100 bytes or more give the classes of equal windows, and of each class all but the
first window are removed. An anchor with very many stretches is dealt by the windows' own hashes instead.

Within a batch equal stretches fold on their bytes before anything is shuffled, so a common line costs a row a batch.
Blocks that are sorted have a bounded size; what a block leaves of an unfinished group, its different strings, goes on
to the next block.

Defined results: null and empty texts have no bytes; ids order the documents; rows that repeat an id with its text count
as one document, different texts of an id as documents of their own, ordered by the texts' hashes; a row with a null id
keeps its whole text and is no source of copies; texts shorter than a window keep all; texts of any length are read
whole, in pieces that overlap by a window less a byte."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, discard, mix64, narrow_batches, odd_numbers, settle

#: Bytes of a repeated string and of an anchor, bytes that are hashed and that are sorted at a time, and stretches of an
#: anchor beyond which it is dealt by windows.
WINDOW, GRAM, PIECE, BLOCK, OFTEN = 100, 32, 1 << 20, 1 << 21, 30_000
REACH = (WINDOW - GRAM) // 2
_LOW = U64((1 << 22) - 1)
_TABLES = [np.random.default_rng(s).integers(0, 2**64 - 1, 256, dtype=np.uint64) for s in (1, 2)]
_BASE = odd_numbers(1, 3)[0]
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        n = max(n, PIECE + 4096)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Polynomial hashes of any stretch of a byte array, modulo 2**64."""

    def __init__(self, data: np.ndarray, table: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` consecutive values: block-wise prefix and suffix minima."""
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, ~U64(0))
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """data: documents one after another; ends: where they end. (anchor hash, stretch hash, start, shape) of all stretches.

    ``shape`` holds the length in its low 8 bits, then 8 bits each of the anchor's left and right sides."""
    if len(data) < WINDOW:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    roll = Rolling(data, _TABLES[0])
    gram = mix64(roll.all(GRAM))
    least = sliding_least((gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64), WINDOW - GRAM + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = np.maximum(ends - starts - WINDOW + 1, 0)
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())  # windows within documents
    anchor = (least[at] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(at) else np.empty(0, np.int64)
    last = np.concatenate([first[1:] - 1, [len(at) - 1]]) if len(first) else first
    lo, q = at[first], anchor[first]
    length = at[last] - lo + WINDOW
    # a window that two stretches share reaches REACH bytes beyond the anchor on one side at least
    left = side(roll, np.maximum(q - REACH, 0), q - lo >= REACH)
    right = side(roll, q, lo + length - q - GRAM >= REACH)
    whole = mix64(roll.of(lo, length) + length.astype(np.uint64) * U64(0x9E3779B97F4A7C15)) + (q - lo).astype(np.uint64) * U64(0xD6E8FEB86659FD93)
    return gram[q], mix64(whole), lo, length | (left << 8) | (right << 16)


def side(roll: Rolling, start: np.ndarray, long_enough: np.ndarray) -> np.ndarray:
    """Eight bits of the anchor's and its side's bytes, never 0; 0 where the stretch does not reach so far."""
    start = np.where(long_enough, start, 0)
    return np.where(long_enough, (mix64(roll.of(start, GRAM + REACH)) % U64(255)).astype(np.int64) + 1, 0)


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a text column: where each row begins and ends among the bytes; a null row is empty."""
    col = col.cast(pa.large_binary())
    bounds = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return np.frombuffer(col.buffers()[2] or b"", np.uint8), bounds


def pieces(data: np.ndarray, bounds: np.ndarray, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, row numbers, offsets within their rows) of texts in pieces of bounded size.

    A text over the bound is cut with an overlap of a window less a byte, so each window lies in one piece."""
    row, lo, hi, off = [], [], [], []
    size = 0

    def out():
        parts = [data[a:b] for a, b in zip(lo, hi)]
        return np.concatenate(parts), np.cumsum([len(p) for p in parts]), np.array(row), np.array(off)

    for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        at = a
        while b - at >= WINDOW:
            end = min(b, at + piece)
            if size and size + end - at > piece:
                yield out()
                row, lo, hi, off, size = [], [], [], [], 0
            row.append(r), lo.append(at), hi.append(end), off.append(at - a)
            size += end - at
            if end == b:
                break
            at = end - WINDOW + 1
    if size:
        yield out()


def runs(doc: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of documents, merged where they touch."""
    order = np.lexsort((at, doc))
    doc, at, end = doc[order], at[order], (at + length)[order]
    if not len(doc):
        return doc, at, end
    ids = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    reach = np.maximum.accumulate(end + ids * (1 << 40)) - ids * (1 << 40)  # running maximum within a document
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > reach[:-1])]))
    return doc[new], at[new], np.maximum.reduceat(end, new) - at[new]


def first_and_later(key: np.ndarray, sub: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the first row of each (key, sub) and of the later ones, by (doc, at), and the first of each later."""
    order = np.lexsort((at, doc, sub, key))
    new = np.ones(len(order), bool)
    k, s = key[order], sub[order]
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    d, a = doc[order], at[order]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
    same = (d == d[head]) & (a == a[head])  # the same place once more, from a repeated row
    later = ~new & ~same
    return order[new], order[later], order[head[later]]


# what a row is: a stretch or window to be compared; one whose anchor stands elsewhere too, or very often; bytes to remove
COMPARE, RESOLVE, OFTEN_SEEN, REMOVE = 0, 1, 2, 3
#: What is shuffled first. ``place`` holds the offset, the shape (24 bits) and the kind (2 bits), so it sorts by offset.
DEALT = "h long, doc long, place long"
#: What the comparison of anchors says, and the bytes that meet by ``key``.
FOUND, CUT = "kind int, key long, doc long, at long, len long", "key long, doc long, at long, bytes binary"
LONGEST = 1 << 23
HASH_BITS = U64((1 << 48) - 1)  # of an anchor: a clash only asks for a needless comparison


def named(schema: str, *cols: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in cols], names=[x.split()[0] for x in schema.split(", ")])


def dealt(kind: int, h: np.ndarray, doc: np.ndarray, at: np.ndarray, shape: np.ndarray) -> pa.RecordBatch:
    return named(DEALT, h.view(np.int64), doc, (at << 26) | (shape << 2) | kind)


def dealt_removed(doc: np.ndarray, at: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """Intervals that only pass through: merged, cut to what a place can hold, and spread over the partitions."""
    doc, at, length = runs(doc, at, length)
    n = np.maximum(1, -(-length // LONGEST))
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    doc, at, length = np.repeat(doc, n), np.repeat(at, n) + k * LONGEST, np.minimum(np.repeat(length, n) - k * LONGEST, LONGEST)
    return dealt(REMOVE, mix64(doc.view(np.uint64)) & HASH_BITS, doc, at, length)


def found_rows(kind: int, key: np.ndarray, doc: np.ndarray, at: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    return named(FOUND, np.full(len(doc), kind, np.int32), key, doc, at, length)


def removed(doc: np.ndarray, at: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    doc, at, length = runs(doc, at, length)
    return found_rows(REMOVE, np.zeros(len(doc), np.int64), doc, at, length)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes from a on equal those from b on, row by row."""
    out = np.ones(len(a), bool)
    for lo in range(0, len(a), 20_000):
        x, y, n = (v[lo : lo + 20_000, None] for v in (a, b, length))
        k = np.arange(int(n.max()))[None, :]
        k = np.minimum(k, n - 1)
        out[lo : lo + 20_000] = (data[x + k] == data[y + k]).all(1)
    return out


def folded(data, h, s, doc, at, shape, absolute) -> Iterator[pa.RecordBatch]:
    """What travels of a batch: the first of its equal strings, and the removal of the later ones, equal byte for byte."""
    first, later, of = first_and_later(h, s, doc, at)
    same = (shape[later] & 255) == (shape[of] & 255)
    same[same] = same_bytes(data, absolute[later[same]], absolute[of[same]], shape[later[same]] & 255)
    travel = np.concatenate([first, later[~same]])
    yield dealt(COMPARE, h[travel] & HASH_BITS, doc[travel], at[travel], shape[travel])
    gone = later[same]
    yield dealt_removed(doc[gone], at[gone], shape[gone] & 255)


def find_stretches(piece: int = PIECE):
    """(doc, text) batches: stretches, equal ones of a batch folded into their first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, bounds = bytes_of(b.column(1))
            found = []
            for part, ends, row, off in pieces(data, bounds, piece):
                h, s, lo, shape = stretches(part, ends)
                i = np.searchsorted(ends, lo, "right")
                at = lo - np.concatenate([[0], ends[:-1]])[i] + off[i]
                found.append((h, s, ids[row[i]], at, shape, bounds[row[i]] + at))
            if found:
                yield from folded(data, *(np.concatenate(x) for x in zip(*found)))

    return run


def compare(often: int, sides: bool):
    """Over rows sorted by (h, doc, place): of an h that stands more than once, the rows that may share a window.

    ``sides`` lets only those pass that share a side of their anchor with another row. An h of more than ``often`` rows
    is streamed past; with ``sides`` its rows are marked as seen often. One group's rows are held at most."""

    def told(h, doc, place, many: bool) -> pa.RecordBatch:
        shape = (place >> 2) & ((1 << 24) - 1)
        keep = np.ones(len(h), bool)
        if sides and not many:
            keep[:] = False
            _, group = np.unique(h, return_inverse=True)
            for bits in (8, 16):
                one = (shape >> bits) & 255
                _, pair, k = np.unique(group * 256 + one, return_inverse=True, return_counts=True)
                keep |= (k[pair] > 1) & (one > 0)
        kind = OFTEN_SEEN if sides and many else RESOLVE
        return found_rows(kind, h[keep], doc[keep], place[keep] >> 26, shape[keep] & 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        passing = None  # the h that has proved to be often
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            kind = cols[2] & 3
            if (go := kind == REMOVE).any():
                yield removed(cols[1][go], cols[2][go] >> 26, (cols[2][go] >> 2) & ((1 << 24) - 1))
            h, doc, place = (np.concatenate([x, y[~go]]) for x, y in zip(held, cols))
            if not len(h):
                continue
            if passing is not None:
                n = int(np.searchsorted(h != passing, True))
                if n:
                    yield told(h[:n], doc[:n], place[:n], True)
                h, doc, place = h[n:], doc[n:], place[n:]
                if len(h):
                    passing = None
                else:
                    held = [h, doc, place]
                    continue
            # a place that a repeated row gives once more counts once
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
            h, doc, place = h[new], doc[new], place[new]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.diff(np.append(starts, len(h)))
            last = starts[-1]
            size = np.repeat(n, n)
            for many, rows in ((False, (size > 1) & (size <= often)), (True, size > often)):
                rows[last:] = False
                if rows.any():
                    yield told(h[rows], doc[rows], place[rows], many)
            held = [h[last:], doc[last:], place[last:]]
            if n[-1] > often:
                yield told(*held, True)
                passing, held = h[-1], [np.empty(0, np.int64)] * 3
        if len(held[0]) > 1:
            yield told(*held, False)

    return run


def suffix_order(t: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """The suffixes of ``t`` (symbols 0 to 256, 0 last) in order of their first ``depth`` symbols, by two-stage sorting."""
    n = len(t)
    packed = pack(t)
    change = np.flatnonzero(np.concatenate([t[1:] != t[:-1], [True]]))  # ends of runs of a symbol
    run = np.repeat(np.arange(len(change)), np.diff(np.concatenate([[-1], change])))
    after = np.concatenate([t[change[:-1] + 1], [t[-1]]])
    small = (after > t[change])[run]  # smaller than the successor
    small[change[-1]] = True  # the last suffix is sorted directly too
    small[run == len(change) - 1] = True
    direct = np.flatnonzero(small)
    order = direct[np.argsort(packed[direct], kind="stable")]
    key = packed[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(order) else order
    for step in range(7, depth, 7):  # refine what is still tied, seven symbols at a time
        n_of = np.bincount(group)
        tied = np.flatnonzero(n_of[group] > 1)
        if not len(tied):
            break
        sub = order[tied]
        key = packed[np.minimum(sub + step, n)]
        by = np.lexsort((key, group[tied]))
        order[tied] = sub[by]
        key, g = key[by], group[tied]
        split = np.zeros(len(order), np.int64)
        split[tied[1:]] = (key[1:] != key[:-1]) & (g[1:] == g[:-1])
        group = group + np.cumsum(split)
        # a group's number must stay unique: numbers grow with every split before them
    small_of = t[order]
    cuts = np.searchsorted(small_of, np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for c in range(257):
        larger = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        waiting[c] = []
        now = larger
        parts = [larger]
        while len(now):  # suffixes that repeat the symbol follow those they stand before
            now = now[now > 0] - 1
            now = now[(t[now] == c) & ~small[now]]
            parts.append(now)
        bucket = np.concatenate([*parts, order[cuts[c] : cuts[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(t[before] > c) & ~small[before]]
        if len(before):
            symbol = t[before]
            by = np.argsort(symbol, kind="stable")
            ends = np.searchsorted(symbol[by], np.arange(258))
            for x in np.unique(symbol):
                waiting[x].append(before[by[ends[x] : ends[x + 1]]])
    return np.concatenate(out) if out else np.empty(0, np.int64)


def pack(t: np.ndarray) -> np.ndarray:
    """Seven symbols from each place on in one integer; a zero beyond the end."""
    wide = np.concatenate([t, np.zeros(8, t.dtype)]).astype(np.uint64)
    out = np.zeros(len(t) + 1, np.uint64)
    for k in range(7):
        out |= wide[k : k + len(t) + 1] << U64(9 * (6 - k))
    return out


def common_prefix_reaches(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Whether suffixes a and b share their first ``depth`` symbols, seven at a time."""
    packed, n = pack(t), len(t)
    alive = np.arange(len(a))
    step = 0
    while step + 7 <= depth and len(alive):
        alive = alive[packed[np.minimum(a[alive] + step, n)] == packed[np.minimum(b[alive] + step, n)]]
        step += 7
    if len(alive) and depth > step:
        shift = U64(9 * (7 - (depth - step)))
        alive = alive[(packed[np.minimum(a[alive] + step, n)] >> shift) == (packed[np.minimum(b[alive] + step, n)] >> shift)]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def equal_windows(t: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the valid windows in suffix order, and the class of equal windows that each belongs to."""
    order = suffix_order(t)
    order = order[valid[order]]
    if not len(order):
        return order, order
    same = common_prefix_reaches(t, order[:-1], order[1:])
    return order, np.concatenate([[0], np.cumsum(~same)])


def wanted_of(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(data, row, key, at, length) of a (doc, text, wanted) batch: the wanted strings and the row that holds each; absolute places."""
    data, bounds = bytes_of(b.column(1))
    wanted = b.column(2)
    n = np.diff(wanted.offsets.to_numpy())
    row = np.repeat(np.arange(len(n)), n)
    key, at, length = (x.to_numpy(zero_copy_only=False) for x in wanted.flatten().flatten())
    return data, bounds, row, key, at, length


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, wanted) batches: the bytes of the wanted strings."""
    for b in batches:
        data, bounds, row, key, at, length = wanted_of(b)
        doc = b.column(0).to_numpy(zero_copy_only=False)
        for lo in range(0, len(row), 20_000):
            part = slice(lo, lo + 20_000)
            n = length[part]
            ends = np.cumsum(n)
            take = np.repeat(bounds[row[part]] + at[part] - (ends - n), n) + np.arange(n.sum())
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            cut = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data[take])])
            yield named(CUT, key[part], doc[row[part]], at[part], cut)


def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, wanted) batches: every window of the wanted strings, dealt by its hash, equal ones of a batch folded."""
    for b in batches:
        data, bounds, row, _, at, length = wanted_of(b)
        doc = b.column(0).to_numpy(zero_copy_only=False)
        found = []
        for r in np.unique(row):
            mine = row == r
            _, a, n = runs(np.zeros(mine.sum(), np.int64), at[mine], length[mine] - WINDOW + 1)  # windows that follow one another
            for x, k in zip(a.tolist(), n.tolist()):
                text = data[bounds[r] + x : bounds[r] + x + k + WINDOW - 1]
                h, s = (mix64(Rolling(text, t).all(WINDOW)) for t in _TABLES)
                place = x + np.arange(k)
                found.append((h, s, np.full(k, doc[r]), place, np.full(k, WINDOW), bounds[r] + place))
        if found:
            yield from folded(data, *(np.concatenate(x) for x in zip(*found)))


def resolve(block: int = BLOCK):
    """Over (key, doc, at, bytes) sorted so: equal strings fold, the others' suffixes are sorted, and of each class of equal
    windows all but the first are removed. The different strings of a group that a block leaves unfinished go on with the next."""

    def settle_block(key, doc, at, strings) -> tuple[pa.RecordBatch, list[int]]:
        known: dict[tuple[int, bytes], int] = {}
        first = np.array([known.setdefault(x, k) for k, x in enumerate(zip(key.tolist(), strings))])
        lens = np.array([len(x) for x in strings])
        mine = np.arange(len(key))
        later = (first != mine) & ~((doc == doc[first]) & (at == at[first]))
        gone = [(doc[later], at[later], lens[later])]
        own = np.flatnonzero(first == mine)
        _, group, n = np.unique(key[own], return_inverse=True, return_counts=True)
        several = own[n[group] > 1]
        if len(several):
            size = lens[several]
            starts = np.cumsum(size + 1) - size - 1
            data = np.frombuffer(b"".join(strings[k] for k in several), np.uint8)
            t = np.zeros(size.sum() + len(several), np.int16)
            t[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(len(data))] = data.astype(np.int16) + 1
            owner = np.repeat(np.arange(len(several)), size + 1)
            valid = np.zeros(len(t), bool)
            n = size - WINDOW + 1
            valid[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())] = True
            order, cls = equal_windows(t, valid)
            of = owner[order]
            d, a = doc[several][of], at[several][of] + order - starts[of]
            _, again, _ = first_and_later(cls, np.zeros_like(cls), d, a)
            gone.append((d[again], a[again], np.full(len(again), WINDOW)))
        return removed(*(np.concatenate(x) for x in zip(*gone))), own[key[own] == key[-1]].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        size = 0
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            at = 0
            while at < b.num_rows:
                end = at
                while end < b.num_rows and size < block:
                    size += len(cols[3][end])
                    end += 1
                for x, y in zip(held, cols):
                    x += y[at:end]
                at = end
                if size >= block:
                    out, left = settle_block(*(np.array(x, np.int64) for x in held[:3]), held[3])
                    yield out
                    held = [[x[k] for k in left] for x in held]
                    size = 0
        if held[0]:
            yield settle_block(*(np.array(x, np.int64) for x in held[:3]), held[3])[0]

    return run


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, doc, text) of every row, and what :func:`discard` may take; ``doc`` orders the documents and is null for a null id.

    It is the id itself, unless an id has several texts: then places in the order of (id, hash of the text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    of = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = rows.where("doc_id IS NOT NULL").select("doc_id", of.alias("of"))
    if not texts.groupBy("doc_id").agg(F.min("of").alias("a"), F.max("of").alias("b")).where("a < b").limit(1).count():
        return rows.select("doc_id", F.col("doc_id").alias("doc"), "text"), None
    places = texts.distinct().repartitionByRange("doc_id", "of").sortWithinPartitions("doc_id", "of")
    places = settle(places.withColumn("doc", F.monotonically_increasing_id()))  # ranges in order, so numbers in order
    return rows.withColumn("of", of).join(places, ["doc_id", "of"], "left").select("doc_id", "doc", "text"), places


def repeats(rows: DataFrame, piece: int = PIECE, block: int = BLOCK, often: int = OFTEN) -> tuple[DataFrame, list[DataFrame]]:
    """rows: (doc, text). (doc, spans): the bytes to remove of each document that has any, as a list of (at, len); and the tables that this reads."""
    solid = rows.where("doc IS NOT NULL").select("doc", "text")

    def met(df: DataFrame, often: int, sides: bool) -> DataFrame:
        return settle(df.repartition("h").sortWithinPartitions("h", "doc", "place").mapInArrow(compare(often, sides), FOUND))

    def holding(found: DataFrame, kind: int) -> DataFrame:
        wanted = found.where(F.col("kind") == kind).groupBy("doc").agg(F.collect_list(F.struct("key", "at", "len")).alias("wanted"))
        return solid.join(wanted, "doc").select("doc", "text", "wanted")

    coarse = met(narrow_batches(solid.where(f"octet_length(text) >= {WINDOW}")).mapInArrow(find_stretches(piece), DEALT), often, True)
    found = [coarse]
    if coarse.where(F.col("kind") == OFTEN_SEEN).limit(1).count():
        found.append(met(holding(coarse, OFTEN_SEEN).mapInArrow(cut_windows, DEALT), often, False))
    some = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    cut = holding(some, RESOLVE).mapInArrow(cut_out, CUT)
    fine = settle(cut.repartition("key").sortWithinPartitions("key", "doc", "at").mapInArrow(resolve(block), FOUND))
    gone = some.where(F.col("kind") == REMOVE).unionByName(fine)
    return gone.groupBy("doc").agg(F.collect_list(F.struct("at", "len")).alias("spans")), [*found, fine]


def remove_repeats(docs: DataFrame, text_out: bool = False, **sizes: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row; ``kept`` is what remains, as bytes.

    ``sizes``: piece, block and often, as :func:`repeats` takes them. The result is a written table."""
    numbers, places = numbered(docs)
    spans, tables = repeats(numbers, **sizes)
    rows = numbers.join(spans, "doc", "left")
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if text_out else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, gone in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = (text or "").encode()
                kept, n, k = data, 0, 0
                if gone:
                    at, length = (np.array([g[x] for g in gone], np.int64) for x in ("at", "len"))
                    _, at, length = runs(np.zeros(len(at), np.int64), at, length)
                    n, k = int(length.sum()), len(at)
                    ends = np.concatenate([[0], at + length])
                    kept = b"".join(data[e:a] for e, a in zip(ends, [*at, len(data)]))
                out.append((doc, len(data), n, k, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) if out else [[]] * 6
            arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.string())] + ([pa.array(cols[5], pa.binary())] if text_out else [])
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in fields.split(", ")])

    out = settle(rows.select("doc_id", "text", "spans").mapInArrow(run, fields))
    discard(*tables, places)
    return out
