"""Benchmark decontamination by greedy string tiling.

Shared five-token seeds propose (document, test item) pairs; a pair whose seeds cannot cover enough of the item is let go.
For the others, rolling-hash matches grow to their maximal length; the longest match that overlaps no earlier one is marked
again and again, the rest of a partly covered match returning to the queue. Where few different seeds stand very often on
both sides, no list of their meetings is made: the longest unmarked match is found by halving its length, with running
hashes, in memory that grows with the two texts alone. The share of the item's tokens under tiles is its coverage,
whatever the order of passages.

Different test items travel to the tasks in blocks of a checked size, one block at a time, so any size of benchmark is
handled, a block a pass; equal items travel once.

Defined results: items or texts with fewer tokens than a seed, and null or empty ones, match nothing; repeated rows
and repeated items each give their own result; null ids stay null; texts of any length are read whole; an empty side gives
an empty table; other columns are carried by :func:`clean` and not read."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, discard, mix64, narrow_batches, odd_numbers, packed, settle, texts_of

#: Tokens of the shortest tile, the coverage from which an item counts as contained, characters of items in a block, and
#: meetings of seeds of a pair that are listed.
TILE, COVERAGE, BLOCK_CHARS, LISTED = 5, 0.5, 4_000_000, 200_000
_words = WordHashes()
_R = odd_numbers(64, 41)
_EDGES = b".,;:!?\"'()[]"


def tokens(text: bytes) -> np.ndarray:
    """Hashes of the words in lower case, without punctuation at their edges."""
    words = [w for w in (x.strip(_EDGES) for x in text.lower().split()) if w]
    return _words(words) if words else np.empty(0, np.uint64)


def windows(t: np.ndarray, k: int) -> np.ndarray:
    n = len(t) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    key = t[:n] * _R[0]
    for i in range(1, k):
        key += t[i : n + i] * _R[i]
    return mix64(key)


class Items:
    """The seeds of a block of test items and where they stand."""

    def __init__(self, items: list[tuple], k: int) -> None:
        self.k, self.ids, self.copies = k, [i for i, _, _ in items], [n for _, _, n in items]
        self.tokens = [tokens((text or "").encode()) for _, text, _ in items]
        keys = [windows(t, k) for t in self.tokens]
        key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
        at = np.concatenate([np.arange(len(x)) for x in keys]) if keys else item
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.at = key[order], item[order], at[order]
        self.mask = U64((1 << 22) - 1)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.key & self.mask).astype(np.int64)] = True

    def hits(self, doc: np.ndarray, coverage: float = 0.0, listed: int = LISTED) -> dict[int, tuple[np.ndarray, np.ndarray] | None]:
        """For each item whose shared seeds may cover enough of it: their places in the item and in the document; None for too many to list."""
        w = windows(doc, self.k)
        j = np.flatnonzero(self.bits[(w & self.mask).astype(np.int64)])
        seeds, back, often = np.unique(w[j], return_inverse=True, return_counts=True)
        lo, hi = np.searchsorted(self.key, seeds), np.searchsorted(self.key, seeds, "right")
        n = hi - lo
        if not n.sum():
            return {}
        rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        seed = np.repeat(np.arange(len(seeds)), n)
        order = np.lexsort((self.at[rows], self.item[rows]))
        rows, seed = rows[order], seed[order]
        item = self.item[rows]
        starts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        by_seed = np.argsort(back, kind="stable")
        ends = np.cumsum(often)
        out = {}
        for a, b in zip(starts, np.append(starts[1:], len(rows))):
            x, at, own = int(item[a]), self.at[rows[a:b]], seed[a:b]
            reach = int(np.minimum(np.diff(np.append(at, at[-1] + self.k)), self.k).sum())
            if reach < coverage * len(self.tokens[x]):
                continue
            m = often[own]
            if m.sum() > listed:
                out[x] = None
                continue
            places = by_seed[np.repeat(ends[own] - m, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            out[x] = np.repeat(at, m), j[places]
        return out


def tiles(i: np.ndarray, j: np.ndarray, k: int, n_item: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from seed hits: (place in the item, in the document, length), longest first."""
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    breaks = np.flatnonzero((np.diff(j - i) != 0) | (np.diff(i) != 1)) + 1
    starts, ends = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(i)]])
    queue = [(-(int(e - s) + k - 1), int(j[s]), int(i[s])) for s, e in zip(starts, ends)]
    heapq.heapify(queue)
    in_item, in_doc, out = np.zeros(n_item, bool), defaultdict(bool), []
    while queue:
        length, jj, ii = heapq.heappop(queue)
        length = -length
        free = ~in_item[ii : ii + length]
        if in_doc:
            free &= ~np.fromiter((in_doc.get(x, False) for x in range(jj, jj + length)), bool, length)
        if free.all():
            out.append((ii, jj, length))
            in_item[ii : ii + length] = True
            in_doc.update((x, True) for x in range(jj, jj + length))
            continue
        edge = np.diff(np.concatenate([[False], free, [False]]).astype(np.int8))
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            if e - s >= k:
                heapq.heappush(queue, (-int(e - s), jj + int(s), ii + int(s)))
    return out


class Running:
    """Hashes of all windows of any length of a token sequence."""

    def __init__(self, t: np.ndarray) -> None:
        odd = int(odd_numbers(1, 43)[0])
        up, down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(t), b, np.uint64))]) for b in (U64(odd), U64(pow(odd, -1, 1 << 64))))
        self.sums, self.down = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(t) * up[:-1], dtype=np.uint64)]), down

    def of(self, start: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def tiles_by_halving(item: np.ndarray, doc: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling as :func:`tiles` gives it, without a list of seed hits: the longest unmarked match, again and again."""
    sides = [(t, Running(t), np.zeros(len(t), bool)) for t in (item, doc)]

    def free(marked: np.ndarray, n: int) -> np.ndarray:
        if len(marked) < n:
            return np.empty(0, np.int64)
        used = np.concatenate([[0], np.cumsum(marked)])
        return np.flatnonzero(used[n:] == used[: len(used) - n])

    def match(n: int) -> tuple[int, int] | None:
        """(place in the item, in the document) of the match of n tokens that comes first in the document."""
        (a, i), (b, j) = ((run.of(at, n), at) for _, run, marked in sides for at in [free(marked, n)])
        known, first = np.unique(a, return_index=True)
        if not len(known) or not len(b):
            return None
        at = np.minimum(np.searchsorted(known, b), len(known) - 1)
        for place in np.flatnonzero(known[at] == b):
            x, y = int(i[first[at[place]]]), int(j[place])
            if (item[x : x + n] == doc[y : y + n]).all():
                return x, y
        return None

    out, most = [], min(len(item), len(doc))
    while True:
        lo, hi, best = k, most, None
        while lo <= hi:  # a match of n tokens holds one of n - 1
            mid = (lo + hi) // 2
            if (got := match(mid)) is not None:
                best, lo = (*got, mid), mid + 1
            else:
                hi = mid - 1
        if best is None:
            return out
        out.append(best)
        most = best[2]
        for (_, _, marked), at in zip(sides, best):
            marked[at : at + best[2]] = True


def found_in(text: bytes, items: Items, coverage: float, listed: int = LISTED) -> list[tuple]:
    """(item id, item tokens, covered tokens, tiles, coverage, how often the item stands) of the items contained in a text."""
    out = []
    doc = tokens(text)
    for x, hit in items.hits(doc, coverage, listed).items():
        n = len(items.tokens[x])
        marked = tiles_by_halving(items.tokens[x], doc, items.k) if hit is None else tiles(*hit, items.k, n)
        covered = sum(t[2] for t in marked)
        if covered >= coverage * n:
            out.append((items.ids[x], n, covered, len(marked), covered / n, items.copies[x]))
    return out


def blocks_of(benchmark: DataFrame, most: int) -> Iterator[list[tuple]]:
    """Different items as (id, text, copies) in blocks of at most ``most`` characters, or of one item; collected one block at a time."""
    rows = benchmark.where("text IS NOT NULL").groupBy(F.col("item_id").cast("long").alias("item_id"), "text").agg(F.count("*").alias("copies"))
    items = settle(rows.withColumn("n", F.length("text")))
    total = items.agg(F.sum("n")).head()[0] or 0
    n = max(1, -(-total // most))
    while True:  # different items fall apart, so this ends
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text", F.lit(n)), F.lit(n)))
        largest = dealt.groupBy("block").agg(F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1").agg(F.max("n")).head()[0] or 0
        if largest <= most:
            break
        n *= 2
    for b in range(n):
        if block := [(r["item_id"], r["text"], r["copies"]) for r in dealt.where(F.col("block") == b).orderBy("item_id", "text").collect()]:
            yield block
    discard(items)


def contained(docs: DataFrame, benchmark: DataFrame, k: int = TILE, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS, listed: int = LISTED) -> DataFrame:
    """A row for each document and test item of which at least ``coverage`` lies under tiles."""
    docs = narrow_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    schema = "doc_id long, item_id long, item_tokens long, covered_tokens long, n_tiles long, coverage double"
    names = [x.split()[0] for x in schema.split(", ")]
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks_of(benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = Items(block, k)
            for b in batches:
                rows = [(d, *x) for d, text in zip(b.column(0).to_pylist(), texts_of(b)) for *x, copies in found_in(text, items, coverage, listed) for _ in range(copies)]
                cols = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(cols[5], pa.float64())], names=names)

        out = out.unionByName(settle(docs.mapInArrow(run, schema)))  # the block itself is let go
    return out


def clean(docs: DataFrame, benchmark: DataFrame, k: int = TILE, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS, listed: int = LISTED) -> DataFrame:
    """``docs`` without those that contain a test item; no shuffle, each text is judged where it is read. A written table, if there are items."""
    out, back = packed(narrow_batches(docs), "text")
    at, schema = out.columns.index("text"), out.schema
    for block in blocks_of(benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = Items(block, k)
            for b in batches:
                yield b.filter(pa.array([not found_in(text, items, coverage, listed) for text in texts_of(b.select([at]))], pa.bool_()))

        was, out = out, settle(out.mapInArrow(run, schema))
        discard(was)
    return out.select(*back(out))
