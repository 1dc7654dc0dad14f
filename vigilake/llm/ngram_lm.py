"""Stupid-backoff scores from count tables of the whole corpus, on one word before (order 2) or two (order 3).

Words and word pairs are counted in tables partitioned by hash; the pairs of each document, exploded and packed by
partition, meet the tables there, and their scores are summed for each document. A pair is scored by what the other
documents hold: if none has it, the word's own frequency counts, times 0.4.

    S(w | v) = (c(v w) - own(v w)) / c(v)   if another document has the pair
             = 0.4 c(w) / N                 otherwise

Order 3 asks for (u v) w first in the same way, in tables of contexts of two words, and sends what no other document has
on to the pairs, times 0.4.

c(v) counts v before any word (the opening of a document included), c(w) and N count words.

Packing keeps rows of one partition of one batch together as compact columns, so a pair travels in about nine bytes.
Pairs go by their first word. Words, and pairs of words, that more places hold than a partition should are known
beforehand with their exact counts (a short list, bounded by a share of all pairs): pairs of such a word are dealt by the
second word as well, such a pair by the document, and no request is sent for such a word's frequency. So a task holds the
pairs of a partition and of one key that is not hot, and cuts of batches are found where the partition changes: the work
grows with the pairs alone.

Sums are 64-bit floats from end to end.

Defined results: null and empty texts have no words and no score (null); rows that repeat an id are scored together,
as one document; null ids are scored together like an id of their own; texts of any length are read whole; other columns
are not read; an empty table gives an empty table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, discard, mix64, narrow_batches, settle, texts_of

#: Pairs of a partition, words tokenised at a time, documents of a slab of sums, and the backoff factor.
PARTITION, PIECE, SLAB, BACKOFF = 1_000_000, 600_000, 16_384, 0.4
#: A word or pair is hot from this share of a partition on, but never below this share of all pairs, which bounds the list.
HOT_PART, HOT_SHARE = 0.25, 1e-5
MASK = U64((1 << 48) - 1)
OPENING = U64(1)
_hashes = WordHashes()


def tokens(text: bytes) -> np.ndarray:
    """48-bit ids of the words, A-Z in lower case."""
    words = text.lower().split()
    return _hashes(words) & MASK if words else np.empty(0, np.uint64)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) batches: (w, n, heads), how often a word stands and how often before another or as the opening."""
    for b in batches:
        texts, at = texts_of(b), 0
        while at < len(texts):
            words, heads, size = [], [], 0
            while at < len(texts) and size < PIECE:
                t = tokens(texts[at])
                at += 1
                if len(t):
                    words.append(t)
                    heads.append(np.concatenate([[OPENING], t[:-1]]))
                    size += len(t)
            if not size:
                continue
            w, n = np.unique(np.concatenate(words), return_counts=True)
            v, m = np.unique(np.concatenate(heads), return_counts=True)
            every = np.union1d(w, v)
            a, c = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
            a[np.searchsorted(every, w)], c[np.searchsorted(every, v)] = n, m
            yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(a), pa.array(c)], names=["w", "n", "heads"])


class Hot:
    """Keys that too many places hold, sorted, with a count for each."""

    def __init__(self, rows: list[tuple[int, int]]) -> None:
        rows = sorted((k & (2**64 - 1), n) for k, n in rows)
        self.keys, self.counts = np.array([k for k, _ in rows], np.uint64), np.array([n for _, n in rows], np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a key is hot, its count then)"""
        if not len(self.keys):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key, self.counts[at]


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(mix64(v) * U64(5) + w)


def partition_of(v: np.ndarray, w: np.ndarray, doc: np.ndarray, hot: Hot, hot_pairs: Hot, parts: int) -> np.ndarray:
    """Where a pair goes: by its first word; by its second too if the first is hot; by its document if the pair is."""
    key = v.copy()
    split, _ = hot.find(v)
    if split.any():
        own = pair_key(v[split], w[split])
        often, _ = hot_pairs.find(own)
        key[split] = np.where(often, mix64(own + doc[split].view(np.uint64)), own)
    return (mix64(key) % U64(parts)).astype(np.int64)


def cuts(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted part numbers."""
    if len(part):
        ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))
        lo = 0
        for hi in ends.tolist():
            yield int(part[lo]), lo, hi
            lo = hi


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns as one compressed block."""
    import zstandard

    out = [len(columns[0]).to_bytes(8, "little")]
    for c in columns:
        out.append(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() if len(c) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unsqueezed(block: bytes, kinds: list) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).ravel() if n else np.empty(0, kind))
        at += n * size
    return out


def packed_ids(ids: np.ndarray) -> bytes:
    """Ids as compressed steps from one to the next."""
    return squeezed(np.diff(np.concatenate([[U64(0)], np.ascontiguousarray(ids, np.int64).view(np.uint64)])))


def ids_of(block: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(block, [np.uint64])[0], dtype=np.uint64).view(np.int64)


def contexts(toks: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, word before) of each word; the context of order 3 is one id of the two words before, openings included."""
    v = np.concatenate([np.concatenate([[OPENING], t[:-1]]) for t in toks])
    if order == 2:
        return v, v
    u = np.concatenate([np.concatenate([[OPENING, OPENING], t[:-2]])[: len(t)] for t in toks])
    return joined(u, v), v


def joined(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix64(mix64(u) * U64(3) + v) & MASK


PAIR = [np.uint64, np.uint32, np.uint16, np.uint32, np.uint32]  # first word (as steps), second word's low and high bits, place in the list of documents, count


TRIPLE = [*PAIR, np.uint32, np.uint16]  # the first is a context of two words; then the word before in low and high bits
LOW, HIGH = U64(0xFFFFFFFF), U64(32)


def halves(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (w & LOW).astype(np.uint32), (w >> HIGH).astype(np.uint16)


def packed_pairs(hot: Hot, hot_pairs: Hot, parts: int, order: int = 2):
    """(doc_id, text) batches: (part, docs, block), the distinct pairs of pieces of documents by partition.

    With ``order`` 3 the first of a pair is the context of two words, and the word before travels along."""

    def piece(ids, toks):
        n = np.array([len(t) for t in toks])
        w = np.concatenate(toks)
        v, near = contexts(toks, order)
        doc = np.repeat(np.arange(len(toks)), n)
        ids = np.array(ids, np.int64)
        part = partition_of(v, w, ids[doc], hot, hot_pairs, parts)
        by = np.lexsort((w, v, part))  # stable: documents stay in order
        part, v, w, doc, near = part[by], v[by], w[by], doc[by], near[by]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(v)))
        part, v, w, doc, near = part[first], v[first], w[first], doc[first], near[first]
        for p, lo, hi in cuts(part):
            seen, place = np.unique(doc[lo:hi], return_inverse=True)
            x = v[lo:hi]
            steps = np.diff(np.concatenate([[U64(0)], x]))
            yield p, packed_ids(ids[seen]), squeezed(steps, *halves(w[lo:hi]), place.astype(np.uint32), count[lo:hi].astype(np.uint32), *(halves(near[lo:hi]) if order == 3 else ()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids, at = texts_of(b), b.column(0).to_pylist(), 0
            while at < len(texts):
                some, toks, size = [], [], 0
                while at < len(texts) and size < PIECE:
                    t = tokens(texts[at])
                    if len(t):
                        some.append(ids[at]), toks.append(t)
                        size += len(t)
                    at += 1
                if size:
                    p, d, x = zip(*piece(some, toks))
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(d, pa.binary()), pa.array(x, pa.binary())], names=["part", "docs", "block"])

    return run


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by their first column, a part at a time."""
    part, rows = None, []
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for row in zip(*cols):
            if row[0] != part:
                if rows:
                    yield part, rows
                part, rows = row[0], []
            rows.append(row)
    if rows:
        yield part, rows


SUM = [np.float64, np.uint32, np.uint32]  # sum of logs, words found elsewhere, words
HELD = 1_000_000  # sums that a task gathers before it writes them
OUT = "slab long, part long, docs binary, block binary"
OUT_NAMES = ["slab", "part", "docs", "block"]


def sums(doc: np.ndarray, value: np.ndarray, found: np.ndarray, n: np.ndarray, slabs: int) -> pa.RecordBatch:
    """Sums of each document, packed by slab of documents: a row a slab, not a row a document."""
    ids, place = np.unique(doc, return_inverse=True)
    slab = (mix64(ids.view(np.uint64)) % U64(slabs)).astype(np.int64)
    order = np.argsort(slab, kind="stable")
    cols = [np.bincount(place, x, len(ids))[order] for x in (value, found, n)]
    ids, slab = ids[order], slab[order]
    some = list(cuts(slab))
    blocks = [squeezed(*[c[lo:hi].astype(kind) for c, kind in zip(cols, SUM)]) for _, lo, hi in some]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in some], pa.int64()), pa.nulls(len(some), pa.int64()), pa.array([packed_ids(ids[lo:hi]) for _, lo, hi in some], pa.binary()), pa.array(blocks, pa.binary())], names=OUT_NAMES)


def requests(part: np.ndarray, doc: np.ndarray, columns: list[np.ndarray], steps: np.ndarray) -> pa.RecordBatch | None:
    """Rows sorted by part as packed requests; ``steps`` is the column that is stored by its steps."""
    p_out, d_out, b_out = [], [], []
    for p, lo, hi in cuts(part):
        ids, place = np.unique(doc[lo:hi], return_inverse=True)
        p_out.append(p), d_out.append(packed_ids(ids))
        b_out.append(squeezed(np.diff(np.concatenate([[U64(0)], steps[lo:hi]])), *[place.astype(np.uint32) if c is None else c[lo:hi] for c in columns]))
    if not p_out:
        return None
    return pa.RecordBatch.from_arrays([pa.nulls(len(p_out), pa.int64()), pa.array(p_out, pa.int64()), pa.array(d_out, pa.binary()), pa.array(b_out, pa.binary())], names=OUT_NAMES)


class Gathered:
    """Sums of documents over the parts of a task, written when there are many and at the end."""

    def __init__(self, slabs: int) -> None:
        self.slabs, self.cols, self.size = slabs, [], 0

    def add(self, doc: np.ndarray, value: np.ndarray, found: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, place = np.unique(doc, return_inverse=True)
        self.cols.append((ids, *[np.bincount(place, x, len(ids)) for x in (value, found, n)]))
        self.size += len(ids)
        if self.size > HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.cols:
            yield sums(*[np.concatenate(x) for x in zip(*self.cols)], self.slabs)
        self.cols, self.size = [], 0


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slab, docs, block) rows sorted by slab: (doc, value, found, n), a row a document."""
    for _, rows in by_part(batches):
        doc = np.concatenate([ids_of(d) for _, d, _ in rows])
        cols = [np.concatenate(x) for x in zip(*[unsqueezed(block, SUM) for _, _, block in rows])]
        ids, place = np.unique(doc, return_inverse=True)
        value, found, n = (np.bincount(place, x, len(ids)) for x in cols)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(value), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["doc", "value", "found", "n"])


WORD = [np.uint64, np.uint32, np.uint32]  # word (as steps), place in the list of documents, count


def counted_elsewhere(v, w, doc, n, hot: Hot, hot_pairs: Hot) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by (v, w, doc): counts of the pair in other documents, and of the first of it."""
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    pair = np.cumsum(new) - 1
    head = np.cumsum(np.concatenate([[True], v[1:] != v[:-1]])) - 1
    c_pair, c_head = np.bincount(pair, n)[pair], np.bincount(head, n)[head]
    often, known = hot.find(v)
    if often.any():
        c_head = np.where(often, known, c_head)
        often, known = hot_pairs.find(pair_key(v, w))
        c_pair = np.where(often, known, c_pair)
    same = np.ones(len(v), bool)  # own counts: an id's rows of one pair together
    same[1:] = new[1:] | (doc[1:] != doc[:-1])
    mine = np.cumsum(same) - 1
    return c_pair - np.bincount(mine, n)[mine], c_head


def unpacked(rows: list[tuple], kinds: list) -> list[np.ndarray]:
    """(first, second word, document, count, ...) of the rows of a part, sorted; then the word before, if it travels, and whether the row is a request."""
    cols = []
    for _, docs, block, *asked in rows:
        steps, low, high, place, count, *near = unsqueezed(block, kinds)
        whole = lambda lo, hi: lo.astype(np.uint64) | (hi.astype(np.uint64) << HIGH)
        cols.append((np.cumsum(steps), whole(low, high), ids_of(docs)[place], count.astype(np.int64), whole(*near) if near else None, np.full(len(steps), bool(asked and asked[0]))))
    cols = [np.concatenate(x) if x[0] is not None else None for x in zip(*cols)]
    order = np.lexsort((cols[2], cols[1], cols[0]))
    return [x if x is None else x[order] for x in cols]


def scored_triples(hot: Hot, hot_triples: Hot, hot_words: Hot, hot_pairs: Hot, parts: int, slabs: int):
    """Triples of a partition: sums of those found elsewhere, and requests for the pairs of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gathered(slabs)
        for _, rows in by_part(batches):
            c, w, doc, n, v, _ = unpacked(rows, TRIPLE)
            rest, c_head = counted_elsewhere(c, w, doc, n, hot, hot_triples)
            seen = rest > 0
            value = np.where(seen, np.log10(np.maximum(rest, 1)) - np.log10(c_head), np.log10(BACKOFF))
            yield from gathered.add(doc, n * value, n * seen, n * seen)
            v, w, doc, n = v[~seen], w[~seen], doc[~seen], n[~seen]
            part = partition_of(v, w, doc, hot_words, hot_pairs, parts)
            order = np.lexsort((doc, w, v, part))
            part, v, w, doc, n = part[order], v[order], w[order], doc[order], n[order]
            if (asked := requests(part, doc, [*halves(w), None, n.astype(np.uint32)], v)) is not None:
                yield asked
        yield from gathered.flush()

    return run


def among_hot(hot: Hot, order: int):
    """(text) batches: (c, n), where the pairs of words that are hot both stand; no other pair can be as common.

    With ``order`` 3 contexts of two words as :func:`contexts` names them, or triples of three hot words, as asked."""

    def keys(t: np.ndarray) -> np.ndarray:
        if order == 2:
            v, w = np.concatenate([[OPENING], t[:-1]]), t
            both = hot.find(v)[0] & hot.find(w)[0]
            return pair_key(v[both], w[both])
        x = np.concatenate([[OPENING, OPENING], t])
        warm = hot.find(x)[0]
        u, v, w = x[:-2], x[1:-1], x[2:]
        some = warm[:-2] & warm[1:-1]
        c = joined(u[some], v[some])
        return np.concatenate([c, pair_key(c, w[some])[warm[2:][some]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at = texts_of(b), 0
            while at < len(texts):
                found, size = [], 0
                while at < len(texts) and size < PIECE:
                    t = tokens(texts[at])
                    at += 1
                    size += len(t)
                    if len(t):
                        found.append(keys(t))
                if found:
                    c, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(n)], names=["c", "n"])

    return run


def scored_pairs(hot: Hot, hot_pairs: Hot, hot_words: Hot, total: int, parts: int, slabs: int):
    """Pairs of a partition: sums of those found elsewhere, and requests for the words of the others, packed by word.

    Words of ``hot_words`` are scored by the counts known of them. Where rows say that they are requests, of triples found
    nowhere else, those alone are scored and the others counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gathered(slabs)
        for _, rows in by_part(batches):
            v, w, doc, n, _, asked = unpacked(rows, PAIR)
            rest, c_head = counted_elsewhere(v, w, doc, np.where(asked, 0, n), hot, hot_pairs)
            if len(rows[0]) > 3:
                w, doc, n, rest, c_head = (x[asked] for x in (w, doc, n, rest, c_head))
            seen = rest > 0
            often, count = hot_words.find(w)
            done = seen | often
            if done.any():
                value = np.where(seen, np.log10(np.maximum(rest, 1)) - np.log10(np.maximum(c_head, 1)), np.log10(BACKOFF) + np.log10(np.maximum(count, 1)) - np.log10(max(total, 1)))
                yield from gathered.add(doc[done], (n * value)[done], (n * seen)[done], n[done])
            if not done.all():
                w, doc, n = w[~done], doc[~done], n[~done]
                part = (mix64(w) % U64(parts)).astype(np.int64)
                order = np.lexsort((doc, w, part))
                part, w, doc, n = part[order], w[order], doc[order], n[order]
                yield requests(part, doc, [None, n.astype(np.uint32)], w)
        yield from gathered.flush()

    return run


def packed_words(parts: int):
    """(w, n) batches of the word table: (part, docs, block), by partition; a null list of documents marks the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, n = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            part = (mix64(w) % U64(parts)).astype(np.int64)
            order = np.lexsort((w, part))
            part, w, n = part[order], w[order], n[order]
            some = list(cuts(part))
            blocks = [squeezed(w[lo:hi], n[lo:hi]) for _, lo, hi in some]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in some], pa.int64()), pa.nulls(len(some), pa.binary()), pa.array(blocks, pa.binary())], names=["part", "docs", "block"])

    return run


def scored_words(total: int, slabs: int):
    """Requests of a partition against its part of the word table: sums for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gathered(slabs)
        for _, rows in by_part(batches):
            table = [unsqueezed(block, [np.uint64, np.int64]) for _, docs, block in rows if docs is None]
            w, n = (np.concatenate(x) for x in zip(*table))
            order = np.argsort(w)
            w, logs = w[order], np.log10(BACKOFF) + np.log10(n[order]) - np.log10(total)
            got = []
            for _, docs, block in rows:
                if docs is not None:
                    steps, place, count = unsqueezed(block, WORD)
                    ids = ids_of(docs)
                    got.append((ids, np.bincount(place, logs[np.searchsorted(w, np.cumsum(steps))] * count, len(ids)), np.bincount(place, count, len(ids))))
            if got:
                doc, value, n = (np.concatenate(x) for x in zip(*got))
                yield from (x.select(["slab", "docs", "block"]) for x in gathered.add(doc, value, np.zeros(len(doc)), n))
        yield from (x.select(["slab", "docs", "block"]) for x in gathered.flush())

    return run


def score(docs: DataFrame, partition: int = PARTITION, hot_share: float = HOT_SHARE, order: int = 3) -> DataFrame:
    """(doc_id, n_words, n_found, log10_sum, score) of every row, counts of an id's rows taken together; ``score`` is the mean log10 of its words' scores.

    ``order`` 3 looks at two words before and backs off to one, and then to none, each time by the factor; ``n_found``
    counts words that another document has after one word before at least."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    rows = narrow_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62))).alias("doc_id"), "text")
    words = settle(docs.select("text").mapInArrow(counted, "w long, n long, heads long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("heads").alias("heads")))
    total = words.agg(F.sum("n").alias("n")).head()["n"] or 0
    parts, slabs = max(1, -(-total // partition)), max(1, -(-docs.count() // SLAB))
    least = max(HOT_PART * partition, hot_share * total)  # at most 2 / hot_share words, and 1 / hot_share pairs, are as common
    top = words.where((F.col("heads") >= least) | (F.col("n") >= least)).collect()
    hot, hot_words = Hot([(r["w"], r["heads"]) for r in top]), Hot([(r["w"], r["n"]) for r in top])

    def common(among: int) -> Hot:
        if not top:
            return Hot([])
        some = docs.select("text").mapInArrow(among_hot(hot, among), "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
        return Hot([(r["c"], r["n"]) for r in some.where(F.col("n") >= least).collect()])

    hot_pairs = common(2)
    block = "part long, docs binary, block binary"
    pairs = rows.mapInArrow(packed_pairs(hot, hot_pairs, parts), block)
    longer = None
    if order == 3:
        hot3 = common(3)  # contexts and triples have names of their own
        triples = rows.mapInArrow(packed_pairs(hot3, hot3, parts, 3), block).repartition("part").sortWithinPartitions("part")
        longer = settle(triples.mapInArrow(scored_triples(hot3, hot3, hot, hot_pairs, parts, slabs), OUT))
        wanted = longer.where("part IS NOT NULL").select("part", "docs", "block", F.lit(True).alias("asked"))
        pairs = pairs.withColumn("asked", F.lit(False)).union(wanted)
    first = settle(pairs.repartition("part").sortWithinPartitions("part").mapInArrow(scored_pairs(hot, hot_pairs, hot_words, total, parts, slabs), OUT))
    table = words.where("n > 0").select("w", "n").mapInArrow(packed_words(parts), block)
    asked = first.where("part IS NOT NULL").select("part", "docs", "block").union(table)
    second = asked.repartition("part").sortWithinPartitions("part").mapInArrow(scored_words(total, slabs), "slab long, docs binary, block binary")
    every = first.where("slab IS NOT NULL").select("slab", "docs", "block").union(second)
    if longer is not None:
        every = every.union(longer.where("slab IS NOT NULL").select("slab", "docs", "block"))
    got = every.repartition("slab").sortWithinPartitions("slab").mapInArrow(merged, "doc long, value double, found long, n long")
    out = rows.select("doc_id").join(got.withColumnRenamed("doc", "doc_id"), "doc_id", "left")
    null_id = F.when(F.col("doc_id") != -(2**62), F.col("doc_id"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias
    out = settle(out.select(null_id.alias("doc_id"), zero(F.col("n"))("n_words"), zero(F.col("found"))("n_found"), F.col("value").alias("log10_sum"), (F.col("value") / F.col("n")).alias("score")))
    discard(words, longer, first)
    return out
