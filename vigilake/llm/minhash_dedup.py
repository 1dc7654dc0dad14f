"""Near-duplicates by min-max hashing, confirmed on full shingle sets.

Each permutation gives two signature values, its minimum and its maximum, so half the hash evaluations fill the same
number of bands. Bands only propose which documents must be compared. Equal sets are folded first. Each document then
joins the cluster of the document that is least in most of its buckets. Clusters are compared in blocks of bounded
size: members that the centre confirms are done, only the others are held against all members, and out of a block
come links that connect, not pairs. Buckets that still hold several components send the members of their lesser
clusters to visit the main one, until every pair of every bucket is confirmed, refuted or already connected.

What is compared is a set of shingles, named by the least id that has it. A visitor is held against a block and let go,
so a block's members alone are in memory, and they are bounded. Links come out, never pairs.

Defined results: no words or null text gives an empty set, linked with nothing; a null id keeps its row with a null
component; rows that repeat an id share its component, whatever their texts, which are linked with each other (an empty
one joins nothing else); texts of any length are read whole; an empty table gives an empty table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, WordHashes, discard, mix64, odd_numbers, settle, texts_of, with_arrow
from .components import components

#: Permutations (two values each), and the chance of losing a link at the threshold that the choice of bands allows.
PERMUTATIONS, MISS = 108, 1e-7
#: Shingles of the members that one block compares, larger clusters being dealt over several blocks, and visitors of a block
#: that one task takes, about.
BLOCK_SHINGLES, VISITORS = 200_000, 1000
#: Rounds of visits in which one cluster of each open bucket is settled; what is left then visits all at once.
ROUNDS = 4
_words = WordHashes()


def banding(threshold: float, values: int = 2 * PERMUTATIONS, miss: float = MISS) -> tuple[int, int]:
    """(rows, bands): the longest bands that still lose a link at the threshold with a chance under ``miss``."""
    for r in range(16, 0, -1):
        if (1 - threshold**r) ** (values // r) <= miss:
            return r, values // r
    return 1, values


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's ``k``-word shingles, A-Z in lower case."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h, r = _words(words), odd_numbers(k + 1, 17)
    m = max(1, n - k + 1)
    key = np.full(m, mix64(np.full(1, min(n, k), np.uint64) + r[k])[0], np.uint64)
    for i in range(min(k, n)):
        key += h[i : i + m] * r[i]
    return np.unique(mix64(key))


def signature(hashes: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """Band keys of the minimum and the maximum under each permutation."""
    a = odd_numbers((rows * bands + 1) // 2, 29)[:, None]
    low = high = None
    for at in range(0, len(hashes), 2048):
        m = a * hashes[None, at : at + 2048]
        lo, hi = m.min(1), m.max(1)
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    values = np.concatenate([low, high])[: rows * bands].reshape(rows, bands)  # a band mixes permutations
    key = np.arange(bands, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)
    for v, r in zip(values, odd_numbers(rows, 31)):
        key = mix64(key + v * r)
    return key.view(np.int64)


def digest_of(shingles: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(doc_id, n, digest, bands) of every row."""
    rows, bands = banding(threshold)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        n, digest, keys = [], [], []
        for text in texts_of(batch):
            s = shingle_set(text, k)
            n.append(len(s))
            digest.append(digest_of(s))
            keys.append(signature(s, rows, bands) if len(s) else [])
        return [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]

    fields = [T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return with_arrow(docs.select("doc_id", "text"), run, fields).select("doc_id", "n", "digest", "bands")


def with_digests(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text, digest)"""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([digest_of(shingle_set(t, k)) for t in texts_of(batch)], pa.binary())]

    return with_arrow(docs, run, [T.StructField("digest", T.BinaryType())])


class Block:
    """The sets of a block's members, and which of them are known to be connected."""

    def __init__(self, ids: list, sets: list[np.ndarray]) -> None:
        self.ids, self.sizes = ids, np.array([len(s) for s in sets])
        self.known, self.place = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.up = list(range(len(ids)))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Members whose sets are similar enough to ``s``: exact intersections with all members at once."""
        at = np.searchsorted(self.known, s)
        at[at == len(self.known)] = 0
        mark = np.zeros(len(self.known), np.int32)
        mark[at[self.known[at] == s]] = 1
        both = np.add.reduceat(mark[self.place], self.starts)
        return np.flatnonzero(100 * both >= percent * (len(s) + self.sizes - both))

    def connect(self, k: int, others: np.ndarray) -> list[tuple]:
        """Links of member ``k`` that join components of this block."""
        out = []
        for o in others.tolist():
            a, b = self.root(k), self.root(o)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                out.append((self.ids[k], self.ids[o]))
        return out

    def reach(self, doc, others: np.ndarray) -> list[tuple]:
        """Links of a visitor, one for each component of this block that it reaches."""
        return [(doc, self.ids[o]) for o in {self.root(o): o for o in others.tolist() if self.ids[o] != doc}.values()]


# roles of a row dealt to a block
CENTRE, MEMBER, VISITOR = 0, 1, 2
LINK, STRAY = 0, 1


def compared(k: int, percent: int):
    """Over rows sorted by (cluster, block, part, role): (kind, a, b), links, and members that no centre of theirs confirms.

    The members of a block come first and are settled when its first visitor or the next block comes."""

    def members_settled(cluster, blocks, rows: list[tuple]) -> tuple[Block, list[tuple]]:
        home = {d: s for _, d, s in rows}
        block = Block(list(home), list(home.values()))
        out = []
        if rows[0][0] == CENTRE:
            near = block.linked(rows[0][2], percent)
            out += [(LINK, *x) for x in block.connect(0, near)]
            strays = set(range(len(home))) - set(near.tolist()) - {0}
            for x in sorted(strays):
                out += [(LINK, *y) for y in block.connect(x, block.linked(home[block.ids[x]], percent))]
                if blocks > 1:
                    out.append((STRAY, cluster, block.ids[x]))
        return block, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written(out):
            cols = list(zip(*out)) if out else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["kind", "a", "b"])

        group, rows, block = None, [], None
        for b in batches:
            out = []
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("id", "cluster", "block", "part", "blocks", "role")]
            for text, doc, cluster, number, part, blocks, role in zip(texts_of(b), *cols):
                if group != (cluster, number, part, blocks):
                    if rows:
                        out += members_settled(group[0], group[3], rows)[1]
                    group, rows, block = (cluster, number, part, blocks), [], None
                if role != VISITOR:
                    rows.append((role, doc, shingle_set(text, k)))
                    continue
                if rows:
                    block, found = members_settled(cluster, blocks, rows)
                    out, rows = out + found, []
                if block is not None:
                    out += [(LINK, *x) for x in block.reach(doc, block.linked(shingle_set(text, k), percent))]
            yield written(out)
        if rows:
            yield written(members_settled(group[0], group[3], rows)[1])

    return run


def held_together(texts: DataFrame, dealt: DataFrame, k: int, percent: int) -> DataFrame:
    """texts: (id, text); dealt: (id, cluster, block, part, blocks, role). What the blocks find, written down."""
    rows = texts.join(dealt, "id").repartition("cluster", "block", "part").sortWithinPartitions("cluster", "block", "part", "role")
    return settle(rows.mapInArrow(compared(k, percent), "kind int, a long, b long"))


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels: (id, comp) or None. The labels after ``links`` (a, b) between ids."""
    if labels is None:
        return settle(components(links).select(F.col("v").alias("id"), F.col("c").alias("comp")))
    la, lb = labels.select(F.col("id").alias("a"), F.col("comp").alias("ca")), labels.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    edges = links.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct()
    new = components(edges)
    moved = labels.join(new.select(F.col("v").alias("comp"), "c"), "comp", "left").select("id", F.coalesce("c", "comp").alias("comp"))
    fresh = new.select(F.col("v").alias("id"), F.col("c").alias("comp")).join(labels, "id", "left_anti")
    out = settle(moved.union(fresh))
    discard(labels, new)
    return out


def named_sets(solid: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """solid: (doc_id, digest, ...). ((digest, id, doc_id), an id for each set and the least document that has it; and of
    ids that have several sets (doc_id, least), or None).

    A set goes by the least document's own id, but for further sets of such ids: those get numbers from 2**62 on."""
    folded = solid.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    several = settle(solid.groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least < most").select("doc_id", "least"))
    if not several.limit(1).count():
        discard(several)
        return settle(folded.withColumn("id", F.col("doc_id"))), None
    made = F.xxhash64("doc_id", "digest").bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62)
    return settle(folded.join(several, "doc_id", "left").withColumn("id", F.when(F.col("digest") != F.col("least"), made).otherwise(F.col("doc_id"))).drop("least")), several


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; ``percent`` is 100 times the least similarity. A written table."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = settle(signatures(docs, k, percent / 100))
    solid = sig.where("n > 0 AND doc_id IS NOT NULL")
    sets, several = named_sets(solid)
    reps = solid.join(sets, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    rows = reps.select("id", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key", "lo")
    live = settle(rows.join(shared, "key"))
    often = live.groupBy("id", "lo").agg(F.count("*").alias("c"), F.min("n").alias("n"))
    homes = settle(often.groupBy("id").agg(F.max(F.struct("c", -F.col("lo"))).alias("m"), F.min("n").alias("n")).select("id", "n", (-F.col("m.col2")).alias("cluster")))
    wanted = sets.join(homes.select("id"), "id", "left_semi").select("id", "doc_id", "digest")
    if several is None:
        texts = settle(docs.join(homes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text"))
    else:  # an id's texts are told apart by their sets
        plain = docs.join(several, "doc_id", "left_anti").join(wanted.drop("digest"), "doc_id").select("id", "text")
        odd = with_digests(docs.join(several, "doc_id", "left_semi"), k).join(wanted, ["doc_id", "digest"]).select("id", "text")
        texts = settle(plain.unionByName(odd))
    sizes = settle(homes.groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(block_shingles)).cast("long").alias("blocks")))
    members = homes.join(sizes, "cluster").where("id != cluster").select("id", "cluster", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "blocks", F.lit(MEMBER).alias("role"))
    every = sizes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    centres = every.select(F.col("cluster").alias("id"), "cluster", "block", "blocks", F.lit(CENTRE).alias("role"))
    found = held_together(texts, members.unionByName(centres).withColumn("part", F.lit(0).cast("long")), k, percent)
    links = found.where(f"kind = {LINK}").select("a", "b")
    if several is not None:
        own = solid.join(several, "doc_id").select("doc_id", "digest", "least").distinct()
        ids = sets.select("digest", "id")
        links = links.unionByName(own.join(ids.withColumnRenamed("id", "b"), "digest").join(ids.select(F.col("digest").alias("least"), F.col("id").alias("a")), "least").select("a", "b"))
    labels = merged(None, links)
    # strays of clusters of several blocks visit the other blocks
    visits = found.where(f"kind = {STRAY}").select(F.col("a").alias("cluster"), F.col("b").alias("id")).distinct()
    live_now = settle(live.join(homes.select("id", "cluster"), "id").select("key", "id", "cluster"))
    discard(live)
    live, done = live_now, None
    for turn in range(ROUNDS + 1):
        # open buckets hold several components in several clusters
        now = live.join(labels.withColumnRenamed("id", "own"), F.col("id") == F.col("own"), "left").withColumn("comp", F.coalesce("comp", "id"))
        open_ = now.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("cluster").alias("k0"), F.max("cluster").alias("k1")).where("c0 < c1 AND k0 < k1").select("key")
        left = settle(live.join(open_, "key"))
        discard(live)
        live = left
        by_cluster = live.groupBy("key", "cluster").agg(F.count("*").alias("c"))
        if turn < ROUNDS:
            main = settle(by_cluster.groupBy("key").agg(F.max(F.struct("c", "cluster")).alias("m")).select("key", F.col("m.cluster").alias("main")))
            whom = F.col("cluster") != F.col("main")
        else:  # each pair of clusters once
            main = settle(by_cluster.select("key", F.col("cluster").alias("main")))
            whom = F.col("cluster") < F.col("main")
        asked = live.join(main, "key").where(whom).select(F.col("main").alias("cluster"), "id").distinct()
        asked = asked.unionByName(visits).distinct() if turn == 0 else asked
        if done is not None:
            asked = asked.join(done, ["cluster", "id"], "left_anti")
        asked = settle(asked)
        if asked.limit(1).count():
            # the visitors of a cluster come in parts, each to the members once more
            parts = asked.groupBy("cluster").agg(F.ceil(F.count("*") / F.lit(VISITORS)).cast("long").alias("parts"))
            go = every.join(parts, "cluster").join(asked, "cluster").withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts"))).withColumn("role", F.lit(VISITOR))
            stay = members.unionByName(centres).join(parts, "cluster").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("role", F.lit(MEMBER))
            seen = held_together(texts, stay.drop("parts").unionByName(go.drop("parts")), k, percent)
            if seen.limit(1).count():
                labels = merged(labels, seen.where(f"kind = {LINK}").select("a", "b"))
            discard(seen)
        was, done = done, settle(asked if done is None else done.unionByName(asked))
        left = settle(live.join(main.withColumnRenamed("main", "cluster"), ["key", "cluster"], "left_anti"))
        discard(live, was, asked, main)
        live = left
        if not live.limit(1).count():
            break
    discard(live, done, texts, found, homes, sizes)
    # one join for all copies of a set: each set's component first
    of_set = sets.join(labels.withColumnRenamed("id", "own"), F.col("id") == F.col("own"), "left").select("digest", F.coalesce("comp", "id").alias("comp"))
    solo = sig.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = settle(solid.join(of_set, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id")).unionByName(solo))
    discard(sig, sets, labels, several)
    return out
