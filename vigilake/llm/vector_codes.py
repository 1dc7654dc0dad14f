"""Codes for vectors: each is cut into parts, each part is named by the nearest of a codebook's entries, learned by exact
Lloyd rounds on integers.

Heap Lloyd: the vectors are dealt once into chunks, and a chunk keeps, for each part position, a heap for each entry over
the parts assigned to it. A part's key is its slack, the lower bound of the distance to every other entry minus the upper
bound of that to its own, plus the drift that its entry had when it was last measured. When entries move, the drift of an
entry (its own path and the longest of the others') grows; only parts whose keys lie under it may have changed sides. They
are popped off the top of their heap and measured against all entries exactly; the rest is not touched. Distances are
squares of integers and exact, keys are rounded and popped with a margin, so that the result is that of plain Lloyd.

Chunks with their heaps are rows of a Parquet table on the shared folder, one table a round, so a lost executor costs its
tasks only. What reaches the driver is the codebooks and the sums of their entries' parts, of a size that vectors do not
change.

Defined results: a component x is floor(1024 x), held at 2**53 in magnitude; vectors that are null, empty or hold null or
non-finite components are dropped, and so are those of another length than most (the longer of two equally common ones);
lengths that the parts do not divide are filled up with zeros. Null ids are coded and come last among the ids that start
the codebooks; rows that repeat an id are coded each, those of the smallest components first. With fewer vectors than
entries the codebook has as many entries as vectors. Equal distances go to the lower index. Errors beyond a long stop at its
largest value. An empty table gives an empty one. Other columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, settle

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Components of a chunk; the largest magnitude of one.
CHUNK, WIDE = 1 << 19, 1 << 53
#: What rounding may add to a bound, far above its error at the narrow magnitudes.
MARGIN = 1e-6
LONGEST = (1 << 63) - 1


def usual_length(vectors: DataFrame, column: str) -> int:
    """The commonest length of the vectors without faults, the longer of two; 0 if there is none."""
    top = vectors.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return top[0]["d"] if top else 0


def sound(column: str) -> F.Column:
    """No null, no component that is null or not finite."""
    return F.coalesce(F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(values: np.ndarray, n: int, parts: int) -> np.ndarray:
    """(n, parts, length of a part) integers."""
    x = np.floor(np.clip(values.astype(np.float64).reshape(n, -1), -WIDE / SCALE, WIDE / SCALE) * SCALE)
    short = -x.shape[1] % parts
    if short:
        x = np.concatenate([x, np.zeros((n, short))], axis=1)
    return x.astype(np.int64).reshape(n, parts, -1)


def exact(largest: int, length: int) -> bool:
    """Whether doubles hold squared distances of integers of that magnitude exactly."""
    return 4 * length * int(largest) ** 2 < 1 << 53


def measured(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(nearest entry, its squared distance, that of the second, whether doubles held them exactly) of parts."""
    narrow = exact(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)), x.shape[1])
    if narrow:
        a, c = x.astype(np.float64), entries.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
        best, i = d.argmin(1), np.arange(len(x))
    else:
        a, c = x.astype(object), entries.astype(object)
        d = np.array([[((p - q) ** 2).sum() for q in c] for p in a], dtype=object).reshape(len(a), len(c))
        best, i = np.array([min(range(len(c)), key=row.__getitem__) for row in d], dtype=np.int64), np.arange(len(x))
    own = d[i, best].copy()
    if len(entries) > 1:
        d[i, best] = d.max(1) if narrow else max((v for row in d for v in row), default=0)
        second = d.min(1)
    else:
        second = np.full(len(x), np.inf)
    return best, own, second, narrow


class Heaps:
    """A chunk's heaps at one position: entry by entry, keys in heap order (ascending) with the parts they stand for."""

    def __init__(self, entry: np.ndarray, key: np.ndarray, n_entries: int) -> None:
        self.part = np.lexsort((key, entry)).astype(np.int32)
        self.key, self.size = key[self.part], np.bincount(entry, minlength=n_entries)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def violated(self, drift: np.ndarray) -> np.ndarray:
        """Parts whose keys do not lie above their entry's drift, found from the tops down: a node is looked at only if its
        parent was popped."""
        heap = np.flatnonzero(self.size)
        node, popped = np.zeros(len(heap), dtype=np.int64), []
        while len(heap):
            at = self.start[heap] + node
            low = self.key[at] <= drift[heap] + MARGIN
            popped.append(self.part[at[low]])
            heap, node = np.repeat(heap[low], 2), np.stack([2 * node[low] + 1, 2 * node[low] + 2], axis=1).ravel()
            there = node < self.size[heap]
            heap, node = heap[there], node[there]
        return np.concatenate(popped) if popped else np.zeros(0, dtype=np.int32)


def assign(x: np.ndarray, entries: np.ndarray, drift: np.ndarray, entry: np.ndarray | None, key: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, key, parts measured) of the parts ``x`` of one position, from what they were before, if anything."""
    if entry is None:
        entry, key, again = np.zeros(len(x), dtype=np.int64), np.zeros(len(x)), np.arange(len(x))
    else:
        entry, key = entry.astype(np.int64), key.copy()
        again = Heaps(entry, key, len(entries)).violated(drift)
    if len(again):
        best, own, second, narrow = measured(x[again], entries)
        entry[again] = best
        # a part that doubles cannot measure is popped every time
        key[again] = np.sqrt(second) - np.sqrt(own) + drift[best] if narrow else -np.inf
    return entry, key, len(again)


def sums_of(x: np.ndarray, entry: np.ndarray, n_entries: int) -> np.ndarray:
    """(entries, 1 + 2 * length): how many parts an entry has, and the sums of their components' high and low words."""
    cols = [np.bincount(entry, minlength=n_entries)]
    for word in (x >> 32, x & 0xFFFFFFFF):
        cols += [np.bincount(entry, weights=word[:, k], minlength=n_entries) for k in range(x.shape[1])]
    return np.stack(cols, axis=1).astype(np.int64)


class Codebooks:
    """(parts, entries, length) integers and how far each entry has drifted: its own path and the longest of the others'."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries, self.drift = entries, np.zeros(entries.shape[:2])

    def moved(self, totals: np.ndarray) -> Codebooks:
        """After a round: each entry the floor of its parts' mean, entries without parts unchanged."""
        out = Codebooks(self.entries.copy())
        length = self.entries.shape[2]
        for p, k in zip(*np.nonzero([[row[0] for row in part] for part in totals]), strict=True):
            row = totals[p][k]
            out.entries[p, k] = [((row[1 + c] << 32) + row[1 + length + c]) // row[0] for c in range(length)]
        step = np.sqrt(((out.entries - self.entries).astype(np.float64) ** 2).sum(2)) * (1 + 1e-12)
        top = np.sort(step, axis=1)
        first, second = top[:, -1:], top[:, -2:-1] if step.shape[1] > 1 else np.zeros_like(top[:, -1:])
        others = np.where(step == first, np.where((step == first).sum(1, keepdims=True) > 1, first, second), first)
        out.drift = self.drift + step + others
        return out

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def chunk_schema(id_type: T.DataType, label_type: T.DataType) -> T.StructType:
    """Chunks: ids and labels, the parts' integers, by position the entries and keys of their heaps, sums, parts measured."""
    return T.StructType([
        T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type)), T.StructField("wide", T.BooleanType()),
        T.StructField("x", T.BinaryType()), T.StructField("entry", T.BinaryType()), T.StructField("key", T.BinaryType()), T.StructField("sums", T.BinaryType()), T.StructField("measured", T.LongType()),
    ])


def parts_of(row: dict, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(row["x"], dtype=np.int64 if row["wide"] else np.int32).astype(np.int64).reshape(len(row["ids"]), shape[0], shape[2])


def step(x: np.ndarray, books: Codebooks, entry: np.ndarray | None, key: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A chunk's round: (entries, keys, sums, parts measured)."""
    parts, n_entries, _ = books.entries.shape
    found = [assign(x[:, p], books.entries[p], books.drift[p], None if entry is None else entry[p], None if key is None else key[p]) for p in range(parts)]
    sums = np.stack([sums_of(x[:, p], found[p][0], n_entries) for p in range(parts)])
    return np.stack([f[0] for f in found]), np.stack([f[1] for f in found]), sums, sum(f[2] for f in found)


def first_round(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """Chunks of vectors, every part measured."""
    schema = chunk_schema(vectors.schema["id"].dataType, vectors.schema["label"].dataType)
    rows = max(CHUNK // (books.entries.shape[0] * max(books.entries.shape[2], 1)), 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                x = integers(b.column("v").flatten().to_numpy(zero_copy_only=False), b.num_rows, books.entries.shape[0])
                entry, key, sums, n = step(x, books, None, None)
                wide = bool(np.abs(x).max(initial=0) >= 1 << 31)
                yield pa.RecordBatch.from_arrays([
                    pa.array([b.column("id").to_pylist()], type=pa.list_(b.schema.field("id").type)), pa.array([b.column("label").to_pylist()], type=pa.list_(b.schema.field("label").type)), pa.array([wide]),
                    pa.array([x.astype(np.int64 if wide else np.int32).tobytes()]), pa.array([entry.astype(np.int16).tobytes()]), pa.array([key.tobytes()]), pa.array([sums.tobytes()]), pa.array([n]),
                ], names=schema.names)

    return vectors.select("id", "label", "v").mapInArrow(run, schema)


def next_round(chunks: DataFrame, books: Codebooks) -> DataFrame:
    """The chunks after the entries moved."""
    shape, names = books.entries.shape, chunks.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                b = whole.slice(at, 1)
                row = b.to_pylist()[0]
                x, by_part = parts_of(row, shape), (shape[0], -1)
                entry, key = np.frombuffer(row["entry"], dtype=np.int16).reshape(by_part), np.frombuffer(row["key"]).reshape(by_part)
                entry, key, sums, n = step(x, books, entry, key)
                new = {"entry": entry.astype(np.int16).tobytes(), "key": key.tobytes(), "sums": sums.tobytes(), "measured": n}
                yield pa.RecordBatch.from_arrays([pa.array([new[c]], type=b.schema.field(c).type) if c in new else b.column(c) for c in names], names=names)

    return chunks.mapInArrow(run, chunks.schema)


def totals(chunks: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """(parts, entries, 1 + 2 * length) Python integers, summed over all chunks: tasks add up their own, the rest meets by cell."""
    width = 1 + 2 * shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for b in batches:
            for blob in b.column(0).to_pylist():
                one = np.frombuffer(blob, dtype=np.int64)
                mine = one.copy() if mine is None else mine + one
        if mine is not None:
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(mine[at])], names=["cell", "s"])

    out = np.zeros(shape[0] * shape[1] * width, dtype=object)
    for row in chunks.select("sums").mapInArrow(run, "cell int, s long").groupBy("cell").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out[row["cell"]] = int(row["s"])
    return out.reshape(shape[0], shape[1], width)


def coded(chunks: DataFrame, books: Codebooks, id_type: T.DataType, label_type: T.DataType) -> DataFrame:
    """(id, label, code, error) of the vectors of the chunks, once more assigned."""
    shape = books.entries.shape
    schema = T.StructType([T.StructField("id", id_type), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in whole.to_pylist():
                x = parts_of(row, shape)
                entry = np.stack([
                    assign(x[:, p], books.entries[p], books.drift[p], np.frombuffer(row["entry"], dtype=np.int16).reshape(shape[0], -1)[p], np.frombuffer(row["key"]).reshape(shape[0], -1)[p])[0]
                    for p in range(shape[0])
                ])
                gap = np.concatenate([x[:, p] - books.entries[p][entry[p]] for p in range(shape[0])], axis=1)
                if exact(np.abs(gap).max(initial=0), gap.shape[1]):
                    error = (gap * gap).sum(1)
                else:
                    error = np.array([min(int(v), LONGEST) for v in (gap.astype(object) ** 2).sum(1)], dtype=np.int64)
                codes = ["".join(f"{k:02x}" for k in ks) for ks in entry.T.tolist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], type=whole.schema.field("ids").type.value_type), pa.array(row["labels"], type=whole.schema.field("labels").type.value_type), pa.array(codes, type=pa.string()), pa.array(error, type=pa.int64()),
                ], names=schema.names)

    return chunks.mapInArrow(run, schema)


#: Labels whose sums may be broadcast.
FEW_LABELS = 100_000


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, work: list[int] | None = None) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the vectors of (vec_id, embedding, label).

    ``entries`` is 256 at most, so that two digits name one. ``work`` is given the number of parts measured in each round."""
    if not 1 <= entries <= 256:
        raise ValueError("entries: 1 to 256")
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("label"), F.col("embedding").alias("v")).where(sound("v"))
    dim = usual_length(rows, "v")
    id_type, label_type = rows.schema["id"].dataType, rows.schema["label"].dataType
    empty = f"vec_id {id_type.simpleString()}, code string, error long, label_error long, codebooks_sha256 string"
    if not dim:
        return vectors.sparkSession.createDataFrame([], empty)
    rows = rows.where(F.size("v") == dim)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = integers(np.array([r["v"] for r in first], dtype=np.float64), len(first), parts)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    chunks = settle(first_round(rows, books))
    for k in range(rounds):
        if work is not None:
            work.append(chunks.agg(F.sum("measured")).first()[0])
        books = books.moved(totals(chunks, books.entries.shape))
        if k + 1 < rounds:
            was, chunks = chunks, settle(next_round(chunks, books))
            discard(was)
    found = settle(coded(chunks, books, id_type, label_type))
    discard(chunks)
    by_label = settle(found.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST)).cast("long").alias("label_error")).withColumnRenamed("label", "of"))
    few = by_label.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    out = found.join(F.broadcast(by_label) if few else by_label, F.col("label").eqNullSafe(F.col("of")))
    result = settle(out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")))
    discard(found, by_label)
    return result
