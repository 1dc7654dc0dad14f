"""Helpers shared by the text operators: cutting lineage on shared storage, Arrow batches, hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); a folder of our own only where that is unset and
    driver and executors are one process."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master or ""
        if not re.match(r"local($|\[)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        path = "file://" + tempfile.gettempdir() + "/vigilake-shared"
    return path.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table on the shared folder and read it again.

    The result no longer depends on ``df``'s lineage, survives lost executors and is column-pruned when read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vigilake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables written by :func:`settle` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_settled_at", None)
        if path:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of an Arrow batch of texts: a worker holds a batch as text, as numbers and as results.
BATCH_ROWS = 2000


def narrow_batches(df: DataFrame) -> DataFrame:
    """Smaller Arrow batches for whole texts, where the session has the default size; returns ``df``."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name)) == 10_000:
        conf.set(name, str(BATCH_ROWS))
    return df


def unused(df: DataFrame, name: str) -> str:
    """``name``, or that name with as many underscores as make it new to ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], list]]:
    """(``needed`` columns and one that holds all others, what selects the columns of ``docs`` from rows of that).

    However the columns of ``docs`` are called, they cannot clash with what an operator adds."""
    others = [c for c in docs.columns if c not in needed]
    held = unused(docs, "__others")
    some = [F.col(f"`{c}`") for c in docs.columns if c in needed]
    if others:
        some.append(F.struct(*[F.col(f"`{c}`") for c in others]).alias(held))

    def back(df: DataFrame, **new) -> list:
        return [new[c].alias(c) if c in new else (F.col(f"`{c}`") if c in needed else F.col(held)[c]).alias(c) for c in docs.columns]

    return docs.select(*some), back


def with_arrow(docs: DataFrame, fn: Callable[[pa.RecordBatch], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """Every column of ``docs``, then ``fields``, computed batch by batch: no shuffle, memory bounded by a batch."""
    if clash := {f.name.lower() for f in fields} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns of that name are there already: {sorted(clash)}")
    schema = T.StructType([*docs.schema.fields, *fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, *fn(b)], names=names)

    return narrow_batches(docs).mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in col.cast(pa.binary() if not pa.types.is_large_string(col.type) else pa.large_binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers (constants of the public MurmurHash3 finaliser)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` seeded odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * U64(2) + U64(1)


class WordHashes:
    """64-bit hashes of words, remembered for the life of a worker up to a bounded number of words."""

    def __init__(self, most: int = 200_000) -> None:
        self.most, self.seen = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        seen, digest = self.seen, xxhash.xxh3_64_intdigest
        if len(seen) > self.most:
            seen.clear()
        out = []
        for w in words:
            h = seen.get(w)
            if h is None:
                h = seen[w] = digest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo ``n``: the fold rule of the labelled queries."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def bounded_sample(rows: DataFrame, by: str, most: int) -> DataFrame:
    """(doc_id, ``by``) rows with the smallest hashes of their ids, about ``most`` for each value of ``by``.

    Counts cover all rows; the cut is a share of the hash range, so one pass over two columns finds the sample."""
    rows = rows.select("doc_id", by).where(F.col("doc_id").isNotNull() & F.col(by).isNotNull())
    sizes = rows.groupBy(by).agg(F.count("*").alias("__n"))
    share = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1_000_000)) < F.lit(1_000_000.0 * most) / F.col("__n")
    return rows.join(sizes, by).where(share).select("doc_id", by).dropDuplicates(["doc_id"])


#: Bytes of the texts of a sample that reaches the driver.
SAMPLE_BYTES = 64_000_000


def sampled_rows(docs: DataFrame, picked: DataFrame, hard_limit: int | None = None) -> DataFrame:
    """The picked documents' texts; never more than ``hard_limit`` rows where that is given, those with the smallest hashes:
    an id that stands on several rows then gives its text of least hash.

    ``picked`` is bounded by what its caller counted, so it may be broadcast."""
    if hard_limit is not None:
        picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(hard_limit)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    if hard_limit is None:
        return rows
    by = [c for c in picked.columns if c != "doc_id"]
    return rows.groupBy("doc_id", *by).agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", *by)


def row_sample(rows: DataFrame, by: str, most: int) -> DataFrame:
    """About ``most`` different (doc_id, text, ``by``) rows for each value of ``by``, those with the smallest hashes of id and
    text; a row is sampled with the value that stands on it, whatever other rows of its id say. Nulls in any of the three are
    left out, equal rows count once."""
    rows = rows.select("doc_id", "text", by).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col(by).isNotNull())
    sizes = rows.groupBy(by).agg(F.count("*").alias("__n"))
    share = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id"), F.col("text")), F.lit(1_000_000)) < F.lit(1_000_000.0 * most) / F.col("__n")
    # a row for each value, of which a model keeps far more; texts that are not sampled are not shuffled
    return rows.join(F.broadcast(sizes), by).where(share).select("doc_id", "text", by).distinct()


def to_driver(rows: DataFrame, by: str, most_bytes: int = SAMPLE_BYTES) -> list:
    """(doc_id, text, ``by``) rows of a bounded sample, in order of their ids: all of them, or of each value of ``by`` those
    with the smallest hashes, as many as an equal share of the bytes holds."""
    from pyspark.sql import Window as W

    rows = rows.select("doc_id", "text", by)
    sizes = rows.select(by, F.octet_length("text").alias("n")).groupBy(by).agg(F.sum("n").alias("n")).collect()
    if sum(r["n"] or 0 for r in sizes) > most_bytes:
        upto = F.sum(F.octet_length("text")).over(W.partitionBy(by).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).rowsBetween(W.unboundedPreceding, W.currentRow))
        rows = rows.withColumn("upto", upto).where(F.col("upto") <= most_bytes / len(sizes)).drop("upto")
    return sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"]))
