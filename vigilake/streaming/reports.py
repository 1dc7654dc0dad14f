"""Reports as a stream: flattened as files arrive, merged so that only a report's latest version stays."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.dedup import latest_versions
from ..sources import schema
from ..sources.reports import flatten
from ..sources.store import drop_settled, settle


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Facts of new report files: one JSON report a line."""
    return flatten(spark.readStream.schema(schema.REPORT).option("maxFilesPerTrigger", files_per_batch).json(folder))


ID, DATE = "safetyreportid", "receivedate"
#: Parts that rows are dealt in, those of all buckets together: a bucket is as many files as it has parts, if tasks are as many.
PARTS = 1024


def newest(rows: DataFrame, parts: int) -> DataFrame:
    """rows: facts or packed reports beside their ``bucket`` and ``at``, the hash that deals them. Of each non-null id all rows at
    its last date, ids without any date dropped; null ids pass; equal rows fold.

    Rows are dealt and sorted once, by bucket and id, and come out in that order."""
    own = [c for c in rows.columns if c not in ("bucket", "at", ID, DATE)]
    dealt = rows.withColumn("part", F.pmod(F.hash("at"), F.lit(parts))).repartition("bucket", "part")
    by = W.partitionBy("bucket", "part", "at", ID).orderBy(DATE, *own)
    row = F.struct(DATE, *own)
    last = F.max(DATE).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    seen = dealt.select("*", last.alias("last"), F.lag(row).over(by).alias("before"))
    kept = seen.where((F.col(ID).isNull() | (F.col(DATE) == F.col("last"))) & ~row.eqNullSafe(F.col("before")))
    return kept.select(*[c for c in rows.columns if c != "at"])


class LatestVersions:
    """A table of current facts kept under ``root``, in buckets by a hash of the id; rows without an id by a hash of the row.

    A batch rewrites the buckets its rows fall in, all in one job, into a version folder of its own; of each bucket the newest
    version counts. Versions that no bucket needs any more, but for the one before, are deleted, so a reader that started
    before a merge still finds its files. A batch is a table on the shared folder while it is merged: none of it is held in memory."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, rows: StructType = schema.FACT) -> None:
        """``rows``: the schema of what is kept, facts or packed reports."""
        self.spark, self.root, self.buckets, self.rows = spark, root.rstrip("/"), buckets, rows

    @staticmethod
    def _at(batch: DataFrame) -> Column:
        return F.when(F.col(ID).isNull(), F.xxhash64(*batch.columns)).otherwise(F.xxhash64(ID))

    def placed(self, batch: DataFrame) -> DataFrame:
        """The batch settled, each row beside the hash that deals it and its bucket."""
        return settle(batch.withColumn("at", self._at(batch)).withColumn("bucket", F.pmod("at", F.lit(self.buckets)).cast("int")))

    def _held_by(self, placed: DataFrame) -> dict[int, str | None]:
        """The buckets that a placed batch falls in, and the folder of each if it has one."""
        held = self._held()
        return {r[0]: held.get(r[0]) for r in placed.select("bucket").distinct().collect()}  # at most ``buckets`` numbers

    def merge(self, batch: DataFrame, batch_id: int, placed: DataFrame | None = None) -> None:
        """``placed``: the batch's :meth:`placed`, if it is there."""
        if placed is None:
            placed = self.placed(batch)
            try:
                return self.merge(batch, batch_id, placed)
            finally:
                drop_settled(placed)
        hit = self._held_by(placed)
        if hit:
            old = self._read({b: path for b, path in hit.items() if path})
            rows = placed
            if old is not None:
                # a row without an id stays in the bucket that its file is in
                bucket = F.when(F.col(ID).isNull(), F.regexp_extract(F.input_file_name(), r"bucket=(\d+)", 1).cast("int")).otherwise(F.pmod(F.xxhash64(ID), F.lit(self.buckets)).cast("int"))
                rows = old.select("*", self._at(batch).alias("at"), bucket.alias("bucket")).unionByName(placed)
            version = f"{self.root}/v{batch_id:08d}-{uuid.uuid4().hex[:8]}"
            newest(rows, max(1, PARTS // self.buckets)).write.mode("overwrite").partitionBy("bucket").parquet(version)
            self._tidy()

    def changes(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows that the batch's ids have now, rows that they have once it is merged); rows without an id are not told."""
        new = batch.where(F.col("safetyreportid").isNotNull())
        ids = new.select("safetyreportid").distinct()
        hit = [r[0] for r in ids.select(F.pmod(F.xxhash64("safetyreportid"), F.lit(self.buckets)).cast("int")).distinct().collect()]  # at most ``buckets`` numbers
        held = self._held()
        old = self._read({b: held[b] for b in hit if b in held})
        before = self.spark.createDataFrame([], self.rows) if old is None else old.join(ids, "safetyreportid", "left_semi")
        before = before.select(batch.columns)
        return before, latest_versions(before.unionByName(new), distinct=True)

    def told(self, placed: DataFrame, **what: Column) -> DataFrame:
        """(safetyreportid, old, date, what): what the rows of the buckets that a placed batch falls in say now, and what the batch
        brings; rows without an id are not told."""
        slim = lambda rows, old: rows.where(F.col(ID).isNotNull()).select(ID, F.lit(old).alias("old"), F.col(DATE).alias("date"), *[c.alias(k) for k, c in what.items()])
        old = self._read({b: path for b, path in self._held_by(placed).items() if path})
        new = slim(placed, False)
        return new if old is None else new.unionByName(slim(old, True))

    def merged(self, batch_id: int) -> bool:
        return any(v.rpartition("/")[2].startswith(f"v{batch_id:08d}-") for v in self._versions())

    def _fs(self):
        sc = self.spark.sparkContext
        P = sc._jvm.org.apache.hadoop.fs.Path
        return P, P(self.root).getFileSystem(sc._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        P, fs = self._fs()
        if not fs.exists(P(self.root)):
            return []
        return sorted(s.getPath().toString() for s in fs.listStatus(P(self.root)) if fs.exists(P(s.getPath().toString() + "/_SUCCESS")))

    def _held(self) -> dict[int, str]:
        """The folder of each bucket's newest version."""
        P, fs = self._fs()
        out = {}
        for v in self._versions():
            for s in fs.listStatus(P(v)):
                name = s.getPath().getName()
                if name.startswith("bucket="):
                    out[int(name[7:])] = f"{v}/{name}"
        return out

    def _tidy(self) -> None:
        P, fs = self._fs()
        needed = {p.rpartition("/")[0] for p in self._held().values()}
        for v in self._versions()[:-2]:
            if v not in needed:
                fs.delete(P(v), True)

    def _read(self, held: dict[int, str]) -> DataFrame | None:
        return self.spark.read.schema(self.rows).parquet(*held.values()) if held else None

    def current(self) -> DataFrame:
        rows = self._read(self._held())
        return rows if rows is not None else self.spark.createDataFrame([], self.rows)

    def follow(self, stream: DataFrame, checkpoint: str):
        """Starts the merge of a stream; a batch that is retried rewrites the same ids to the same rows."""
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).start()


def quarterly_counts(stream: DataFrame) -> DataFrame:
    """Rows by derived quarter: month windows have no fixed length, so the quarter's name is the group."""
    return stream.groupBy("receive_quarter").agg(F.count("*").alias("n_rows"))
