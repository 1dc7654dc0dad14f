"""Marts that follow a table of reports: counts of distinct reports kept by what each merge takes away and adds.

A report belongs to a merge with all its rows, so its old (key, report) pairs count minus one each and its new ones plus one,
as far as they differ; its rows, facts or packed reports, are read as faces: sex, age, drugs and reactions. What is left by key is the merge's delta, written beside the others. A mart is the sum of its deltas: only keys whose counts
change are written, and a merge that replaces a report by itself writes nothing. Deltas are folded into one when there are
many. A batch that is retried after its merge is done finds its deltas written and leaves them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.contingency import cells
from ..operators.marts import Marts
from ..sources import schema
from ..sources.store import drop_settled, settle
from .deltas import DRUG, ID, PT, Count, deltas, summed_up
from .reports import LatestVersions

#: What is kept: of all reports, by reaction, by stratum, by both, by drug, by drug and reaction, and the index itself.
COUNTS = {
    "total": Count(()), "pt": Count((PT,), (PT,)), "stratum": Count(("sex", "age_stratum")), "cube": Count(("sex", "age_stratum", PT), (PT,)),
    "bridge": Count((DRUG, ID), (DRUG,)), "n_all": Count((), (DRUG, PT)), "n_drug": Count((DRUG,), (DRUG, PT)), "n_pt": Count((PT,), (DRUG, PT)), "pair": Count((DRUG, PT), (DRUG, PT)),
}


class LiveMarts:
    """Marts under ``root`` that follow the current rows of a :class:`LatestVersions`."""

    def __init__(self, spark: SparkSession, root: str, reports: LatestVersions, fold_at: int = 16) -> None:
        self.spark, self.root, self.reports, self.fold_at = spark, root.rstrip("/"), reports, fold_at

    def _fs(self):
        sc = self.spark.sparkContext
        P = sc._jvm.org.apache.hadoop.fs.Path
        return P, P(self.root).getFileSystem(sc._jsc.hadoopConfiguration())

    def _finished(self, name: str) -> tuple[list[str], int]:
        """(a mart's finished deltas, the oldest first; the place of the last that folds all before it, else 0)."""
        P, fs = self._fs()
        folder = P(f"{self.root}/{name}")
        there = sorted(s.getPath().toString() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        there = [p for p in there if fs.exists(P(p + "/_SUCCESS"))]
        return there, max((k for k, p in enumerate(there) if p.endswith("-fold")), default=0)

    def _deltas(self, name: str) -> list[str]:
        """The deltas that make up a mart."""
        there, last = self._finished(name)
        return there[last:]

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Merge rows into the reports, and what that changes into every mart.

        Deltas are written first: a batch that broke off before its merge finds the same change again and overwrites them,
        one that broke off after it has nothing left to do."""
        if self.reports.merged(batch_id):
            return
        names = ("drugs.drug_name", "reactions") if "drugs" in batch.columns else (F.array(DRUG), F.array(PT))
        said = {c: F.col(x) if isinstance(x, str) else x for c, x in zip((DRUG, PT), names, strict=True)}
        tables = [new := self.reports.placed(batch)]
        try:
            tables.append(changed := settle(deltas(self.reports.told(new, sex=F.col("sex"), age_stratum=F.col("age_stratum"), **said), COUNTS)))
            tables.append(counts := settle(summed_up(changed)))
            for name, count in COUNTS.items():
                if ID in count.keys:  # a report's own keys, each once
                    sides = [F.transform(c, lambda d: F.struct(d.alias(DRUG), F.lit(n).cast("long").alias("n"))) for c, n in (("gained", 1), ("lost", -1))]
                    delta = changed.where((F.col("mart") == name) & F.col(ID).isNotNull()).select(ID, F.inline(F.concat(*sides))).select(*count.keys, "n")
                else:
                    delta = counts.where(F.col("mart") == name).select(*count.keys, "n")
                delta.write.mode("overwrite").parquet(f"{self.root}/{name}/d{batch_id:08d}")
            self.reports.merge(batch, batch_id, new)
        finally:
            drop_settled(*tables)
        if len(self._deltas("total")) > self.fold_at:
            self.fold(batch_id)

    def read(self, name: str) -> DataFrame:
        """A mart's keys and the distinct reports ``n`` of each."""
        keys, there = COUNTS[name].keys, self._deltas(name)
        rows = T.StructType([*[schema.FACT[k] for k in keys], T.StructField("n", T.LongType())])
        if not there:
            return self.spark.createDataFrame([], rows)
        held = self.spark.read.schema(rows).parquet(*there)
        if ID in keys:  # a key is in few deltas: summed where it is dealt, not before
            held = held.repartition(ID)
        return held.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")

    def fold(self, batch_id: int) -> None:
        """One delta in place of all so far. What the fold before this one held goes; what this one holds stays until the next,
        so that a reader that started before it still finds its files."""
        P, fs = self._fs()
        for name in COUNTS:
            there, last = self._finished(name)
            self.read(name).write.mode("overwrite").parquet(f"{self.root}/{name}/d{batch_id:08d}-fold")
            for p in there[:last]:
                fs.delete(P(p), True)

    def marts(self) -> Marts:
        """What contingency routes read."""
        total = self.read("total").select(F.col("n").alias("n_total"))
        strata, cube = self.read("stratum").withColumnRenamed("n", "n_stratum"), self.read("cube").withColumnRenamed("n", "n_pt_stratum")
        pairs = cube.groupBy("sex", "age_stratum").agg(F.sum("n_pt_stratum").alias("n_pairs_stratum"))
        by_stratum = strata.join(pairs, ["sex", "age_stratum"])
        return Marts(
            self.read("pt").select(F.col(PT).alias("pt"), F.col("n").alias("n_pt")).crossJoin(F.broadcast(total)),  # one row
            cube.join(F.broadcast(by_stratum), ["sex", "age_stratum"]).select("sex", "age_stratum", PT, "n_pt_stratum", "n_stratum", "n_pairs_stratum"),  # a stratum is one of twelve
            self.read("bridge").select(DRUG, ID),
        )

    def all_pairs(self, min_a: int = 3) -> DataFrame:
        """Every drug's contingency table, from counts alone."""
        a, d, p = (self.read(x) for x in ("pair", "n_drug", "n_pt"))
        n = self.read("n_all").select("n")
        whole = a.select(F.col(DRUG).alias("drug"), F.col(PT).alias("pt"), F.col("n").alias("a")).join(d.select(F.col(DRUG).alias("drug"), F.col("n").alias("n_drug")), "drug").join(p.select(F.col(PT).alias("pt"), F.col("n").alias("n_pt")), "pt")
        return cells(whole.crossJoin(F.broadcast(n)), min_a)  # one row

    def follow(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).start()
