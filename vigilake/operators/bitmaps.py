"""The index of reports as bitmaps: which reports name a drug or a reaction, by dense report numbers.

Reports are numbered without a gap (packed reports: but for gaps between partitions), and a value's reports lie in buckets of as many numbers as one bitmap holds. A bucket
with few reports is a sorted list of positions, any other a bitmap, so that rare drugs take their own size and common ones
an eighth of a byte a report. No drug is one array: a hot drug has as many rows as there are buckets. Strata are
intersections, bucket by bucket, in Arrow batches; what is counted is counted on the bits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import settle
from .contingency import cells
from .marts import has_text, told
from .scan import Ranges

#: Positions up to which a bucket is a list: it then takes no more than a bitmap.
FEW = 1024
BUCKET_BYTES = 4096


def numbered(facts: DataFrame, id_: str = "safetyreportid") -> DataFrame:
    """(id, number): numbers from 1 without gaps, in the order of ids."""
    ids = facts.where(F.col(id_).isNotNull()).select(F.col(id_).alias("id")).distinct().withColumn("all", F.lit(1))
    return Ranges(ids, "all", "id").done().select("id", F.col("i").cast("long").alias("number"))


def containers(members: DataFrame) -> DataFrame:
    """members: (field, value, number), distinct. (field, value, bucket, n, bits, few): one of bits and few is null."""
    keys = ["field", "value", "bucket"]
    at = members.select("field", "value", F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("position"))
    full = at.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > FEW).select(*keys, F.lit(True).alias("full"))
    told = at.join(full, keys, "left")
    bits = told.where("full").groupBy(*keys).agg(F.count("*").alias("n"), F.bitmap_construct_agg("position").alias("bits")).withColumn("few", F.lit(None).cast("array<int>"))
    few = told.where("full IS NULL").groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.col("position").cast("int"))).alias("few"))
    return bits.unionByName(few.withColumn("bits", F.lit(None).cast("binary")))


def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (number, drugs, pts) as rows (field, value, bucket, few): a batch's positions of each value and bucket."""
    size = BUCKET_BYTES * 8
    for batch in batches:
        at = batch.column("number").to_numpy() - 1
        for field, name in (("drug", "drugs"), ("pt", "pts")):
            lists = batch.column(name)
            told = lists.flatten().dictionary_encode()
            if not len(told):
                continue
            mine = np.repeat(at, lists.value_lengths().to_numpy())
            buckets, bucket = np.unique(mine // size, return_inverse=True)
            key = told.indices.to_numpy().astype(np.int64) * len(buckets) + bucket
            order = np.argsort(key, kind="stable")
            keys, starts = np.unique(key[order], return_index=True)
            few = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), pa.array((mine % size)[order], pa.int32()))
            values = told.dictionary.take(pa.array(keys // len(buckets)))
            yield pa.RecordBatch.from_arrays([pa.array([field] * len(keys)), values, pa.array(buckets[keys % len(buckets)] + 1, pa.int64()), few], ["field", "value", "bucket", "few"])


@F.pandas_udf(T.BinaryType())
def as_bits(few: pd.Series) -> pd.Series:
    """Lists of positions as bitmaps; null stays null."""
    return few.map(lambda x: None if x is None else opened(None, x).tobytes())


def containers_of_reports(reports: DataFrame) -> DataFrame:
    """:func:`containers` from (drugs, pts), a row a report, each naming a value once. A report's number is its row's in its
    partition, so a bucket's rows lie together, and what is shuffled are lists of positions, one for each batch and value."""
    held = reports.select((F.monotonically_increasing_id() + 1).alias("number"), "drugs", "pts")
    lists = held.mapInArrow(positions, "field string, value string, bucket long, few array<int>")
    at = lists.groupBy("field", "value", "bucket").agg(F.sort_array(F.flatten(F.collect_list("few"))).alias("few")).withColumn("n", F.size("few").cast("long"))
    many = F.col("n") > FEW
    return at.select("field", "value", "bucket", "n", as_bits(F.when(many, F.col("few"))).alias("bits"), F.when(~many, F.col("few")).alias("few"))


def opened(bits: bytes | None, few: np.ndarray | None) -> np.ndarray:
    """A bucket's bytes, whatever it is kept as; the lowest bit of a byte is its first position."""
    if bits is not None:
        return np.frombuffer(bits, dtype=np.uint8)
    flags = np.zeros(BUCKET_BYTES * 8, dtype=np.uint8)
    flags[np.asarray(few, dtype=np.int64)] = 1
    return np.packbits(flags, bitorder="little")


def met(a_bits, a_few, b_bits, b_few) -> np.ndarray:
    """Positions or bytes that two buckets share: a list where either is one."""
    if a_bits is not None and b_bits is not None:
        return np.frombuffer(a_bits, dtype=np.uint8) & np.frombuffer(b_bits, dtype=np.uint8)
    if a_bits is None and b_bits is None:
        return np.intersect1d(a_few, b_few, assume_unique=True)
    bits, few = (a_bits, b_few) if a_bits is not None else (b_bits, a_few)
    few = np.asarray(few, dtype=np.int64)
    return few[np.frombuffer(bits, dtype=np.uint8)[few >> 3] >> (few & 7) & 1 == 1]


@F.pandas_udf(T.LongType())
def count_met(a_bits: pd.Series, a_few: pd.Series, b_bits: pd.Series, b_few: pd.Series) -> pd.Series:
    """How many reports two buckets share."""
    out = []
    for p, q, r, s in zip(a_bits, a_few, b_bits, b_few, strict=True):
        x = met(p, q, r, s)
        out.append(int(np.bitwise_count(x).sum()) if x.dtype == np.uint8 else len(x))
    return pd.Series(out, dtype="int64")


@F.pandas_udf(T.BinaryType())
def bits_met(a_bits: pd.Series, a_few: pd.Series, b_bits: pd.Series, b_few: pd.Series) -> pd.Series:
    """The bitmap of the reports that two buckets share."""
    def one(p, q, r, s) -> bytes:
        x = met(p, q, r, s)
        return x.tobytes() if x.dtype == np.uint8 else opened(None, x).tobytes()

    return pd.Series([one(*x) for x in zip(a_bits, a_few, b_bits, b_few, strict=True)])


@dataclass(frozen=True)
class ReportIndex:
    """(field, value, bucket, n, bits, few) over the fields ``drug`` and ``pt``, and (field, value, n) of whole values.

    Facts cross the drugs of a report with its reactions, so a report in both of a drug's and a reaction's bitmaps is one
    that names the pair. A report without a reaction is in no bitmap, as in a scan's counts of reports with reactions."""

    buckets: DataFrame

    @staticmethod
    def of(facts: DataFrame, pt: str = "reaction_pt") -> ReportIndex:
        told = facts.where(has_text(pt) & has_text("drug_name") & F.col("safetyreportid").isNotNull())
        numbers = numbered(told)
        pairs = [told.select(F.lit(field).alias("field"), F.col(c).alias("value"), F.col("safetyreportid").alias("id")).distinct() for field, c in (("drug", "drug_name"), ("pt", pt))]
        members = pairs[0].unionByName(pairs[1]).join(numbers, "id").select("field", "value", "number")
        return ReportIndex(settle(containers(members)))

    @staticmethod
    def of_reports(reports: DataFrame) -> ReportIndex:
        """The same from packed reports, a row for each id: nothing is crossed, made distinct or joined with its number."""
        return ReportIndex(settle(containers_of_reports(told(reports))))

    def write(self, path: str) -> None:
        """In ranges of (field, bucket, value), so that a stratum's buckets are read next to those they meet."""
        self.buckets.repartitionByRange("field", "bucket", "value").sortWithinPartitions("field", "value", "bucket").write.mode("overwrite").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> ReportIndex:
        return ReportIndex(spark.read.parquet(path))

    def of_value(self, field: str, value: str, name: str) -> DataFrame:
        """(bucket, name_bits, name_few, name_n) of one value."""
        mine = self.buckets.where((F.col("field") == field) & (F.col("value") == value))
        return mine.select("bucket", F.col("bits").alias(f"{name}_bits"), F.col("few").alias(f"{name}_few"), F.col("n").alias(f"{name}_n"))

    def sizes(self, field: str) -> DataFrame:
        """(value, n): reports of each value."""
        return self.buckets.where(F.col("field") == field).groupBy("value").agg(F.sum("n").alias("n"))

    def shared(self, field: str, stratum: DataFrame, name: str) -> DataFrame:
        """(value, k): reports of the stratum (bucket, name_bits, name_few) that have each value of a field."""
        both = self.buckets.where(F.col("field") == field).join(stratum, "bucket")
        k = count_met("bits", "few", f"{name}_bits", f"{name}_few")
        return both.select("value", k.alias("k")).groupBy("value").agg(F.sum("k").alias("k")).where("k > 0")

    def comedication(self, drug: str, co_drug: str, min_a: int = 3) -> DataFrame:
        """The contingency table of a drug among the reports of another."""
        co, own = self.of_value("drug", co_drug, "co"), self.of_value("drug", drug, "own")
        both = settle(co.join(own, "bucket").select("bucket", bits_met("co_bits", "co_few", "own_bits", "own_few").alias("both_bits")))
        both = both.withColumn("both_few", F.lit(None).cast("array<int>"))
        a = self.shared("pt", both, "both").select(F.col("value").alias("pt"), F.col("k").alias("a"))
        back = self.shared("pt", co, "co").select(F.col("value").alias("pt"), F.col("k").alias("n_pt"))
        one = co.agg(F.sum("co_n").alias("n")).crossJoin(F.broadcast(both.agg(F.sum(F.bitmap_count("both_bits")).alias("n_drug"))))  # one row each
        return cells(a.join(back, "pt").crossJoin(F.broadcast(one)).withColumn("drug", F.lit(drug)), min_a)  # one row

    def comedications(self, drug: str) -> DataFrame:
        """(co_drug, n, n_both): reports of every other drug, and those that name ``drug`` as well."""
        k = self.shared("drug", self.of_value("drug", drug, "own"), "own")
        every = self.sizes("drug").where(F.col("value") != drug)
        return every.join(k, "value", "left").select(F.col("value").alias("co_drug"), "n", F.coalesce("k", F.lit(0)).cast("long").alias("n_both"))
