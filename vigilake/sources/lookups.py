"""Answers of slow outside sources kept as a table: what was found, and what was looked for in vain.

Wanted keys that the table does not hold are handed to a fetcher, a function from a frame of keys to a frame of keys and
payloads (a join with another table, or batches of requests in ``mapInArrow``); keys that it gives nothing for are stored as
misses and not asked for again. Each round is a version of its own: readers see it once its write is complete, or not at
all, and a round that fetches nothing writes nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "key string, payload string, found boolean, round int"


class LookupTable:
    """(key, payload, found) under ``root``; of a key with several answers the latest counts."""

    def __init__(self, spark: SparkSession, root: str, fetch: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.root, self.fetch = spark, root.rstrip("/"), fetch

    def _versions(self) -> list[str]:
        sc = self.spark.sparkContext
        P = sc._jvm.org.apache.hadoop.fs.Path
        root = P(self.root)
        fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
        there = [s.getPath().toString() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(p for p in there if fs.exists(P(p + "/_SUCCESS")))

    def current(self) -> DataFrame:
        """All answers so far."""
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], "key string, payload string, found boolean")
        rows = self.spark.read.schema(SCHEMA).parquet(*versions)
        latest = F.row_number().over(W.partitionBy("key").orderBy(F.desc("round")))
        return rows.withColumn("turn", latest).where("turn = 1").select("key", "payload", "found")

    def ask(self, wanted: DataFrame, again: bool = False) -> int:
        """Fetch the keys of (key) that are not held, or with ``again`` those held as misses as well; how many were fetched."""
        held = self.current()
        held = held.where("found") if again else held
        keys = wanted.where("key IS NOT NULL").select("key").distinct().join(held.select("key"), "key", "left_anti")
        if not keys.limit(1).count():
            return 0
        got = self.fetch(keys).select("key", "payload").where("payload IS NOT NULL").dropDuplicates(["key"])
        number = len(self._versions())
        rows = keys.join(got, "key", "left").select("key", "payload", F.col("payload").isNotNull().alias("found"), F.lit(number).alias("round"))
        path = f"{self.root}/v{number:06d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(path)
        return self.spark.read.schema(SCHEMA).parquet(path).count()

    def answers(self, wanted: DataFrame) -> DataFrame:
        """(key, payload) of the wanted keys, null for misses; asks for what is not held."""
        self.ask(wanted)
        return wanted.select("key").distinct().join(self.current(), "key", "left").select("key", "payload")
