"""The fact laid out for joins by report: bucketed by report id, so that reports meet their rows without a shuffle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a fact; a bucket should be some hundred MB.
BUCKETS = 32


def write_buckets(facts: DataFrame, name: str, path: str, buckets: int = BUCKETS, by: str = "safetyreportid") -> DataFrame:
    """``facts`` as an external table ``name`` under ``path``, one file a bucket, sorted by report within it.

    Joins, semi-joins and counts by report of tables with as many buckets read them bucket by bucket: their plans have no
    exchange on the report. A report's rows are few, so no drug or term, however hot, makes a bucket large."""
    if not re.fullmatch(r"\w+", name):
        raise ValueError("a table's name has letters, digits and underscores")
    facts.repartition(buckets, by).write.mode("overwrite").bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(name)
    return read_buckets(facts.sparkSession, name)


def read_buckets(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def exchanges(df: DataFrame, by: str = "safetyreportid") -> int:
    """How many exchanges of a plan are on a column alone or with others."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(rf"Exchange hashpartitioning\([^)]*\b{by}#", plan))


def footer_summary(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """One row: the rows of a Parquet table, and the least and largest value of number columns, from its files' footers alone.

    Executors read footers, no data: the aggregates are pushed into the scan. A session of its own asks for that, so the
    caller's settings stay. Texts are left out: footers may hold them cut."""
    asking = spark.newSession()
    asking.conf.set("spark.sql.sources.useV1SourceList", "")
    asking.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    table = asking.read.parquet(path)
    if texts := [c for c in columns if table.schema[c].dataType.simpleString() in ("string", "binary")]:
        raise ValueError(f"footers do not tell the bounds of {texts}")
    both = [f(c).alias(f"{name}_{c}") for c in columns for f, name in ((F.min, "min"), (F.max, "max"))]
    return table.agg(F.count("*").alias("n_rows"), *both)
