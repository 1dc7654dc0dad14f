"""Follow-ups of a report: only its latest version counts. And the checks around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_versions(facts: DataFrame, key: str = "safetyreportid", date: str = "receivedate", distinct: bool = False) -> DataFrame:
    """Of each non-null id all rows at its last date, ids without any date dropped; null ids pass. With ``distinct`` equal rows fold.

    The last dates are aggregated before the shuffle and joined back, so a large id never sits in one window."""
    last = facts.where(F.col(key).isNotNull() & F.col(date).isNotNull()).groupBy(key).agg(F.max(date).alias(date))
    kept = facts.join(last, [key, date], "left_semi").unionByName(facts.where(F.col(key).isNull()))
    return kept.distinct() if distinct else kept


def version_stats(facts: DataFrame, key: str = "safetyreportid", date: str = "receivedate") -> DataFrame:
    """One row: ids, ids with several dates, ids without a date, rows with no id."""
    ids = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(date).alias("k"))
    a = ids.agg(F.count("*").alias("n_ids"), F.count_if(F.col("k") > 1).alias("n_multi"), F.count_if(F.col("k") == 0).alias("n_undated"))
    b = facts.agg(F.count("*").alias("n_rows"), F.coalesce(F.count_if(F.col(key).isNull()), F.lit(0)).alias("n_null_id"))
    return a.crossJoin(F.broadcast(b))  # one row each


def quarter_breakdown(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows and ids of each quarter before and after."""
    def side(df, tag):
        return df.groupBy("receive_quarter").agg(F.count("*").alias(f"rows_{tag}"), F.count_distinct("safetyreportid").alias(f"ids_{tag}"))

    return side(before, "pre").join(side(after, "post"), "receive_quarter").withColumn("rows_removed", F.col("rows_pre") - F.col("rows_post"))


def source_share(facts: DataFrame) -> DataFrame:
    """Rows of each provenance of drug names, and their per cent of all."""
    n = facts.groupBy("drug_name_source").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(W.partitionBy()), 1))


def missing_by_quarter(facts: DataFrame, above: float = 5.0) -> DataFrame:
    """Quarters in which more than ``above`` per cent of rows lack a drug name."""
    out = facts.groupBy("receive_quarter").agg(F.count("*").alias("n"), F.count_if((F.col("drug_name") == "") | F.col("drug_name").isNull()).alias("n_missing"))
    return out.withColumn("pct", F.round(F.lit(100.0) * F.col("n_missing") / F.col("n"), 1)).where(F.col("pct") > above)


def reports_by_year(facts: DataFrame) -> DataFrame:
    return facts.select("receive_year", "safetyreportid").distinct().groupBy("receive_year").agg(F.count("safetyreportid").alias("n_reports"))


def comedication_coverage(facts: DataFrame) -> DataFrame:
    """One row: reports, and those with more than one drug."""
    per = facts.where("safetyreportid IS NOT NULL").select("safetyreportid", "drug_name").distinct().groupBy("safetyreportid").agg(F.count("drug_name").alias("k"))
    return per.agg(F.count("*").alias("n_reports"), F.count_if(F.col("k") > 1).alias("n_multi"), F.round(100.0 * F.count_if(F.col("k") > 1) / F.count("*"), 1).alias("pct_multi"))


def top_drugs(facts: DataFrame, k: int = 20, role: str = "1") -> DataFrame:
    """The drugs with most reports in a role; ties by name."""
    pairs = facts.where(F.col("drug_characterization") == role).select("drug_name", "safetyreportid").distinct()
    return pairs.groupBy("drug_name").agg(F.count("safetyreportid").alias("n_reports")).orderBy(F.desc("n_reports"), "drug_name").limit(k)
