"""Launch-period reporting bias: whether reports of a drug crowd into its first years on the market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Thresholds of the risk criteria.
EARLY_HIGH, EARLY_MODERATE, YEARS_LOW, YEARS_MODERATE, PEAK_HIGH, PEAK_MODERATE, LEAST_REPORTS = 0.70, 0.50, 5, 3, 4, 8, 30
LEVELS = ["LOW", "MODERATE", "HIGH"]


def quarterly(facts: DataFrame) -> DataFrame:
    """(drug_name, year, q, reports): distinct reports of every drug by quarter."""
    rows = facts.where("receive_year IS NOT NULL AND receive_quarter IS NOT NULL AND safetyreportid IS NOT NULL")
    rows = rows.select("drug_name", F.col("receive_year").alias("year"), F.right("receive_quarter", F.lit(1)).cast("int").alias("q"), "safetyreportid").distinct()
    return rows.groupBy("drug_name", "year", "q").agg(F.count("*").alias("reports"))


def totals(facts: DataFrame) -> DataFrame:
    """(drug_name, total, first_year, last_year, years)"""
    rows = facts.where("safetyreportid IS NOT NULL").select("drug_name", "receive_year", "safetyreportid").distinct()
    out = rows.groupBy("drug_name").agg(F.count_distinct("safetyreportid").alias("total"), F.min("receive_year").alias("first_year"), F.max("receive_year").alias("last_year"))
    return out.withColumn("years", F.col("last_year") - F.col("first_year") + 1)


def offsets(series: DataFrame, sums: DataFrame, approvals: DataFrame) -> DataFrame:
    """Quarters counted from the approval year, or from the first year where that is unknown."""
    x = series.join(sums, "drug_name").join(approvals.select("drug_name", F.col("year").alias("approval_year")), "drug_name", "left")
    return x.withColumn("offset", (F.col("year") - F.coalesce("approval_year", "first_year")) * 4 + F.col("q") - 1)


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope, rounded; null under four points or without spread."""
    return F.when((F.count(x) >= 4) & (F.var_pop(x) > 0), F.round(F.regr_slope(y, x), 4))


def metrics(series: DataFrame) -> DataFrame:
    """series: what offsets() gives. One row a drug: early ratio, peak, trend and the slope after the peak."""
    first_most = W.partitionBy("drug_name").orderBy(F.desc("reports"), "year", "q")
    peak = series.withColumn("rn", F.row_number().over(first_most)).where("rn = 1").select("drug_name", F.col("offset").alias("peak_offset"))
    x = series.join(peak, "drug_name")
    early = F.sum(F.when(F.col("offset").between(0, 7), F.col("reports")).otherwise(0)) / F.first("total")
    after = F.when(F.col("offset") > F.col("peak_offset"), F.col("offset"))
    post = F.when(F.col("offset") > F.col("peak_offset"), F.col("reports"))
    return x.groupBy("drug_name").agg(
        F.first("total").alias("total"), F.first("years").alias("years"), F.first("first_year").alias("first_year"), F.first("approval_year").alias("approval_year"),
        F.when(F.first("approval_year").isNotNull(), early).alias("early_ratio"), F.first("peak_offset").alias("peak_offset"),
        slope(F.col("reports"), F.col("offset")).alias("trend_slope"), slope(post, after).alias("post_peak_slope"),
    )


def risk(m: DataFrame) -> DataFrame:
    """Adds ``risk``, the highest of the criteria that apply, and ``reasons``, the codes of those above LOW."""
    known = F.col("approval_year").isNotNull()
    peak = F.col("peak_offset")
    marks = {
        "few_reports": F.when(F.col("total") < LEAST_REPORTS, 2),
        "early_ratio": F.when(F.col("early_ratio").isNull(), 1).when(F.col("early_ratio") >= EARLY_HIGH, 2).when(F.col("early_ratio") >= EARLY_MODERATE, 1).otherwise(0),
        "short_history": F.when(F.col("years") < YEARS_MODERATE, 2).when(F.col("years") < YEARS_LOW, 1).otherwise(0),
        "early_peak": F.when(known & peak.isNotNull(), F.when(peak.between(0, PEAK_HIGH - 1), 2).when(peak.between(PEAK_HIGH, PEAK_MODERATE - 1), 1).otherwise(0)),
        "decline": F.when(known & peak.between(0, PEAK_MODERATE - 1) & (F.col("post_peak_slope") < 0), 2),
    }
    level = F.greatest(*[F.coalesce(v, F.lit(0)) for v in marks.values()])
    reasons = F.array_join(F.filter(F.array(*[F.when(v >= 1, k) for k, v in marks.items()]), lambda x: x.isNotNull()), ",")
    return m.withColumn("risk", F.element_at(F.array(*[F.lit(x) for x in LEVELS]), level + 1)).withColumn("reasons", reasons)


def check(facts: DataFrame, drugs: DataFrame, approvals: DataFrame) -> DataFrame:
    """The risk of each wanted drug; a drug without reports is HIGH, with empty metrics."""
    own = facts.join(F.broadcast(drugs.select("drug_name").distinct()), "drug_name", "left_semi") if drugs.limit(1001).count() <= 1000 else facts.join(drugs.select("drug_name").distinct(), "drug_name", "left_semi")
    found = risk(metrics(offsets(quarterly(own), totals(own), approvals)))
    out = drugs.select("drug_name").distinct().join(found, "drug_name", "left")
    return out.withColumns({"total": F.coalesce("total", F.lit(0)), "risk": F.coalesce("risk", F.lit("HIGH")), "reasons": F.coalesce("reasons", F.lit("no_reports"))})
