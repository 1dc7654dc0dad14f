"""Raw report files: manifests, nested JSON, flattening, cached lookups, sinks."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalise as N
from . import schema


def order_manifest(manifest: DataFrame) -> DataFrame:
    """Manifest entries with year and quarter from their address (0, 0 if it has none) and their rank in time."""
    year = F.coalesce(F.nullif(F.regexp_extract("file", r"/(\d{4})q(\d)/", 1), F.lit("")).cast("int"), F.lit(0))
    quarter = F.coalesce(F.nullif(F.regexp_extract("file", r"/(\d{4})q(\d)/", 2), F.lit("")).cast("int"), F.lit(0))
    return manifest.withColumn("year", year).withColumn("quarter", quarter)


def select_partitions(manifest: DataFrame, quarters: Iterable[str] | None = None) -> DataFrame:
    """All entries, or of each wanted quarter its first part. ``target`` is a path of its own for every part."""
    parts = F.split("file", "/")
    out = manifest.withColumn("quarter_name", F.element_at(parts, -2)).withColumn("name", F.element_at(parts, -1))
    if quarters is not None:
        out = out.where(F.col("quarter_name").isin(*quarters) & F.col("name").contains("0001-of"))
    return out.withColumn("target", F.concat_ws("/", "quarter_name", F.regexp_replace("name", r"\.zip$", ""))).drop("name")


def pending(spark: SparkSession, targets: DataFrame, root: str) -> DataFrame:
    """Targets with no file below ``root`` yet, for fetching outside the engine; what is there is skipped."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    there = [os.path.basename(s.getPath().toString()) for s in fs.globStatus(sc._jvm.org.apache.hadoop.fs.Path(root + "/*/*")) or []]
    return targets.where(~F.element_at(F.split("target", "/"), -1).isin(there)) if there else targets


def report_paths(spark: SparkSession, root: str, listing: str = "downloaded.txt") -> list[str]:
    """Report files below ``root``: those that its listing names, a path a line, relative or whole, as far as they are there; all
    JSON files of the folder and its folders where it has no listing."""
    sc = spark.sparkContext
    P = sc._jvm.org.apache.hadoop.fs.Path
    fs = P(root).getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.exists(P(f"{root}/{listing}")):
        named = [r["value"].strip() for r in spark.read.text(f"{root}/{listing}").collect()]  # a line a file
        paths = [n if n.startswith("/") or ":" in n else f"{root}/{n}" for n in named if n]
        return sorted({p for p in paths if fs.exists(P(p))})
    found = [s.getPath().toString() for pattern in ("*.json", "*/*.json") for s in fs.globStatus(P(f"{root}/{pattern}")) or []]
    return sorted(found)


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Reports of whole-file JSON documents with a ``results`` list."""
    return spark.read.schema(schema.RAW_FILE).option("multiLine", True).json(list(paths)).select(F.explode("results").alias("report")).select("report.*")


#: How a record begins in files whose records all have their id first.
RECORD_START = '{"safetyreportid":'


def read_files_cut(spark: SparkSession, *paths: str, start: str = RECORD_START) -> DataFrame:
    """:func:`read_files` for files too large for one task: a file is cut at byte ranges wherever records begin.

    ``start`` is the text that every record begins with. It holds a brace before an unescaped quote, which no JSON string
    can, so it never occurs inside one; it is the separator of a text scan, which Spark splits like any other. A piece is a
    record without its start, then a comma or the end of list and file; the piece that opens a file ends with the list's
    bracket and is no record. A file whose records begin otherwise is refused."""
    head = F.ltrim("value").startswith("{") | F.ltrim("value").startswith("[")
    opens = F.rtrim("value").endswith("[") | F.col("value").rlike(r"\[\s*\]\s*\}?\s*$")
    refused = F.raise_error(F.concat(F.lit(f"no record that begins with {start} in "), F.col("_metadata.file_name"))).cast("boolean")
    pieces = spark.read.option("lineSep", start).text(list(paths))
    pieces = pieces.where(F.when(~head, F.length(F.trim("value")) > 0).when(opens, False).otherwise(refused))
    return pieces.select(F.from_json(F.concat(F.lit(start), F.col("value")), schema.REPORT).alias("report")).select("report.*")


def as_list(value: Column, element: str) -> Column:
    """A JSON list, or one object taken as a list of it; entries that are no objects become null."""
    return F.from_json(F.when(F.ltrim(value).startswith("["), value).otherwise(F.concat(F.lit("["), value, F.lit("]"))), f"array<{element}>")


def flatten(reports: DataFrame) -> DataFrame:
    """Reports in the raw schema as facts: a row for each drug and reaction; reports that lack either give none."""
    date = N.iso_date(F.coalesce(F.nullif(F.col("receivedate"), F.lit("")), F.col("receiptdate")))
    flag = lambda c: F.coalesce(F.col(c), F.lit("0"))
    one = reports.select(
        F.nullif(F.col("safetyreportid"), F.lit("")).alias("safetyreportid"), date.alias("receivedate"), "serious",
        flag("seriousnessdeath").alias("outcome_death"), flag("seriousnesslifethreatening").alias("outcome_lifethreat"),
        flag("seriousnesshospitalization").alias("outcome_hosp"), flag("seriousnessdisabling").alias("outcome_disab"),
        F.col("primarysource.reportercountry").alias("reporter_country"), F.col("primarysource.qualification").alias("reporter_qual"),
        N.age_years(F.col("patient.patientonsetage"), F.col("patient.patientonsetageunit")).alias("age_years"), N.sex(F.col("patient.patientsex")).alias("sex"),
        F.filter(as_list(F.col("patient.drug"), schema.DRUG.simpleString()), lambda x: x.isNotNull()).alias("drugs"),
        # texts are cleaned before they multiply with the drugs
        F.transform(F.filter(as_list(F.col("patient.reaction"), schema.REACTION.simpleString()), lambda x: F.length(x["reactionmeddrapt"]) > 0), lambda x: F.upper(F.trim(x["reactionmeddrapt"]))).alias("reactions"),
    ).where("size(drugs) > 0 AND size(reactions) > 0")
    drug = one.withColumn("drug", F.explode("drugs")).drop("drugs")
    d = F.col("drug")
    name, source = N.drug_name(d["activesubstance"]["activesubstancename"], d["medicinalproduct"], *[N.first_of(d["openfda"][x]) for x in ("generic_name", "brand_name", "substance_name")])
    out = drug.withColumn("drug_name", name).withColumn("drug_name_source", source).withColumn("reaction_pt", F.explode("reactions"))
    out = out.withColumns({
        "receive_year": N.year_of(F.col("receivedate")), "receive_quarter": N.quarter_of(F.col("receivedate")), "age_stratum": N.age_stratum(F.col("age_years")),
        "drug_characterization": d["drugcharacterization"], "drug_indication": F.upper(d["drugindication"]),
    })
    return out.select(schema.FACT.fieldNames())


def approval_year(approvals: DataFrame) -> DataFrame:
    """(drug_name, year): the first year of an approved original submission among a product's first five results; null on a miss."""
    sub = approvals.select("drug_name", F.explode_outer(F.slice("results", 1, 5)).alias("r")).select("drug_name", F.explode_outer("r.submissions").alias("s"))
    year = F.when((F.col("s.submission_type") == "ORIG") & (F.col("s.submission_status") == "AP"), F.substring("s.submission_status_date", 1, 4).try_cast("int"))
    return sub.groupBy("drug_name").agg(F.min(year).alias("year"))


def substances(facts: DataFrame) -> DataFrame:
    return facts.where("drug_name IS NOT NULL AND drug_name != ''").select("drug_name").distinct().orderBy("drug_name")


def write_sorted(facts: DataFrame, path: str, rows_of_file: int = 1_000_000) -> None:
    """The fact ordered by drug and report, so that row groups prune by drug: range partitions, each sorted, no global sort.
    A drug with a large share of all rows is cut by its reports into as many ranges as it fills."""
    order = [F.col("drug_name").asc_nulls_last(), F.col("safetyreportid").asc_nulls_last()]
    facts.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("compression", "snappy").option("maxRecordsPerFile", rows_of_file).parquet(path)


def write_crossed(drugs: DataFrame, path: str, rows_of_file: int = 1_000_000) -> None:
    """:func:`write_sorted` of facts that are not crossed yet: a row for each report and drug with the list ``reactions``. The
    rows are dealt and sorted so, and cross as they are written."""
    order = [F.col("drug_name").asc_nulls_last(), F.col("safetyreportid").asc_nulls_last()]
    rows = drugs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("reaction_pt", F.explode("reactions"))
    rows.select(schema.FACT.fieldNames()).write.mode("overwrite").option("compression", "snappy").option("maxRecordsPerFile", rows_of_file).parquet(path)


def is_stale(spark: SparkSession, source: str, *targets: str) -> bool:
    """Whether any target is missing or older than the source, by the times of the file system that holds them."""
    sc = spark.sparkContext
    P = sc._jvm.org.apache.hadoop.fs.Path

    def time(p: str) -> int | None:
        path = P(p)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        return fs.getFileStatus(path).getModificationTime() if fs.exists(path) else None

    times = [time(t) for t in targets]
    return any(t is None for t in times) or min(times, default=0) < (time(source) or 0)


def verify(spark: SparkSession, least_bytes: int = 1000, **paths: str) -> DataFrame:
    """(name, rows, ok) of written tables: readable, large enough, and with rows."""
    sc = spark.sparkContext
    out = None
    for name, path in paths.items():
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        size = fs.getContentSummary(p).getLength() if fs.exists(p) else 0
        rows = spark.read.parquet(path).agg(F.count("*").alias("rows")) if size else spark.createDataFrame([(0,)], "rows long")
        one = rows.select(F.lit(name).alias("name"), "rows", ((F.col("rows") > 0) & F.lit(size >= least_bytes)).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out


def sink(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """parquet, csv (with a header) or json."""
    writer = df.write.mode("overwrite")
    {"parquet": writer.parquet, "csv": lambda p: writer.option("header", True).csv(p), "json": writer.json}[kind](path)
