"""Signals against the text of product labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.schema import SAFETY_SECTIONS

# British spellings and their American forms, tried in this order.
SPELLINGS = {
    "diarrhoea": "diarrhea", "haemorrhage": "hemorrhage", "haemorrhagic": "hemorrhagic", "haematuria": "hematuria", "haemoglobin": "hemoglobin",
    "haemolysis": "hemolysis", "haemolytic": "hemolytic", "haematopoietic": "hematopoietic", "oedema": "edema", "anaemia": "anemia",
    "anaesthetic": "anesthetic", "dyspnoea": "dyspnea", "hypokalaemia": "hypokalemia", "hyperkalaemia": "hyperkalemia", "hyponatraemia": "hyponatremia",
    "hypernatraemia": "hypernatremia", "hypocalcaemia": "hypocalcemia", "hypercalcaemia": "hypercalcemia", "foetal": "fetal", "foetus": "fetus",
    "tumour": "tumor", "behaviour": "behavior", "colour": "color", "labour": "labor", "leukopenia": "leukopenia", "neutropenia": "neutropenia",
    "thrombocytopenia": "thrombocytopenia", "ischaemia": "ischemia", "ischaemic": "ischemic", "oesophageal": "esophageal", "oesophagus": "esophagus",
    "diarrhoeal": "diarrheal", "paediatric": "pediatric", "gynaecological": "gynecological", "orthopaedic": "orthopedic",
}
#: Records of a product that count.
RECORDS = 3
#: Characters of a snippet on each side, and of a stored snippet.
AROUND, STORED = 150, 300


def variants(term: Column) -> Column:
    """Spellings of a term to look for: its own, its entry in the table, and with every part of it respelled."""
    low = F.lower(F.trim(term))
    table = F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])
    respelled = low
    for uk, us in SPELLINGS.items():
        respelled = F.replace(respelled, F.lit(uk), F.lit(us))
    return F.array_distinct(F.filter(F.array(low, table[low], respelled), lambda x: x.isNotNull()))


def from_records(raw: DataFrame, most: int = RECORDS) -> DataFrame:
    """raw: (drug_name, results), results a product's label records as the regulator's JSON gives them: a list of objects whose
    sections are lists of texts. (drug_name, label, section, text) of its first ``most`` records' safety sections."""
    record = "struct<" + ", ".join(f"{s}:array<string>" for s in SAFETY_SECTIONS) + ">"
    one = raw.select("drug_name", F.posexplode(F.slice(F.from_json("results", f"array<{record}>"), 1, most)).alias("label", "r"))
    held = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.col(f"r.{s}").alias("texts")) for s in SAFETY_SECTIONS]))
    rows = one.select("drug_name", "label", held.alias("s")).select("drug_name", "label", "s.section", F.array_join("s.texts", " ").alias("text"))
    return rows.where(F.length("text") > 0)


def first_records(rows: DataFrame, most: int = RECORDS) -> DataFrame:
    """rows: (drug_name, label, ...). The rows of a product's first records in the order of ``label``.

    Numbers alone are ranked, and cut to ``most`` before they are shuffled; no task holds a product's texts."""
    labels = rows.select("drug_name", "label").distinct()
    turn = F.row_number().over(W.partitionBy("drug_name").orderBy("label"))
    return rows.join(labels.withColumn("__turn", turn).where(F.col("__turn") <= most).drop("__turn"), ["drug_name", "label"], "left_semi")


def sections(labels: DataFrame) -> DataFrame:
    """labels: (drug_name, label, section, text). One lower-case text for each drug and section, labels in order."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("label", "text"))), lambda x: x["text"])
    return labels.groupBy("drug_name", "section").agg(F.lower(F.concat_ws(" ", parts)).alias("text"))


def quoted(text: Column) -> Column:
    """A text as a literal inside a regular expression."""
    return F.regexp_replace(text, r"([^A-Za-z0-9 ])", r"\\$1")


def matches(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """terms: (drug_name, pt); texts: (drug_name, section, text). A row for each section that holds a term as whole words.

    The first spelling that a section holds wins. Drugs keep the join within a label's few sections."""
    tried = terms.select("drug_name", "pt", F.posexplode(variants(F.col("pt"))).alias("turn", "variant"))
    word = F.concat(F.lit(r"(?<![A-Za-z0-9_])"), quoted(F.col("variant")), F.lit(r"(?![A-Za-z0-9_])"))
    hit = tried.join(texts, "drug_name").where(F.col("text").contains(F.col("variant")) & F.regexp_like(F.col("text"), word))
    at = F.regexp_instr("text", word) - 1
    first = hit.withColumn("at", at).groupBy("drug_name", "pt", "section").agg(F.min(F.struct("turn", "variant", "at")).alias("m"), F.first("text").alias("text"))
    start = F.greatest(F.col("m.at") - AROUND, F.lit(0))
    end = F.least(F.col("m.at") + F.length("m.variant") + AROUND, F.length("text"))
    snippet = F.concat(F.lit("…"), F.substring(F.col("text"), start + 1, end - start), F.lit("…"))
    return first.select("drug_name", "pt", "section", F.col("m.variant").alias("matched_term"), snippet.alias("snippet"))


def contains(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """The plain form: (drug_name, pt, section) where the lower-case term stands anywhere."""
    return terms.join(texts, "drug_name").where(F.col("text").contains(F.lower(F.trim("pt")))).select("drug_name", "pt", "section")


def validate(signals: DataFrame, texts: DataFrame) -> DataFrame:
    """signals: (drug_name, pt, positive). Adds validation_status, sections_hit, label_snippet and matched_term."""
    has_label = texts.select("drug_name").distinct().withColumn("has_label", F.lit(True))
    found = matches(signals.where("positive").select("drug_name", "pt").distinct(), texts)
    by = found.groupBy("drug_name", "pt").agg(
        F.array_join(F.sort_array(F.collect_set("section")), ",").alias("sections_hit"),
        F.min(F.struct("section", "snippet", "matched_term")).alias("m"),
    )
    out = signals.join(has_label, "drug_name", "left").join(by, ["drug_name", "pt"], "left")
    status = F.when(~F.col("positive"), "NO_SIGNAL").when(F.col("has_label").isNull(), "NO_LABEL").when(F.col("sections_hit").isNotNull(), "KNOWN").otherwise("POTENTIALLY_NEW")
    return out.select(
        *signals.columns, status.alias("validation_status"), F.coalesce("sections_hit", F.lit("")).alias("sections_hit"),
        F.coalesce(F.substring("m.snippet", 1, STORED), F.lit("")).alias("label_snippet"), F.coalesce("m.matched_term", F.lit("")).alias("matched_term"),
    )


def status_counts(validated: DataFrame) -> DataFrame:
    return validated.groupBy("validation_status").agg(F.count("*").alias("n"))


def top_new(validated: DataFrame, strength: list[str], k: int = 10) -> DataFrame:
    """The strongest potentially new terms by the first strength that a row has."""
    return validated.where("validation_status = 'POTENTIALLY_NEW'").withColumn("strength", F.coalesce(*strength)).orderBy(F.desc_nulls_last("strength"), "pt").limit(k)


def union_positive(**results: DataFrame) -> DataFrame:
    """One row for each term and algorithm that calls it, in the order given; columns are united."""
    out = None
    for name, df in results.items():
        part = df.where("signal").withColumn("algorithm", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def confidence(ct: DataFrame, statuses: DataFrame | None = None, weights: tuple = (0.30, 0.30, 0.40), **results: DataFrame) -> DataFrame:
    """Ranks a drug's called terms: share of algorithms, mean strength and reporting rate, the latter two against the best.

    results: prr, ror, bcpnn, mgps tables. Strengths: ln prr, ln ror and ln ebgm from 0, the information component from 0."""
    from functools import reduce

    value = {"prr": "ln(greatest(prr, 1.0))", "ror": "ln(greatest(ror, 1.0))", "bcpnn": "greatest(ic, 0.0)", "mgps": "ln(greatest(ebgm, 1.0))"}
    parts = [df.where("signal").select("drug", "pt", F.lit(k).alias("algorithm"), F.expr(value[k]).alias("strength")) for k, df in results.items()]
    by = reduce(DataFrame.unionByName, parts).groupBy("drug", "pt").agg(F.count("*").alias("n_algorithms"), F.array_join(F.sort_array(F.collect_list("algorithm")), ",").alias("algorithms"), F.avg("strength").alias("avg_strength"))
    x = by.join(ct.select("drug", "pt", F.coalesce(F.try_divide("a", F.col("a") + F.col("b")), F.lit(0.0)).alias("reporting_rate")), ["drug", "pt"], "left")
    every = W.partitionBy("drug")
    part = lambda c: F.coalesce(F.try_divide(F.col(c), F.nullif(F.greatest(F.max(c).over(every), F.lit(0.0)), F.lit(0.0))), F.lit(0.0))
    a, b, c = weights
    score = F.round(100.0 * (a * F.col("n_algorithms") / float(len(value)) + b * part("avg_strength") + c * part("reporting_rate")), 1)
    x = x.withColumn("confidence_score", score).withColumn("rank", F.row_number().over(every.orderBy(F.desc("confidence_score"), "pt")))
    x = x.withColumn("score_band", F.when(F.col("confidence_score") >= 60, "high").when(F.col("confidence_score") >= 35, "medium").otherwise("low"))
    return x if statuses is None else x.join(statuses, ["drug", "pt"], "left")
