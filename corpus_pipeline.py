"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and gives back rows with the columns
of ``documents``; the last gives the words that the mix takes of each document. Stages that only drop or edit rows do
so where the rows are read; near-duplicates alone shuffle texts. Extra columns are carried, whatever their names, and empty
tables give empty results at every stage. What each stage makes of other odd rows its function says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigilake.llm import decontaminate, minhash_dedup, quality_rules, secret_scan, source_mix
from vigilake.llm.common import discard, documents, settle, unused

#: SQL cannot express the learned list, the tilings or the novelty scan; tests hold the stages against brute force.
ORACLE_SQL = None
#: Words of a shingle and 100 times the least similarity of near-duplicates; what stands for a secret.
SHINGLE, SIMILAR, REDACTED = 5, 80, "[SECRET]"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go.

    A null or empty text has no words and goes; a null id or a repeated row is judged by its own text; labels with nulls
    teach nothing."""
    verdict = unused(docs, "verdict")
    judged = quality_rules.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), into=verdict)
    return judged.where(F.col(verdict)["kept"]).drop(verdict)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays.

    Of rows that repeat that id the one stays whose text, and then whose row, has the least hash; a row with a null id always
    stays; documents without words are near-duplicates of none."""
    groups = minhash_dedup.near_duplicates(docs, SHINGLE, SIMILAR)
    least = settle(groups.where("doc_id = component_id").select("doc_id").distinct())
    discard(groups)
    turn = unused(docs, "turn")
    first = W.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]))
    kept = docs.join(least, "doc_id", "left_semi").withColumn(turn, F.row_number().over(first)).where(F.col(turn) == 1).drop(turn)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go.

    Null and empty texts and items contain and are nothing; a null id or a repeated row is judged by its own text."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets are replaced in the text; lengths follow.

    Null and empty texts stay as they are; each row is scanned by itself."""
    spans = unused(docs, "spans")
    found = secret_scan.scan(docs, redact=REDACTED, into=spans)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.size(spans) > 0, length).otherwise(F.col("n_chars")))
    return found.drop(spans)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document.

    Null texts have no words; a null source is a source of its own; rows that repeat an id are taken each for itself."""
    return source_mix.mix(docs)


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("source mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet on the shared folder and read again; what is read no more is deleted."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        was = docs
        docs = settle(stage(spark, was, sf_dir))
        discard(was)
    mixed = STAGES[-1][1](spark, docs, sf_dir)
    out = settle(mixed)
    discard(docs, mixed)
    return out
