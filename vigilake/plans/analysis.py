"""One analysis from configuration to ranked terms."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contingency as C
from ..operators import disproportionality as D
from ..operators import labels as L
from ..operators import launch_bias as B
from ..operators.marts import Marts
from ..sources.store import settle
from .predicate import Predicate


@dataclass(frozen=True)
class AnalysisConfig:
    """What to analyse, and the thresholds of all algorithms in one place."""

    drug: str
    where: str | None = None
    min_a: int = 3
    min_events: int = 3
    prr_threshold: float = 0.05
    ror_threshold: float = 0.05
    ic_threshold: float = 0.0
    eb05_threshold: float = 2.0
    algorithms: tuple[str, ...] = ("prr", "ror", "bcpnn", "mgps")
    approval_year: int | None = None
    output: str | None = None

    @staticmethod
    def from_json(text: str) -> AnalysisConfig:
        known = {f.name for f in fields(AnalysisConfig)}
        raw = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()}
        if unknown := set(raw) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return AnalysisConfig(**raw)


#: Models of one's own: name -> table of statistics of a contingency table under a configuration. The four that are built in
#: are computed together, see :func:`disproportionality.every_model`.
ALGORITHMS: dict = {}
BUILT_IN = ("prr", "ror", "bcpnn", "mgps")


class Kept:
    """Cells and statistics of earlier questions under ``root``, by what was asked; a question asked again reads them.

    ``of`` names the facts that the answers are of (a path and version, say): other facts have answers of their own."""

    def __init__(self, spark: SparkSession, root: str, of: str) -> None:
        self.spark, self.root, self.of = spark, root.rstrip("/"), of

    def table(self, make: Callable[[], DataFrame], *asked) -> DataFrame:
        path = f"{self.root}/{hashlib.sha256(repr((self.of, *asked)).encode()).hexdigest()}"
        sc = self.spark.sparkContext
        done = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(sc._jsc.hadoopConfiguration()).exists(done):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def tables(ct: DataFrame, config: AnalysisConfig, kept: Kept | None = None) -> dict[str, DataFrame]:
    """Each model's table of results. The built-in models' cells are settled once, with all their statistics."""
    together = tuple(k for k in config.algorithms if k in BUILT_IN and k not in ALGORITHMS)
    how = (config.min_events, config.prr_threshold, config.ror_threshold, config.ic_threshold, config.eb05_threshold)
    make = lambda: D.every_model(ct, together, *how)
    wide = None if not together else settle(make()) if kept is None else kept.table(make, "models", config.drug, config.where, config.min_a, together, *how)
    return {k: wide.select(f"model_{k}.*") if k in together else ALGORITHMS[k](ct, config) for k in config.algorithms}


@dataclass(frozen=True)
class Analysis:
    """The frames of an analysis. Cells and statistics are settled; the rest is computed when it is read."""

    config: AnalysisConfig
    contingency: DataFrame
    results: dict[str, DataFrame]
    signals: DataFrame
    ranked: DataFrame
    launch: DataFrame | None = None
    validated: DataFrame | None = None
    notes: dict = field(default_factory=dict)

    def summary(self) -> DataFrame:
        """(item, value): what was asked, pairs and positives of each algorithm, statuses of the validation and the launch risk."""
        c = self.config
        asked = {"target_drug": c.drug, "where": c.where, "min_a": c.min_a, "algorithms": ",".join(c.algorithms), "fdr": c.prr_threshold, "eb05": c.eb05_threshold, "ic": c.ic_threshold}
        rows = [(k, None if v is None else str(v)) for k, v in asked.items()]
        parts = [self.contingency.sparkSession.createDataFrame(rows, "item string, value string"), self.contingency.agg(F.lit("cells").alias("item"), F.count("*").cast("string").alias("value"))]
        for k, df in self.results.items():
            both = df.agg(F.count("*").alias("pairs"), F.count_if("signal").alias("positive"))
            parts.append(both.selectExpr(f"stack(2, '{k}_pairs', CAST(pairs AS STRING), '{k}_positive', CAST(positive AS STRING)) AS (item, value)"))
        if self.validated is not None:
            n = self.validated.agg(*[F.count_if(F.col("validation_status") == s).alias(s) for s in ("KNOWN", "POTENTIALLY_NEW", "NO_LABEL")])
            parts.append(n.selectExpr("stack(3, 'KNOWN', CAST(KNOWN AS STRING), 'POTENTIALLY_NEW', CAST(POTENTIALLY_NEW AS STRING), 'NO_LABEL', CAST(NO_LABEL AS STRING)) AS (item, value)"))
        if self.launch is not None:
            parts.append(self.launch.select(F.lit("launch_risk").alias("item"), F.col("risk").alias("value")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def write(self, path: str, kind: str = "parquet") -> None:
        from ..sources.reports import sink

        sink(self.signals, f"{path}/signals", kind)
        sink(self.ranked, f"{path}/ranked", kind)


def analyse(facts: DataFrame, config: AnalysisConfig, marts: Marts | None = None, label_texts: DataFrame | None = None, approvals: DataFrame | None = None, kept: Kept | None = None) -> Analysis:
    """The contingency table and what the models make of it are small tables of their own, written when this is called and read
    by every frame of the analysis; an empty table gives empty frames. With ``kept`` they stay for whoever asks the same again.
    ``notes`` tells the seconds that each took."""
    began = time.monotonic()
    make = lambda: C.contingency(facts, config.drug, Predicate.parse(config.where), marts, config.min_a)
    ct = settle(make()) if kept is None else kept.table(make, "cells", config.drug, config.where, config.min_a)
    cells_s = time.monotonic() - began
    results = tables(ct, config, kept)
    notes = {"cells_s": round(cells_s, 3), "models_s": round(time.monotonic() - began - cells_s, 3)}
    signals = L.union_positive(**results)
    ranked = L.confidence(ct, **results)
    validated = None
    if label_texts is not None:
        terms = signals.select(F.col("drug").alias("drug_name"), "pt").distinct().withColumn("positive", F.lit(True))
        validated = L.validate(terms, label_texts)
        ranked = ranked.join(validated.select(F.col("drug_name").alias("drug"), "pt", "validation_status"), ["drug", "pt"], "left")
    launch = None
    if approvals is not None:
        drugs = facts.sparkSession.createDataFrame([(config.drug,)], "drug_name string")
        known = approvals if config.approval_year is None else facts.sparkSession.createDataFrame([(config.drug, config.approval_year)], "drug_name string, year int")
        launch = B.check(facts, drugs, known)
    return Analysis(config, ct, results, signals, ranked, launch, validated, notes)
