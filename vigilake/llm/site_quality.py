"""Document quality by hierarchical empirical Bayes.

A logistic classifier on text statistics gives each document's evidence. Hosts, and paths below them, gather that
evidence by grouped aggregation; a site's rate is shrunk toward its parent's with a strength fitted to how much sites
differ, so sparse sites lean on global priors. Document and site evidence then add up on the log-odds scale.

A labelled document vouches for its site with its label, any other with the classifier's probability; for itself none does:
what a document's score takes from its path and host is what the others there say (``host_posterior`` is the host's own).

Defined results: null or empty texts are classified by their zero statistics; a null host or path is a site of its
own; with no usable labels every document scores the prior and is kept; repeated rows count as often as they stand, rows of
labels that repeat an id once, with their least label; texts of any length are read whole; other columns are not read; an
empty table gives an empty table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, discard, sampled_rows, settle
from .quality_rules import FEATURES, feature, with_statistics

#: Labelled rows of a class at most, the weight of a site's evidence against a document's own, and the score that keeps.
PER_CLASS, SITE_WEIGHT, KEEP = 6000, 0.5, 0.5


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """Logistic regression by Newton steps on a bounded sample, classes weighed to the label rate of all rows."""
    usable = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("__y"))
    rate = usable.agg(F.avg("__y")).head()[0]
    rows = with_statistics(sampled_rows(docs, bounded_sample(usable, "__y", PER_CLASS), 2 * PER_CLASS))
    got = rows.select("doc_id", "__y", *[feature(f).alias(f) for f in FEATURES]).toPandas().sort_values("doc_id")
    x, y = spread(got[list(FEATURES)].to_numpy(float)), got["__y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return {"beta": [0.0] * (1 + x.shape[1]), "mean": [0.0] * x.shape[1], "sd": [1.0] * x.shape[1], "prior": float(rate if rate is not None else 1.0)}
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    weight = np.where(y == 1, rate / (y == 1).mean(), (1 - rate) / (y == 0).mean())
    beta = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(len(beta))
        beta += np.clip(np.linalg.solve(h, z.T @ (weight * (y - p)) - beta), -2, 2)
    return {"beta": beta.tolist(), "mean": mean.tolist(), "sd": sd.tolist(), "prior": float(rate)}


def spread(x: np.ndarray) -> np.ndarray:
    """The features and their square roots: shares matter most near 0."""
    return np.column_stack([x, np.sqrt(x)])


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def evidence(model: dict) -> Column:
    """The classifier as one column expression."""
    x = [feature(f) for f in FEATURES]
    x += [F.sqrt(f) for f in x]
    out = F.lit(model["beta"][0])
    for f, b, m, s in zip(x, model["beta"][1:], model["mean"], model["sd"]):
        out = out + (f - F.lit(m)) * F.lit(b / s)
    return 1 / (1 + F.exp(-F.least(F.greatest(out, F.lit(-30.0)), F.lit(30.0))))


def strength(sites: DataFrame, parent: str) -> float:
    """Prior strength by moments: how far site rates spread around their parents' beyond binomial noise. One row."""
    m = sites.agg(
        F.sum("n").alias("n"), F.count("*").alias("k"),
        F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col(parent)) ** 2).alias("q"),
        F.sum(F.col(parent) * (1 - F.col(parent))).alias("v"),
        F.sum(F.col("n") * F.col(parent) * (1 - F.col(parent))).alias("nv"),
    ).head()
    if not m["n"] or not m["nv"]:
        return 100.0
    between = max(0.0, m["q"] - m["v"]) / m["nv"]  # variance of sites, as a share of p (1 - p)
    return float(min(1e4, max(1.0, 1 / between - 1))) if between > 0 else 1e4


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, keep: float = KEEP) -> DataFrame:
    """(doc_id, doc_score, host_posterior, path_posterior, score, kept) of every row.

    ``host`` and ``path`` name a document's site; a path belongs to its host."""
    model = learn(docs, labels)
    prior = min(max(model["prior"], 1e-3), 1 - 1e-3)
    usable = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    base = docs.select("doc_id", "text", host.cast("string").alias("host"), path.cast("string").alias("path"))
    rows = with_statistics(base).select("doc_id", "host", "path", evidence(model).alias("p")).join(usable, "doc_id", "left")
    rows = settle(rows.select("doc_id", "host", "path", "p", F.coalesce("y", "p").alias("e")))
    out = settle(posteriors(rows, prior, keep))
    discard(rows)
    return out


def posteriors(rows: DataFrame, prior: float, keep: float = KEEP) -> DataFrame:
    """rows: (doc_id, host, path, p, e), a document's probability and its evidence. What :func:`score` returns."""
    # a path's sums hold all its host's: one aggregation of the documents serves both levels
    paths = settle(rows.groupBy("host", "path").agg(F.sum("e").alias("s"), F.count("*").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    whole = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).head()
    mean = min(max((whole["s"] or 0.0) / max(1, whole["n"] or 0), 1e-3), 1 - 1e-3) if whole["n"] else prior
    a = strength(hosts.withColumn("up", F.lit(mean)), "up")
    hosts = hosts.select("host", F.col("s").alias("host_s"), F.col("n").alias("host_n"), ((F.col("s") + a * mean) / (F.col("n") + a)).alias("host_posterior"))
    joined = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    b = strength(joined, "host_posterior")
    sites = joined.select(F.col("host").alias("h"), F.col("path").alias("q"), "s", "n", "host_s", "host_n", "host_posterior")
    out = rows.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    # a document does not vouch for itself, neither in its path nor in its host
    host_others = (F.col("host_s") - F.col("e") + a * mean) / (F.col("host_n") - 1 + a)
    others = (F.col("s") - F.col("e") + b * host_others) / (F.col("n") - 1 + b)
    out = out.withColumn("path_posterior", others)
    total = logit(F.col("p")) + SITE_WEIGHT * (logit(F.col("path_posterior")) - logit(F.lit(mean)))
    out = out.withColumn("score", 1 / (1 + F.exp(-total)))
    return out.select("doc_id", F.col("p").alias("doc_score"), "host_posterior", "path_posterior", "score", (F.col("score") >= keep).alias("kept"))
