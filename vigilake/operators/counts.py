"""Count tables of products and events: conversion, expected counts, time slices, regressions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import drop_settled, settle


def convert(counts: DataFrame, margin_threshold: int = 1) -> DataFrame:
    """counts: (name, AE, count). The long form with margins, all taken before either is thresholded; n is the sum of events."""
    cell = counts.groupBy("name", "AE").agg(F.sum("count").alias("events"))
    rows = cell.groupBy("name").agg(F.sum("events").alias("product_aes"))
    cols = cell.groupBy("AE").agg(F.sum("events").alias("count_across_brands"))
    kept = cell.join(rows.where(F.col("product_aes") >= margin_threshold), "name").join(cols.where(F.col("count_across_brands") >= margin_threshold), "AE")
    total = kept.agg(F.sum("events").alias("n"))
    return kept.where("events > 0").crossJoin(F.broadcast(total)).select(F.col("name").alias("drug"), F.col("AE").alias("pt"), F.col("events").alias("a"), (F.col("product_aes") - F.col("events")).alias("b"), (F.col("count_across_brands") - F.col("events")).alias("c"), (F.col("n") - F.col("product_aes") - F.col("count_across_brands") + F.col("events")).alias("d"), "n")  # one row


def convert_wide(counts: DataFrame, events: list[str]) -> DataFrame:
    """The matrix form over a known list of events; missing cells are 0."""
    return counts.groupBy("name").pivot("AE", events).agg(F.sum("count")).na.fill(0)


def convert_binary(counts: DataFrame, events: list[str], expand_counts: bool = True) -> DataFrame:
    """One row for each counted report: its product and a 0/1 column for each of a known list of events."""
    rows = counts.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))) if expand_counts else counts.withColumn("i", F.lit(1))
    return rows.select("name", "i", *[F.when(F.col("AE") == e, 1).otherwise(0).alias(e) for e in events])


def convert_multi_item(rows: DataFrame, min_threshold: int = 3, sep: str = "|") -> DataFrame:
    """rows: (id, items, AE), items a list of co-products. Counts of every non-empty subset of items with each event (a null
    event is one of its own), from the threshold on.

    Level by level, whatever the lists' lengths: a row carries its frequent subsets of k items, each grown by a later item,
    since no subset is more frequent than what it holds. Equal lists fold before they grow. A level is a table of its own."""
    x = rows.withColumn("items", F.array_sort(F.array_distinct(F.filter("items", lambda v: v.isNotNull() & (v != ""))))).where("size(items) > 0")
    grown = x.groupBy("items", "AE").agg(F.count("*").alias("n")).withColumn("have", F.array().cast("array<string>"))
    levels, was = [], []
    while True:
        later = F.filter("items", lambda v: (F.size("have") == 0) | (v > F.try_element_at(F.col("have"), F.lit(-1))))
        tried = settle(grown.select("items", "AE", "n", F.explode(F.transform(later, lambda v: F.concat("have", F.array(v)))).alias("have")))
        levels.append(settle(tried.groupBy("have", "AE").agg(F.sum("n").alias("count")).where(F.col("count") >= min_threshold)))
        drop_settled(*was)
        was = [tried]
        if not levels[-1].limit(1).count():
            drop_settled(tried)
            break
        keep = levels[-1].select(F.col("have").alias("kept"), F.col("AE").alias("of"))
        grown = tried.join(keep, (F.col("have") == F.col("kept")) & F.col("AE").eqNullSafe(F.col("of")), "left_semi")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select(F.array_join("have", sep).alias("name"), "AE", "count")


def periods(rows: DataFrame, unit: str, date: str = "date") -> DataFrame:
    """Ends of all periods between the first and last date; ``unit`` is month, quarter or year."""
    step = {"month": "1 month", "quarter": "3 months", "year": "1 year"}[unit]
    r = rows.agg(F.date_trunc(unit, F.min(date)).alias("lo"), F.date_trunc(unit, F.max(date)).alias("hi"))
    return r.select(F.explode(F.sequence("lo", "hi", F.expr(f"interval {step}"))).alias("start")).select("start", F.date_sub(F.expr(f"cast(start + interval {step} as date)"), 1).alias("slice_end"))


def slices(rows: DataFrame, unit: str, cumulative: bool = True, gaps: bool = True, date: str = "date") -> DataFrame:
    """rows: (name, AE, count, date). Counts by period end, of the period or up to its end; periods without rows give null counts.

    Cumulative counts are window sums over per-period sums: rows are read once, not once a period."""
    own = rows.groupBy(F.date_trunc(unit, date).alias("start"), "name", "AE").agg(F.sum("count").alias("count"))
    ends = periods(rows, unit, date)
    if not cumulative:
        return ends.join(own, "start", "left" if gaps else "inner").select("slice_end", "name", "AE", "count")
    pairs = own.groupBy("name", "AE").agg(F.min("start").alias("since"))
    # a pair has a row from its first period on
    grid = pairs.join(F.broadcast(ends), F.col("start") >= F.col("since")).select("start", "slice_end", "name", "AE")  # one row a period
    run = W.partitionBy("name", "AE").orderBy("start").rowsBetween(W.unboundedPreceding, W.currentRow)
    return grid.join(own, ["start", "name", "AE"], "left").withColumn("count", F.sum(F.coalesce("count", F.lit(0))).over(run)).select("slice_end", "name", "AE", "count")


def longitudinal(rows: DataFrame, model, unit: str = "quarter", cumulative: bool = True, date: str = "date") -> DataFrame:
    """A model over every slice in one plan: each slice's pairs are named apart, so windows and margins stay within it."""
    cut = slices(rows, unit, cumulative, gaps=False, date=date).where("count > 0")
    key = ["slice_end"]
    prod = cut.groupBy(*key, "name").agg(F.sum("count").alias("p"))
    ev = cut.groupBy(*key, "AE").agg(F.sum("count").alias("e"))
    tot = cut.groupBy(*key).agg(F.sum("count").alias("n"))
    x = cut.join(prod, [*key, "name"]).join(ev, [*key, "AE"]).join(F.broadcast(tot), key)
    ct = x.select(F.concat_ws("@", F.col("slice_end").cast("string"), "name").alias("drug"), F.col("AE").alias("pt"), F.col("count").alias("a"), (F.col("p") - F.col("count")).alias("b"), (F.col("e") - F.col("count")).alias("c"), (F.col("n") - F.col("p") - F.col("e") + F.col("count")).alias("d"), "n")
    out = model(ct)
    return out.withColumn("slice_end", F.to_date(F.substring_index("drug", "@", 1))).withColumn("drug", F.expr("substring(drug, 12)"))


def irls(ct: DataFrame, alpha: float, steps: int = 25) -> np.ndarray:
    """(intercept, slope of log product margin, slope of log event margin) of a regression of a with a log link and variance
    mu + alpha mu^2; alpha 0 is Poisson.

    Cells fold to their different margins and counts once; a step aggregates nine sums of those."""
    x = ct.groupBy("a", (F.col("a") + F.col("b")).alias("r"), (F.col("a") + F.col("c")).alias("s")).agg(F.count("*").cast("double").alias("k"))
    x = x.select(F.col("a").cast("double").alias("y"), F.log(F.col("r").cast("double")).alias("u"), F.log(F.col("s").cast("double")).alias("v"), "k").persist()
    try:
        return _irls(x, alpha, steps)
    finally:
        x.unpersist()


def _irls(x: DataFrame, alpha: float, steps: int) -> np.ndarray:
    """x: (y, u, v, k), k how often a row counts."""
    m = x.agg(F.sum(F.col("y") * F.col("k")) / F.sum("k")).head()[0]
    beta = np.array([np.log(max(m or 1.0, 1e-9)), 0.0, 0.0])
    for _ in range(steps):
        mu = f"exp({beta[0]} + {beta[1]} * u + {beta[2]} * v)"
        w, z = f"(k * {mu} / (1 + {alpha} * {mu}))", f"(ln({mu}) + (y - {mu}) / {mu})"
        cols = {"1": "1.0", "u": "u", "v": "v"}
        names = [(p, q) for i, p in enumerate(cols) for q in list(cols)[i:]]
        got = x.agg(*[F.sum(F.expr(f"{w} * {cols[p]} * {cols[q]}")).alias(f"h{p}{q}") for p, q in names], *[F.sum(F.expr(f"{w} * {z} * {cols[p]}")).alias(f"g{p}") for p in cols]).head()
        h = np.array([[got[f"h{p}{q}"] if f"h{p}{q}" in got.asDict() else got[f"h{q}{p}"] for q in cols] for p in cols])
        new = np.linalg.lstsq(h, np.array([got[f"g{p}"] for p in cols]), rcond=None)[0]
        done = np.abs(new - beta).max() < 1e-10
        beta = new
        if done:
            break
    return beta


def expected(ct: DataFrame, method: str = "mantel-haentzel", alpha: float = 1.0) -> DataFrame:
    """Adds ``expected``: margins' product over n, or a Poisson or negative-binomial regression on log margins."""
    if method == "mantel-haentzel":
        return ct.withColumn("expected", (F.col("a") + F.col("b")) * (F.col("a") + F.col("c")) / F.col("n").cast("double"))
    b = irls(ct, 0.0 if method == "poisson" else alpha)
    return ct.withColumn("expected", F.exp(F.lit(float(b[0])) + F.lit(float(b[1])) * F.log((F.col("a") + F.col("b")).cast("double")) + F.lit(float(b[2])) * F.log((F.col("a") + F.col("c")).cast("double"))))


def dispersion(ct: DataFrame) -> DataFrame:
    """Auxiliary regression of Cameron and Trivedi without intercept: alpha, its 95% bounds, and whether counts are overdispersed."""
    fit = expected(ct, "poisson").select(F.col("a").cast("double").alias("y"), F.col("expected").alias("mu"))
    z = fit.withColumn("z", (F.pow(F.col("y") - F.col("mu"), 2) - F.col("y")) / F.col("mu"))
    s = z.agg(F.sum(F.col("z") * F.col("mu")).alias("zm"), F.sum(F.col("mu") ** 2).alias("mm"), F.sum(F.col("z") ** 2).alias("zz"), F.count("*").alias("k"))
    s = s.withColumn("alpha", F.col("zm") / F.col("mm")).withColumn("err", F.sqrt((F.col("zz") - F.col("alpha") * F.col("zm")) / (F.col("k") - 1) / F.col("mm")))
    return s.select("alpha", (F.col("alpha") - 1.959963985 * F.col("err")).alias("lb"), (F.col("alpha") + 1.959963985 * F.col("err")).alias("ub"), (F.col("alpha") - 1.959963985 * F.col("err") > 0).alias("dispersion"))


def descend(g: np.ndarray, c: np.ndarray, alpha: float, beta: np.ndarray | None = None, steps: int = 200, least: float | None = None) -> np.ndarray:
    """Coordinate descent on half b'gb - b'c + alpha |b|_1; ``least`` bounds coefficients from below."""
    beta = np.zeros(len(c)) if beta is None else beta.copy()
    for _ in range(steps):
        old = beta.copy()
        for k in range(len(beta)):
            if g[k, k] > 0:
                r = c[k] - g[k] @ beta + g[k, k] * beta[k]
                beta[k] = np.sign(r) * max(0.0, abs(r) - alpha) / g[k, k]
                if least is not None:
                    beta[k] = max(least, beta[k])
        if np.abs(beta - old).max(initial=0.0) < 1e-10:
            break
    return beta


def moments(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted covariances of centred columns, with y, and y's variance: what :func:`lasso` makes of its counts."""
    w = w / w.sum()
    xc, yc = x - w @ x, y - w @ y
    return (xc * w[:, None]).T @ xc, (xc * w[:, None]).T @ yc, float(w @ yc**2)


def angle_path(g: np.ndarray, c: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """(penalty, coefficients) at the knots of the lasso's path, by least angles: coefficients are linear in between.

    A column that the active ones explain wholly never enters."""
    beta, active = np.zeros(len(c)), []
    r = c.copy()
    free = [k for k in range(len(c)) if g[k, k] > 1e-12]
    knots = [(float(np.abs(c[free]).max(initial=0.0)), beta.copy())]
    if free:
        active = [max(free, key=lambda k: abs(c[k]))]
    for _ in range(8 * len(c)):
        level = float(np.abs(r[active]).max(initial=0.0)) if active else 0.0
        if level < 1e-12:
            break
        signs = np.sign(r[active])
        step = np.linalg.lstsq(g[np.ix_(active, active)], signs, rcond=None)[0]
        fall = g[:, active] @ step  # how fast each column's correlation falls while the level falls by one
        best, what = level, None
        for k in free:
            if k in active:
                continue
            if g[k, k] - g[k, active] @ np.linalg.lstsq(g[np.ix_(active, active)], g[active, k], rcond=None)[0] < 1e-10:
                continue
            for s in (1.0, -1.0):
                d = 1 - s * fall[k]
                if d > 1e-12 and 1e-12 < (t := (level - s * r[k]) / d) < best - 1e-12:
                    best, what = t, ("in", k)
        for at, k in enumerate(active):
            if step[at] and 1e-12 < (t := -beta[k] / step[at]) < best - 1e-12:
                best, what = t, ("out", k)
        beta[active] += best * step
        r = c - g @ beta
        if what and what[0] == "out":
            beta[what[1]] = 0.0
        knots.append((max(0.0, level - best), beta.copy()))
        if what is None:
            break
        active = [k for k in active if k != what[1]] + ([what[1]] if what[0] == "in" else [])
    return knots


def on_path(knots: list[tuple[float, np.ndarray]], alpha: float) -> np.ndarray:
    """The coefficients at a penalty."""
    for (a, x), (b, y) in zip(knots, knots[1:]):
        if b <= alpha <= a:
            return x + (y - x) * (a - alpha) / max(a - b, 1e-300)
    return knots[0][1] if alpha >= knots[0][0] else knots[-1][1]


def by_criterion(g: np.ndarray, c: np.ndarray, vy: float, n: float, criterion: str) -> np.ndarray:
    """The knot of the path of least information criterion ("aic" or "bic"); the noise is that of the full fit."""
    rss = lambda b: n * max(0.0, vy - 2 * b @ c + b @ g @ b)
    knots = angle_path(g, c)
    full = np.linalg.lstsq(g, c, rcond=None)[0]
    noise = max(rss(full) / max(1.0, n - np.linalg.matrix_rank(g) - 1), 1e-12)
    price = 2.0 if criterion == "aic" else np.log(n)
    return min((k for _, k in knots), key=lambda b: n * np.log(2 * np.pi * noise) + rss(b) / noise + price * np.count_nonzero(np.abs(b) > 1e-12))


def negative_binomial(x: np.ndarray, y: np.ndarray, w: np.ndarray, alpha: float, dispersion: float, steps: int = 100) -> np.ndarray:
    """L1-penalised negative-binomial regression with a log link and no intercept: weighted quadratic steps, each by coordinate
    descent, halved until the mean likelihood less the penalty rises. Negative coefficients are given as 0."""
    w = w / w.sum()

    def cost(b):
        mu = np.exp(np.clip(x @ b, -30, 30))
        return -(w @ (y * np.log(dispersion * mu / (1 + dispersion * mu)) - np.log1p(dispersion * mu) / dispersion)) + alpha * np.abs(b).sum()

    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        mu = np.exp(np.clip(x @ beta, -30, 30))
        v = w * mu / (1 + dispersion * mu)
        z = x @ beta + (y - mu) / mu
        new = descend((x * v[:, None]).T @ x, (x * v[:, None]).T @ z, alpha, beta)
        t = 1.0
        while t > 1e-6 and cost(beta + t * (new - beta)) > cost(beta):
            t /= 2
        if t <= 1e-6 or np.abs(t * (new - beta)).max() < 1e-9:
            break
        beta = beta + t * (new - beta)
    return np.clip(beta, 0, None)


#: Products whose co-reports the driver and every task hold as a matrix.
MOST_PRODUCTS = 1000
#: Chances that a report stands at most 0, 1, 2, ... times in a resample: the Poisson distribution of mean 1.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(10)])


def weights(num_bootstrap: int, seed: int) -> list:
    """How often a report counts: once, and in each resample by a seeded hash of its id, wherever its rows are."""
    def drawn(k: int):
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(1 << 40)) / float(1 << 40)
        out = F.lit(len(POISSON))
        for times in range(len(POISSON) - 1, -1, -1):
            out = F.when(u < float(POISSON[times]), times).otherwise(out)
        return out

    return [F.lit(1), *[drawn(k) for k in range(num_bootstrap)]]


def held_together(rows: DataFrame) -> DataFrame:
    """(id, names, AEs) of rows (id, name, AE): an id's different products and events as lists."""
    return rows.groupBy("id").agg(F.collect_set("name").alias("names"), F.collect_set("AE").alias("AEs"))


def co_reports(reports: DataFrame, products: list[str], events: list[str], num_bootstrap: int, seed: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """(reports (b), reports with products p and q (b, p, q), and a frame (AE, reports with it, (product, reports with both))),
    each as often as the reports and every resample have them; b is the resample, 0 the reports themselves.

    reports: (id, names, AEs), a row for each id, neither list with repeats. A report's few products and events are paired
    where they lie and counts alone are shuffled: no report becomes a row of a matrix."""
    spark, w = reports.sparkSession, weights(num_bootstrap, seed)
    names = [f"w{k}" for k in range(len(w))]
    count = [F.sum(x).cast("long").alias(x) for x in names]
    place = {p: k for k, p in enumerate(products)}
    at = F.create_map(*[F.lit(x) for item in place.items() for x in item]) if place else F.create_map().cast("map<string, int>")
    mine = F.array_sort(F.transform(F.filter("names", lambda v: v.isin(products)), lambda v: at[v]))
    # weights are drawn once a report: left to the plan, they would be drawn anew for each of its pairs
    drawn = [x.cast("tinyint").alias(k) for k, x in zip(names, w, strict=True)]
    told = settle(reports.select(mine.alias("at"), F.filter("AEs", lambda v: v.isin(events)).alias("AEs"), *drawn))
    n = np.array([v or 0 for v in told.agg(*count).head()], dtype=float)
    both = np.zeros((len(w), len(products), len(products)))
    pairs = told.select("at", F.posexplode("at").alias("i", "p"), *names).select("p", F.explode(F.slice("at", F.col("i") + 1, F.size("at"))).alias("q"), *names)
    for r in pairs.groupBy("p", "q").agg(*count).collect():  # MOST_PRODUCTS a side at most
        both[:, r["p"], r["q"]] = both[:, r["q"], r["p"]] = r[2:]
    has = told.select("at", F.explode("AEs").alias("AE"), *names)
    alone = has.groupBy("AE").agg(F.array(*count).alias("n"))
    met = has.select("AE", F.explode("at").alias("p"), *names).groupBy("AE", "p").agg(*count)
    met = met.groupBy("AE").agg(F.collect_list(F.struct("p", F.array(*names).alias("n"))).alias("met"))
    return n, both, spark.createDataFrame([(e,) for e in events], "AE string").join(alone, "AE", "left").join(met, "AE", "left")


def lasso(rows: DataFrame, products: list[str], events: list[str], alpha: float = 0.5, min_events: int = 3, num_bootstrap: int = 10, ci: float = 95, seed: int = 1, variant: str = "descent", criterion: str = "bic", dispersion: float = 1.0) -> DataFrame:
    """rows: (id, name, AE), an id's products and events, or (id, names, AEs), a row for each id. For each event an L1 regression on product indicators, with
    percentile bounds from seeded resamples; events under the floor give zeros. Every id counts: one with none of the
    listed products is a row of zeros.

    ``variant``: descent or lars at the penalty ``alpha`` (the same minimum, found in two ways), ic at the penalty of least
    ``criterion``, or nb, a negative-binomial regression, which has no bounds.

    The regressions need no more than how many reports have two products, or a product and an event: Spark counts these
    (:func:`co_reports`), for all resamples at once, and each event is then a row of its own, solved where it lies. ``nb``
    alone reads patterns of indicators, folded with counts."""
    if variant not in ("descent", "lars", "ic", "nb"):
        raise ValueError("variant must be descent, lars, ic or nb")
    if len(products) > MOST_PRODUCTS:
        raise ValueError(f"more than {MOST_PRODUCTS} products")
    schema = "drug string, pt string, events long, coefficient double, ci_low double, ci_high double"
    reports = rows if {"names", "AEs"} <= set(rows.columns) else held_together(rows)
    if variant == "nb":
        return _negative_binomials(reports, products, events, alpha, min_events, dispersion, schema)
    n, both, asked = co_reports(reports, products, events, num_bootstrap, seed)
    share = np.divide(np.diagonal(both, axis1=1, axis2=2), np.maximum(n, 1)[:, None])
    cov = both / np.maximum(n, 1)[:, None, None] - share[:, :, None] * share[:, None, :]

    def solved(k: int, with_: np.ndarray, all_: float) -> np.ndarray:
        y = all_ / max(n[k], 1)
        c, vy = with_ / max(n[k], 1) - share[k] * y, y * (1 - y)
        if variant == "ic":
            return by_criterion(cov[k], c, vy, n[k], criterion)
        return on_path(angle_path(cov[k], c), alpha) if variant == "lars" else descend(cov[k], c, alpha)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ae, all_, met in zip(pdf["AE"], pdf["n"], pdf["met"], strict=True):
                counts = np.zeros(len(n)) if all_ is None else np.asarray(all_, dtype=float)
                out = pd.DataFrame({"drug": products, "pt": ae, "events": int(counts[0]), "coefficient": 0.0, "ci_low": 0.0, "ci_high": 0.0})
                if counts[0] >= min_events:
                    with_ = np.zeros((len(n), len(products)))
                    for m in met if met is not None else []:
                        with_[:, m["p"]] = m["n"]
                    found = np.array([solved(k, with_[k], counts[k]) for k in range(len(n))])
                    out["coefficient"] = found[0]
                    if num_bootstrap:
                        out["ci_low"], out["ci_high"] = np.percentile(found[1:], (100 - ci) / 2, axis=0), np.percentile(found[1:], 100 - (100 - ci) / 2, axis=0)
                yield out

    return asked.select("AE", "n", "met").mapInPandas(fit, schema)


def _negative_binomials(reports: DataFrame, products: list[str], events: list[str], alpha: float, min_events: int, dispersion: float, schema: str) -> DataFrame:
    items = reports.select(F.array_sort(F.filter("names", lambda x: x.isin(products))).alias("items"), F.col("AEs").alias("aes"))
    patterns = items.select("items", F.explode(F.array(*[F.struct(F.lit(e).alias("AE"), F.array_contains("aes", e).cast("int").alias("y")) for e in events])).alias("x")).groupBy(F.col("x.AE").alias("AE"), "items", F.col("x.y").alias("y")).agg(F.count("*").alias("w"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(key=pdf["items"].map(lambda v: "|".join(v))).sort_values(["key", "y"])
        n_ev = int((pdf["y"] * pdf["w"]).sum())
        out = pd.DataFrame({"drug": products, "pt": pdf["AE"].iloc[0], "events": n_ev, "coefficient": 0.0, "ci_low": 0.0, "ci_high": 0.0})
        if n_ev >= min_events:
            x = np.array([[float(p in v) for p in products] for v in pdf["items"].map(set)])
            out["coefficient"] = negative_binomial(x, pdf["y"].to_numpy(float), pdf["w"].to_numpy(float), alpha, dispersion)
        return out

    return patterns.groupBy("AE").applyInPandas(fit, schema)
