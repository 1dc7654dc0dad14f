"""Disproportionality statistics on contingency tables, as columns of the same lazy plan.

Every function takes rows (drug, pt, a, b, c, d, n) of any number of drugs; what ranks or averages does so within a
drug. Estimates, variances and normal tails are arithmetic that stays in generated code; only the mixture quantile and
Fisher's tail go through Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import special as S
from .scan import Ranges

EPS = 1e-7
Z = 1.959963985
# The prior of the gamma-Poisson mixture (alpha1, beta1, alpha2, beta2, weight).
PRIOR = (0.2041, 0.05816, 1.415, 1.838, 0.0969)


def prepared(ct: DataFrame, min_events: int = 3) -> DataFrame:
    """Adds n11, n1j, ni1, nn, expected and the corrected cells."""
    out = ct.where(F.col("a") >= min_events).withColumns({
        "n11": F.col("a").cast("double"), "n1j": (F.col("a") + F.col("b")).cast("double"), "ni1": (F.col("a") + F.col("c")).cast("double"), "nn": F.col("n").cast("double"),
    })
    out = out.withColumns({"expected": F.expr("n1j * ni1 / nn"), "n10": F.expr(f"n1j - n11 + {EPS}"), "n01": F.expr(f"ni1 - n11 + {EPS}")})
    return out.withColumn("n00", F.expr(f"nn - (n11 + n10 + n01) + {EPS}"))


def log_prr() -> tuple[str, str]:
    return "ln((n11 / (n11 + n10)) / (n01 / (n01 + n00)))", "1.0 / n11 - 1.0 / (n11 + n10) + 1.0 / n01 - 1.0 / (n01 + n00)"


def log_ror() -> tuple[str, str]:
    return "ln(n11 * n00 / (n10 * n01))", "1.0 / n11 + 1.0 / n10 + 1.0 / n01 + 1.0 / n00"


def ratio(ct: DataFrame, estimate: tuple[str, str], name: str, min_events: int = 3, relative_risk: float = 1.0) -> DataFrame:
    """Adds the estimate, its log's standard error and lower bound, and the upper-tail p-value."""
    x = prepared(ct, min_events).withColumns({"lg": F.expr(estimate[0]), "se": F.sqrt(F.expr(estimate[1]))})
    x = x.withColumn("z", (F.col("lg") - F.lit(float(np.log(relative_risk)))) / F.col("se"))
    p = F.least(F.greatest(F.expr(S.normal_upper("z")), F.lit(0.0)), F.lit(1.0))
    return x.withColumns({name: F.exp("lg"), "ci_low": F.exp(F.col("lg") - Z * F.col("se")), "p_value": p})


@F.pandas_udf(T.DoubleType())
def lbe_power(m: pd.Series) -> pd.Series:
    return m.map({k: S.lbe_power(int(k)) if k > 400 else 1.0 for k in m.unique()})


def pi0(ps: DataFrame, p: str = "p_value") -> DataFrame:
    """(drug, m, k, power, pi0), a row for each drug: the estimated share of its null cells.

    Cells only pass through aggregates; Python sees one number of each drug."""
    q = f"(2.0 * least({p}, 1.0 - {p}))"
    sizes = ps.groupBy("drug").agg(F.count("*").alias("m"), F.count_if(F.col(p) <= 0.5).alias("k")).withColumn("power", lbe_power("m"))
    # q = 1 says nothing but null: its -log is unbounded
    value = F.expr(f"CASE WHEN {q} >= 1.0 THEN CAST('Infinity' AS DOUBLE) ELSE pow(-ln(1.0 - {q}), power) END")
    means = ps.select("drug", p).join(sizes.select("drug", "power"), "drug").groupBy("drug").agg(F.avg(value).alias("v"))
    return sizes.join(means, "drug").withColumn("pi0", F.least(F.lit(1.0), F.col("v") / F.exp(F.expr(S.log_gamma("(power + 1.0)"))))).drop("v")


def power_text(m: str) -> str:
    """SQL text for :func:`special.lbe_power`: 1 up to 400 cells, where nothing is solved, else by halving."""
    step = f"CASE WHEN {S.log_gamma('(s.lo + s.hi + 1.0)')} - 2.0 * {S.log_gamma('((s.lo + s.hi) / 2.0 + 1.0)')} < ln(1.0 + {m} * 0.0025) THEN named_struct('lo', (s.lo + s.hi) / 2.0, 'hi', s.hi) ELSE named_struct('lo', s.lo, 'hi', (s.lo + s.hi) / 2.0) END"
    start = "named_struct('lo', CAST(1.0 AS DOUBLE), 'hi', CAST(64.0 AS DOUBLE))"
    return f"CASE WHEN {m} <= 400 THEN CAST(1.0 AS DOUBLE) ELSE aggregate(sequence(1, 60), {start}, (s, k) -> {step}, s -> (s.lo + s.hi) / 2.0) END"


def with_pi0(ps: DataFrame, p: str = "p_value") -> DataFrame:
    """Adds m, k, power and pi0 of each row's drug, in windows over the drug: the rows are read once and shuffled once."""
    every = W.partitionBy("drug")
    x = ps.withColumns({"m": F.count("*").over(every), "k": F.count_if(F.col(p) <= 0.5).over(every), "__q": F.expr(f"2.0 * least({p}, 1.0 - {p})")})
    x = x.withColumn("power", F.expr(power_text("m")))
    # q = 1 says nothing but null: its -log is unbounded
    value = F.expr("CASE WHEN __q >= 1.0 THEN CAST('Infinity' AS DOUBLE) WHEN m <= 400 THEN -ln(1.0 - __q) ELSE pow(-ln(1.0 - __q), power) END")
    x = x.withColumn("__v", F.avg(value).over(every))
    return x.withColumn("pi0", F.least(F.lit(1.0), F.when(F.col("m") <= 400, F.col("__v")).otherwise(F.col("__v") / F.exp(F.expr(S.log_gamma("(power + 1.0)")))))).drop("__q", "__v")


def lbe(ps: DataFrame, p: str = "p_value", fdr_level: float = 0.05, confidence: float = 0.95) -> DataFrame:
    """The whole location-based estimate of each row's drug: adds m, power, pi0, its standard error bound and upper bound,
    q-values, and whether a row is significant at ``fdr_level``.

    From the largest p-value down, a q-value is the least of pi0 m p / (rank - 1) so far, the last of all divided by m; equal
    p-values take that of their mean rank, rounded down."""
    x = with_pi0(ps, p).withColumn("i", F.row_number().over(W.partitionBy("drug").orderBy(p, "pt")))
    raw = F.try_divide(F.col("pi0") * F.col("m") * F.col(p), F.when(F.col("i") == F.col("m"), F.col("m")).otherwise(F.col("i") - 1))
    down = W.partitionBy("drug").orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, W.currentRow)
    ties = W.partitionBy("drug", p)
    x = x.withColumn("q", F.min(raw).over(down))
    place = F.floor((F.min("i").over(ties) + F.max("i").over(ties)) / 2)
    x = x.withColumn("place", place).withColumn("qvalue", F.max(F.when(F.col("i") == F.col("place"), F.col("q"))).over(ties))
    spread = F.sqrt((F.exp(F.expr(S.log_gamma("(2.0 * power + 1.0)")) - 2 * F.expr(S.log_gamma("(power + 1.0)"))) - 1) / F.col("m"))
    x = x.withColumn("sd_bound", spread)
    z = S.normal_quantile(confidence)
    return x.withColumns({"pi0_upper": F.least(F.lit(1.0), F.col("pi0") + z * F.col("sd_bound")), "significant": F.col("qvalue") <= fdr_level}).drop("i", "q", "place", "k")


def lbe_family(ps: DataFrame, p: str = "p_value", fdr_level: float = 0.05, confidence: float = 0.95, ranges: int | None = None) -> DataFrame:
    """:func:`lbe` for families too large for a window: all cells of all drugs, say. Ranks, ties and the running minimum are
    scans over ranges of p-values; a family's own numbers are a row of :func:`pi0`."""
    x = Ranges(ps, "drug", p, "pt", ranges=ranges)
    own = pi0(x.rows.select("drug", p), p).select(F.col("drug").alias("__d"), "power", "pi0")
    x.rows = x.rows.join(own, F.col("drug").eqNullSafe(F.col("__d"))).drop("__d")
    raw = F.try_divide(F.col("pi0") * F.col("m") * F.col(p), F.when(F.col("i") == F.col("m"), F.col("m")).otherwise(F.col("i") - 1))
    x.running("min", raw, "q", backwards=True)
    x.over_ties(lo=("min", F.col("i")), hi=("max", F.col("i")))
    x.over_ties(qvalue=("max", F.when(F.col("i") == F.floor((F.col("lo") + F.col("hi")) / 2), F.col("q"))))
    out = x.done().drop("q", "lo", "hi", "i")
    spread = F.sqrt((F.exp(F.expr(S.log_gamma("(2.0 * power + 1.0)")) - 2 * F.expr(S.log_gamma("(power + 1.0)"))) - 1) / F.col("m"))
    out = out.withColumn("sd_bound", spread)
    return out.withColumns({"pi0_upper": F.least(F.lit(1.0), F.col("pi0") + S.normal_quantile(confidence) * F.col("sd_bound")), "significant": F.col("qvalue") <= fdr_level})


def posterior_errors_family(x: DataFrame, p: str = "p_null", ranges: int | None = None) -> DataFrame:
    """:func:`posterior_errors` for families too large for a window; adds ``mean_rank``, the average place of equal
    probabilities, and ``score``, 1 - p over the largest such of the family."""
    scan = Ranges(x.withColumn("__null", F.round(p, 12)), "drug", "__null", "pt", ranges=ranges)
    scan.running("sum", F.col(p), "cum").running("max", 1 - F.col(p), "top").running("max", F.col("cum"), "tot", backwards=True)
    scan.running("max", F.col("top"), "best", backwards=True)
    scan.over_ties(lo=("min", F.col("i")), hi=("max", F.col("i")))
    hit, true_all = F.col("i") - F.col("cum"), F.col("m") - F.col("tot")
    return scan.done().withColumns({
        "fdr": F.col("cum") / F.col("i"), "fnr": F.try_divide(true_all - hit, F.col("m") - F.col("i")), "se": F.try_divide(hit, true_all), "sp": F.try_divide(F.col("tot") - F.col("cum"), F.col("tot")),
        "mean_rank": (F.col("lo") + F.col("hi")) / 2, "score": F.try_divide(1 - F.col(p), F.greatest("best", "top")),
    }).withColumnRenamed("i", "rk").drop("__null", "cum", "m", "tot", "top", "best", "lo", "hi")


def with_fdr(ps: DataFrame, p: str = "p_value", legacy_order: bool = False) -> DataFrame:
    """Adds ``fdr``, aligned with its row. ``legacy_order`` gives rows by descending a the sorted values in turn instead."""
    x = with_pi0(ps, p).withColumn("i", F.row_number().over(W.partitionBy("drug").orderBy(p, "pt")))
    j = F.col("i") - 1
    late = F.try_divide(F.col("pi0") * F.col("m"), 2.0 * j) + 1 - F.try_divide(F.col("k").cast("double"), j)
    fdr = F.when(F.col("i") <= F.col("k"), F.col("pi0") * F.col(p) * F.col("m") / F.col("i")).otherwise(late)
    x = x.withColumn("fdr", F.least(F.lit(1.0), fdr))
    if legacy_order:
        turn = F.row_number().over(W.partitionBy("drug").orderBy(F.desc("a"), "pt"))
        values = x.select("drug", F.col("i").alias("turn"), F.col("fdr"))
        x = x.drop("fdr").withColumn("turn", turn).join(values, ["drug", "turn"]).drop("turn")
    return x.drop("i", "m", "k", "power")


def ratio_table(name: str, decision_thres: float = 0.05) -> list:
    """The columns of a ratio's table of results."""
    return ["drug", "pt", "a", "expected", "p_value", name, "ci_low", F.col("n1j").alias("product_margin"), F.col("ni1").alias("event_margin"), "fdr", (F.col("fdr") < decision_thres).alias("signal")]


def prr(ct: DataFrame, min_events: int = 3, decision_thres: float = 0.05, **how) -> DataFrame:
    return with_fdr(ratio(ct, log_prr(), "prr", min_events), **how).select(*ratio_table("prr", decision_thres))


def ror(ct: DataFrame, min_events: int = 3, decision_thres: float = 0.05, **how) -> DataFrame:
    return with_fdr(ratio(ct, log_ror(), "ror", min_events), **how).select(*ratio_table("ror", decision_thres))


@F.pandas_udf(T.DoubleType())
def fisher_upper(a: pd.Series, n1j: pd.Series, ni1: pd.Series, n: pd.Series, mid: pd.Series) -> pd.Series:
    """P(X >= a) of the hypergeometric, less half of P(X = a) if ``mid``."""
    return pd.Series(S.hypergeometric_upper(*(x.to_numpy(float) for x in (a, n1j, ni1, n)), mid.to_numpy(bool)))


def rfet(ct: DataFrame, min_events: int = 3, decision_thres: float = 0.05, mid_p: bool = False) -> DataFrame:
    """Fisher's exact test of the reporting table, upper tail."""
    x = prepared(ct, min_events).withColumn("p_value", fisher_upper("n11", "n1j", "ni1", "nn", F.lit(mid_p)))
    out = with_fdr(x)
    return out.select("drug", "pt", "a", "expected", "p_value", "fdr", (F.col("fdr") < decision_thres).alias("signal"))


def bcpnn_columns(ct: DataFrame, min_events: int = 3) -> DataFrame:
    """Adds ic, its variance, its lower bound and the posterior probability of no association."""
    x = prepared(ct, min_events).withColumns({
        "p1": F.expr("1.0 + n1j"), "p12": F.expr("2.0 + nn"), "q1": F.expr("1.0 + ni1"), "r1": F.expr("1.0 + n11"),
    })
    x = x.withColumn("r12", F.expr("r1 + nn - n11 - 1.0 + (2.0 + nn) * (2.0 + nn) / (q1 * p1)"))
    ic = f"({S.digamma('r1')} - {S.digamma('r12')} - ({S.digamma('p1')} - {S.digamma('p12')} + {S.digamma('q1')} - {S.digamma('p12')})) / {np.log(2)}"
    var = f"({S.trigamma('r1')} - {S.trigamma('r12')} + {S.trigamma('p1')} - {S.trigamma('p12')} + {S.trigamma('q1')} - {S.trigamma('p12')}) / {np.log(2) ** 2}"
    x = x.withColumns({"ic": F.expr(ic), "ic_var": F.expr(var)})
    x = x.withColumns({"ic025": F.expr("ic - 1.95996 * sqrt(ic_var)"), "z": F.expr("ic / sqrt(ic_var)")})
    return x.withColumn("p_null", F.expr(S.normal_upper("z")))


def posterior_errors(x: DataFrame, p: str = "p_null", order: tuple[Column, ...] | None = None) -> DataFrame:
    """Adds posterior FDR, FNR, sensitivity and specificity as cells are called in order of their null probability.

    Probabilities that agree to twelve places count as equal; the term decides then."""
    order = order or (F.round(p, 12).asc(), F.col("pt").asc())
    run = W.partitionBy("drug").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy("drug")
    x = x.withColumns({"rk": F.row_number().over(W.partitionBy("drug").orderBy(*order)), "cum": F.sum(p).over(run), "m": F.count("*").over(every), "tot": F.sum(p).over(every)})
    hit = F.col("rk") - F.col("cum")  # expected true signals called so far
    true_all = F.col("m") - F.col("tot")
    return x.withColumns({
        "fdr": F.col("cum") / F.col("rk"), "fnr": F.try_divide(true_all - hit, F.col("m") - F.col("rk")),
        "se": F.try_divide(hit, true_all), "sp": F.try_divide(F.col("tot") - F.col("cum"), F.col("tot")),
    }).drop("cum", "m", "tot")


def bcpnn_table(ic_threshold: float = 0.0) -> list:
    return ["drug", "pt", "a", "expected", "ic", "ic025", F.expr("n11 / expected").alias("count_expected"), "p_null", "fdr", "fnr", "se", "sp", (F.col("ic025") > ic_threshold).alias("signal")]


def bcpnn(ct: DataFrame, min_events: int = 3, ic_threshold: float = 0.0) -> DataFrame:
    return posterior_errors(bcpnn_columns(ct, min_events)).select(*bcpnn_table(ic_threshold))


def bcpnn_simulated(ct: DataFrame, draws: int = 10_000, min_events: int = 3, seed: int = 1) -> DataFrame:
    """Lower 2.5% point of simulated information components: Dirichlet cell shares, seeded by each cell's key."""
    import zlib

    @F.pandas_udf(T.DoubleType())
    def low(drug: pd.Series, pt: pd.Series, n11: pd.Series, n1j: pd.Series, ni1: pd.Series, nn: pd.Series) -> pd.Series:
        out = []
        for d, t, a, r, c, n in zip(drug, pt, n11, n1j, ni1, nn):
            rng = np.random.default_rng([seed, zlib.crc32(f"{d}\0{t}".encode())])
            q1, q2 = (r + 1) / (n + 2), (c + 1) / (n + 2)
            weight = 1 / (q1 * q2)  # prior of total weight that expects independence
            prior = weight * np.array([q1 * q2, q1 * (1 - q2), (1 - q1) * q2, (1 - q1) * (1 - q2)])
            g = rng.gamma(prior + np.array([a, r - a, c - a, n - r - c + a]), size=(draws, 4))
            p = g / g.sum(1, keepdims=True)
            out.append(float(np.quantile(np.log2(p[:, 0] / ((p[:, 0] + p[:, 1]) * (p[:, 0] + p[:, 2]))), 0.025)))
        return pd.Series(out)

    x = prepared(ct, min_events)
    return x.select("drug", "pt", "a", low("drug", "pt", "n11", "n1j", "ni1", "nn").alias("ic025_mc"))


def mixture_weight(prior: tuple = PRIOR) -> str:
    """Posterior weight of the first gamma component, as SQL text over n11 and expected."""
    a1, b1, a2, b2, w = prior

    def log_nb(a, b):
        return f"({S.log_gamma(f'(n11 + {a})')} - {S.log_gamma(f'({a} + 0.0 * n11)')} - {S.log_gamma('(n11 + 1.0)')} + {a} * ln({b} / ({b} + expected)) + n11 * ln(expected / ({b} + expected)))"

    return f"(1.0 / (1.0 + exp(least(700.0, {np.log((1 - w) / w)} + {log_nb(a2, b2)} - {log_nb(a1, b1)}))))"


def mgps_columns(ct: DataFrame, min_events: int = 3, prior: tuple = PRIOR) -> DataFrame:
    """Adds qn, eb_log2 and ebgm, its power of two."""
    a1, b1, a2, b2, _ = prior
    x = prepared(ct, min_events).withColumn("qn", F.expr(mixture_weight(prior)))
    for k, a in ((1, a1), (2, a2)):
        x = x.withColumn(f"g{k}", F.expr(f"n11 + {a}"))
    text = f"(qn * ({S.digamma('g1')} - ln({b1} + expected)) + (1.0 - qn) * ({S.digamma('g2')} - ln({b2} + expected))) / {np.log(2)}"
    return x.withColumn("eb_log2", F.expr(text)).withColumn("ebgm", F.expr("pow(2.0, eb_log2)"))


def mixture_udfs(prior: tuple = PRIOR):
    """(quantile of the posterior mixture, its mass up to a value), each solved row by row to convergence."""
    a1, b1, a2, b2, _ = prior

    def cdf(x, n, e, q):
        return q * S.gamma_cdf(a1 + n, (b1 + e) * x) + (1 - q) * S.gamma_cdf(a2 + n, (b2 + e) * x)

    @F.pandas_udf(T.DoubleType())
    def quantile(n: pd.Series, e: pd.Series, q: pd.Series, level: pd.Series) -> pd.Series:
        n, e, q, t = (x.to_numpy(float) for x in (n, e, q, level))
        return pd.Series(S.solve_increasing(lambda x: cdf(x, n, e, q), t, n.shape))

    @F.pandas_udf(T.DoubleType())
    def mass(n: pd.Series, e: pd.Series, q: pd.Series, at: pd.Series) -> pd.Series:
        n, e, q, t = (x.to_numpy(float) for x in (n, e, q, at))
        return pd.Series(cdf(t, n, e, q))

    return quantile, mass


def mgps(ct: DataFrame, min_events: int = 3, eb05_threshold: float = 2.0, prior: tuple = PRIOR, relative_risk: float = 1.0) -> DataFrame:
    return mgps_wide(ct, min_events, prior, relative_risk).select(*mgps_table(eb05_threshold))


def mgps_wide(ct: DataFrame, min_events: int = 3, prior: tuple = PRIOR, relative_risk: float = 1.0) -> DataFrame:
    """``ct`` with all that its shrinkage needs and finds."""
    quantile, mass = mixture_udfs(prior)
    x = mgps_columns(ct, min_events, prior)
    return posterior_errors(x.withColumns({"eb05": quantile("n11", "expected", "qn", F.lit(0.05)), "p_null": mass("n11", "expected", "qn", F.lit(float(relative_risk)))}))


def mgps_table(eb05_threshold: float = 2.0) -> list:
    return ["drug", "pt", "a", "expected", "eb_log2", "ebgm", "eb05", "p_null", "fdr", "fnr", "se", "sp", (F.col("eb05") >= eb05_threshold).alias("signal")]


def every_model(ct: DataFrame, names: tuple[str, ...] = ("prr", "ror", "bcpnn", "mgps"), min_events: int = 3, prr_threshold: float = 0.05, ror_threshold: float = 0.05, ic_threshold: float = 0.0, eb05_threshold: float = 2.0) -> DataFrame:
    """``ct`` with a struct column for each named model, the row of its table of results.

    All models stand in one plan over one reading of the cells: their windows share the drug, so cells are shuffled once."""
    wide = {
        "prr": lambda x: (with_fdr(ratio(x, log_prr(), "prr", min_events)), ratio_table("prr", prr_threshold)), "ror": lambda x: (with_fdr(ratio(x, log_ror(), "ror", min_events)), ratio_table("ror", ror_threshold)),
        "bcpnn": lambda x: (posterior_errors(bcpnn_columns(x, min_events)), bcpnn_table(ic_threshold)), "mgps": lambda x: (mgps_wide(x, min_events), mgps_table(eb05_threshold)),
    }
    keep, x = list(ct.columns), ct
    for name in names:
        done, table = wide[name](x)
        x = done.select(*keep, F.struct(*table).alias(f"model_{name}"))
        keep.append(f"model_{name}")
    return x


def fit_prior(ct: DataFrame, start: tuple = (0.2, 0.06, 1.4, 1.8, 0.1), truncate: int | None = None, steps: int = 400) -> tuple:
    """Maximum-likelihood prior of the mixture. Cells fold to bins before the driver sees them: of each count up to 1,000, of three
    leading digits beyond, and of an expectation's logarithm to two places, so at most some thousand times some hundred rows
    however many cells there are.

    With ``truncate`` only cells of at least that count enter, each likelihood divided by its chance of doing so."""
    x = prepared(ct, truncate or 0)
    digits = F.pow(F.lit(10.0), F.floor(F.log10("n11")) - 2)
    level = F.when(F.col("n11") <= 1000, F.col("n11")).otherwise(F.round(F.col("n11") / digits) * digits)
    table = x.groupBy(level.alias("level"), F.expr("round(log10(expected), 2)").alias("le")).agg(F.count("*").alias("w"), F.avg("expected").alias("e"), F.avg("n11").alias("n")).toPandas()
    n, e, w = table["n"].to_numpy(float), table["e"].to_numpy(float), table["w"].to_numpy(float)

    def log_nb(k, a, b):
        return S.lgamma_np(k + a) - S.lgamma_np(a) - S.lgamma_np(k + 1) + a * np.log(b / (b + e)) + k * np.log(e / (b + e))

    def cost(t):
        a1, b1, a2, b2 = np.exp(np.clip(t[:4], -8, 8))
        p = 1 / (1 + np.exp(-np.clip(t[4], -20, 20)))
        mix = lambda k: p * np.exp(log_nb(k, a1, b1)) + (1 - p) * np.exp(log_nb(k, a2, b2))
        like = mix(n)
        if truncate:
            like = like / np.maximum(1e-300, 1 - sum(mix(np.full(n.shape, float(k))) for k in range(truncate)))
        return -(w * np.log(np.maximum(like, 1e-300))).sum()

    points = [np.append(np.log(start[:4]), np.log(start[4] / (1 - start[4])))]
    points += [points[0] + 0.5 * np.eye(5)[k] for k in range(5)]
    values = [cost(p) for p in points]
    for _ in range(steps):  # a simplex search
        order = np.argsort(values)
        points, values = [points[k] for k in order], [values[k] for k in order]
        if values[-1] - values[0] < 1e-9 * (1 + abs(values[0])):
            break
        centre = np.mean(points[:-1], axis=0)
        trial = [centre + f * (centre - points[-1]) for f in (1, 2, 0.5, -0.5)]
        scores = [cost(t) for t in trial]
        k = int(np.argmin(scores))
        if scores[k] < values[-1]:
            points[-1], values[-1] = trial[k], scores[k]
        else:
            points = [points[0] + 0.5 * (p - points[0]) for p in points]
            values = [cost(p) for p in points]
    best = points[int(np.argmin(values))]
    a1, b1, a2, b2 = np.exp(np.clip(best[:4], -8, 8))
    return float(a1), float(b1), float(a2), float(b2), float(1 / (1 + np.exp(-best[4])))


#: What may rank cells, by model: a column, and whether small values come first.
RANKINGS = {
    "prr": {"p_value": ("p_value", True), "CI": ("ci_low", False)}, "ror": {"p_value": ("p_value", True), "CI": ("ci_low", False)}, "rfet": {"p_value": ("p_value", True)},
    "bcpnn": {"p_value": ("p_null", True), "quantile": ("ic025", False)}, "mgps": {"p_value": ("p_null", True), "quantile": ("eb05", False), "log2": ("eb_log2", False)},
}


def decided(x: DataFrame, model: str, ranking: str = "p_value", metric: str = "fdr", threshold: float = 0.05) -> DataFrame:
    """Cells of a model's table in the order of a ranking statistic, those called first: adds ``rank`` and ``called``.

    ``fdr`` calls as many as have a false discovery rate up to the threshold, ``signals`` that many cells, and ``rank`` those
    whose statistic reaches it: from above where small values come first, from below otherwise."""
    column, rising = RANKINGS[model][ranking]
    c = F.col(column)
    every = W.partitionBy("drug")
    x = x.withColumn("rank", F.row_number().over(every.orderBy(c.asc() if rising else c.desc(), "pt")))
    if metric == "signals":
        return x.withColumn("called", F.col("rank") <= int(threshold))
    hit = F.col("fdr") <= threshold if metric == "fdr" else (c <= threshold if rising else c >= threshold)
    return x.withColumn("called", F.col("rank") <= F.count_if(hit).over(every))
