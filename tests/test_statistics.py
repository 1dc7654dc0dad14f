"""Published rows, invariants and independent arithmetic for the statistics."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vigilake.functions import special as S
from vigilake.operators import disproportionality as D

N, N1J = 95990, 45
# term, a, event margin, PRR, ROR, p of the PRR
ROWS = [
    ("HYPOCALCAEMIA", 4, 106, 83.61220016795224, 91.67192699394825, 0.0), ("FEBRILE NEUTROPENIA", 4, 441, 19.515891129383885, 21.32231952784468, 2.919974262383107e-10),
    ("DIARRHOEA", 7, 3283, 4.55579296219659, 5.210807453509081, 6.485065368488918e-06), ("DISEASE PROGRESSION", 3, 684, 9.392559938590312, 9.992028504205175, 3.0819881628008083e-05),
    ("CHILLS", 3, 715, 8.983614210984408, 9.553872367554108, 4.296625491650996e-05), ("PYREXIA", 3, 2170, 2.951699731806225, 3.091106855174748, 0.02624249473165563),
    ("NAUSEA", 3, 4744, 1.3491527776807308, 1.374092261741403, 0.2957229304100846),
]
SCHEMA = "drug string, pt string, a long, b long, c long, d long, n long"


def ct(spark, rows=ROWS, n=N, n1j=N1J, drug="LAPATINIB"):
    return spark.createDataFrame([(drug, r[0], r[1], n1j - r[1], r[2] - r[1], n - n1j - r[2] + r[1], n) for r in rows], SCHEMA)


def test_published_ratios(spark):
    prr = {r["pt"]: r for r in D.prr(ct(spark)).collect()}
    ror = {r["pt"]: r for r in D.ror(ct(spark)).collect()}
    for name, _, _, want_prr, want_ror, p in ROWS:
        assert math.isclose(prr[name]["prr"], want_prr, rel_tol=1e-12)
        assert math.isclose(ror[name]["ror"], want_ror, rel_tol=1e-12)
        assert math.isclose(prr[name]["p_value"], p, rel_tol=1e-6, abs_tol=1e-15)


def test_fdr_follows_p_and_legacy_order_does_not(spark):
    rows = sorted(D.prr(ct(spark)).collect(), key=lambda r: r["p_value"])
    fdr = [r["fdr"] for r in rows]
    assert fdr == sorted(fdr)
    legacy = D.prr(ct(spark), legacy_order=True).collect()
    assert sorted(r["fdr"] for r in legacy) == pytest.approx(fdr)


def test_published_information_components(spark):
    rows = [("p", 92, 118), ("q", 76, 98)]
    got = {r["pt"]: r for r in D.bcpnn(ct(spark, rows, 100000, 3208)).collect()}
    assert got["p"]["ic025"] == pytest.approx(3.873880, abs=2e-6) and got["q"]["ic025"] == pytest.approx(3.768979, abs=2e-6)
    assert got["p"]["expected"] == pytest.approx(3.78544)


def test_mixture_quantile_holds_its_mass(spark):
    quantile, mass = D.mixture_udfs()
    x = D.mgps_columns(ct(spark)).withColumn("q", quantile("n11", "expected", "qn", D.F.lit(0.05)))
    for r in x.withColumn("m", mass("n11", "expected", "qn", "q")).collect():
        assert r["m"] == pytest.approx(0.05, abs=1e-9)


def test_order_of_rows_does_not_matter(spark):
    a = {r["pt"]: r["fdr"] for r in D.mgps(ct(spark)).collect()}
    b = {r["pt"]: r["fdr"] for r in D.mgps(ct(spark, ROWS[::-1])).collect()}
    assert a == b


def test_fisher_by_brute_force(spark):
    rows = [("x", 3, 7), ("y", 5, 5)]
    got = {r["pt"]: r["p_value"] for r in D.rfet(ct(spark, rows, 40, 11)).collect()}
    for name, a, margin in rows:
        want = sum(math.comb(11, k) * math.comb(29, margin - k) for k in range(a, min(11, margin) + 1)) / math.comb(40, margin)
        assert got[name] == pytest.approx(want, rel=1e-9)


def test_edge_tables(spark):
    one = ct(spark, [("only", 3, 3)], 1000, 3)
    for f in (D.prr, D.ror, D.rfet, D.bcpnn, D.mgps):
        assert f(one).count() == 1
        assert f(one.limit(0)).count() == 0
    assert D.prr(ct(spark, [("a", 3, 900), ("b", 4, 900)], 1000, 50)).count() == 2  # all p above one half


@settings(max_examples=60, deadline=None)
@given(st.floats(0.2, 60), st.floats(0.01, 80))
def test_gamma_cdf_against_integration(a, x):
    grid = np.linspace(0, 1, 20001)[1:] ** 3 * x  # dense where the density may spike
    f = np.exp((a - 1) * np.log(grid) - grid - math.lgamma(a))
    area = float(np.sum((f[1:] + f[:-1]) / 2 * np.diff(grid)) + f[0] * grid[0] / a)
    assert S.gamma_cdf(np.array([a]), np.array([x]))[0] == pytest.approx(min(1, area), abs=2e-3)


@pytest.mark.parametrize("z", [-9.0, -3.7, -1.0, 0.0, 0.5, 2.9, 3.59, 3.61, 6.2, 9.3, 20.0])
def test_normal_tail(spark, z):
    got = spark.sql(f"SELECT {S.normal_upper('z')} AS p FROM (SELECT CAST({z} AS DOUBLE) AS z)").head()["p"]
    assert got == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-9)


def test_gamma_family(spark):
    for x in (0.3, 1.0, 2.5, 40.0):
        r = spark.sql(f"SELECT {S.log_gamma('x')} AS g, {S.digamma('x')} AS d, {S.trigamma('x')} AS t FROM (SELECT CAST({x} AS DOUBLE) AS x)").head()
        h = 1e-4
        lg = lambda v: math.lgamma(v)
        assert r["g"] == pytest.approx(lg(x), abs=1e-10)
        assert r["d"] == pytest.approx((lg(x + h) - lg(x - h)) / (2 * h), rel=1e-5, abs=1e-6)
        assert r["t"] == pytest.approx((lg(x + h) - 2 * lg(x) + lg(x - h)) / h**2, rel=1e-4)


def test_lbe_power():
    assert S.lbe_power(400) == pytest.approx(1.0)
    assert S.lbe_power(1000) == pytest.approx(1.5274, abs=1e-3) and S.lbe_power(5000) == pytest.approx(2.6792, abs=1e-3)


def test_prior_fit_recovers_scale(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(1500):
        e = float(rng.uniform(0.5, 20))
        lam = rng.gamma(2.0, 1 / 4.0) if rng.random() < 0.3 else rng.gamma(2.0, 1 / 1.5)
        a = int(rng.poisson(lam * e))
        n1j, n = 1000, 1_000_000
        ni1 = int(e * n / n1j)
        rows.append(("D", f"p{k}", a, n1j - a, max(0, ni1 - a), n, n))
    fit = D.fit_prior(spark.createDataFrame(rows, SCHEMA))
    assert all(v > 0 for v in fit) and 0 < fit[4] < 1
    mean = fit[4] * fit[0] / fit[1] + (1 - fit[4]) * fit[2] / fit[3]
    assert mean == pytest.approx(0.3 * 0.5 + 0.7 * 2 / 1.5, rel=0.2)


def test_tails_of_all_rows_at_once():
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(300):
        t = int(rng.integers(2, 60))
        r, c = int(rng.integers(0, t + 1)), int(rng.integers(0, t + 1))
        rows.append((int(rng.integers(max(0, r + c - t), min(r, c) + 1)), r, c, t, bool(rng.integers(2))))
    a, r, c, t, mid = (np.array(x) for x in zip(*rows))
    got = S.hypergeometric_upper(*(x.astype(float) for x in (a, r, c, t)), mid)
    for k, (a_, r_, c_, t_, half) in enumerate(rows):
        pmf = lambda k: math.comb(r_, k) * math.comb(t_ - r_, c_ - k) / math.comb(t_, c_)  # noqa: E731,B023
        want = sum(pmf(k) for k in range(a_, min(r_, c_) + 1)) - (pmf(a_) / 2 if half else 0)
        assert got[k] == pytest.approx(want, abs=1e-10)
    assert S.hypergeometric_upper(*(np.array([x], float) for x in (5000, 900_000, 9_000, 1_000_000)), np.array([False]))[0] == pytest.approx(1.0)


def brute_lbe(p, level=0.05):
    """The published estimate, position by position."""
    p = np.asarray(p)
    m = len(p)
    a = S.lbe_power(m)
    q = 2 * np.minimum(p, 1 - p)
    pi0 = min(1.0, float(np.mean((-np.log(1 - q)) ** a)) / math.gamma(a + 1))
    up = np.sort(p)
    qv = np.empty(m)
    qv[m - 1] = pi0 * up[m - 1]
    for j in range(m - 2, -1, -1):
        qv[j] = min(pi0 * m * up[j] / j if j else np.inf, qv[j + 1])
    rank = [int((np.sum(p < x) + (np.sum(p == x) + 1) / 2) - 1) for x in p]
    sd = math.sqrt((math.gamma(2 * a + 1) / math.gamma(a + 1) ** 2 - 1) / m)
    return a, pi0, sd, qv[rank]


@pytest.mark.parametrize("m", [7, 60, 700])
def test_whole_estimate(spark, m):
    rng = np.random.default_rng(m)
    p = np.round(rng.beta(0.6, 1.4, m), 3).clip(0.001, 0.998)  # with ties
    df = spark.createDataFrame([("d", f"t{k}", float(x)) for k, x in enumerate(p)], "drug string, pt string, p_value double")
    a, pi0, sd, qv = brute_lbe(p)
    for r in D.lbe(df).collect():
        assert r["qvalue"] == pytest.approx(qv[int(r["pt"][1:])], rel=1e-9)
        assert (r["power"], r["pi0"], r["sd_bound"]) == pytest.approx((a, pi0, sd), rel=1e-7)
        assert r["significant"] == (r["qvalue"] <= 0.05) and r["pi0_upper"] == pytest.approx(min(1, pi0 + 1.6448536 * sd))


def test_decisions(spark):
    x = D.ror(ct(spark)).persist()
    called = lambda *how: {r["pt"] for r in D.decided(x, "ror", *how).where("called").collect()}
    by_p = [r["pt"] for r in sorted(x.collect(), key=lambda r: (r["p_value"], r["pt"]))]
    assert called("p_value", "signals", 3) == set(by_p[:3])
    assert called("p_value", "rank", 0.01) == {r["pt"] for r in x.collect() if r["p_value"] <= 0.01}
    assert called("CI", "rank", 1.5) == {r["pt"] for r in x.collect() if r["ci_low"] >= 1.5}
    assert len(called("CI", "fdr", 0.05)) == len(called("p_value", "fdr", 0.05)) > 0
    y = D.mgps(ct(spark))
    assert D.decided(y, "mgps", "quantile", "signals", 2).where("called").count() == 2
