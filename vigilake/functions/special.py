"""Special functions. Those that plain arithmetic can spell are SQL text, used by ``F.expr`` and in equivalent queries
alike; the incomplete gamma functions and what builds on them are NumPy, for Arrow UDFs."""

from __future__ import annotations

import math

import numpy as np


def num(x: float) -> str:
    """A double literal in either SQL: one without an exponent would be a decimal."""
    text = repr(float(x))
    return text if "e" in text else text + "E0"


def normal_upper(z: str) -> str:
    """1 - Phi(z): a nested series of positive terms for |z| < 3.6, a continued fraction beyond; tails keep their digits.

    ``z`` should be a column name: it is repeated."""
    x = f"(abs({z}) / {num(math.sqrt(2))})"
    root, one, half_ = num(math.sqrt(math.pi)), num(1), num(0.5)
    x2 = f"({z} * {z})"  # 2 x^2
    series = one
    for k in range(60, 0, -1):
        series = f"({one} + {x2} / {num(2 * k + 1)} * {series})"
    small = f"({half_} - {x} * exp(-{half_} * {x2}) / {root} * {series})"
    fraction = x
    for k in range(60, 0, -1):
        fraction = f"({x} + {num(k / 2)} / {fraction})"
    large = f"({half_} * exp(-{half_} * {x2}) / {root} / {fraction})"
    half = f"(CASE WHEN abs({z}) < 3.6 THEN {small} ELSE {large} END)"
    return f"(CASE WHEN {z} >= 0 THEN {half} ELSE {one} - {half} END)"


def nested(r: str, *terms: float) -> str:
    """t0 - r (t1 - r (t2 - ...))"""
    out = num(terms[-1])
    for t in reversed(terms[:-1]):
        out = f"({num(t)} - {r} * {out})"
    return out


def digamma(x: str) -> str:
    """For x > 0: eight steps up, then the asymptotic series."""
    y = f"({x} + {num(8)})"
    shift = " + ".join(f"{num(1)} / ({x} + {num(k)})" for k in range(8))
    r = f"({num(1)} / ({y} * {y}))"
    return f"(ln{y} - {num(0.5)} / {y} - {r} * {nested(r, 1 / 12, 1 / 120, 1 / 252, 1 / 240, 1 / 132)} - ({shift}))"


def trigamma(x: str) -> str:
    y = f"({x} + {num(8)})"
    shift = " + ".join(f"{num(1)} / (({x} + {num(k)}) * ({x} + {num(k)}))" for k in range(8))
    r = f"({num(1)} / ({y} * {y}))"
    return f"({num(1)} / {y} + {num(0.5)} * {r} + {r} / {y} * {nested(r, 1 / 6, 1 / 30, 1 / 42, 1 / 30, 5 / 66)} + {shift})"


def log_gamma(x: str) -> str:
    y = f"({x} + {num(8)})"
    shift = " + ".join(f"ln({x} + {num(k)})" for k in range(8))
    r = f"({num(1)} / ({y} * {y}))"
    return f"(({y} - {num(0.5)}) * ln{y} - {y} + {num(0.5 * math.log(2 * math.pi))} + {nested(r, 1 / 12, 1 / 360, 1 / 1260, 1 / 1680)} / {y} - ({shift}))"


def lgamma_np(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0."""
    x = np.asarray(x, float)
    y, r = x + 8, 1 / (x + 8) ** 2
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y
    for k in range(8):
        out = out - np.log(x + k)
    return out


def gamma_cdf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma P(a, x): the series below a + 1, the continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    front = np.exp(np.where(x > 0, a * np.log(np.maximum(x, 1e-300)) - x - lgamma_np(a), -np.inf))
    low = (x < a + 1) & (x > 0)
    if low.any():
        p, q = a[low], x[low]
        term = total = 1 / p
        for k in range(1, 2000):
            term = term * q / (p + k)
            total = total + term
            if (term < total * 1e-16).all():
                break
        out[low] = front[low] * total
    high = (x >= a + 1) & (x > 0)
    if high.any():  # Lentz's scheme
        p, q = a[high], x[high]
        b = q + 1 - p
        c, d = np.full(p.shape, 1e300), 1 / b
        h = d
        for k in range(1, 2000):
            an = -k * (k - p)
            b = b + 2
            d = 1 / (an * d + b)
            c = b + an / c
            step = c * d
            h = h * step
            if (np.abs(step - 1) < 1e-15).all():
                break
        out[high] = 1 - front[high] * h
    return np.clip(out, 0, 1)


def solve_increasing(f, target, shape, low: float = 0.0, high: float = 1.0, steps: int = 100) -> np.ndarray:
    """For each element, the x >= 0 at which an increasing f reaches the target: bracketing, then bisection."""
    lo, hi = np.full(shape, low), np.full(shape, high)
    for _ in range(200):
        under = f(hi) < target
        if not under.any():
            break
        hi = np.where(under, hi * 2, hi)
    for _ in range(steps):
        mid = (lo + hi) / 2
        under = f(mid) < target
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return (lo + hi) / 2


def lbe_power(m: int, bound: float = 0.05) -> float:
    """The power of the location-based estimator: 1 while its standard deviation at 1 exceeds the bound."""
    goal = math.log(1 + m * bound * bound)
    f = lambda a: math.lgamma(2 * a + 1) - 2 * math.lgamma(a + 1)
    if f(1.0) >= goal:
        return 1.0
    lo, hi = 1.0, 2.0
    while f(hi) < goal:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < goal else (lo, mid)
    return (lo + hi) / 2


def normal_quantile(p: float) -> float:
    """The z that a standard normal stays under with chance p."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def hypergeometric_upper(a: np.ndarray, r: np.ndarray, c: np.ndarray, t: np.ndarray, mid: np.ndarray) -> np.ndarray:
    """P(X >= a) for r and c marked among t, less half of P(X = a) where ``mid``; all rows at once, a term at a time.

    Terms are summed away from the mean, where they fall, and a row is done when they no longer count."""
    f = lambda x: lgamma_np(x + 1)
    lowest = np.maximum(0.0, r + c - t)
    up = a > r * c / np.maximum(t, 1)
    inside = (a >= lowest) & (a <= np.minimum(r, c))
    start = np.where(up, a, a - 1)  # below the mean: 1 - P(X <= a - 1)
    known = np.where((start >= lowest) & (start <= np.minimum(r, c)), start, lowest)
    at = lambda k: np.exp(f(r) + f(t - r) + f(c) + f(t - c) - f(t) - f(k) - f(r - k) - f(c - k) - f(t - r - c + k))
    term = np.where(known == start, at(known), 0.0)
    total, k = term.copy(), start.copy()
    live = np.flatnonzero(term > 0)
    while len(live):
        kk, rr, cc, tt, u = k[live], r[live], c[live], t[live], up[live]
        rise = (rr - kk) * (cc - kk) / ((kk + 1) * (tt - rr - cc + kk + 1))
        fall = kk * (tt - rr - cc + kk) / np.maximum((rr - kk + 1) * (cc - kk + 1), 1e-300)
        term[live] = term[live] * np.where(u, rise, fall)
        total[live] += term[live]
        k[live] += np.where(u, 1, -1)
        live = live[term[live] > total[live] * 1e-17]
    out = np.where(up, total, 1 - total)
    out = np.where(a <= lowest, 1.0, out)
    return np.clip(out - np.where(mid & inside, 0.5 * at(np.where(inside, a, lowest)), 0.0), 0, 1)
