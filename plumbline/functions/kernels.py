"""Tail probabilities of the normal, t, F and chi-square laws, over Arrow batches.

Each kernel takes whole columns. The incomplete beta and gamma functions are worked
out for all rows of a batch at once, by continued fractions in the modified
Lentz form and a power series; rows that have converged stay as they are.
"""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TINY, EPS, STEPS = 1e-300, 1e-15, 3000

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_erfc = np.frompyfunc(math.erfc, 1, 1)


def lgamma(x: np.ndarray) -> np.ndarray:
    return _lgamma(x).astype(float)


def normal_sf(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2)).astype(float)


def normal_ppf(p: np.ndarray) -> np.ndarray:
    """Quantiles; 0 and 1 give the infinities, what is outside gives NaN."""
    inverse = NormalDist().inv_cdf
    one = lambda x: inverse(x) if 0 < x < 1 else {0.0: -math.inf, 1.0: math.inf}.get(x, math.nan)
    return np.array([one(float(x)) for x in np.asarray(p, float)])


def _fraction(terms, first: np.ndarray) -> np.ndarray:  # noqa: ANN001
    """first + a1/(b1 + a2/(b2 + ...)) for all rows; terms(m) gives (a, b)."""
    f = np.where(first == 0, TINY, first)
    c, d = f.copy(), np.zeros_like(f)
    live = np.ones(len(f), bool)
    for m in range(1, STEPS):
        a, b = terms(m)
        d = b + a * d
        d = 1 / np.where(d == 0, TINY, d)
        c = b + a / c
        c = np.where(c == 0, TINY, c)
        f = np.where(live, f * c * d, f)
        live &= np.abs(c * d - 1) > EPS
        if not live.any():
            break
    return f


def beta_inc(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta function I_x(a, b)."""
    x, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(x, a, b))
    out = np.full(x.shape, np.nan)
    out[(x <= 0)], out[(x >= 1)] = 0.0, 1.0
    ok = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    if ok.any():
        x, a, b = x[ok], a[ok], b[ok]
        swap = x > (a + 1) / (a + b + 2)
        p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)

        def terms(m: int) -> tuple[np.ndarray, np.ndarray]:
            if m == 1:
                return np.ones_like(y), np.ones_like(y)
            k = (m - 1) // 2
            if m % 2:
                return k * (q - k) * y / ((p + 2 * k - 1) * (p + 2 * k)), np.ones_like(y)
            return -(p + k) * (p + q + k) * y / ((p + 2 * k) * (p + 2 * k + 1)), np.ones_like(y)

        log_front = lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y)
        value = np.exp(log_front) / p * _fraction(terms, np.zeros_like(y))
        out[ok] = np.where(swap, 1 - value, value)
    return out


def gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized upper incomplete gamma function Q(a, x)."""
    a, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, x))
    out = np.full(x.shape, np.nan)
    out[(a > 0) & (x <= 0)] = 1.0
    ok = (a > 0) & (x > 0)
    if ok.any():
        a, x = a[ok], x[ok]
        front = np.exp(a * np.log(x) - x - lgamma(a))
        low = x < a + 1
        value = np.empty_like(x)
        if low.any():
            s, t, n = 1 / a[low], 1 / a[low], a[low].copy()
            for _ in range(STEPS):
                n += 1
                t = t * x[low] / n
                s = s + t
                if (t < s * EPS).all():
                    break
            value[low] = 1 - front[low] * s
        if (~low).any():
            u, v = a[~low], x[~low]

            def terms(m: int) -> tuple[np.ndarray, np.ndarray]:
                return (np.ones_like(v) if m == 1 else (m - 1) * (u - m + 1)), v + 2 * m - 1 - u

            value[~low] = front[~low] * _fraction(terms, np.zeros_like(v))
        out[ok] = np.clip(value, 0, 1)
    return out


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / (df + t * t), df / 2, np.full_like(df, 0.5))


def f_sf(x: np.ndarray, df1: np.ndarray, df2: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    return np.where(x <= 0, 1.0, beta_inc(df2 / (df2 + df1 * x), df2 / 2, df1 / 2))


def chi2_sf(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    return gamma_q(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def test_p(kind: np.ndarray, x: np.ndarray, df1: np.ndarray, df2: np.ndarray, one_tailed: np.ndarray) -> np.ndarray:
    """p-values of test statistics; symmetric ones are two-sided unless one-tailed."""
    p = np.full(len(x), np.nan)
    for name in np.unique(kind.astype(str)):
        at = kind == name
        v, a, b = x[at], df1[at], df2[at]
        if name == "t":
            p[at] = t_two_sided(v, a)
        elif name == "F":
            p[at] = f_sf(v, a, b)
        elif name in ("chi2", "Q"):
            p[at] = chi2_sf(v, a)
        elif name == "r":
            p[at] = t_two_sided(v * np.sqrt(a / (1 - v * v)), a)
        elif name == "z":
            p[at] = 2 * normal_sf(np.abs(v))
    symmetric = np.isin(kind.astype(str), ["t", "r", "z"])
    return np.minimum(1.0, np.where(one_tailed.astype(bool) & symmetric, p / 2, p))


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([0 if x is None else len(x) for x in lists])
    return (np.concatenate([np.asarray(x, float) for x in lists if x is not None]) if sizes.sum() else np.empty(0)), sizes


def _cut(values: np.ndarray, sizes: np.ndarray) -> pd.Series:
    return pd.Series(np.split(values, np.cumsum(sizes)[:-1])) if len(sizes) else pd.Series([], dtype=object)


#: Statistics by the number that stands for them in what audit_p is asked, from 1 on.
TESTS = ("t", "F", "chi2", "Q", "r", "z")
#: Numbers that an item of each kind brings.
STAT, EFFECT, COMPARISON = 8, 14, 10
#: What audit_p says of a record's comparisons together.
COMBINED = ("size", "fisher", "fisher_p", "f_low", "f_high", "stouffer_z", "stouffer_p", "extreme_p", "safe_p")


def _stat_p(a: np.ndarray) -> np.ndarray:
    """(p, p_min, p_max) of rows (test, df1, df2, one-tailed, value, low, high, zero)."""
    out = np.full((len(a), 3), np.nan)
    at = np.flatnonzero(np.isfinite(a[:, 0]))
    if len(at):
        code, df1, df2, tail, *x = a[at].T
        kind, x = np.array(TESTS, object)[code.astype(int) - 1], np.stack(x, 1)
        n = x.shape[1]
        p = test_p(np.repeat(kind, n), x.ravel(), np.repeat(df1, n), np.repeat(df2, n), np.repeat(tail == 1, n)).reshape(-1, n)
        out[at] = np.stack([p[:, 0], np.fmin.reduce(p, 1), np.fmax.reduce(p, 1)], 1)
    return out


def _effect_p(a: np.ndarray) -> np.ndarray:
    """(p, p_min, p_max) of rows (level, one-tailed, four estimates, four lower and four upper limits); the printed ones first."""
    level, tail, m, low, high = a[:, 0], a[:, 1] == 1, a[:, 2:6], a[:, 6:10], a[:, 10:14]
    critical = normal_ppf(1 - (1 - level / 100) / 2)
    critical = np.where(np.isfinite(critical) & (critical > 0), critical, np.nan)
    m, low, high = m[:, :, None, None], low[:, None, :, None], high[:, None, None, :]
    with np.errstate(invalid="ignore", divide="ignore"):
        z = np.where((low < high) & (low <= m) & (m <= high), np.abs(m) * 2 / (high - low), np.nan).reshape(len(a), 64)
        point = np.abs(a[:, 2]) * 2 / (a[:, 10] - a[:, 6])
        inside = (a[:, 6] <= a[:, 2]) & (a[:, 2] <= a[:, 10])
    # p falls as z grows
    zs = np.where(inside[:, None], np.stack([point, np.fmax.reduce(z, 1), np.fmin.reduce(z, 1)], 1), np.nan)
    p = normal_sf(zs * critical[:, None])
    return np.where(tail[:, None], p, np.minimum(1.0, 2 * p))


def _comparison_p(a: np.ndarray) -> np.ndarray:
    """(p, p_low, p_high) of Welch's test for rows (means, SDs, half widths of the four, sizes), over the corners of the rounding boxes."""
    if not len(a):
        return np.empty((0, 3))
    steps = np.array(list(itertools.product((0, -1, 1), repeat=4)), float)
    corner = a[:, None, :4] + steps[None] * a[:, None, 4:8]
    ma, mb, sa, sb = np.moveaxis(corner, 2, 0)
    na, nb = a[:, 8:9], a[:, 9:10]
    with np.errstate(invalid="ignore", divide="ignore"):
        va, vb = sa * sa / na, sb * sb / nb
        good = (sa > 0) & (sb > 0)
        t = np.where(good, np.abs(ma - mb) / np.sqrt(va + vb), np.nan)
        df = np.where(good, (va + vb) ** 2 / (va * va / (na - 1) + vb * vb / (nb - 1)), np.nan)
    p = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & np.isfinite(df)
    p[ok] = t_two_sided(t[ok], df[ok])
    touch = (a[:, 0] - a[:, 4] <= a[:, 1] + a[:, 5]) & (a[:, 1] - a[:, 5] <= a[:, 0] + a[:, 4])
    high = np.fmax.reduce(p, 1)
    return np.stack([p[:, 0], np.fmin.reduce(p, 1), np.where(touch, np.fmax(high, 1.0), high)], 1)


def _combined(p: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """COMBINED per record, from its comparisons' (p, p_low, p_high); rows: comparisons a record."""
    out = np.full((len(rows), len(COMBINED)), np.nan)
    some = np.flatnonzero(rows)
    if len(some):
        starts = np.concatenate([[0], np.cumsum(rows[some])[:-1]])
        total = lambda x: np.add.reduceat(x, starts)
        n = rows[some].astype(float)
        inner = np.clip(p[:, 0], 1e-300, 1 - 1e-16)
        least = lambda x: np.log(np.fmax(1e-300, x))
        fisher, low, high = -2 * total(np.log(inner)), -2 * total(least(p[:, 2])), -2 * total(least(p[:, 1]))
        z = total(normal_ppf(1 - np.clip(inner, 1e-15, 1 - 1e-15))) / np.sqrt(n)
        fisher_p, f_low, f_high = (chi2_sf(x, 2 * n) for x in (fisher, high, low))
        two = lambda q: 2 * np.minimum(q, 1 - q)
        safe = np.where((f_low <= 0.5) & (f_high >= 0.5), 1.0, np.maximum(two(f_low), two(f_high)))
        out[some] = np.stack([n, fisher, fisher_p, f_low, f_high, z, 2 * normal_sf(np.abs(z)), np.minimum(1.0, two(fisher_p)), safe], 1)
    return out


def _flat(lists: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All records' numbers as rows of so many, and the rows a record."""
    sizes = np.array([0 if x is None else len(x) for x in lists], int)
    flat = np.concatenate([np.asarray(x, float) for x in lists if x is not None and len(x)]) if sizes.sum() else np.empty(0)
    return flat.reshape(-1, width), sizes // width


def _cut(rows: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return [x.ravel() for x in np.split(rows, np.cumsum(sizes)[:-1])] if len(sizes) else []


@F.pandas_udf(T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("stats", "effects", "comparisons", "combined")]))
def audit_p(stats: pd.Series, effects: pd.Series, comparisons: pd.Series) -> pd.DataFrame:
    """p-values of all that a record reports: three an item (printed, least, largest), and its comparisons combined; NaN where there is none."""
    s, n_s = _flat(stats, STAT)
    e, n_e = _flat(effects, EFFECT)
    c, n_c = _flat(comparisons, COMPARISON)
    p = _comparison_p(c)
    return pd.DataFrame({"stats": _cut(_stat_p(s), n_s), "effects": _cut(_effect_p(e), n_e), "comparisons": _cut(p, n_c), "combined": list(_combined(p, n_c))})


@F.pandas_udf(T.DoubleType())
def normal_ppf_udf(p: pd.Series) -> pd.Series:
    return pd.Series(normal_ppf(p.to_numpy()))


@F.pandas_udf(T.DoubleType())
def normal_sf_udf(z: pd.Series) -> pd.Series:
    return pd.Series(normal_sf(z.to_numpy()))


@F.pandas_udf(T.DoubleType())
def normal_cdf_udf(z: pd.Series) -> pd.Series:
    return pd.Series(normal_sf(-z.to_numpy()))


@F.pandas_udf(T.DoubleType())
def t_p_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def f_sf_udf(x: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(f_sf(x.to_numpy(float), df1.to_numpy(float), df2.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def chi2_sf_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(x.to_numpy(float), df.to_numpy(float)))


def register(spark: SparkSession) -> None:
    """The kernels as SQL functions."""
    for name, f in (("normal_sf", normal_sf_udf), ("normal_cdf", normal_cdf_udf), ("normal_ppf", normal_ppf_udf), ("t_two_sided_p", t_p_udf), ("f_sf", f_sf_udf), ("chi2_sf", chi2_sf_udf)):
        spark.udf.register(name, f)
