"""Statistics: t distribution, least squares, rank correlation, circular means."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|), by the continued fraction of the incomplete beta function."""
    if not (df > 0) or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    return _beta_share(df / (df + t * t), df / 2, 0.5)


def _beta_share(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + step * d) or 1e-300)
        c = (1 + step / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_quantile(p: float, df: float) -> float:
    """t with P(|T| >= t) = 1 - p, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2


def _beta_shares(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As :func:`_beta_share`, for arrays: all fractions advance together until each has settled."""
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    inner = (x > 0) & (x < 1)
    z = np.where(inner, x, 0.5)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(z) + b * np.log1p(-z)) / a
    tiny = lambda v: np.where(v == 0, 1e-300, v)
    f, c, d = np.ones_like(z), np.ones_like(z), np.zeros_like(z)
    going = inner.copy()
    for i in range(400):
        m = i // 2
        step = np.ones_like(z) if i == 0 else m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / tiny(1 + step * d), tiny(1 + step / c)
        f = np.where(going, f * c * d, f)
        going &= np.abs(1 - c * d) >= 1e-14
        if not going.any():
            break
    share = np.where(inner, front * (f - 1), (x >= 1).astype(float))
    return np.where(flip, 1 - share, share)


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of t at df degrees of freedom, a batch at a time; missing where either is, or df isn't positive."""
    a, b = t.to_numpy(float), df.to_numpy(float)
    good = ~np.isnan(a) & (b > 0)
    out = np.full(len(a), np.nan)
    out[good] = _beta_shares(b[good] / (b[good] + a[good] ** 2), b[good] / 2, np.full(good.sum(), 0.5))
    return pd.Series(out).astype("Float64").where(~np.isnan(out)).astype("Float64")


def trend(frame: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 10, p_values: bool = False) -> DataFrame:
    """Per group: trend, yint, r2, stderr and n of the least-squares line of y on x; null under ``min_n`` pairs.

    Missing values (null or NaN) are left out.  ``p_values`` adds the two-sided p of the slope.
    """
    fx, fy = (F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in (x, y))
    own = frame.where(fx.isNotNull() & fy.isNotNull()) if not keys else frame
    made = own.groupBy(*keys).agg(
        F.regr_count(fy, fx).alias("n"), F.regr_slope(fy, fx).alias("b"), F.regr_intercept(fy, fx).alias("a"), F.regr_r2(fy, fx).alias("r"), F.regr_sxx(fy, fx).alias("sxx"), F.regr_syy(fy, fx).alias("syy")
    )
    enough = F.col("n") >= min_n
    error = F.sqrt(F.greatest((1 - F.col("r")) * F.try_divide(F.col("syy"), F.col("sxx")) / F.nullif(F.col("n") - 2, F.lit(0)), F.lit(0.0)))
    out = made.select(*keys, "n", *[F.when(enough, c).alias(k) for k, c in (("trend", F.col("b")), ("yint", F.col("a")), ("r2", F.col("r")), ("stderr", F.when(F.col("n") > 2, error)))])
    return out.withColumn("pvalue", t_p_value(F.try_divide(F.col("trend"), F.col("stderr")), (F.col("n") - 2).cast("double"))) if p_values else out


def spearman(frame: DataFrame, keys: Sequence[str], x: str, y: str, p_values: bool = False) -> DataFrame:
    """Per group: rank correlation rho (average ranks for ties) and n, over rows where neither value is missing."""
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    fx, fy = (F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in (x, y))
    both = frame.where(fx.isNotNull() & fy.isNotNull()).select(*keys, fx.alias("x"), fy.alias("y"))
    both = both.withColumn("nx", F.count(F.lit(1)).over(W.partitionBy(*keys, "x"))).withColumn("ny", F.count(F.lit(1)).over(W.partitionBy(*keys, "y")))
    ranked = both.select(*keys, *[(F.rank().over(part.orderBy(c)) + (F.col(f"n{c}") - 1) / 2).alias(f"r{c}") for c in ("x", "y")])
    out = ranked.groupBy(*keys).agg(F.corr("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))
    if not p_values:
        return out
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") * F.col("rho")))
    return out.withColumn("pvalue", t_p_value(t, (F.col("n") - 2).cast("double")))


def multi_ols(frame: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], scaled: bool = True, constant: bool = False, level: float = 0.95) -> DataFrame:
    """Per group and term: coefficient, its confidence bounds and p, and the fit's n and adjusted R².

    Rows with a missing value are left out.  ``scaled`` divides each centred variable by its
    population deviation; without ``constant`` the fit goes through the origin, and R² is then
    about 0 rather than the mean.  The sums of products are gathered by the JVM, one small row
    for each group; only the solution runs in Python.
    """
    names = [y, *xs]
    clean = frame.select(*keys, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in names]).dropna(subset=names)
    if scaled:
        part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
        clean = clean.select(*keys, *[F.try_divide(F.col(c) - F.avg(c).over(part), F.stddev_pop(c).over(part)).alias(c) for c in names]).dropna(subset=names)
    terms = [*xs, *["const"] * constant]
    wide = clean.withColumn("const", F.lit(1.0)) if constant else clean
    all_of = [y, *terms]
    pairs = [(a, b) for i, a in enumerate(all_of) for b in all_of[i:]]
    sums = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), *[F.sum(F.col(a) * F.col(b)).alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name in keys] + ["term string", "coef double", "low double", "high double", "pvalue double", "n bigint", "adj_r2 double"])

    def solve(batches):
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                k, n = len(terms), int(r["n"])
                full = np.zeros((k + 1, k + 1))
                for i, (a, b) in enumerate(pairs):
                    u, v = all_of.index(a), all_of.index(b)
                    full[u, v] = full[v, u] = r[f"s{i}"]
                xx, xy, yy = full[1:, 1:], full[1:, 0], full[0, 0]
                inverse = np.linalg.pinv(xx)
                beta = inverse @ xy
                df = n - k
                rest = max(yy - beta @ xy, 0.0)
                total = yy - r["sy"] ** 2 / n if constant else yy
                error = np.sqrt(np.maximum(np.diag(inverse) * rest / df, 0)) if df > 0 else np.full(k, np.nan)
                adj = 1 - (rest / df) / (total / (n - constant)) if df > 0 and total > 0 else np.nan
                reach = t_quantile(level, df) if df > 0 else np.nan
                for i, term in enumerate(terms):
                    p = t_two_sided(beta[i] / error[i] if error[i] > 0 else math.inf, df) if df > 0 else np.nan
                    rows.append([*(r[c] for c in keys), term, beta[i], beta[i] - reach * error[i], beta[i] + reach * error[i], p, n, adj])
            yield pd.DataFrame(rows, columns=[*keys, "term", "coef", "low", "high", "pvalue", "n", "adj_r2"])

    return sums.mapInPandas(solve, schema)


def mean_circular(values: Column, low: float, high: float, favor_max: bool = True) -> Column:
    """Running circular mean of an array of values on [low, high], folded from the largest down.

    Each next value is drawn the shorter way round; the mean is wrapped back after each step.
    Nulls are left out; an empty array gives null.  The order matters, so this isn't a vector mean.
    """
    around = high - low

    def step(s: Column, v: Column) -> Column:
        n, mean = s["n"], s["mean"]
        arc = F.when((mean - v) / around < 0.5, v).otherwise(v + around)
        moved = mean * n / (n + 1) + arc / (n + 1)
        moved = F.when(moved < low, high - low + moved).when(moved > high, low - high + moved).otherwise(moved)
        return F.struct((n + 1).alias("n"), F.when(n == 0, v).otherwise(moved).alias("mean"))

    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("mean"))
    ordered = F.sort_array(F.filter(F.transform(values, lambda v: v.cast("double")), lambda v: v.isNotNull()), asc=False)
    edge = (lambda m: F.when(m == low, F.lit(high)).otherwise(m)) if favor_max else (lambda m: F.when(m == high, F.lit(low)).otherwise(m))
    return F.aggregate(ordered, start, step, lambda s: edge(s["mean"]))


def mean_ignoring_missing(c: Column) -> Column:
    """Aggregate mean over values that are there; null if none is."""
    return F.avg(F.nanvl(c.cast("double"), F.lit(None).cast("double")))


def sum_ignoring_missing(c: Column) -> Column:
    return F.sum(F.nanvl(c.cast("double"), F.lit(None).cast("double")))


def mean_with_missing(c: Column) -> Column:
    """Aggregate mean that is NaN as soon as one value is missing."""
    return F.when(F.count(F.lit(1)) > F.count(c), F.lit(float("nan"))).otherwise(F.avg(c))


def spread(c: Column, min_n: int = 10) -> Column:
    """Sample deviation of at least ``min_n`` values, else null."""
    v = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    return F.when(F.count(v) >= min_n, F.stddev(v))
