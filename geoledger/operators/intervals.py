"""Interval estimates for counts per stratum."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.lgamma, x.tolist()), float, len(x))


def beta_share(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function of all rows at once, by its continued fraction; constant memory at any count."""
    x, a, b = (np.array(v, float) for v in np.broadcast_arrays(x, a, b))
    far = x > (a + 1) / (a + b + 2)  # there the fraction of the other side is the fast one
    x, a, b = np.where(far, 1 - x, x), np.where(far, b, a), np.where(far, a, b)
    out, todo = np.zeros(len(x)), np.flatnonzero((x > 0) & (x < 1))
    out[x >= 1] = 1.0
    front = np.zeros(len(x))
    y, p, q = x[todo], a[todo], b[todo]
    front[todo] = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny, c, d = 1e-300, np.ones(len(todo)), 1 / (1 - (p + q) * y / (p + 1))
    value, k = d.copy(), 0
    while len(todo):
        k += 1
        for term in (k * (q - k) * y / ((p + 2 * k - 1) * (p + 2 * k)), -(p + k) * (p + q + k) * y / ((p + 2 * k) * (p + 2 * k + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / np.where(d == 0, tiny, d), np.where(c == 0, tiny, c)
            value *= c * d
        done = np.abs(c * d - 1) < 1e-14
        out[todo[done]] = front[todo[done]] * value[done]
        todo, y, p, q, c, d, value = (v[~done] for v in (todo, y, p, q, c, d, value))
    return np.where(far, 1 - out, out)


def _lower(x: np.ndarray, n: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Lower exact bounds of all rows at once: the share at which so many hits or more have a chance of alpha / 2."""
    lo, hi = np.zeros(len(x)), np.where(x > 0, 1.0, 0.0)
    hits = np.maximum(x, 1)
    for _ in range(60):
        mid = (lo + hi) / 2
        above = beta_share(mid, hits, n - hits + 1) > alpha / 2
        lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)
    return np.where(x > 0, (lo + hi) / 2, 0.0)


@F.pandas_udf(DoubleType())
def _bound(x: pd.Series, n: pd.Series, alpha: pd.Series, upper: pd.Series) -> pd.Series:
    known = (x.notna() & n.notna() & (n > 0)).to_numpy(bool)
    out, up = np.full(len(x), np.nan), upper.to_numpy(bool)[known]
    k, m, a = (v.to_numpy(float)[known] for v in (x, n, alpha))
    bound = _lower(np.where(up, m - k, k), m, a)
    out[known] = np.where(up, 1 - bound, bound)
    return pd.Series(out).where(known, None)


def exact_lower(x: Column, n: Column, alpha: Column | float = 0.05) -> Column:
    """Lower Clopper-Pearson bound of ``x`` hits in ``n``; null for an empty stratum."""
    return _bound(x, n, F.lit(alpha) if isinstance(alpha, float) else alpha, F.lit(False))


def exact_upper(x: Column, n: Column, alpha: Column | float = 0.05) -> Column:
    return _bound(x, n, F.lit(alpha) if isinstance(alpha, float) else alpha, F.lit(True))


def combined_estimate(strata: DataFrame, by: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Stratum-weighted exact bounds, rescaled about the point estimate.

    ``strata`` has labeled, unlabeled and positive; strata without labels are left out. Returns (by,) total, unlabeled,
    positive, point, lower, upper as shares and point_n, lower_n, upper_n as truncated counts.
    """
    s = strata.where("labeled > 0").withColumns({"lo": exact_lower(F.col("positive"), F.col("labeled"), alpha), "hi": exact_upper(F.col("positive"), F.col("labeled"), alpha)})
    g = s.withColumn("size", F.expr("labeled + unlabeled")).groupBy(*(by or [])).agg(
        F.sum("size").alias("total"), F.sum("unlabeled").alias("unlabeled"), F.sum("positive").alias("positive"),
        F.expr("sum(size * positive / labeled) / sum(size) as point"), F.expr("sum(size * lo) / sum(size) as lo"), F.expr("sum(size * hi) / sum(size) as hi"),
        F.expr("sqrt(sum(size * size / labeled)) / sum(size / sqrt(labeled)) as scale"),
    )
    out = g.withColumns({"lower": F.expr("point - (point - lo) * scale"), "upper": F.expr("point + (hi - point) * scale")}).drop("lo", "hi", "scale")
    return out.withColumns({f"{c}_n": F.expr(f"cast({c} * unlabeled + positive as bigint)") for c in ("point", "lower", "upper")})
