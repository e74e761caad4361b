"""Random draws that depend on a seed and on keys alone: the same at any partitioning and on every rerun."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType

from geoledger.operators.intervals import beta_share


def uniform(seed: int, *keys: str) -> Column:
    """A number between 0 and 1, hashed from the seed and the keys of its row."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def binomial_quantile(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The smallest k with P(X <= k) >= u for X binomial, by bisection over all rows at once.

    P(X <= k) is 1 - I_p(k + 1, n - k). No trials (n <= 0) and impossible ones (p <= 0) give 0, certain ones n.
    """
    n, p, u = np.maximum(np.asarray(n, np.int64), 0), np.asarray(p, float), np.asarray(u, float)
    lo, hi = np.full(len(n), -1), n.copy()  # P(X <= lo) < u <= P(X <= hi)
    inside = (p > 0) & (p < 1) & (n > 0)
    hi = np.where(inside, hi, np.where(p >= 1, n, 0))
    lo = np.where(inside, lo, hi - 1)
    while np.any(open_ := hi - lo > 1):
        at = np.flatnonzero(open_)
        mid = (lo[at] + hi[at]) // 2
        enough = 1 - beta_share(p[at], mid + 1.0, (n[at] - mid).astype(float)) >= u[at]
        hi[at], lo[at] = np.where(enough, mid, hi[at]), np.where(enough, lo[at], mid)
    return hi


@F.pandas_udf(LongType())
def _binomial(n: pd.Series, p: pd.Series, u: pd.Series) -> pd.Series:
    known = (n.notna() & p.notna() & u.notna()).to_numpy()
    out = pd.Series([pd.NA] * len(n), dtype="Int64")
    out[known] = binomial_quantile(n[known].to_numpy(np.int64), p[known].to_numpy(float), u[known].to_numpy(float))
    return out


def binomial(n: Column, p: Column, u: Column) -> Column:
    """A binomial draw of ``n`` trials with chance ``p`` from a uniform number; null in, null out."""
    return _binomial(n.cast("long"), p.cast("double"), u.cast("double"))


def replicates(table: DataFrame, draws: int) -> DataFrame:
    """Every row once per replicate 0 .. draws - 1."""
    return table.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Uniform numbers from whole numbers by shifts and multiplications (fixed constants of a 64-bit finaliser)."""
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)


@F.pandas_udf(DoubleType())
def _resampled(size: pd.Series, values: pd.Series, counts: pd.Series, seed: pd.Series) -> pd.Series:
    n = np.array([len(v) for v in values], np.int64)
    wide = int(n.max(initial=0))
    value, count = np.zeros((len(n), wide)), np.zeros((len(n), wide))
    for k, (v, c) in enumerate(zip(values, counts, strict=True)):
        value[k, : n[k]], count[k, : n[k]] = v, c
    rest = np.cumsum(count[:, ::-1], 1)[:, ::-1]
    left, total, start = size.to_numpy(np.int64), np.zeros(len(n)), seed.to_numpy(np.int64).astype(np.uint64)
    for i in range(wide):  # the draws of value i of all rows at once
        share = np.divide(count[:, i], rest[:, i], out=np.zeros(len(n)), where=rest[:, i] > 0)
        with np.errstate(over="ignore"):
            u = _mixed(start + np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15))
        got = binomial_quantile(left, share, u)
        total, left = total + got * value[:, i], left - got
    return pd.Series(total)


def resampled_sum(size: Column, values: Column, counts: Column, seed: Column) -> Column:
    """The sum of ``size`` draws with replacement from a population that has each of ``values`` as often as ``counts`` says.

    The draws of one value are a binomial of those left, one value after another: a multinomial draw, which takes as
    long as there are different values, not individuals. ``seed`` is a hash of what the draw is for. Without individuals the sum is 0.
    """
    return _resampled(size.cast("long"), values.cast("array<double>"), counts.cast("array<bigint>"), seed.cast("long"))


def interval(table: DataFrame, value: str, by: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """(by,) point, lower, upper: median and central range of ``value`` over rows."""
    tail = (1 - level) / 2
    at = lambda q: F.percentile(value, F.lit(q))
    return table.groupBy(*(by or [])).agg(at(0.5).alias("point"), at(tail).alias("lower"), at(1 - tail).alias("upper"))
