"""Exponential smoothing per series.

A recursion over time cannot be written as relational operators, so each series
(one key, already aggregated to periods) is one ``applyInPandas`` group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: weight of the seasonal update.
GAMMA = 0.1


def smooth(y, alpha: float, beta: float | None = None, period: int | None = None, mode: str = "one_step"):
    """Fitted values of simple, trend or additive seasonal smoothing.

    ``one_step`` returns the forecast made before a value is seen. ``reference``
    returns the state after the update, with the seasonal index that lags by one
    period; it reproduces the figures of the original helper and is not a
    measure of forecast error.
    """
    y = np.asarray(y, dtype=float)
    lagging = mode == "reference"
    if period:
        head = y[:period].mean()
        state = [head, (y[period:2 * period].mean() - head) / period]
        season = [v - head for v in y[:period]]
        if not lagging:
            season.append(season[0])
    else:
        state = [y[0], y[1] - y[0] if beta is not None and len(y) > 1 else 0.0]
        season = None
    b = 0.0 if beta is None else beta
    out = [state[0] + (season[0] if season else 0.0)]
    for t, v in enumerate(y[1:], start=1):
        slot = t - 1 if lagging else t
        s = season[slot] if season else 0.0
        expected = state[0] + state[1]
        level = expected + alpha * (v - s - expected)
        state = [level, state[1] + b * (level - state[0] - state[1])]
        if season:
            season.append(s + GAMMA * (v - level - s))
        if lagging:
            out.append(level + (season[t] if season else 0.0))
        else:
            out.append(expected + s)
    return np.array(out), state, season


def best_alpha(y, beta=None, period=None, mode="one_step", low=0.01, high=0.99, tol=1e-6):
    """Alpha with the least mean squared error, by golden-section search."""
    y = np.asarray(y, dtype=float)
    loss = lambda a: float(np.mean((y - smooth(y, a, beta, period, mode)[0]) ** 2))
    g = (5 ** 0.5 - 1) / 2
    a, b = low, high
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = loss(c), loss(d)
    while b - a > tol:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = loss(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = loss(d)
    return 0.5 * (a + b)


def exponential_smoothing(df: DataFrame, keys: list[str], order: str, value: str, alpha: float | None = None, beta: float | None = None,
                          period: int | None = None, mode: str = "one_step") -> DataFrame:
    """Fitted value and residual per point, with the alpha used; alpha is searched when not given.

    Seasonal smoothing needs two full cycles; the points of shorter series have no fit and say so in ``reason``. A series
    without keys is one group, bounded by its number of periods.
    """
    if period and beta is None:
        beta = 0.1
    fields = [df.schema[k] for k in keys] + [df.schema[order]]
    schema = T.StructType([*fields, *[T.StructField(n, T.DoubleType()) for n in ("value", "fitted", "residual", "alpha")], T.StructField("reason", T.StringType())])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        y = pd.to_numeric(pdf["_v"]).ffill()
        pdf, y = pdf[y.notna()], y[y.notna()].to_numpy(dtype=float)
        if len(y) == 0 or (period and len(y) < 2 * period):
            return pdf[[*keys, order]].assign(value=y, fitted=np.nan, residual=np.nan, alpha=np.nan, reason="shorter than two cycles" if len(y) else "no values").replace({np.nan: None})
        a = best_alpha(y, beta, period, mode) if alpha is None else alpha
        fitted = smooth(y, a, beta, period, mode)[0]
        out = pdf[[*keys, order]].copy()
        out["value"], out["fitted"], out["residual"], out["alpha"], out["reason"] = y, fitted, y - fitted, a, None
        return out

    src = df.select(*keys, order, F.col(value).cast("double").alias("_v"))
    grouped = src.groupBy(*keys) if keys else src.groupBy(F.lit(0))
    return grouped.applyInPandas(fit, schema)


def fit_quality(fitted: DataFrame, keys: list[str]) -> DataFrame:
    """Alpha, MSE and MAE per series."""
    g = fitted.groupBy(*keys) if keys else fitted.groupBy()
    return g.agg(F.max("alpha").alias("alpha"), F.avg(F.col("residual") ** 2).alias("mse"), F.avg(F.abs("residual")).alias("mae"), F.count(F.lit(1)).alias("n"))
