"""Time series operators. Input is one row per (keys, period); facts are
aggregated to periods before they come here."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insightspark.functions.columns import clean, ratio, sign_label
from insightspark.operators.relational import calendar_join
from insightspark.operators.windows import by_period

N = lambda: F.count(F.lit(1))


def _grp(df, keys):
    return df.groupBy(*keys) if keys else df.groupBy()


def _whole(keys):
    return W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))


def prepare_series(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Fill gaps forward and drop what has no value yet."""
    filled = F.last(clean(value), ignorenulls=True).over(by_period(keys, order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(value, filled).where(F.col(value).isNotNull())


def indexed(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Row index from 1 and series length."""
    return df.withColumn("idx", F.row_number().over(by_period(keys, order))).withColumn("n_points", N().over(_whole(keys)))


def step_interval(unit: str) -> str:
    return {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}[unit]


def naive_forecast(df: DataFrame, keys: list[str], order: str, value: str, periods: int = 7, method: str = "last",
                   window: int = 7, unit: str = "day", cycle: int | None = None) -> DataFrame:
    """Baseline forecasts: last value, mean of the last ``window``, drift, or the last seasonal cycle.

    ``cycle=None`` infers the cycle per key from the autocorrelation, 7 where none shows.
    """
    s = indexed(prepare_series(df, keys, order, value), keys, order)
    ends = _grp(s, keys).agg(
        F.max(order).alias("_last_ts"), F.max("idx").alias("_n"), F.max_by(value, "idx").alias("_last"), F.min_by(value, "idx").alias("_first"),
        F.avg(F.when(F.col("idx") > F.col("n_points") - window, F.col(value))).alias("_mean"))
    steps = ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    base = {"last": F.col("_last"), "mean": F.col("_mean"),
            "drift": F.col("_last") + F.coalesce(ratio(F.col("_last") - F.col("_first"), F.col("_n") - 1), F.lit(0.0)) * F.col("step")}
    if method in base:
        out = steps.withColumn("forecast", base[method])
    elif method == "seasonal_naive":
        if cycle is not None:
            steps = steps.withColumn("_c", F.lit(cycle))
        elif keys:
            dom = dominant_period(df, keys, order, value).select(*keys, "dominant_period")
            steps = steps.join(dom, keys, "left").withColumn("_c", F.coalesce("dominant_period", F.lit(7)))
        else:
            steps = steps.withColumn("_c", F.coalesce(dominant_period(df, keys, order, value).select("dominant_period").scalar(), F.lit(7)))
        steps = steps.withColumn("_c", F.least("_c", "_n")).withColumn("idx", (F.col("_n") - F.col("_c") + F.pmod(F.col("step") - 1, F.col("_c")) + 1).cast("int"))
        out = steps.join(s.select(*keys, "idx", F.col(value).alias("forecast")), [*keys, "idx"])
    else:
        raise ValueError(f"unknown method {method}")
    stamp = F.col("_last_ts") + F.expr(step_interval(unit)) * F.col("step")
    return out.select(*keys, "step", stamp.cast(df.schema[order].dataType).alias(order), F.col("forecast").cast("double").alias("forecast"))


def _lagged(keys: list[str], order: str, value: str, max_lag: int | None):
    """All lags of one series at once: the products at every lag are the inverse transform of the power spectrum."""

    def run(series: pa.Table) -> pa.Table:
        series = series.sort_by(order)
        v = series.column(value).to_numpy().astype(float)
        n = len(v)
        top = n // 2 if max_lag is None else min(max_lag, n // 2)
        d = v - v.mean() if n else v
        variance = float((d * d).mean()) if n else 0.0
        if n < 4 or variance <= 0:
            top = 0
        size = 1 << (2 * n).bit_length()  # room for the longest shift, so that nothing wraps round
        spectrum = np.fft.rfft(d, size)
        products = np.fft.irfft(spectrum * np.conj(spectrum), size)[1: top + 1]
        lags = np.arange(1, top + 1)
        out = {k: pa.repeat(series.column(k)[0], top) for k in keys} if n else {}
        return pa.table({**out, "lag": pa.array(lags, pa.int32()), "acf": pa.array(products / (n - lags) / variance if top else np.empty(0)), "n_points": pa.array(np.full(top, n, np.int64))})

    return run


def acf(df: DataFrame, keys: list[str], order: str, value: str, max_lag: int | None = None) -> DataFrame:
    """Autocorrelation per lag up to half the series (or ``max_lag``): mean lagged product over the population variance.

    A series is one group: it is as long as it has periods, and takes n log n steps.
    """
    s = prepare_series(df, keys, order, value).select(*keys, order, F.col(value).cast("double").alias(value))
    schema = T.StructType([s.schema[k] for k in keys] + [T.StructField("lag", T.IntegerType()), T.StructField("acf", T.DoubleType()), T.StructField("n_points", T.LongType())])
    return _grp(s, keys).applyInArrow(_lagged(keys, order, value, max_lag), schema)


def acf_peaks(df: DataFrame, keys: list[str], order: str, value: str, max_lag: int | None = None) -> DataFrame:
    """Interior local maxima of the autocorrelation above 2/√n."""
    a = acf(df, keys, order, value, max_lag)
    w = by_period(keys, "lag")
    p = a.withColumn("_l", F.lag("acf").over(w)).withColumn("_r", F.lead("acf").over(w))
    return p.where((F.col("acf") > F.col("_l")) & (F.col("acf") > F.col("_r")) & (F.col("acf") > 2 / F.sqrt("n_points"))).drop("_l", "_r")


def dominant_period(df: DataFrame, keys: list[str], order: str, value: str, max_lag: int | None = None) -> DataFrame:
    """Strongest cycle per series with its strength class; of cycles that are equal to nine digits the shortest."""
    p = acf_peaks(df, keys, order, value, max_lag)
    one = _grp(p, keys).agg(F.max_by("lag", F.struct(F.round("acf", 9), -F.col("lag"))).alias("dominant_period"), F.max("acf").alias("strength"), N().alias("n_peaks"))
    return one.withColumn("label", F.when(F.col("strength") > 0.5, "strong").when(F.col("strength") > 0.3, "moderate").when(F.col("strength").isNotNull(), "weak").otherwise("none"))


def control_chart(df: DataFrame, keys: list[str], order: str, value: str, sigma: float = 3.0, window: int | None = None) -> DataFrame:
    """Points that break one of four run rules; one row per (point, rule)."""
    s = df.where(clean(value).isNotNull()).withColumn("_v", clean(value))
    w = by_period(keys, order)
    if window:
        fr = w.rowsBetween(-(window - 1), 0)
        enough = F.count("_v").over(fr) >= 2
        s = s.withColumn("center", F.when(enough, F.avg("_v").over(fr))).withColumn("std", F.when(enough, F.stddev_samp("_v").over(fr)))
    else:
        s = s.withColumn("center", F.avg("_v").over(_whole(keys))).withColumn("std", F.stddev_samp("_v").over(_whole(keys)))
    z = F.when(F.col("center").isNull(), None).when(F.coalesce(F.col("std"), F.lit(0.0)) > 0, (F.col("_v") - F.col("center")) / F.col("std")).otherwise(0.0)
    s = s.withColumn("z", z)

    def run(n, hit, need):
        fr = w.rowsBetween(-(n - 1), 0)
        return (F.count("z").over(fr) == n) & (F.sum(F.when(hit, 1).otherwise(0)).over(fr) >= need)

    zc, above, below = F.col("z"), F.col("_v") > F.col("center"), F.col("_v") < F.col("center")
    rules = {"beyond_limit": F.abs(zc) > sigma, "2_of_3_beyond_2": run(3, zc > 2, 2) | run(3, zc < -2, 2),
             "4_of_5_beyond_1": run(5, zc > 1, 4) | run(5, zc < -1, 4), "8_one_side": run(8, above, 8) | run(8, below, 8)}
    for i, cond in enumerate(rules.values()):
        s = s.withColumn(f"_r{i}", cond)
    flags = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(f"_r{i}"), F.lit(False)).alias("hit")) for i, n in enumerate(rules)])
    out = s.select(*keys, order, F.col("_v").alias("value"), "center", "z", F.inline(flags))
    return out.where("hit").drop("hit")


def granularity(df: DataFrame, day: str, keys: list[str] = ()) -> DataFrame:
    """Period length that suits the span of the data."""
    g = _grp(df, list(keys)).agg(F.min(F.to_date(day)).alias("first_day"), F.max(F.to_date(day)).alias("last_day"))
    g = g.withColumn("span_days", F.date_diff("last_day", "first_day") + 1)
    d = F.col("span_days")
    return g.withColumn("granularity", F.when(d < 90, "daily").when(d <= 365, "weekly").when(d <= 3 * 365, "monthly").otherwise("quarterly"))


def rate_of_change_anomalies(df: DataFrame, keys: list[str], order: str, value: str, factor: float = 2.0) -> DataFrame:
    """Steps larger than ``factor`` times the mean absolute step."""
    s = df.withColumn("change", F.col(value) - F.lag(value).over(by_period(keys, order)))
    s = s.withColumn("mean_step", F.avg(F.abs("change")).over(_whole(keys)))
    return s.where(F.abs("change") > factor * F.col("mean_step"))


def structural_break(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Mean, variance and slope of the first and second half."""
    s = indexed(df, keys, order).withColumn("_h", F.col("idx") <= F.floor(F.col("n_points") / 2))
    y = F.col(value).cast("double")
    part = lambda c, f: f(F.when(c, y))
    h1, h2 = F.col("_h"), ~F.col("_h")
    g = _grp(s, keys).agg(
        part(h1, F.avg).alias("mean_1"), part(h2, F.avg).alias("mean_2"), part(h1, F.var_samp).alias("var_1"), part(h2, F.var_samp).alias("var_2"),
        F.regr_slope(F.when(h1, y), F.col("idx")).alias("slope_1"), F.regr_slope(F.when(h2, y), F.col("idx")).alias("slope_2"))
    return g.withColumn("mean_shift_pct", 100.0 * ratio(F.col("mean_2") - F.col("mean_1"), F.abs("mean_1"))).withColumn("var_ratio", ratio("var_2", "var_1"))


def trend_line(df: DataFrame, keys: list[str], order: str, value: str, exclude=None) -> DataFrame:
    """Least-squares line over the row index; ``exclude`` leaves points out of the fit."""
    s = indexed(df, keys, order)
    y = F.col(value).cast("double") if exclude is None else F.when(~exclude, F.col(value).cast("double"))
    g = _grp(s, keys).agg(F.regr_slope(y, F.col("idx")).alias("slope"), F.regr_intercept(y, F.col("idx")).alias("intercept"), F.regr_r2(y, F.col("idx")).alias("r2"),
                          F.count(y).alias("n"), F.avg(y).alias("mean"))
    return g.withColumn("pct_per_period", 100.0 * ratio("slope", F.abs("mean")))


def _with_line(df, keys, order, value):
    s = indexed(df, keys, order)
    fit = trend_line(df, keys, order, value)
    if keys:
        return s.join(fit.select(*keys, "slope", "intercept"), keys)
    return s.withColumn("_f", fit.select(F.struct("slope", "intercept")).scalar()).select("*", "_f.*").drop("_f")


def decompose(df: DataFrame, keys: list[str], order: str, value: str, cycle: int) -> DataFrame:
    """Linear trend + mean of each phase + residual."""
    s = _with_line(df, keys, order, value).withColumn("trend", F.col("intercept") + F.col("slope") * F.col("idx"))
    s = s.withColumn("phase", F.pmod(F.col("idx") - 1, F.lit(cycle))).withColumn("_dev", F.col(value) - F.col("trend"))
    seasonal = F.avg("_dev").over(W.partitionBy(*keys, "phase"))
    s = s.withColumn("seasonal", seasonal).withColumn("residual", F.col("_dev") - F.col("seasonal"))
    return s.select(*keys, order, value, "trend", "phase", "seasonal", "residual")


def segment_divergence(df: DataFrame, segment: str, order: str, value: str) -> DataFrame:
    """Growth, share of the total and direction of each segment's line."""
    t = trend_line(df, [segment], order, value)
    size = df.groupBy(segment).agg(F.sum(value).alias("total"))
    whole = df.agg(F.sum(value)).scalar()
    out = t.join(size, segment).withColumn("share", ratio("total", whole))
    return out.select(segment, "slope", "pct_per_period", "share", sign_label("slope").alias("direction"))


def drop_partial_periods(df: DataFrame, period: str, unit: str, first_day: str, last_day: str) -> DataFrame:
    """Leave out the first or last period when the data does not cover it fully."""
    end = F.date_add((F.col(period) + F.expr(step_interval(unit))).cast("date"), -1)
    return df.where((F.col(period) >= F.lit(first_day).cast("date")) & (end <= F.lit(last_day).cast("date")))


def index_to_base(df: DataFrame, keys: list[str], order: str, value: str, base_periods: int) -> DataFrame:
    """Value over the mean of the first periods, times 100."""
    s = indexed(df, keys, order)
    base = F.avg(F.when(F.col("idx") <= base_periods, F.col(value).cast("double"))).over(_whole(keys))
    return s.withColumn("indexed", 100.0 * ratio(value, base)).drop("idx", "n_points")


def event_overlay(anomalies: DataFrame, day: str, calendar: DataFrame) -> DataFrame:
    """Calendar events that cover each anomaly; anomalies without one stay."""
    return calendar_join(anomalies, day, calendar, "start", "end", "left")


def union_all(frames):
    return reduce(DataFrame.unionByName, frames)
