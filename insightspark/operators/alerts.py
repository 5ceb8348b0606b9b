"""Alert engine: metric values per date and dimensions, thresholds, recovery.

Batch and stream share these functions; streams call them per micro-batch.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from insightspark.functions.columns import ratio

N = lambda: F.count(F.lit(1))

# Functions a metric expression may use.
METRIC_FUNCTIONS = {"sum", "avg", "min", "max", "count", "count_if", "approx_count_distinct", "try_divide", "nullif", "coalesce", "if", "abs", "round"}
_WORDS = re.compile(r"'[^']*'|[A-Za-z_][A-Za-z0-9_]*")
_KEYWORDS = {"and", "or", "not", "is", "null", "in", "between", "true", "false", "case", "when", "then", "else", "end", "distinct"}


@dataclass(frozen=True)
class Alert:
    """One alert definition.

    ``relative`` is a percentage with an optional side: ``"5"`` both ways,
    ``"5-"`` drops only, ``"5+"`` rises only, against the mean of ``data_points``
    values ``seasonality`` days apart (0 = the days just before).
    """

    name: str
    metric: str
    dims: tuple = ()
    where: str | None = None
    date: str = "day"
    lower: float | None = None
    upper: float | None = None
    relative: str | None = None
    data_points: int = 30
    seasonality: int = 0
    recovery: bool = False
    tags: tuple = field(default=())


def checked_expr(text: str, columns: list[str]):
    """Expression over known columns and listed aggregate functions only."""
    for word in _WORDS.findall(text):
        if word.startswith("'") or word.lower() in _KEYWORDS | METRIC_FUNCTIONS or word in columns:
            continue
        raise ValueError(f"'{word}' is neither a column nor an allowed function")
    if ";" in text or "--" in text:
        raise ValueError("statement separators are not allowed")
    return F.expr(text)


def metric_values(df: DataFrame, alerts: list[Alert]) -> DataFrame:
    """(alert, validation_date, dim1, dim2, value); alerts with the same grouping and filter share one scan."""
    groups: dict = {}
    for a in alerts:
        groups.setdefault((a.date, tuple(a.dims), a.where), []).append(a)
    frames = []
    for (date, dims, where), members in groups.items():
        src = df.where(checked_expr(where, df.columns)) if where else df
        g = src.groupBy(F.to_date(date).alias("validation_date"), *dims).agg(*[
            checked_expr(a.metric, df.columns).cast("double").alias(f"m{i}") for i, a in enumerate(members)])
        d = [F.col(x).cast("string") for x in dims] + [F.lit(None).cast("string")] * (2 - len(dims))
        frames.append(g.select("validation_date", d[0].alias("dim1"), d[1].alias("dim2"), F.inline(F.array(*[
            F.struct(F.lit(a.name).alias("alert"), F.col(f"m{i}").alias("value")) for i, a in enumerate(members)]))))
    return reduce(DataFrame.unionByName, frames).select("alert", "validation_date", "dim1", "dim2", "value")


def definitions(spark: SparkSession, alerts: list[Alert]) -> DataFrame:
    """Definitions as a table, one row per alert."""
    rows = []
    for a in alerts:
        pct, side = (None, None) if a.relative is None else (float(a.relative.rstrip("+-")), a.relative[-1] if a.relative[-1] in "+-" else "both")
        rows.append((a.name, a.lower, a.upper, pct, side, a.data_points, a.seasonality, a.recovery))
    return spark.createDataFrame(rows, "alert string, lower_limit double, upper_limit double, rel_pct double, rel_side string, data_points int, seasonality int, recovery boolean")


def absolute_status(values: DataFrame, defs: DataFrame) -> DataFrame:
    """FAIL below the lower or above the upper limit."""
    v = values.join(defs.select("alert", "lower_limit", "upper_limit"), "alert")
    bad = (F.col("value") < F.col("lower_limit")) | (F.col("value") > F.col("upper_limit"))
    return v.withColumn("status", F.when(F.coalesce(bad, F.lit(False)), "FAIL").otherwise("PASS"))


def relative_status(values: DataFrame, defs: DataFrame, min_points: int | None = None) -> DataFrame:
    """Compare each value with the mean of its baseline days.

    A value is sent forward to every day it is a baseline for, so the comparison
    is one aggregate and one equality join. Fewer baseline values than asked for
    give INSUFFICIENT.
    """
    d = defs.where("rel_pct IS NOT NULL")
    v = values.join(d, "alert")
    step = F.greatest(F.col("seasonality"), F.lit(1))
    ahead = v.select("alert", "dim1", "dim2", "value", F.explode(F.transform(F.sequence(F.lit(1), F.col("data_points")), lambda k: F.date_add("validation_date", (k * step).cast("int")))).alias("validation_date"))
    base = ahead.groupBy("alert", "dim1", "dim2", "validation_date").agg(F.avg("value").alias("baseline"), F.count("value").alias("n_points"))
    a, b = v.alias("a"), base.alias("b")
    j = a.join(b, (F.col("a.alert") == F.col("b.alert")) & F.col("a.dim1").eqNullSafe(F.col("b.dim1")) & F.col("a.dim2").eqNullSafe(F.col("b.dim2")) & (F.col("a.validation_date") == F.col("b.validation_date")), "left")
    out = j.select("a.*", "b.baseline", F.coalesce("b.n_points", F.lit(0)).alias("n_points"))
    dev = 100.0 * ratio(F.col("value") - F.col("baseline"), F.abs("baseline"))
    out = out.withColumn("deviation_pct", dev)
    over = ((F.col("rel_side") != "-") & (F.col("deviation_pct") > F.col("rel_pct"))) | ((F.col("rel_side") != "+") & (F.col("deviation_pct") < -F.col("rel_pct")))
    need = F.col("data_points") if min_points is None else F.lit(min_points)
    status = F.when(F.col("n_points") < need, "INSUFFICIENT").when(F.coalesce(over, F.lit(False)), "FAIL").otherwise("PASS")
    return out.select("alert", "validation_date", "dim1", "dim2", "value", "baseline", "n_points", "deviation_pct", status.alias("status"))


def flow_status(steps: DataFrame, flow: str, step: str, value: str, max_diff_pct: float, keys: list[str] = ()) -> DataFrame:
    """Ordered steps whose value differs from the step before by more than the limit."""
    prev = F.lag(value).over(W.partitionBy(flow, *keys).orderBy(step))
    s = steps.withColumn("previous", prev).withColumn("diff_pct", 100.0 * ratio(F.abs(F.col(value) - F.col("previous")), F.abs("previous")))
    return s.withColumn("status", F.when(F.coalesce(F.col("diff_pct") > max_diff_pct, F.lit(False)), "FAIL").otherwise("PASS"))


def recovery_filter(statuses: DataFrame) -> DataFrame:
    """First failure of a run and the first success after one."""
    w = W.partitionBy("alert", "dim1", "dim2").orderBy("validation_date")
    s = statuses.where("status IN ('PASS', 'FAIL')").withColumn("_p", F.coalesce(F.lag("status").over(w), F.lit("PASS")))
    fired = s.where(F.col("status") != F.col("_p"))
    return fired.withColumn("notice", F.when(F.col("status") == "FAIL", "FIRED").otherwise("RECOVERED")).drop("_p")


def intraday(df: DataFrame, ts: str, minutes: int, keys: list[str], aggs: dict) -> DataFrame:
    """Aggregates per bucket of minutes."""
    g = df.groupBy(F.window(ts, f"{int(minutes)} minutes").alias("_w"), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return g.select(F.col("_w.start").alias("bucket"), *keys, *aggs)


def seasonal_baseline(series: DataFrame, ts: str, value: str, keys: list[str], kind: str = "hour") -> DataFrame:
    """Value against the mean of the same hour over 7 days, or the same weekday over 4 weeks."""
    n, unit = (7, "INTERVAL 1 DAY") if kind == "hour" else (4, "INTERVAL 7 DAYS")
    ahead = reduce(DataFrame.unionByName, [series.select(*keys, (F.col(ts) + F.expr(unit) * k).cast(series.schema[ts].dataType).alias(ts), F.col(value).alias("_b")) for k in range(1, n + 1)])
    base = ahead.groupBy(*keys, ts).agg(F.avg("_b").alias("baseline"), N().alias("n_points"))
    return series.join(base, [*keys, ts]).withColumn("deviation_pct", 100.0 * ratio(F.col(value) - F.col("baseline"), F.abs("baseline")))


def volume_cliff(hourly: DataFrame, hour: str, value: str, drop: float = 0.6, first: int = 13, last: int = 19, keys: list[str] = ()) -> DataFrame:
    """Hour-over-hour drops in peak hours."""
    prev = F.lag(value).over(W.partitionBy(*keys, F.to_date(hour)).orderBy(hour))
    s = hourly.withColumn("previous", prev).withColumn("drop", 1 - ratio(value, "previous"))
    return s.where(F.hour(hour).between(first, last) & (F.col("drop") > drop))


def group_gap(rates: DataFrame, period: str, group: str, rate: str, limit: float = 0.15) -> DataFrame:
    """Largest minus smallest rate over groups per period."""
    g = rates.groupBy(period).agg(F.max(rate).alias("best"), F.min(rate).alias("worst"), F.min_by(group, rate).alias("worst_group"))
    return g.withColumn("gap", F.col("best") - F.col("worst")).withColumn("status", F.when(F.col("gap") > limit, "FAIL").otherwise("PASS"))


def lone_drop(rates: DataFrame, period: str, group: str, value: str, drop_pct: float, hold_pct: float) -> DataFrame:
    """Periods in which exactly one group drops while every other one holds."""
    prev = F.lag(value).over(W.partitionBy(group).orderBy(period))
    s = rates.withColumn("_c", 100.0 * ratio(F.col(value) - prev, F.abs(prev))).where("_c IS NOT NULL")
    g = s.groupBy(period).agg(F.count_if(F.col("_c") < -drop_pct).alias("n_drop"), F.count_if(F.col("_c") >= -hold_pct).alias("n_hold"), N().alias("n_groups"), F.min_by(group, "_c").alias("group"))
    return g.where("n_drop = 1 AND n_hold = n_groups - 1").select(period, "group")


def share_shift(df: DataFrame, period: str, group: str, n: str, max_share: float = 0.5, max_shift: float = 0.10) -> DataFrame:
    """Group shares per period, flagged when too large or moved too far."""
    s = df.withColumn("share", ratio(n, F.sum(n).over(W.partitionBy(period))))
    s = s.withColumn("shift", F.col("share") - F.lag("share").over(W.partitionBy(group).orderBy(period)))
    flag = F.when(F.col("share") > max_share, "SHARE").when(F.abs("shift") > max_shift, "SHIFT")
    return s.withColumn("flag", flag)


def zero_success(df: DataFrame, keys: list[str], success, min_attempts: int = 500) -> DataFrame:
    """Groups with many attempts and no success."""
    return df.groupBy(*keys).agg(N().alias("attempts"), F.count_if(success).alias("successes")).where((F.col("attempts") > min_attempts) & (F.col("successes") == 0))


def growth_over(series: DataFrame, keys: list[str], period: str, value: str, factor: float = 2.0) -> DataFrame:
    """Periods whose value is more than ``factor`` times the one before."""
    prev = F.lag(value).over(W.partitionBy(*keys).orderBy(period))
    return series.withColumn("previous", prev).where(F.col(value) > factor * F.col("previous"))


def new_values(current: DataFrame, history: DataFrame, column: str) -> DataFrame:
    """Values never seen before, with their rows."""
    return current.where(F.col(column).isNotNull()).groupBy(column).agg(N().alias("n")).join(history.select(column).distinct(), column, "left_anti")


def fixed_band(series: DataFrame, period: str, value: str, low: float | None = None, high: float | None = None, max_step_pct: float | None = None, drift_days: int | None = None, max_drift: float | None = None) -> DataFrame:
    """Band, daily step and drift-from-average flags of one series."""
    w = W.partitionBy(F.lit(0)).orderBy(period)
    s = series.withColumn("step_pct", 100.0 * ratio(F.col(value) - F.lag(value).over(w), F.abs(F.lag(value).over(w))))
    s = s.withColumn("drift", F.col(value) - F.avg(value).over(w.rowsBetween(-(drift_days or 30), -1)))
    no = F.lit(False)
    band = (F.col(value) < low if low is not None else no) | (F.col(value) > high if high is not None else no)
    step = F.abs("step_pct") > max_step_pct if max_step_pct is not None else no
    drift = F.abs("drift") > max_drift if max_drift is not None else no
    return s.withColumn("out_of_band", F.coalesce(band, no)).withColumn("big_step", F.coalesce(step, no)).withColumn("drifting", F.coalesce(drift, no))


def event_day_lift(daily: DataFrame, day: str, value: str, calendar: DataFrame, days_before: int = 14, min_lift: float = 1.10) -> DataFrame:
    """Value on the start day of each event over the mean of the days before."""
    off = calendar.select("event", "start", F.explode(F.sequence(F.lit(-days_before), F.lit(0))).alias("_o")).withColumn(day, F.date_add("start", F.col("_o")))
    g = daily.join(off, day).groupBy("event", "start").agg(F.max(F.when(F.col("_o") == 0, F.col(value))).alias("event_value"), F.avg(F.when(F.col("_o") < 0, F.col(value))).alias("prior_mean"), F.count_if(F.col("_o") < 0).alias("n_prior"))
    g = g.withColumn("lift", ratio("event_value", "prior_mean"))
    return g.withColumn("status", F.when(F.col("lift") >= min_lift, "PASS").when(F.col("lift").isNull(), "INSUFFICIENT").otherwise("FAIL"))
