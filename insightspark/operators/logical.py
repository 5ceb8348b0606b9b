"""Logical checks: totals, shares, order, trends, segments, balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insightspark.functions.checks import Probe, check_row, emit, run_probes, severity_scale, stack_rows, static_rows
from insightspark.functions.columns import ratio
from insightspark.operators.windows import by_period, rolling

N = lambda: F.count(F.lit(1))


def _pass(ok, otherwise="WARNING"):
    return F.when(ok, "PASS").otherwise(otherwise)


def relative_gap(expected, actual):
    """|expected - actual| over the larger-than-zero side, 0 when both are zero."""
    e, a = F.col(expected), F.col(actual)
    return F.coalesce(ratio(F.abs(e - a), F.when(e != 0, F.abs(e)).otherwise(F.abs(a))), F.lit(0.0))


def aggregation_total(detail: DataFrame, summary: DataFrame, metric: str, tolerance: float = 0.01) -> DataFrame:
    """Total of the detail against the total of the summary."""
    e = detail.agg(F.coalesce(F.sum(metric), F.lit(0)).cast("double").alias("expected"))
    a = summary.agg(F.coalesce(F.sum(metric), F.lit(0)).cast("double")).scalar()
    gap = relative_gap("expected", "actual")
    ok = gap <= tolerance
    return emit(e.withColumn("actual", a), [check_row("aggregation_total", metric, ok, _pass(ok, "BLOCKER"), gap, str(tolerance))])


def aggregation_by_group(detail: DataFrame, summary: DataFrame, keys: list[str], metric: str, tolerance: float = 0.01) -> DataFrame:
    """Groups whose recomputed total differs from the summary; a missing side or more than 5 % is a BLOCKER."""
    d = detail.groupBy(*keys).agg(F.sum(metric).cast("double").alias("expected"))
    s = summary.select(*keys, F.col(metric).cast("double").alias("actual"))
    both = d.join(s, keys, "full_outer")
    gap = F.when(F.col("expected").isNotNull() & F.col("actual").isNotNull(), relative_gap("expected", "actual"))
    out = both.withColumn("diff_pct", gap)
    sev = (F.when(F.col("diff_pct").isNull() | (F.col("diff_pct") > 0.05), "BLOCKER").when(F.col("diff_pct") > tolerance, "WARNING").otherwise("PASS"))
    return out.withColumn("severity", sev).where("severity <> 'PASS'")


def pct_sum(df: DataFrame, pct: str, keys: list[str] = (), expected: float = 100.0, tolerance: float = 1.0) -> DataFrame:
    """Sum of percentages, the worst group when keys are given."""
    per = (df.groupBy(*keys) if keys else df.groupBy()).agg(F.sum(pct).alias("_s"))
    one = per.agg(F.max_by("_s", F.abs(F.col("_s") - expected)).alias("s"), F.max(F.abs(F.col("_s") - expected)).alias("gap"))
    ok = F.coalesce(F.col("gap") <= tolerance, F.lit(True))
    return emit(one, [check_row("pct_sum", pct, ok, _pass(ok, "BLOCKER"), F.col("s"), f"{expected:g}")])


def monotonic(series: DataFrame, order: str, value: str, direction: str = "increasing", strict: bool = False, keys: list[str] = ()) -> DataFrame:
    """Violations of the order of an aggregated series and where the first one is."""
    d = F.col(value) - F.lag(value).over(by_period(list(keys), order))
    bad = {("increasing", False): d < 0, ("increasing", True): d <= 0, ("decreasing", False): d > 0, ("decreasing", True): d >= 0}[(direction, strict)]
    marked = series.where(F.col(value).isNotNull()).withColumn("_bad", F.coalesce(bad, F.lit(False)))
    one = (marked.groupBy(*keys) if keys else marked.groupBy()).agg(
        F.count_if("_bad").alias("n"), F.min(F.when(F.col("_bad"), F.col(order))).alias("first"))
    ok = F.col("n") == 0
    return emit(one, [check_row("monotonic", value, ok, _pass(ok), F.col("n"), direction, F.col("first"))], tuple(keys))


def trend_zscore(series: DataFrame, order: str, value: str, window: int = 3, max_z: float = 3.0) -> DataFrame:
    """Points far from the mean of the previous ``window`` points (zero deviation skipped)."""
    r = rolling(series, [], order, value, window, window, lagged=True)
    z = ratio(F.abs(F.col(value) - F.col("roll_mean")), "roll_std")
    return r.withColumn("z", z).where(F.col("z") > max_z).select(order, value, "roll_mean", "roll_std", "z")


def segment_probe(segment: str, metric: str) -> Probe:
    aggs = {"_seg_t": F.coalesce(F.sum(metric), F.lit(0)).cast("double"),
            "_seg_s": F.coalesce(F.sum(F.when(F.col(segment).isNotNull(), F.col(metric))), F.lit(0)).cast("double"),
            "_seg_m": F.count_if(F.col(segment).isNull())}

    def build():
        gap = relative_gap("_seg_t", "_seg_s")
        sev = F.when((gap > 0.01) | (F.col("_seg_m") > 0), "BLOCKER").when(gap > 0.001, "WARNING").otherwise("PASS")
        return [check_row("segment_exhaustive", segment, sev == "PASS", sev, gap, "0.001", F.col("_seg_m"))]
    return Probe(aggs, build)


def segment_exhaustive(df, segment, metric) -> DataFrame:
    """Segments must cover all rows and the whole metric."""
    return run_probes(df, [segment_probe(segment, metric)])


def ratio_probe(num: str, den: str, low: float = 0.0, high: float = 1.0) -> Probe:
    r = ratio(num, den)
    out = (r < low) | (r > high)
    aggs = {"_rb_out": F.count_if(out), "_rb_n": F.count(r)}

    def build():
        ok = F.col("_rb_out") == 0
        return [check_row("ratio_bounds", f"{num}/{den}", ok, _pass(ok), F.col("_rb_out"), f"{low:g}..{high:g}", F.col("_rb_n"))]
    return Probe(aggs, build)


def ratio_bounds(df, num, den, low=0.0, high=1.0) -> DataFrame:
    return run_probes(df, [ratio_probe(num, den, low, high)])


def group_balance(df: DataFrame, group: str, min_size: int = 10, max_ratio: float = 100.0) -> DataFrame:
    """Smallest group and largest-to-smallest ratio."""
    per = df.where(F.col(group).isNotNull()).groupBy(group).agg(N().alias("_n"))
    one = per.agg(F.min("_n").alias("lo"), F.max("_n").alias("hi"))
    r = ratio("hi", "lo")
    ok = F.coalesce((F.col("lo") >= min_size) & (r <= max_ratio), F.lit(True))
    return emit(one, [check_row("group_balance", group, ok, _pass(ok), F.round(r, 4), f"{max_ratio:g}", F.col("lo"))])


def future_probe(day: str, as_of: str) -> Probe:
    aggs = {f"_fut_{day}": F.count_if(F.to_date(day) > F.lit(as_of).cast("date"))}

    def build():
        ok = F.col(f"_fut_{day}") == 0
        return [check_row("future_dates", day, ok, _pass(ok), F.col(f"_fut_{day}"), as_of)]
    return Probe(aggs, build)


def future_dates(df, day, as_of) -> DataFrame:
    return run_probes(df, [future_probe(day, as_of)])


def step_changes(series: DataFrame, order: str, value: str, limit: float, keys: list[str] = ()) -> DataFrame:
    """Relative steps above ``limit``; a step away from zero counts as infinite."""
    prev = F.lag(value).over(by_period(list(keys), order))
    s = series.where(F.col(value).isNotNull()).withColumn("previous", prev.cast("double"))
    change = (F.when((F.col("previous") == 0) & (F.col(value) != 0), F.lit(float("inf")))
               .otherwise(ratio(F.abs(F.col(value) - F.col("previous")), F.abs("previous"))))
    return s.withColumn("change", change).where(F.col("change") > limit)


def trend_continuity(series: DataFrame, order: str, value: str, max_gap: float = 0.5) -> DataFrame:
    """1-2 breaks WARNING, more BLOCKER."""
    one = step_changes(series, order, value, max_gap).agg(N().alias("n"))
    sev = severity_scale(F.col("n"), 2, 0)
    return emit(one, [check_row("trend_continuity", value, F.col("n") == 0, sev, F.col("n"), str(max_gap))])


def temporal_consistency(df: DataFrame, day: str, metric: str, unit: str = "day") -> DataFrame:
    """Missing, duplicate and zero dates; duplicates or more than 10 % issues are a BLOCKER.

    The first and last row (by date) are left out of the zero test.
    """
    per = df.select(F.date_trunc(unit, F.col(day)).cast("date").alias("d"), F.col(metric).alias("_v")).groupBy("d").agg(
        N().alias("_n"), F.count_if(F.col("_v").isNull() | (F.col("_v") == 0)).alias("_z"))
    edge = per.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    span = {"day": F.date_diff("b", "a") + 1, "week": F.floor(F.date_diff("b", "a") / 7) + 1,
            "month": (F.year("b") - F.year("a")) * 12 + F.month("b") - F.month("a") + 1}[unit]
    e = edge.select(F.struct("a", "b", span.alias("expected")).alias("e")).scalar()
    one = per.withColumn("_e", e).agg(
        F.max("_e.expected").alias("expected"), F.count(F.lit(1)).alias("actual"), F.count_if(F.col("_n") > 1).alias("dups"),
        F.coalesce(F.sum(F.when((F.col("d") != F.col("_e.a")) & (F.col("d") != F.col("_e.b")), F.col("_z"))), F.lit(0)).alias("zeros"))
    miss = F.coalesce(F.col("expected") - F.col("actual"), F.lit(0))
    issues = miss + F.col("dups") + F.col("zeros")
    rate = F.coalesce(ratio(issues, "expected"), F.lit(0.0))
    sev = F.when((F.col("dups") > 0) | (rate > 0.1), "BLOCKER").when(issues > 0, "WARNING").otherwise("PASS")
    return emit(one, [check_row(f"temporal_{n}", day, sev == "PASS", sev, v, "0") for n, v in
                      (("missing", miss), ("duplicates", F.col("dups")), ("zeros", F.col("zeros")))])


def run_logical(df: DataFrame, config: dict, summary: DataFrame | None = None) -> DataFrame:
    """Configured logical checks; ok only when at least one check ran.

    Keys: segment (segment, metric), ratio (num, den), future (day, as_of),
    balance (group), total (metric, needs ``summary``), temporal (day, metric).
    """
    probes, frames = [], []
    if "segment" in config:
        probes.append(segment_probe(*config["segment"]))
    if "ratio" in config:
        probes.append(ratio_probe(*config["ratio"]))
    if "future" in config:
        probes.append(future_probe(*config["future"]))
    if probes:
        frames.append(run_probes(df, probes))
    if "balance" in config:
        frames.append(group_balance(df, config["balance"]))
    if "total" in config and summary is not None:
        frames.append(aggregation_total(df, summary, config["total"]))
    if "temporal" in config:
        frames.append(temporal_consistency(df, *config["temporal"]))
    if not frames:
        return static_rows(df.sparkSession, [("logical", "*", False, "WARNING", 0.0, "1", "no check ran")])
    return stack_rows(frames)
