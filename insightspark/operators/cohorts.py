"""Cohorts, retention and reactivation.

Facts are reduced to one row per user and period first. Offsets to a user's
first period come from a window over those rows, so every Dx shares one shuffle
and no distinct count is needed afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from insightspark.functions.columns import ratio
from insightspark.functions.scalars import months_between_calendar, week_start, weeks_between
from insightspark.operators.statistics import mean_ci
from insightspark.operators.windows import by_period

N = lambda: F.count(F.lit(1))


def user_days(df: DataFrame, user: str, ts: str, measures: dict[str, Column] | None = None) -> DataFrame:
    """One row per user and active day with summed measures."""
    aggs = [F.sum(c).alias(n) for n, c in (measures or {}).items()] or [N().alias("n_events")]
    return df.where(F.col(user).isNotNull()).groupBy(F.col(user).alias("user_id"), F.to_date(ts).alias("day")).agg(*aggs)


def with_anchor(days: DataFrame, period: str = "day") -> DataFrame:
    """Add the user's first period as ``anchor``."""
    return days.withColumn("anchor", F.min(period).over(W.partitionBy("user_id")))


def _offset(period: str, unit: str) -> Column:
    if unit == "month":
        return months_between_calendar(period, "anchor")
    if unit == "week":
        return weeks_between(period, "anchor")
    return F.date_diff(F.col(period), F.col("anchor"))


def cohort_assign(df: DataFrame, user: str, ts: str, unit: str = "month", min_size: int = 50) -> DataFrame:
    """Cohort sizes by first period; cohorts below ``min_size`` are flagged."""
    first = df.where(F.col(user).isNotNull()).groupBy(user).agg(F.date_trunc(unit, F.min(ts)).cast("date").alias("cohort"))
    return first.groupBy("cohort").agg(N().alias("cohort_size")).withColumn("small", F.col("cohort_size") < min_size)


def _user_periods(df, user, ts, unit, value=None):
    agg = N().alias("n_events") if value is None else F.sum(value).alias("value")
    p = df.where(F.col(user).isNotNull()).groupBy(F.col(user).alias("user_id"), F.date_trunc(unit, F.col(ts)).cast("date").alias("period")).agg(agg)
    return with_anchor(p, "period").withColumn("offset", _offset("period", unit).cast("int"))


def _offset_grid(p: DataFrame, sizes: DataFrame, unit: str, max_offset: int | None) -> DataFrame:
    """Every cohort with every offset up to the longest span observed (or ``max_offset``), and the last period."""
    ends = p.agg(F.min("anchor").alias("anchor"), F.max("period").alias("_last")).withColumn("_span", _offset("_last", unit).cast("int"))
    top = ends.select("_span").scalar() if max_offset is None else F.lit(max_offset)
    return sizes.withColumn("offset", F.explode(F.sequence(F.lit(0), top))).withColumn("_last", ends.select("_last").scalar()).withColumn("anchor", F.col("cohort"))


def retention_matrix(df: DataFrame, user: str, ts: str, unit: str = "month", max_offset: int | None = None) -> DataFrame:
    """(cohort, offset, active, size, retention) for every offset in the span of the data, or up to ``max_offset`` if given.

    Offsets a cohort has not reached yet are NULL, reached ones without activity 0.
    """
    p = _user_periods(df, user, ts, unit)
    hits = p.groupBy(F.col("anchor").alias("cohort"), "offset").agg(N().alias("active"))
    sizes = hits.where("offset = 0").select("cohort", F.col("active").alias("cohort_size"))
    grid = _offset_grid(p, sizes, unit, max_offset)
    reached = F.col("offset") <= _offset("_last", unit)
    out = grid.join(hits, ["cohort", "offset"], "left")
    active = F.when(reached, F.coalesce(F.col("active"), F.lit(0)))
    return out.select("cohort", "offset", "cohort_size", active.alias("active"), ratio(active, "cohort_size").alias("retention"))


def retention_wide(matrix: DataFrame, max_offset: int) -> DataFrame:
    """One row per cohort, one column per offset."""
    return matrix.groupBy("cohort", "cohort_size").pivot("offset", list(range(max_offset + 1))).agg(F.max("retention"))


def aggregate_curve(matrix: DataFrame, min_size: int = 50, with_ci: bool = True) -> DataFrame:
    """Mean retention per offset over reached cohorts of enough users, with a t interval."""
    return mean_ci(matrix.where((F.col("cohort_size") >= min_size) & F.col("retention").isNotNull()), ["offset"], "retention", with_ci=with_ci)


def cohort_trend(matrix: DataFrame, offsets: list[int]) -> DataFrame:
    """Slope of retention across cohorts at key offsets and cohorts beyond two deviations."""
    m = matrix.where(F.col("offset").isin(offsets) & F.col("retention").isNotNull())
    s = m.withColumn("i", F.row_number().over(W.partitionBy("offset").orderBy("cohort")))
    g = s.groupBy("offset").agg(F.regr_slope("retention", "i").alias("slope"), F.avg("retention").alias("mean"), F.stddev_samp("retention").alias("std"), N().alias("n_cohorts"))
    out = m.join(g, "offset").groupBy("offset").agg(F.count_if(F.abs(F.col("retention") - F.col("mean")) > 2 * F.col("std")).alias("n_outliers"))
    return g.join(out, "offset")


def cohort_ltv(df: DataFrame, user: str, ts: str, value: str, unit: str = "month", max_offset: int | None = None) -> DataFrame:
    """Cumulative revenue per starting user by cohort and offset, for reached offsets."""
    p = _user_periods(df, user, ts, unit, value)
    hits = p.groupBy(F.col("anchor").alias("cohort"), "offset").agg(N().alias("active"), F.sum("value").alias("v"))
    sizes = hits.where("offset = 0").select("cohort", F.col("active").alias("cohort_size"))
    grid = _offset_grid(p, sizes, unit, max_offset)
    out = grid.where(F.col("offset") <= _offset("_last", unit)).join(hits.select("cohort", "offset", "v"), ["cohort", "offset"], "left")
    cum = F.sum(F.coalesce("v", F.lit(0.0))).over(by_period(["cohort"], "offset").rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("ltv", cum / F.col("cohort_size")).select("cohort", "offset", "cohort_size", "ltv")


def ltv_maturity(ltv: DataFrame, share: float = 0.8) -> DataFrame:
    """First offset at which a cohort has reached ``share`` of its last observed value."""
    w = W.partitionBy("cohort")
    final = F.max_by("ltv", "offset").over(w)
    return ltv.withColumn("final_ltv", final).groupBy("cohort").agg(
        F.max("final_ltv").alias("final_ltv"), F.min(F.when(F.col("ltv") >= share * F.col("final_ltv"), F.col("offset"))).alias("maturity_offset"))


def mature_benchmark(matrix: DataFrame, n: int = 3, gap: float = 0.05) -> DataFrame:
    """Mean of the ``n`` oldest cohorts per offset they have reached, and cohorts that deviate by more than ``gap``."""
    oldest = matrix.select("cohort").distinct().orderBy("cohort").limit(n)
    bench = matrix.join(oldest, "cohort").groupBy("offset").agg(F.avg("retention").alias("benchmark"))
    out = matrix.where("retention IS NOT NULL").join(bench, "offset").withColumn("deviation", F.col("retention") - F.col("benchmark"))
    return out.withColumn("flag", F.abs("deviation") > gap)


def dx_retention(days: DataFrame, offsets: list[int], as_of: str, keys: list[str] = ()) -> DataFrame:
    """Dx retention per offset: users active exactly X days after their first day over mature users.

    ``days`` has one row per (user_id, day). A user counts for X once X + 1 days
    have passed since the anchor.
    """
    a = with_anchor(days).withColumn("_off", F.date_diff("day", "anchor")).withColumn("_age", F.date_diff(F.lit(as_of).cast("date"), F.col("anchor")))
    aggs = []
    for x in offsets:
        ok = F.col("_age") > x
        aggs += [F.count_if((F.col("_off") == 0) & ok).alias(f"m{x}"), F.count_if((F.col("_off") == x) & ok).alias(f"r{x}")]
    g = (a.groupBy(*keys) if keys else a.groupBy()).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(x).alias("offset"), F.col(f"m{x}").alias("mature_users"), F.col(f"r{x}").alias("retained"), ratio(f"r{x}", f"m{x}").alias("retention")) for x in offsets])
    return g.select(*keys, F.inline(rows))


def dx_value(days: DataFrame, offsets: list[int], as_of: str, value: str = "revenue", keys: list[str] = ()) -> DataFrame:
    """Cumulative value per starting user and share of users with any value, through day X."""
    a = with_anchor(days).withColumn("_off", F.date_diff("day", "anchor")).withColumn("_age", F.date_diff(F.lit(as_of).cast("date"), F.col("anchor")))
    per = a.groupBy(*keys, "user_id").agg(F.max("_age").alias("_age"), *[F.sum(F.when(F.col("_off") <= x, F.col(value))).alias(f"v{x}") for x in offsets])
    aggs = []
    for x in offsets:
        ok = F.col("_age") > x
        aggs += [F.count_if(ok).alias(f"m{x}"), F.sum(F.when(ok, F.col(f"v{x}"))).alias(f"s{x}"), F.count_if(ok & (F.col(f"v{x}") > 0)).alias(f"c{x}")]
    g = (per.groupBy(*keys) if keys else per.groupBy()).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(x).alias("offset"), F.col(f"m{x}").alias("mature_users"), ratio(f"s{x}", f"m{x}").alias("arpi"), ratio(f"c{x}", f"m{x}").alias("conversion")) for x in offsets])
    return g.select(*keys, F.inline(rows))


def anchored_metrics(days: DataFrame, offsets: list[int], measures: list[str], as_of: str, keys: list[str] = ()) -> DataFrame:
    """Sums of several measures within X days of the anchor over mature users, one pass for all X."""
    a = with_anchor(days).withColumn("_off", F.date_diff("day", "anchor")).withColumn("_age", F.date_diff(F.lit(as_of).cast("date"), F.col("anchor")))
    aggs = []
    for x in offsets:
        ok = F.col("_age") > x
        aggs.append(F.count_if((F.col("_off") == 0) & ok).alias(f"baked_{x}"))
        aggs += [F.sum(F.when(ok & (F.col("_off") <= x), F.col(m)).otherwise(0)).alias(f"{m}_{x}") for m in measures]
    return (a.groupBy(*keys) if keys else a.groupBy()).agg(*aggs)


def reactivations(days: DataFrame, min_gap: int, min_tenure: int = 30) -> DataFrame:
    """User-days that follow at least ``min_gap`` silent days, with gap, tenure and prior count.

    Windows run per user over distinct active days, at most one row per day.
    """
    w = W.partitionBy("user_id").orderBy("day")
    d = with_anchor(days).withColumn("gap", F.date_diff(F.col("day"), F.lag("day").over(w)) - 1).withColumn("tenure", F.date_diff("day", "anchor"))
    hit = (F.col("gap") >= min_gap) & (F.col("tenure") >= min_tenure)
    d = d.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    prior = F.coalesce(F.sum(F.when(F.col("_hit"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("prior_reactivations", prior).where("_hit").drop("_hit")


def forward_window(days: DataFrame, value: str, span: int = 7) -> DataFrame:
    """Add value of the next ``span`` days (today included) and whether the user is active exactly then."""
    n = F.date_diff(F.col("day"), F.lit("1970-01-01").cast("date"))
    w = W.partitionBy("user_id").orderBy(n)
    return (days.withColumn("value_ahead", F.sum(value).over(w.rangeBetween(0, span)))
                .withColumn("active_then", F.count(F.lit(1)).over(w.rangeBetween(span, span)) > 0))


def weekly_scorecard(days: DataFrame, flags: DataFrame, as_of: str, min_gap: int, min_tenure: int, repeat: int = 5, value: str = "revenue") -> DataFrame:
    """Weekly reactivated users with D7 retention, conversion, ARPI, repeat and suspicious share, week over week.

    ``flags`` holds one row per user with ``suspicious``. The suspicious share is
    taken over everyone, the other figures over the clean population. Only weeks
    whose 7-day window has passed are reported.
    """
    r = reactivations(forward_window(days, value), min_gap, min_tenure)
    r = r.where(F.date_diff(F.lit(as_of).cast("date"), F.col("day")) > 7).join(flags, "user_id", "left").withColumn("week", week_start("day"))
    bad = F.coalesce(F.col("suspicious"), F.lit(False))
    one = r.groupBy("week", "user_id").agg(F.max(bad).alias("_bad"), F.max("active_then").alias("_ret"), F.max(F.col("value_ahead") > 0).alias("_conv"),
                                           F.sum("value_ahead").alias("_rev"), F.max(F.col("prior_reactivations") >= repeat).alias("_rep"))
    ok = ~F.col("_bad")
    g = one.groupBy("week").agg(
        F.count_if(ok).alias("reactivated_users"), F.count_if(ok & F.col("_ret")).alias("a"), F.count_if(ok & F.col("_conv")).alias("b"),
        F.sum(F.when(ok, F.col("_rev"))).alias("c"), F.count_if(ok & F.col("_rep")).alias("d"), F.count_if("_bad").alias("e"), N().alias("n"))
    out = g.select("week", "reactivated_users", ratio("a", "reactivated_users").alias("d7_retention"), ratio("b", "reactivated_users").alias("d7_conversion"),
                   ratio("c", "reactivated_users").alias("d7_arpi"), ratio("d", "reactivated_users").alias("repeat_share"), ratio("e", "n").alias("suspicious_share"))
    prev = F.lag("reactivated_users").over(by_period([], "week"))
    return out.withColumn("users_wow", ratio(F.col("reactivated_users") - prev, prev))


def mix_over_time(df: DataFrame, period: str, bucket: str) -> DataFrame:
    """Share of each bucket per period."""
    g = df.groupBy(period, bucket).agg(N().alias("n"))
    return g.withColumn("share", ratio("n", F.sum("n").over(W.partitionBy(period))))


def retention_by_bucket(rows: DataFrame, keys: list[str], week: str, flag: str, weeks_back: int = 4) -> DataFrame:
    """Weekly rate of ``flag`` per key against the average of the previous weeks."""
    g = rows.groupBy(*keys, week).agg(N().alias("n"), F.count_if(flag).alias("hit")).withColumn("rate", ratio("hit", "n"))
    prev = F.avg("rate").over(by_period(keys, week).rowsBetween(-weeks_back, -1))
    return g.withColumn("prior_avg", prev).withColumn("delta", F.col("rate") - F.col("prior_avg"))


def cohort_table_retention(table: DataFrame, age: str, users: str, active: dict[int, str], keys: list[str] = ()) -> DataFrame:
    """Σ active_dX over Σ users old enough for X, from pre-aggregated rows."""
    aggs = []
    for x, c in active.items():
        aggs += [F.sum(F.when(F.col(age) >= x, F.col(c))).alias(f"a{x}"), F.sum(F.when(F.col(age) >= x, F.col(users))).alias(f"u{x}")]
    g = (table.groupBy(*keys) if keys else table.groupBy()).agg(*aggs)
    return g.select(*keys, *[ratio(f"a{x}", f"u{x}").alias(f"d{x}_retention") for x in active])
