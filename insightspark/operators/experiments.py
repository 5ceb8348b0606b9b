"""Experiment readouts and quasi-experiments, built on the two-step statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from insightspark.functions.columns import clean, ratio
from insightspark.functions.dist import chi2_sf_udf, norm_cdf_udf, norm_ppf
from insightspark.operators import statistics as S
from insightspark.operators.windows import by_period

N = lambda: F.count(F.lit(1))


def unpivot_kpis(df: DataFrame, kpis: list[str], keep: list[str]) -> DataFrame:
    """(keep, kpi, value) rows, NULL values left out."""
    long = df.select(*keep, F.inline(F.array(*[F.struct(F.lit(k).alias("kpi"), clean(k).alias("value")) for k in kpis])))
    return long.where("value IS NOT NULL")


def srm_check(df: DataFrame, arm: str, split: dict, with_p: bool = True) -> DataFrame:
    """Sample ratio mismatch: group sizes against the planned split."""
    total = float(sum(split.values()))
    sizes = df.where(F.col(arm).isin(list(split))).groupBy(arm).agg(N().alias("observed"))
    n = sizes.agg(F.sum("observed")).scalar()
    share = reduce(lambda c, kv: c.when(F.col(arm) == kv[0], kv[1] / total), list(split.items())[1:], F.when(F.col(arm) == list(split)[0], list(split.values())[0] / total))
    e = sizes.withColumn("expected", share * n)
    one = e.agg(F.sum((F.col("observed") - F.col("expected")) ** 2 / F.col("expected")).alias("chi2"), (N() - 1).cast("double").alias("dof"), F.sum("observed").alias("n"))
    if not with_p:
        return one
    return one.withColumn("p_value", chi2_sf_udf("chi2", "dof")).withColumn("mismatch", F.col("p_value") < 0.01)


def covariate_balance(df: DataFrame, arm: str, numeric: list[str], categorical: list[str], a, b, with_p: bool = True) -> DataFrame:
    """Welch t per numeric and chi² per categorical covariate."""
    num = S.welch_t(S.arm_stats(unpivot_kpis(df, numeric, [arm]), ["kpi"], arm, "value", a, b), with_p=with_p)
    cols = ["covariate", "test", "stat"] + (["p_value"] if with_p else [])
    num = num.withColumn("covariate", F.col("kpi")).withColumn("test", F.lit("welch")).withColumn("stat", F.col("t_stat")).select(*cols)
    long = df.where(F.col(arm).isin([a, b])).select(arm, F.inline(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("string").alias("v")) for c in categorical])))
    cat = S.chi_squared(long, arm, "v", ["covariate"], with_p).withColumn("test", F.lit("chi2")).withColumn("stat", F.col("chi2")).select(*cols)
    return num.unionByName(cat)


def readout(df: DataFrame, arm: str, kpis: list[str], a, b, keys: list[str] = (), alpha: float = 0.05, with_p: bool = True) -> DataFrame:
    """Per KPI: control, variant, difference, lift, interval and verdict, in one scan."""
    k = [*keys, "kpi"]
    w = S.welch_t(S.arm_stats(unpivot_kpis(df, kpis, [*keys, arm]), k, arm, "value", a, b), alpha, with_p)
    out = w.withColumn("control", F.col("mean_a")).withColumn("variant", F.col("mean_b")).withColumn("lift_pct", 100.0 * ratio("diff", F.abs("mean_a")))
    cols = [*k, "n_a", "n_b", "control", "variant", "diff", "lift_pct", "t_stat"]
    return out.select(*cols, *(["ci_low", "ci_high", "p_value", "significant"] if with_p else []))


def hetero_effects(df: DataFrame, arm: str, kpis: list[str], segment: str, a, b, with_p: bool = True) -> DataFrame:
    """Readout per segment value and whether it runs with or against the overall effect."""
    seg = readout(df, arm, kpis, a, b, [segment], with_p=with_p)
    overall = readout(df, arm, kpis, a, b, with_p=False).select("kpi", F.col("diff").alias("overall_diff"))
    j = seg.join(overall, "kpi")
    s = F.signum("diff") * F.signum("overall_diff")
    return j.withColumn("direction", F.when(s > 0, "same").when(s < 0, "reversed").otherwise("flat"))


def effect_over_time(df: DataFrame, arm: str, week: str, metric: str, a, b) -> DataFrame:
    """Lift per week, with the change from the first to the last week as novelty."""
    g = S.arm_stats(df, [week], arm, metric, a, b)
    out = g.select(week, "n_a", "n_b", "mean_a", "mean_b", (F.col("mean_b") - F.col("mean_a")).alias("diff"), (100.0 * ratio(F.col("mean_b") - F.col("mean_a"), F.abs("mean_a"))).alias("lift_pct"))
    w = W.partitionBy(F.lit(0)).orderBy(week).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return out.withColumn("novelty", F.last("lift_pct").over(w) - F.first("lift_pct").over(w))


def posthoc_power(stats: DataFrame, alpha: float = 0.05, with_power: bool = True) -> DataFrame:
    """Smallest detectable effect at the sample seen, and the power for the observed effect."""
    w = S.welch_t(stats, with_p=False)
    out = w.withColumn("mde_absolute", F.lit(S.power_z(alpha, 0.8)) * F.col("se")).withColumn("observed_z", F.abs(ratio("diff", "se")))
    if with_power:
        z = norm_ppf(1 - alpha / 2)
        out = out.withColumn("power", norm_cdf_udf(F.col("observed_z") - F.lit(z)) + norm_cdf_udf(-F.col("observed_z") - F.lit(z)))
    return out


def diff_in_diff(df: DataFrame, group: str, period: str, metric: str, order: str, treated="treated", post="post") -> DataFrame:
    """(Tpost - Tpre) - (Cpost - Cpre) and the difference of the pre-period slopes."""
    is_t, is_post = F.col(group) == treated, F.col(period) == post
    m = lambda c: F.avg(F.when(c, F.col(metric)))
    slope = lambda c: F.regr_slope(F.when(c, F.col(metric)), F.when(c, F.col(order)))
    one = df.agg(m(is_t & ~is_post).alias("t_pre"), m(is_t & is_post).alias("t_post"), m(~is_t & ~is_post).alias("c_pre"), m(~is_t & is_post).alias("c_post"),
                 slope(is_t & ~is_post).alias("t_slope"), slope(~is_t & ~is_post).alias("c_slope"))
    return one.withColumn("did", (F.col("t_post") - F.col("t_pre")) - (F.col("c_post") - F.col("c_pre"))).withColumn("pre_trend_gap", F.col("t_slope") - F.col("c_slope"))


def pre_post(df: DataFrame, day: str, change_day: str, window: int, metric: str, with_p: bool = True) -> DataFrame:
    """Mean difference between equal windows before and after a change."""
    off = F.date_diff(F.col(day), F.lit(change_day).cast("date"))
    d = df.withColumn("_side", F.when(off.between(-window, -1), "pre").when(off.between(0, window - 1), "post")).where("_side IS NOT NULL")
    return S.welch_t(S.arm_stats(d, [], "_side", metric, "pre", "post"), with_p=with_p)


def interrupted_series(series: DataFrame, order: str, value: str, change) -> DataFrame:
    """Fit the trend before ``change``, project it and report the excess per period."""
    x = F.row_number().over(by_period([], order))
    s = series.withColumn("x", x)
    pre = F.col(order) < F.lit(change)
    fit = s.agg(F.struct(F.regr_slope(F.when(pre, F.col(value)), F.when(pre, F.col("x"))).alias("b"), F.regr_intercept(F.when(pre, F.col(value)), F.when(pre, F.col("x"))).alias("a")))
    out = s.withColumn("_f", fit.scalar()).where(~pre)
    exp = F.col("_f.a") + F.col("_f.b") * F.col("x")
    return out.select(order, F.col(value).cast("double").alias("actual"), exp.alias("expected"), (F.col(value) - exp).alias("excess"))


def matched_strata(df: DataFrame, strata: list[str], arm: str, metric: str, treated, control) -> DataFrame:
    """Compare arms inside exact covariate strata, weighted by treated units; strata with one arm are reported, not hidden."""
    g = df.groupBy(*strata).agg(
        F.count(F.when(F.col(arm) == treated, F.col(metric))).alias("nt"), F.count(F.when(F.col(arm) == control, F.col(metric))).alias("nc"),
        F.avg(F.when(F.col(arm) == treated, F.col(metric))).alias("mt"), F.avg(F.when(F.col(arm) == control, F.col(metric))).alias("mc"))
    ok = (F.col("nt") > 0) & (F.col("nc") > 0)
    return g.agg(F.count_if(ok).alias("n_strata"), F.count_if(~ok).alias("n_unmatched"), F.sum(F.when(ok, F.col("nt"))).alias("n_treated"),
                 ratio(F.sum(F.when(ok, F.col("nt") * (F.col("mt") - F.col("mc")))), F.sum(F.when(ok, F.col("nt")))).alias("att"))


def propensity_strata(df: DataFrame, covariates: list[str], arm: str, metric: str, treated, control, buckets: int = 5) -> DataFrame:
    """Logistic propensity score cut into equal-width buckets, then compared per bucket.

    Rows with a NULL covariate have no score; they are the bucket -1.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = df.where(F.col(arm).isin([treated, control])).withColumn("label", F.when(F.col(arm) == treated, 1.0).otherwise(0.0))
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in covariates])
    vec = VectorAssembler(inputCols=covariates, outputCol="features").transform(d.where(whole))
    scored = LogisticRegression(maxIter=25, regParam=0.01).fit(vec).transform(vec)
    p = scored.withColumn("score", vector_to_array("probability")[1])
    lo = p.agg(F.struct(F.min("score").alias("a"), F.max("score").alias("b"))).scalar()
    p = p.withColumn("_e", lo)
    width = (F.col("_e.b") - F.col("_e.a")) / buckets
    p = p.withColumn("bucket", F.when(width > 0, F.least(F.floor((F.col("score") - F.col("_e.a")) / width), F.lit(buckets - 1))).otherwise(0)).select("bucket", "label", metric)
    p = p.unionByName(d.where(~F.coalesce(whole, F.lit(False))).select(F.lit(-1).cast("long").alias("bucket"), "label", metric))
    return p.groupBy("bucket").agg(F.count_if(F.col("label") == 1).alias("n_treated"), F.count_if(F.col("label") == 0).alias("n_control"),
                                   (F.avg(F.when(F.col("label") == 1, F.col(metric))) - F.avg(F.when(F.col("label") == 0, F.col(metric)))).alias("diff"))


def business_impact(df: DataFrame, low: str, mid: str, high: str, volume: str, value: str) -> DataFrame:
    """Interval of an effect turned into value: effect × volume × value per unit."""
    f = F.col(volume) * F.col(value)
    return df.withColumn("impact_low", F.col(low) * f).withColumn("impact_mid", F.col(mid) * f).withColumn("impact_high", F.col(high) * f)


def decision_rule(df: DataFrame, primary: str, guardrail: str) -> DataFrame:
    """SHIP, INVESTIGATE or DON'T SHIP from the primary outcome and the guardrail state."""
    good, held = F.col(primary) == "positive", F.col(guardrail) == "ok"
    return df.withColumn("decision", F.when(good & held, "SHIP").when(good, "INVESTIGATE").otherwise("DON'T SHIP"))


def runtime_estimate(df: DataFrame, n: str, daily: str) -> DataFrame:
    """Days until both arms are full and how viable that is."""
    days = ratio(2 * F.col(n), daily)
    return df.withColumn("days", days).withColumn("viability", F.when(days <= 14, "VIABLE").when(days <= 28, "VIABLE WITH PATIENCE").when(days <= 56, "MARGINAL").otherwise("NOT VIABLE"))
