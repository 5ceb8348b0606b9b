"""Statistical tests in two steps: Spark reduces the facts to sufficient
statistics per group, the closed forms run on those few rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insightspark.functions.columns import clean, ratio
from insightspark.functions.dist import chi2_sf_udf, f_sf_udf, norm_ppf, norm_sf2_udf, t_ppf_udf, t_sf2_udf
from insightspark.functions.ranks import join_null_safe, prefix_totals, quantiles_wide, range_buckets, split_count, value_counts

N = lambda: F.count(F.lit(1))


def significance(p, alpha: float = 0.05):
    return F.when(p < 0.001, "highly significant").when(p < alpha, "significant").when(p.isNotNull(), "not significant")


def effect_label(d):
    return F.when(F.abs(d) < 0.2, "small").when(F.abs(d) <= 0.8, "medium").when(d.isNotNull(), "large")


def arm_stats(df: DataFrame, keys: list[str], arm: str, metric: str, a, b) -> DataFrame:
    """One row per key with count, sum, mean and variance of both arms."""
    v = clean(metric)
    side = lambda x: F.when(F.col(arm) == x, v)
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(*[c for tag, x in (("a", a), ("b", b)) for c in (
        F.count(side(x)).alias(f"n_{tag}"), F.sum(side(x)).alias(f"sum_{tag}"), F.avg(side(x)).alias(f"mean_{tag}"), F.var_samp(side(x)).alias(f"var_{tag}"))])


def proportion_z(stats: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Two-proportion z test on :func:`arm_stats` of a 0/1 metric.

    z uses the pooled error, the interval the unpooled one; difference is b - a.
    """
    pa, pb = F.col("mean_a"), F.col("mean_b")
    pool = ratio(F.col("sum_a") + F.col("sum_b"), F.col("n_a") + F.col("n_b"))
    se0 = F.sqrt(pool * (1 - pool) * (ratio(F.lit(1), "n_a") + ratio(F.lit(1), "n_b")))
    se1 = F.sqrt(ratio(pa * (1 - pa), "n_a") + ratio(pb * (1 - pb), "n_b"))
    z = F.lit(norm_ppf(1 - alpha / 2))
    out = stats.withColumn("diff", pb - pa).withColumn("z", ratio(pb - pa, se0))
    out = out.withColumn("ci_low", F.col("diff") - z * se1).withColumn("ci_high", F.col("diff") + z * se1)
    out = out.withColumn("p_value", norm_sf2_udf("z"))
    return out.withColumn("significant", F.col("p_value") < alpha)


def welch_t(stats: DataFrame, alpha: float = 0.05, with_p: bool = True) -> DataFrame:
    """Welch test: t is a - b, the difference b - a, Cohen's d uses the pooled deviation."""
    va, vb = ratio("var_a", "n_a"), ratio("var_b", "n_b")
    se = F.sqrt(va + vb)
    df = ratio((va + vb) * (va + vb), ratio(va * va, F.col("n_a") - 1) + ratio(vb * vb, F.col("n_b") - 1))
    pooled = F.sqrt(ratio((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b"), F.col("n_a") + F.col("n_b") - 2))
    out = (stats.withColumn("diff", F.col("mean_b") - F.col("mean_a")).withColumn("t_stat", ratio(F.col("mean_a") - F.col("mean_b"), se))
                .withColumn("df", df).withColumn("se", se).withColumn("cohens_d", ratio(F.col("mean_b") - F.col("mean_a"), pooled)))
    if not with_p:
        return out
    out = out.withColumn("p_value", t_sf2_udf("t_stat", "df")).withColumn("_q", t_ppf_udf(F.lit(1 - alpha / 2), "df"))
    return (out.withColumn("ci_low", F.col("diff") - F.col("_q") * F.col("se")).withColumn("ci_high", F.col("diff") + F.col("_q") * F.col("se"))
               .withColumn("significant", F.col("p_value") < alpha).drop("_q"))


def side_counts(df: DataFrame, keys: list[str], arm: str, metric: str, a, b) -> DataFrame:
    """(keys, value, c_a, c_b): how often each arm takes each value."""
    d = df.select(*keys, clean(metric).alias("_v"), F.col(arm).alias("_arm")).where("_v IS NOT NULL")
    return d.groupBy(*keys, "_v").agg(F.count_if(F.col("_arm") == a).alias("c_a"), F.count_if(F.col("_arm") == b).alias("c_b")).where("c_a + c_b > 0")


def mann_whitney(counts: DataFrame, keys: list[str], with_p: bool = True) -> DataFrame:
    """Two-sided U test from :func:`side_counts`: tie-corrected normal with continuity 0.5.

    Ranks come from prefix sums over distinct values, so ties and hot values cost
    one row each and no task sorts all rows.
    """
    c = counts.withColumn("c_n", F.col("c_a") + F.col("c_b"))
    r = prefix_totals(c, keys, "_v", {"before": "c_n"})
    avg_rank = F.col("before") + (F.col("c_n") + 1) / 2.0
    t = F.col("c_n").cast("double")
    g = (r.groupBy(*keys) if keys else r.groupBy()).agg(
        F.sum("c_a").alias("n_a"), F.sum("c_b").alias("n_b"), F.sum(F.col("c_a") * avg_rank).alias("_ra"), F.sum(t * t * t - t).alias("_ties"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    u = F.col("_ra") - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * ((n + 1) - ratio("_ties", n * (n - 1))))
    out = g.withColumn("u_stat", u).withColumn("rank_biserial", 1 - 2 * ratio("u_stat", na * nb))
    out = out.withColumn("z", ratio(F.greatest(F.col("u_stat"), na * nb - F.col("u_stat")) - na * nb / 2 - 0.5, sd)).drop("_ra", "_ties")
    if with_p:
        out = out.withColumn("p_value", F.when(F.col("z") > 0, norm_sf2_udf("z")).otherwise(1.0))
    return out


def mean_ci(df: DataFrame, keys: list[str], metric: str, confidence: float = 0.95, with_ci: bool = True) -> DataFrame:
    """Mean with its t interval."""
    g = (df.groupBy(*keys) if keys else df.groupBy()).agg(F.count(clean(metric)).alias("n"), F.avg(clean(metric)).alias("mean"), F.stddev_samp(clean(metric)).alias("std"))
    g = g.withColumn("se", ratio("std", F.sqrt("n")))
    if not with_ci:
        return g
    half = t_ppf_udf(F.lit(0.5 + confidence / 2), (F.col("n") - 1).cast("double")) * F.col("se")
    return g.withColumn("_h", half).withColumn("ci_low", F.col("mean") - F.col("_h")).withColumn("ci_high", F.col("mean") + F.col("_h")).drop("_h")


def chi_squared(df: DataFrame, row: str, col: str, keys: list[str] = (), with_p: bool = True) -> DataFrame:
    """Test of independence over the observed table; Yates correction for 2x2.

    Empty cells never appear as rows: sum(O^2 / E) - N covers them, and in a 2x2
    table all four |O - E| are equal.
    """
    k = list(keys)
    cells = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(*k, row, col).agg(N().alias("o"))
    r = cells.groupBy(*k, row).agg(F.sum("o").alias("r"))
    c = cells.groupBy(*k, col).agg(F.sum("o").alias("c"))
    total = (r.groupBy(*k) if k else r.groupBy()).agg(F.sum("r").cast("double").alias("n"), N().alias("n_rows"), F.sum(1 / F.col("r")).alias("inv_r"))
    width = (c.groupBy(*k) if k else c.groupBy()).agg(N().alias("n_cols"), F.sum(1 / F.col("c")).alias("inv_c"))
    part = cells.join(r, [*k, row]).join(c, [*k, col])
    part = part.withColumn("e", F.col("r") * F.col("c").cast("double"))
    s = (part.groupBy(*k) if k else part.groupBy()).agg(F.sum(F.col("o") * F.col("o") / F.col("e")).alias("s"), F.max(F.struct("o", "r", "c")).alias("one"))
    if k:
        j = s.join(total, k).join(width, k)
    else:
        j = s.withColumn("_t", total.select(F.struct("n", "n_rows", "inv_r")).scalar()).withColumn("_w", width.select(F.struct("n_cols", "inv_c")).scalar()).select("s", "one", "_t.*", "_w.*")
    plain = F.col("n") * F.col("s") - F.col("n")
    gap = F.abs(F.col("one.o") - F.col("one.r") * F.col("one.c") / F.col("n"))
    yates = F.pow(gap - F.least(F.lit(0.5), gap), 2) * F.col("n") * F.col("inv_r") * F.col("inv_c")
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    out = j.select(*k, F.when(dof == 1, yates).otherwise(plain).alias("chi2"), dof.cast("long").alias("dof"), F.col("n").cast("long").alias("n"))
    return out.withColumn("p_value", chi2_sf_udf("chi2", F.col("dof").cast("double"))) if with_p else out


def _poisson_steps() -> list[int]:
    """Thresholds of a 32-bit number: how many of them it reaches is Poisson(1), to the last step that 32 bits can tell."""
    steps, cum, k = [], 0.0, 0
    while True:
        cum += math.exp(-1.0) / math.factorial(k)
        step = math.floor(cum * (1 << 32) + 0.5)
        if step >= 1 << 32 or k > 40:
            return steps
        steps.append(step)
        k += 1


POISSON_STEPS = _poisson_steps()
#: Rows whose weights are drawn at once (times replicates, 4 bytes each).
_BOOT_ROWS = 1024


def _mixed(h: np.ndarray) -> np.ndarray:
    """A 32-bit finalizer; wraps modulo 2 ** 32."""
    h = h ^ (h >> np.uint32(16))
    h = h * np.uint32(0x7FEB352D)
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def resampling_weights(keys: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Poisson(1) weight of each row in each replicate, from the row's key alone: (rows, replicates)."""
    keys = keys.astype(np.int64).view(np.uint64)
    low, high = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint32)
    one = _mixed(low ^ _mixed(high ^ np.uint32(seed)))
    two = _mixed(one + low + np.uint32(1))
    turn = (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(2654435769)).astype(np.uint32)
    drawn = _mixed(_mixed(one[:, None] ^ turn[None, :]) + two[:, None])
    return np.searchsorted(np.array(POISSON_STEPS, np.uint32), drawn.ravel(), side="right").reshape(drawn.shape)


def _replicate_sums(replicates: int, seed: int):
    """One row for each task and replicate: the sums of both figures over the rows of the task, each times its weight."""

    def run(batches):
        totals = np.zeros((2, replicates))
        met = False
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            x, w = (np.nan_to_num(batch.column(i).to_numpy(zero_copy_only=False).astype(float)) for i in (1, 2))
            for at in range(0, len(keys), _BOOT_ROWS):
                part = slice(at, at + _BOOT_ROWS)
                totals += np.stack([x[part], w[part]]) @ resampling_weights(keys[part], replicates, seed)
            met = met or len(keys) > 0
        if met:
            yield pa.record_batch({"b": pa.array(np.arange(1, replicates + 1)), "x": pa.array(totals[0]), "w": pa.array(totals[1])})

    return run


def bootstrap_mean_ci(df: DataFrame, key: str, num: str, den: str | None = None, replicates: int = 1000, confidence: float = 0.95, seed: int = 7) -> DataFrame:
    """Percentile bootstrap interval of a mean, or of Σnum / Σden, with a Poisson(1) weight for every row and replicate.

    A row's weights come from its key (unique; whole numbers as they are, others by their hash), so they do not depend
    on partitions. Each task adds its rows into one vector of replicate sums; the vectors are added element by element. So what is shuffled
    is tasks times replicates, whatever the number of rows.
    """
    v = clean(num)
    d = F.when(v.isNotNull(), F.lit(1.0)) if den is None else clean(den)
    whole = isinstance(df.schema[key].dataType, T.IntegralType)
    number = F.coalesce(F.col(key).cast("long") if whole else F.xxhash64(F.col(key)), F.lit(0).cast("long"))
    rows = df.select(number.alias("k"), F.coalesce(v, F.lit(0.0)).alias("x"), F.coalesce(d, F.lit(0.0)).alias("w"))
    reps = rows.mapInArrow(_replicate_sums(replicates, seed), "b long, x double, w double").groupBy("b").agg(ratio(F.sum("x"), F.sum("w")).alias("stat"))
    tail = (1 - confidence) / 2
    ci = reps.agg(F.expr(f"percentile(stat, {tail})").alias("ci_low"), F.expr(f"percentile(stat, {1 - tail})").alias("ci_high"), F.stddev_samp("stat").alias("boot_se"), N().alias("replicates"))
    return ci.withColumn("estimate", rows.agg(ratio(F.sum("x"), F.sum("w"))).scalar())


def bootstrap_quantile_ci(df: DataFrame, value: str, prob: float = 0.5, confidence: float = 0.95) -> DataFrame:
    """Interval of a quantile as the percentile bootstrap gives it with ever more replicates.

    Resampling moves the rank of a quantile binomially, so the interval ends are
    two order statistics; they are found exactly without resampling.
    """
    d = df.select(clean(value).alias("_v")).where("_v IS NOT NULL")
    n = d.count()
    half = norm_ppf(0.5 + confidence / 2) * math.sqrt(prob * (1 - prob) / max(n, 1))
    q = quantiles_wide(d, [], "_v", {"estimate": prob, "ci_low": max(0.0, prob - half), "ci_high": min(1.0, prob + half)})
    return q.withColumn("n", F.lit(n))


def adjust_pvalues(tests: DataFrame, p: str, key: str, keys: list[str] = ()) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg adjusted p-values per family of tests; tests without p are not counted and get NULL.

    Equal p-values of a family get equal results (Holm that of their first rank, Benjamini-Hochberg that of their
    last), so everything is done on distinct p-values with counts: ranks are prefix sums over range buckets, the
    running maximum and minimum come from the buckets before and after and from inside a bucket. No task holds a family. ``key`` names a test; it decides nothing.
    """
    keys = list(keys)
    distinct = value_counts(tests.where(~F.isnan(p)), keys, p)
    ranked = prefix_totals(distinct, keys, p, {"_less": "n"})
    m = F.col("_less_all")
    ranked = ranked.withColumn("_h", (m - F.col("_less")) * F.col(p)).withColumn("_q", F.col(p) * m / (F.col("_less") + F.col("n")))
    cut = range_buckets(ranked, keys, p)
    across = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))  # one row for each bucket of a family
    per = cut.groupBy(*keys, "_b").agg(F.max("_h").alias("_bh"), F.min("_q").alias("_bq"))
    per = per.select(*keys, "_b", F.max("_bh").over(across.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_ph"), F.min("_bq").over(across.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)).alias("_nq"))
    inner = W.partitionBy(*keys, "_b")
    both = join_null_safe(cut, per, [*keys, "_b"])
    both = both.withColumn("_h", F.greatest("_ph", F.max("_h").over(inner.orderBy(p)))).withColumn("_q", F.least("_nq", F.min("_q").over(inner.orderBy(F.desc(p)))))
    one = F.lit(1.0)
    adjusted = both.select(*[F.col(k).alias(f"_f_{k}") for k in keys], F.col(p).alias("_p"), F.least(F.col(p) * m, one).alias("bonferroni"), F.least(F.col("_h"), one).alias("holm"), F.least(F.col("_q"), one).alias("benjamini_hochberg"))
    same = F.col(p) == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_f_{k}"))
    return tests.join(adjusted, same, "left").drop("_p", *[f"_f_{k}" for k in keys])


def normality(df: DataFrame, keys: list[str], metric: str, with_p: bool = True) -> DataFrame:
    """D'Agostino-Pearson K² from the moments, for every sample size of at least 8."""
    g = (df.groupBy(*keys) if keys else df.groupBy()).agg(
        F.count(clean(metric)).cast("double").alias("n"), F.skewness(clean(metric)).alias("g1"), F.kurtosis(clean(metric)).alias("g2"))
    n = F.col("n")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    delta = 1 / F.sqrt(0.5 * F.ln(w2))
    alpha = F.sqrt(2 / (w2 - 1))
    z1 = delta * F.ln(y / alpha + F.sqrt((y / alpha) * (y / alpha) + 1))
    mean_b2 = 3 * (n - 1) / (n + 1)
    var_b2 = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("g2") + 3 - mean_b2) / F.sqrt(var_b2)
    rb1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / rb1 * (2 / rb1 + F.sqrt(1 + 4 / (rb1 * rb1)))
    ratio_ = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.cbrt(ratio_)) / F.sqrt(2 / (9 * a))
    ok = n >= 8
    out = g.withColumn("z_skew", F.when(ok, z1)).withColumn("z_kurt", F.when(ok, z2)).withColumn("k2", F.col("z_skew") ** 2 + F.col("z_kurt") ** 2)
    return out.withColumn("p_value", chi2_sf_udf("k2", F.lit(2.0))) if with_p else out


def rank_dimensions(df: DataFrame, metric: str, dims: list[str], with_p: bool = True) -> DataFrame:
    """Dimensions by explained variance: eta², F and rank from one scan of count, sum and square sum."""
    long = df.select(clean(metric).alias("_v"), F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("val")) for d in dims]))).where("_v IS NOT NULL AND val IS NOT NULL")
    g = long.groupBy("dimension", "val").agg(N().cast("double").alias("n"), F.avg("_v").alias("m"), F.var_pop("_v").alias("v"))
    t = g.groupBy("dimension").agg(F.sum("n").alias("tn"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    j = g.join(t, "dimension")
    big = F.col("n") >= 2
    dev = F.col("n") * (F.col("m") - F.col("grand")) ** 2
    a = j.groupBy("dimension").agg(
        F.sum(dev + F.col("n") * F.col("v")).alias("ss_total"), F.sum(F.when(big, dev)).alias("ss_between"), F.sum(F.when(big, F.col("n") * F.col("v"))).alias("ss_within"),
        F.count_if(big).alias("n_groups"), F.sum(F.when(big, F.col("n"))).alias("n_in"), F.sum(F.when(big, F.col("n") * F.col("m"))).alias("s_in"),
        F.sum(F.when(big, F.col("n") * F.col("m") ** 2)).alias("q_in"))
    # the F test uses the mean of the groups that take part
    between_f = F.col("q_in") - F.col("s_in") ** 2 / F.col("n_in")
    valid = F.col("n_groups") >= 2
    f = ratio(between_f / (F.col("n_groups") - 1), F.col("ss_within") / (F.col("n_in") - F.col("n_groups")))
    eta = F.when(valid, F.coalesce(ratio("ss_between", "ss_total"), F.lit(0.0))).otherwise(0.0)
    out = a.select("dimension", "n_groups", eta.alias("eta_squared"), F.when(valid, f).otherwise(0.0).alias("f_stat"),
                   (F.col("n_groups") - 1).cast("double").alias("df1"), (F.col("n_in") - F.col("n_groups")).alias("df2"))
    label = F.when(F.col("eta_squared") < 0.01, "negligible").when(F.col("eta_squared") < 0.06, "small").when(F.col("eta_squared") < 0.14, "medium").otherwise("large")
    out = out.withColumn("effect", label).withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("eta_squared"), "dimension")))
    if with_p:
        out = out.withColumn("p_value", F.coalesce(f_sf_udf("f_stat", "df1", "df2"), F.lit(1.0)))
    return out.drop("df1", "df2")


def power_z(alpha: float, power: float) -> float:
    return norm_ppf(1 - alpha / 2) + norm_ppf(power)


def sample_size_proportion(base: DataFrame, rate: str, mde_rel: float, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Users per group to see a relative lift of ``mde_rel``; NULL when the lift is zero."""
    p1 = F.col(rate)
    p2 = p1 * (1 + mde_rel)
    n = ratio(power_z(alpha, power) ** 2 * (p1 * (1 - p1) + p2 * (1 - p2)), (p2 - p1) * (p2 - p1))
    return base.withColumn("n_per_group", F.ceil(n).cast("double"))


def sample_size_mean(base: DataFrame, std: str, mde: str, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Observations per group to see an absolute difference."""
    n = ratio(power_z(alpha, power) ** 2 * 2 * F.col(std) * F.col(std), F.col(mde) * F.col(mde))
    return base.withColumn("n_per_group", F.ceil(n).cast("double")).withColumn("effect_d", ratio(mde, std))


def detectable_effect(base: DataFrame, n: str, rate: str | None = None, std: str | None = None, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Smallest detectable effect at a fixed sample size."""
    z = power_z(alpha, power)
    if rate is not None:
        p = F.col(rate)
        out = base.withColumn("mde_absolute", z * F.sqrt(ratio(2 * p * (1 - p), n)))
        return out.withColumn("mde_relative", F.coalesce(ratio("mde_absolute", rate), F.lit(0.0)))
    out = base.withColumn("mde_absolute", z * F.col(std) * F.sqrt(ratio(F.lit(2), n)))
    return out.withColumn("mde_relative", F.coalesce(ratio("mde_absolute", std), F.lit(0.0)))


def segment_summary(df: DataFrame, segment: str, metric: str) -> DataFrame:
    d = df.select(segment, clean(metric).alias("_v")).where(F.col(segment).isNotNull() & F.col("_v").isNotNull())
    s = d.groupBy(segment).agg(N().alias("n"), F.avg("_v").alias("mean"), F.var_samp("_v").alias("var"))
    return s.join(quantiles_wide(d, [segment], "_v", {"median": 0.5}), segment)


def _wins(batch: pa.Table) -> pa.Table:
    """The win matrix of one range of values: rows ``s, v, c`` by segment and value, NULL values being the counts before the range.

    A running vector of counts over all segments goes up along the values, so all pairs are updated by one product.
    """
    names, index = np.unique(np.array(batch.column("s").to_pylist(), object), return_inverse=True)
    value, count = batch.column("v").to_numpy(), batch.column("c").to_numpy().astype(float)
    k = len(names)
    start = np.isnan(value)
    running = np.bincount(index[start], count[start], k)
    index, value, count = index[~start], value[~start], count[~start]
    order = np.argsort(value, kind="stable")
    index, value, count = index[order], value[order], count[order]
    place = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]])) if len(value) else np.empty(0, int)
    u, squares, cubes = np.zeros((k, k)), np.zeros((k, k)), np.zeros(k)
    step, at = max(1, (1 << 20) // k), 0
    while at < len(value):
        to = int(np.searchsorted(place, place[at] + step))
        c = np.zeros((int(place[to - 1] - place[at]) + 1, k))
        c[place[at:to] - place[at], index[at:to]] = count[at:to]
        upto = np.cumsum(c, axis=0) + running
        u += c.T @ (upto - c / 2)
        squares += (c * c).T @ c
        cubes += (c ** 3).sum(0)
        running, at = upto[-1], to
    a, b = np.triu_indices(k, 1)
    return pa.table({"seg_a": pa.array(names[a].tolist(), pa.string()), "seg_b": pa.array(names[b].tolist(), pa.string()), "u": u[a, b], "t3": cubes[a] + cubes[b] + 3 * (squares[a, b] + squares[b, a])})


def win_matrix(d: DataFrame, segment: str, value: str) -> DataFrame:
    """``seg_a, seg_b, u, t3`` for all pairs of segments (as text): the U statistic of the first and the sum of cubes of ties.

    Values are counted once by (segment, value) and cut into ranges. The counts before a range are prefix sums by segment; inside a
    range all pairs are updated together, so no count is copied for each other segment.
    """
    counts = value_counts(d.select(F.col(segment).cast("string").alias("s"), F.col(value).alias("v")), ["s"], "v")
    splits = split_count(counts)
    cut = range_buckets(counts, [], "v", splits)
    at = cut.groupBy("s", "_b").agg(F.sum("n").alias("c"))
    every = counts.select("s").distinct().withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    before = F.sum("c").over(W.partitionBy("s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    led = every.join(at, ["s", "_b"], "left").select("_b", "s", F.lit(float("nan")).alias("v"), F.coalesce(before, F.lit(0)).alias("c"))
    rows = cut.select("_b", "s", "v", F.col("n").alias("c")).unionByName(led)
    return rows.groupBy("_b").applyInArrow(_wins, "seg_a string, seg_b string, u double, t3 double").groupBy("seg_a", "seg_b").agg(F.sum("u").alias("u"), F.sum("t3").alias("t3"))


def compare_segments(df: DataFrame, segment: str, metric: str, with_p: bool = True) -> DataFrame:
    """All pairs of segments (as text) with Welch's t, Mann-Whitney's U and both effect sizes; with ``with_p`` both p-values as well.

    ``advised`` names the test to read: Mann-Whitney where one of the two segments has fewer than 30 rows or fails the
    normality test, else Welch; ``p_adjusted`` is Bonferroni's over all pairs for that one. Pairs are formed from segment summaries and the win matrix.
    """
    d = df.select(F.col(segment).cast("string").alias("s"), clean(metric).alias("_v")).where(F.col("s").isNotNull() & F.col("_v").isNotNull())
    s = d.groupBy("s").agg(N().alias("n"), F.avg("_v").alias("mean"), F.var_samp("_v").alias("var"))
    k2 = normality(d, ["s"], "_v", with_p=False).select(F.col("s").alias("_s"), F.coalesce(F.exp(-F.col("k2") / 2) < 0.05, F.lit(True)).alias("odd"))  # the tail of two degrees of freedom
    s = s.join(k2, F.col("s") == F.col("_s")).select("s", "n", "mean", "var", (F.col("odd") | (F.col("n") < 30)).alias("odd"))
    side = lambda tag: s.select(F.col("s").alias(f"seg_{tag}"), *[F.col(c).alias(f"{c}_{tag}") for c in ("n", "mean", "var", "odd")])
    wide = win_matrix(d, "s", "_v").join(side("a"), "seg_a").join(side("b"), "seg_b")
    wide = welch_t(wide, with_p=with_p)
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    sd = F.sqrt(na * nb / 12 * ((n + 1) - ratio(F.col("t3") - n, n * (n - 1))))
    z = ratio(F.greatest(F.col("u"), na * nb - F.col("u")) - na * nb / 2 - 0.5, sd)
    out = wide.withColumn("advised", F.when(F.col("odd_a") | F.col("odd_b"), "mann-whitney").otherwise("welch-t")).withColumn("rank_biserial", 1 - 2 * ratio("u", na * nb)).withColumn("_z", z)
    keep = ["seg_a", "seg_b", "n_a", "n_b", "t_stat", F.col("u").alias("u_stat"), (-F.col("cohens_d")).alias("effect_size"), "rank_biserial", "advised"]
    if with_p:
        m = N().over(W.partitionBy(F.lit(0)))  # a row for each pair: the result itself
        out = out.withColumn("p_welch", F.col("p_value")).withColumn("p_mann_whitney", F.when(F.col("_z") > 0, norm_sf2_udf("_z")).otherwise(1.0))
        out = out.withColumn("p_adjusted", F.least(F.when(F.col("advised") == "welch-t", F.col("p_welch")).otherwise(F.col("p_mann_whitney")) * m, F.lit(1.0)))
        out = out.withColumn("significant", F.col("p_adjusted") < 0.05)
        keep += ["p_welch", "p_mann_whitney", "p_adjusted", "significant"]
    return out.select(*keep)
