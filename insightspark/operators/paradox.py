"""Misleading aggregates: reversals, weighting, mix effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from insightspark.functions.columns import ratio, with_totals
from insightspark.functions.ranks import quantiles
from insightspark.operators.profile import family

N = lambda: F.count(F.lit(1))


def split_sides(df: DataFrame, comparison: str) -> DataFrame:
    """Add ``side`` A or B: the two most frequent values, or below and above the median.

    The median split applies to numeric columns with more than two values; ties
    in frequency go to the smaller value.
    """
    known = df.where(F.col(comparison).isNotNull())
    numeric = family(df.schema[comparison].dataType) == "numeric"
    if numeric and known.select(comparison).distinct().limit(3).count() > 2:
        mid = quantiles(known.select(comparison), [], comparison, [0.5]).select("quantile").scalar()
        return known.withColumn("side", F.when(F.col(comparison) <= mid, "A").otherwise("B"))
    top = known.groupBy(comparison).agg(N().alias("n")).orderBy(F.desc("n"), comparison).limit(2)
    ordered = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(comparison).alias("v")))).alias("t"))
    pair = known.withColumn("_t", ordered.scalar())
    side = F.when(F.col(comparison) == F.get("_t", F.lit(0))["v"], "A").when(F.col(comparison) == F.get("_t", F.lit(1))["v"], "B")
    return pair.withColumn("side", side).drop("_t").where("side IS NOT NULL")


def _sides(df: DataFrame, keys: list[str], metric: str) -> DataFrame:
    on = lambda s, v: F.when(F.col("side") == s, v)
    return df.groupBy(*keys).agg(
        F.sum(on("A", F.col(metric))).alias("sum_a"), F.count(on("A", F.col(metric))).alias("n_a"),
        F.sum(on("B", F.col(metric))).alias("sum_b"), F.count(on("B", F.col(metric))).alias("n_b"))


def _direction(a, b):
    return F.when(a > b, "positive").when(a < b, "negative").otherwise("neutral")


def segment_directions(df: DataFrame, metric: str, segments: list[str], comparison: str, agg: str = "mean") -> DataFrame:
    """Side values and direction per (segment column, segment) from one scan."""
    base = split_sides(df.where(F.col(metric).isNotNull()), comparison)
    long = base.select("side", F.col(metric).cast("double").alias("_m"), F.inline(F.array(*[
        F.struct(F.lit(s).alias("segment_column"), F.col(s).cast("string").alias("segment")) for s in segments])))
    per = _sides(long.where("segment IS NOT NULL"), ["segment_column", "segment"], "_m")
    a, b = (ratio("sum_a", "n_a"), ratio("sum_b", "n_b")) if agg == "mean" else (F.col("sum_a"), F.col("sum_b"))
    return per.withColumn("value_a", a).withColumn("value_b", b).withColumn("direction", _direction(a, b))


def simpsons(df: DataFrame, metric: str, segments: list[str], comparison: str, agg: str = "mean") -> DataFrame:
    """One row per segment column: overall direction, reversals, verdict and severity.

    Totals come from the segment sums, so many segment columns cost one scan.
    Segments without rows on both sides are left out of the vote.
    """
    per = segment_directions(df, metric, segments, comparison, agg)
    per = with_totals(per, ["segment_column"], {f"_all_{c}": c for c in ("sum_a", "n_a", "sum_b", "n_b")})
    tot = {c: F.col(f"_all_{c}") for c in ("sum_a", "n_a", "sum_b", "n_b")}
    a, b = (ratio(tot["sum_a"], tot["n_a"]), ratio(tot["sum_b"], tot["n_b"])) if agg == "mean" else (tot["sum_a"], tot["sum_b"])
    voted = per.withColumn("overall_a", a).withColumn("overall_b", b).withColumn("overall", _direction(F.col("overall_a"), F.col("overall_b")))
    counted = (F.col("n_a") > 0) & (F.col("n_b") > 0) & (F.col("direction") != "neutral") & (F.col("overall") != "neutral")
    one = voted.groupBy("segment_column").agg(
        F.max("overall").alias("aggregate_direction"), F.max("overall_a").alias("value_a"), F.max("overall_b").alias("value_b"),
        F.count_if(counted).alias("n_segments"), F.count_if(counted & (F.col("direction") != F.col("overall"))).alias("n_reversals"))
    r = ratio("n_reversals", "n_segments")
    sev = F.when((F.col("n_segments") == 0) | (F.col("n_reversals") == 0), "none").when(r <= 0.25, "low").when(r <= 0.5, "medium").otherwise("high")
    return one.withColumn("paradox_detected", F.col("n_reversals") > F.col("n_segments") - F.col("n_reversals")).withColumn("severity", sev)


def weighted_vs_unweighted(df: DataFrame, metric: str, weight: str, segment: str, flag: float = 0.01) -> DataFrame:
    """Weighted mean against the mean of segment means."""
    ok = df.where(F.col(metric).isNotNull() & (F.col(weight) > 0) & F.col(segment).isNotNull())
    seg = ok.groupBy(segment).agg(F.avg(metric).alias("m"), F.sum(F.col(metric) * F.col(weight)).alias("wx"), F.sum(weight).alias("w"))
    one = seg.agg(ratio(F.sum("wx"), F.sum("w")).alias("weighted"), F.avg("m").alias("unweighted"), N().alias("n_segments"))
    diff = F.col("weighted") - F.col("unweighted")
    return one.withColumn("difference", diff).withColumn("flagged", F.coalesce(ratio(F.abs(diff), F.abs("unweighted")) > flag, F.lit(False)))


def suggest_segments(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """Columns whose group sizes vary most (2 to 50 values), best first."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])))
    sizes = long.where("v IS NOT NULL").groupBy("column_name", "v").agg(N().alias("n"))
    g = sizes.groupBy("column_name").agg(N().alias("n_values"), F.try_divide(F.stddev_pop("n"), F.avg("n")).alias("cv")).where("n_values BETWEEN 2 AND 50")
    return g.withColumn("score", F.col("cv") / (1.0 + 0.1 * F.greatest(F.lit(0), F.col("n_values") - 10))).orderBy(F.desc("score"), "column_name").limit(k)


def trend_reversal_screen(df: DataFrame, dims: list[str], period: str, value: str) -> DataFrame:
    """Segments that moved against the total between the two periods ('prev', 'curr')."""
    long = df.select(F.col(period).alias("_p"), F.col(value).alias("_v"), F.inline(F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("segment")),
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("segment")) for d in dims])))
    g = long.groupBy("dimension", "segment").agg(F.sum(F.when(F.col("_p") == "prev", F.col("_v"))).alias("prev"), F.sum(F.when(F.col("_p") == "curr", F.col("_v"))).alias("curr"))
    g = g.withColumn("change", F.coalesce("curr", F.lit(0.0)) - F.coalesce("prev", F.lit(0.0)))
    total = g.where("dimension = 'total'").select("change").scalar()
    return g.where("dimension <> 'total'").withColumn("total_change", total).where(F.signum("change") * F.signum("total_change") < 0)


def mix_vs_rate(df: DataFrame, segment: str, period: str, num: str, den: str) -> DataFrame:
    """Split the change of Σnum/Σden into share shift and within-segment rate change.

    mix = Δshare · previous rate, rate = current share · Δrate; they add up to the total.
    """
    on = lambda p, c: F.coalesce(F.sum(F.when(F.col(period) == p, F.col(c))), F.lit(0.0))
    g = df.groupBy(segment).agg(on("prev", num).alias("n0"), on("prev", den).alias("d0"), on("curr", num).alias("n1"), on("curr", den).alias("d1"))
    g = g.withColumn("_t", g.agg(F.struct(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))).scalar())
    s0, s1 = ratio("d0", "_t.d0"), ratio("d1", "_t.d1")
    r0, r1 = ratio("n0", "d0"), ratio("n1", "d1")
    # a segment absent from one period carries its whole effect as mix
    r0f, r1f = F.coalesce(r0, r1), F.coalesce(r1, r0)
    return g.select(segment, s0.alias("share_prev"), s1.alias("share_curr"), r0.alias("rate_prev"), r1.alias("rate_curr"),
                    ((s1 - s0) * r0f).alias("mix_effect"), (s1 * (r1f - r0f)).alias("rate_effect"))


def controlled_lift(df: DataFrame, stratum: str, arm: str, outcome: str, treated="treated", control="control") -> DataFrame:
    """Raw lift and the average of within-stratum differences."""
    g = df.groupBy(stratum).agg(
        F.avg(F.when(F.col(arm) == treated, F.col(outcome))).alias("t"), F.avg(F.when(F.col(arm) == control, F.col(outcome))).alias("c"),
        F.sum(F.when(F.col(arm) == treated, F.col(outcome))).alias("ts"), F.count(F.when(F.col(arm) == treated, F.col(outcome))).alias("tn"),
        F.sum(F.when(F.col(arm) == control, F.col(outcome))).alias("cs"), F.count(F.when(F.col(arm) == control, F.col(outcome))).alias("cn"))
    return g.agg((ratio(F.sum("ts"), F.sum("tn")) - ratio(F.sum("cs"), F.sum("cn"))).alias("raw_lift"),
                 F.avg(F.col("t") - F.col("c")).alias("controlled_lift"), F.count(F.col("t") - F.col("c")).alias("n_strata"))
