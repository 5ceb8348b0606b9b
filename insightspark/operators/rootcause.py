"""Root cause search, baselines and opportunity sizing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from insightspark.functions.columns import ratio, with_totals
from insightspark.operators.windows import by_period

N = lambda: F.count(F.lit(1))


def contributions(df: DataFrame, dims: list[str], period: str, value: str) -> DataFrame:
    """Change of every dimension value between 'base' and 'anomaly' and its share of the total excess, in one scan."""
    long = df.select(F.col(period).alias("_p"), F.col(value).alias("_v"), F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("(none)")).alias("val")) for d in dims])))
    on = lambda p: F.coalesce(F.sum(F.when(F.col("_p") == p, F.col("_v"))), F.lit(0.0))
    g = long.groupBy("dimension", "val").agg(on("base").alias("base"), on("anomaly").alias("anomaly"))
    g = g.withColumn("change", F.col("anomaly") - F.col("base"))
    w = W.partitionBy("dimension")
    g = with_totals(g, ["dimension"], {"_all": "change"}).withColumn("contribution", ratio("change", "_all")).drop("_all")
    g = g.withColumn("change_pct", 100.0 * ratio("change", F.abs("base")))
    return g.withColumn("rank", F.row_number().over(w.orderBy(F.desc("contribution"), "val")))


def explanatory_power(contrib: DataFrame) -> DataFrame:
    """Per dimension: HIGH when one value makes more than half of the excess, MEDIUM when two make more than 70 %."""
    g = contrib.groupBy("dimension").agg(
        F.max(F.when(F.col("rank") == 1, F.col("contribution"))).alias("top1"), F.sum(F.when(F.col("rank") <= 2, F.col("contribution"))).alias("top2"),
        F.max(F.when(F.col("rank") == 1, F.col("val"))).alias("top_value"))
    return g.withColumn("power", F.when(F.col("top1") > 0.5, "HIGH").when(F.col("top2") > 0.7, "MEDIUM").otherwise("LOW"))


def interaction(df: DataFrame, a: str, b: str, period: str, value: str) -> DataFrame:
    """Contributions of the combination of two dimensions."""
    both = df.withColumn("_ab", F.concat_ws(" × ", F.col(a).cast("string"), F.col(b).cast("string")))
    return contributions(both, ["_ab"], period, value).withColumn("dimension", F.lit(f"{a} × {b}"))


def search(df: DataFrame, dims: list[str], period: str, value: str, min_depth: int = 3, max_depth: int = 7, stop: float = 0.10) -> DataFrame:
    """Narrow down the excess level by level: pick the strongest dimension, keep its top value, repeat.

    The facts are summed once over all dimensions; each level is then a small
    aggregate of that table and fetches one row. Stops when dimensions run out,
    at ``max_depth``, or from ``min_depth`` on when less than ``stop`` of the
    excess is left unexplained.
    """
    cube = df.groupBy(period, *dims).agg(F.sum(value).alias("_v")).persist()
    scope, left, rows = cube, list(dims), []
    depth, explained = 0, 1.0
    try:
        while left and depth < max_depth:
            best = explanatory_power(contributions(scope, left, period, "_v")).orderBy(F.desc("top1"), "dimension").first()
            if best is None or best["top1"] is None:
                break
            depth += 1
            explained *= best["top1"]
            rows.append((depth, best["dimension"], best["top_value"], float(best["top1"]), best["power"], float(explained)))
            scope = scope.where(F.coalesce(F.col(best["dimension"]).cast("string"), F.lit("(none)")) == best["top_value"])
            left.remove(best["dimension"])
            if depth >= min_depth and 1 - explained < stop:
                break
    finally:
        cube.unpersist()
    return df.sparkSession.createDataFrame(rows, "level int, dimension string, top_value string, contribution double, power string, explained double")


def baseline_excess(series: DataFrame, keys: list[str], order: str, value: str, window: int = 8, limit_pct: float = 20.0) -> DataFrame:
    """Excess over the mean of the previous ``window`` periods and the run of anomalous periods it belongs to."""
    w = by_period(keys, order)
    exp = F.avg(value).over(w.rowsBetween(-window, -1))
    s = series.withColumn("expected", exp).withColumn("excess", F.col(value) - F.col("expected")).withColumn("excess_pct", 100.0 * ratio("excess", F.abs("expected")))
    s = s.withColumn("anomalous", F.coalesce(F.abs("excess_pct") > limit_pct, F.lit(False))).withColumn("_i", F.row_number().over(w))
    a = s.where("anomalous").withColumn("_g", F.col("_i") - F.row_number().over(w))
    g = a.groupBy(*keys, "_g").agg(F.min(order).alias("anomaly_start"), F.max(order).alias("anomaly_end"), N().alias("periods"), F.sum("excess").alias("excess"), F.sum("expected").alias("expected"))
    return g.withColumn("excess_pct", 100.0 * ratio("excess", F.abs("expected"))).drop("_g")


def isolate(df: DataFrame, dim: str, val: str, period: str, num: str, den: str) -> DataFrame:
    """The metric with and without one value, per period."""
    out = F.coalesce(F.col(dim).cast("string") != val, F.lit(True))
    return df.groupBy(period).agg(ratio(F.sum(num), F.sum(den)).alias("metric"), ratio(F.sum(F.when(out, F.col(num))), F.sum(F.when(out, F.col(den)))).alias("metric_without"))


# -- opportunity -----------------------------------------------------------

def opportunity(base: DataFrame, users: str, improvement: float, value: str, periods_per_year: float = 12.0) -> DataFrame:
    """Users × improvement × value per user, per period and per year."""
    per = F.col(users) * F.lit(float(improvement)) * F.col(value)
    return base.withColumn("impact", per).withColumn("annual_impact", per * periods_per_year)


def sensitivity_grid(base: DataFrame, users: str, rate: str, value: str, cost: str, steps=(-0.5, -0.25, 0.0, 0.25, 0.5)) -> DataFrame:
    """Two-way grid of ±50/25 % on reach and rate with the break-even rate; multipliers are literals, exploded per row."""
    m = F.array(*[F.lit(float(s)) for s in steps])
    g = base.withColumn("reach_step", F.explode(m)).withColumn("rate_step", F.explode(m))
    v = F.col(users) * (1 + F.col("reach_step")) * F.col(rate) * (1 + F.col("rate_step")) * F.col(value)
    return g.withColumn("outcome", v).withColumn("break_even_rate", ratio(F.col(cost), F.col(users) * (1 + F.col("reach_step")) * F.col(value))).withColumn("profitable", F.col("outcome") > F.col(cost))


def scenarios(base: DataFrame, impact: str, effort: str, confidence: str) -> DataFrame:
    """Expected value and priority: impact × confidence (.8 high, .5 medium, .3 low) over effort."""
    c = F.when(F.col(confidence) == "high", 0.8).when(F.col(confidence) == "medium", 0.5).otherwise(0.3)
    return base.withColumn("expected_value", F.col(impact) * c).withColumn("priority", ratio(F.col(impact) * c, effort))


def waterfall(df: DataFrame, components: list[str], final_index: str) -> DataFrame:
    """Log shares of multiplicative components (index 100 = unchanged) of the total change."""
    logs = [F.ln(F.col(c) / 100.0) for c in components]
    total = logs[0]
    for x in logs[1:]:
        total = total + x
    s = df.withColumn("_t", total)
    return s.select(*[c for c in df.columns], *[((F.col(final_index) - 100.0) * ratio(F.ln(F.col(c) / 100.0), F.col("_t"))).alias(f"contribution_{c}") for c in components])
