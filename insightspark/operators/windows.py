"""Window operators. Row-level running values are split by time slot, so one hot
key does not sit in one task; keyless windows run on aggregated periods only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from insightspark.functions.columns import as_col, pct_change, ratio
from insightspark.functions.ranks import quantiles, prefix_totals, running_by_time, value_counts

MIN_ROWS = "rows"


def running(df, keys, ts, tie, sums, slot="hour", inclusive=True):
    """Running sums per key in time order, with or without the current row."""
    return running_by_time(df, keys, ts, tie, sums, slot=slot, inclusive=inclusive)


def asof(df: DataFrame, keys: list[str], ts: str, tie: list[str], state: dict[str, Column], slot="hour") -> DataFrame:
    """Latest non-NULL state at a strictly earlier time."""
    return running_by_time(df, keys, ts, tie, {}, slot=slot, carry_last=state)


def trailing_hit(df: DataFrame, keys: list[str], ts: str, tie: list[str], target: Column, hours: int) -> DataFrame:
    """``hit`` is true when a target row lies within ``hours`` before the row (same time included)."""
    seen = running_by_time(df, keys, ts, tie, {}, carry_last={"_seen": F.when(target, F.col(ts))}, peers="before")
    edge = F.col(ts) - F.expr(f"INTERVAL {int(hours)} HOURS")
    return seen.withColumn("hit", F.coalesce(F.col("_seen") >= edge, F.lit(False))).drop("_seen")


def period_series(df: DataFrame, period: Column, value: Column, keys: list[str] = (), period_name="period",
                  value_name="value") -> DataFrame:
    """Aggregate facts to one row per (keys, period): the input every series operator expects."""
    return df.groupBy(*keys, period.alias(period_name)).agg(value.alias(value_name))


def by_period(keys: list[str], order: str = "period"):
    """Window over an aggregated series."""
    return (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(order)


def rolling(df: DataFrame, keys, order, value, window: int, min_periods: int = 1, lagged: bool = False) -> DataFrame:
    """Rolling mean and sample deviation; ``lagged`` leaves the current row out."""
    frame = by_period(keys, order)
    frame = frame.rowsBetween(-window, -1) if lagged else frame.rowsBetween(-(window - 1), 0)
    enough = F.count(value).over(frame) >= min_periods
    return (df.withColumn("roll_mean", F.when(enough, F.avg(value).over(frame)))
              .withColumn("roll_std", F.when(enough, F.stddev_samp(value).over(frame))))


def period_change(df: DataFrame, keys, order, value, lag: int = 1) -> DataFrame:
    prev = F.lag(value, lag).over(by_period(keys, order))
    return (df.withColumn("previous", prev).withColumn("change", as_col(value) - F.col("previous"))
              .withColumn("change_pct", 100.0 * ratio(F.col("change"), F.abs("previous"))))


def rolling_average(df: DataFrame, keys, order, value, grain: str) -> DataFrame:
    """7 points for daily series, 4 for weekly, 3 for monthly."""
    n = {"day": 7, "week": 4, "month": 3}[grain]
    return df.withColumn("rolling_avg", F.avg(value).over(by_period(keys, order).rowsBetween(-(n - 1), 0)))


def cumulative(df: DataFrame, keys, order, value) -> DataFrame:
    return df.withColumn("cumulative", F.sum(value).over(by_period(keys, order).rowsBetween(W.unboundedPreceding, 0)))


def share_of_total(df: DataFrame, keys, value) -> DataFrame:
    if not keys:
        return df.withColumn("share", ratio(value, df.agg(F.sum(value)).scalar()))
    return df.withColumn("share", ratio(value, F.sum(value).over(W.partitionBy(*keys))))


def quintile_edges(df: DataFrame, value: str, q: int = 5) -> DataFrame:
    """One row with the array of ``q + 1`` quantile edges, duplicates kept."""
    long = quantiles(df.select(F.col(value).alias("_v")), [], "_v", [i / q for i in range(q + 1)])
    return long.agg(F.transform(F.array_sort(F.collect_list(F.struct("prob", "quantile"))), lambda s: s["quantile"]).alias("edges"))


def quintile_score(df: DataFrame, value: str, name: str, descending: bool = False) -> DataFrame:
    """Scores 1-5 from quantile edges; equal values share a score.

    Collapsed edges fall back to fewer bins (4, 3, 2) with the leading labels of
    the 1-5 (or 5-1) list, and to 3 for everyone when no split works.
    """
    labels = [5, 4, 3, 2, 1] if descending else [1, 2, 3, 4, 5]
    probs = sorted({i / q for q in (5, 4, 3, 2) for i in range(q + 1)})
    long = quantiles(df.select(F.col(value).alias("_v")), [], "_v", probs)
    one = long.agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"p{i}") for i, p in enumerate(probs)])
    chain = F.lit(None)
    for q in (2, 3, 4, 5):
        inner = F.array(*[F.col(f"p{probs.index(i / q)}") for i in range(q + 1)])
        chain = F.when(F.size(F.array_distinct(inner)) == q + 1, inner).otherwise(chain)
    edges = one.select(chain.alias("edges")).scalar()
    scored = df.withColumn("_e", edges)
    bin_no = F.size(F.filter(F.slice("_e", 2, F.greatest(F.size("_e") - 2, F.lit(0))), lambda x: x < F.col(value).cast("double")))
    score = F.when(F.col("_e").isNull(), F.lit(3)).otherwise(F.element_at(F.array(*[F.lit(x) for x in labels]), bin_no + 1))
    return scored.withColumn(name, F.when(F.col(value).isNotNull(), score)).drop("_e")


def global_rank(df: DataFrame, score: str, key: str, rank: str = "rank") -> DataFrame:
    """Rank 1..n by score descending, ties by key ascending, without a one-task sort.

    Rows are range-partitioned on (score, key) into a saved table; each partition
    is numbered on its own and shifted by the sizes of the partitions before it.
    """
    from insightspark.session import cut_lineage
    parted = df.repartitionByRange(F.col(score).desc(), F.col(key).asc()).withColumn("_p", F.spark_partition_id())
    parted = cut_lineage(parted)
    sizes = parted.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    shift = sizes.select("_p", F.coalesce(F.sum("_n").over(
        W.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = W.partitionBy("_p").orderBy(F.col(score).desc(), F.col(key).asc())
    return parted.join(shift, "_p").withColumn(rank, F.col("_before") + F.row_number().over(w)).drop("_p", "_before")


def average_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, avg_rank): ascending ranks with ties at their mean."""
    pre = prefix_totals(value_counts(df, keys, value), keys, value, {"before": "n"})
    return pre.select(*keys, value, "n", (F.col("before") + (F.col("n") + 1) / 2.0).alias("avg_rank"))


def islands(days: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Runs of consecutive dates: (keys, start, end, length)."""
    w = by_period(keys, day)
    grp = F.date_sub(F.col(day), F.row_number().over(w).cast("int"))
    return (days.withColumn("_g", grp).groupBy(*keys, "_g")
                .agg(F.min(day).alias("gap_start"), F.max(day).alias("gap_end"), F.count(F.lit(1)).alias("length")).drop("_g"))


def missing_days(days: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Dates between the first and last day of a key with no row."""
    seen = days.select(*keys, day).distinct()
    spine = seen.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b")).select(
        *keys, F.explode(F.sequence("_a", "_b")).alias(day))
    return spine.join(seen, [*keys, day], "left_anti")


def first_event(df: DataFrame, keys: list[str], ts: str, tie: str, cols: list[str]) -> DataFrame:
    """First row per key as an aggregate (partial per task, no sort)."""
    picked = F.min_by(F.struct(F.col(ts), *[F.col(c) for c in cols]), F.struct(ts, tie))
    return df.groupBy(*keys).agg(picked.alias("_f")).select(*keys, "_f.*")
