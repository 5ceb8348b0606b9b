"""Exact order statistics and prefix sums without one-task sorts.

Everything works on *distinct values with counts*: equal values collapse in the
map-side combine, so a value held by a third of all rows is one row here. The
distinct values of a group are then cut into range buckets (bounds from a
bounded quantile sketch), so no single task sorts a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPLITS = 64
#: Bits of the code left out in the rounds of radix selection: 22, 21 and 21 of 64 are counted.
RADIX = (42, 21, 0)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` with NULL equal to NULL; the keys of ``left`` stay."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(named, same).drop(*[f"_r_{k}" for k in keys])


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n) over non-NULL values."""
    return (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
              .agg(F.count(F.lit(1)).alias("n")))


def split_count(df: DataFrame) -> int:
    """Range buckets of a group: as many as the session's shuffle has partitions, ``SPLITS`` at least."""
    return max(SPLITS, min(4096, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def places_in(bounds, values: list[Column], splits: int) -> Column:
    """For each of ``values`` the number of the ascending ``bounds`` (an array of ``splits`` - 1) below it, as an array.

    By bisection: the work of a row grows with the logarithm of the number of ranges. ``bounds`` is named once, so a column that holds a scalar subquery is not copied into rows.
    """
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((splits - 1).bit_length()))])
    # the first ``at`` bounds are below; a place past the end is NULL and adds nothing
    below = lambda b, value: F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(b, at + step - 1) < value, step).otherwise(0))
    return F.transform(F.array(bounds), lambda b: F.transform(F.array(*values), lambda value: below(b, value)))[0]


def range_buckets(distinct: DataFrame, keys: list[str], value: str, splits: int | None = None) -> DataFrame:
    """Add ``_b``, the range bucket of ``value`` inside its group.

    ``distinct`` holds each (keys, value) once. Bounds are an array of at most
    ``splits`` numbers per group; equal values always share a bucket.
    """
    splits = splits or split_count(distinct)
    probs = F.array(*[F.lit(i / splits) for i in range(1, splits)])
    sketch = F.percentile_approx(F.col(value).cast("double"), probs, F.lit(max(1000, 4 * splits)))
    within = places_in(F.col("_bounds"), [F.col(value).cast("double")], splits)[0]
    if keys:
        bounds = distinct.groupBy(*keys).agg(sketch.alias("_bounds"))
        joined = join_null_safe(distinct, bounds, keys)
    else:
        bounds = distinct.agg(sketch.alias("_bounds"))
        joined = distinct.withColumn("_bounds", bounds.scalar())
    return joined.withColumn("_b", within).drop("_bounds")


def prefix_totals(distinct: DataFrame, keys: list[str], value: str, sums: dict[str, str],
                  splits: int | None = None) -> DataFrame:
    """Exclusive running totals over ascending ``value``.

    ``sums`` maps an output name to the column summed. Adds ``<name>`` (total of
    all strictly smaller values) and ``<name>_all`` (group total).
    """
    cut = range_buckets(distinct, keys, value, splits)
    per = cut.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    across = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = across.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    whole = across.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.select(*keys, "_b", *[
        c for n in sums for c in (
            F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}"),
            F.sum(f"_s_{n}").over(whole).alias(f"{n}_all"))])
    inner = W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    joined = join_null_safe(cut, per, [*keys, "_b"])
    for n, c in sums.items():
        joined = joined.withColumn(n, F.col(f"_o_{n}") + F.coalesce(F.sum(c).over(inner), F.lit(0)))
    return joined.drop("_b", *[f"_o_{n}" for n in sums])


def with_order_code(df: DataFrame, value: str, code: str) -> DataFrame:
    """Add a long that sorts as the double ``value`` does: its sign, exponent and mantissa (both zeros are 0; NaN is not expected).

    The exponent is a guess from the logarithm, mended by one where the mantissa would leave [1, 2); each step is a column of its own, so that it is
    worked out once.
    """
    size, power, part = F.abs(F.col(value)), F.pow(F.lit(2.0), F.col("_e")), F.col("_p")
    df = df.withColumn("_e", F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022)).cast("double"))
    df = df.withColumn("_p", size / power)
    up, down = part >= 2, (part < 1) & (F.col("_e") > -1022)
    df = df.withColumn("_e", F.col("_e") + F.when(up, 1.0).when(down, -1.0).otherwise(0.0)).withColumn("_p", F.when(up, part / 2).when(down, part * 2).otherwise(part))
    whole = F.lit(2.0 ** 52)
    # below the least normal number the mantissa is under 1 and its exponent field 0, which the same sum gives
    made = F.when(F.col(value) == 0, F.lit(0).cast("long")).otherwise((F.col("_e") + 1022).cast("long") * F.lit(1 << 52) + (part * whole).cast("long"))
    made = F.when(size == float("inf"), F.lit(2047 << 52)).otherwise(made)
    return df.withColumn(code, F.coalesce(F.when(F.col(value) < 0, -made).otherwise(made), F.lit(0).cast("long"))).drop("_e", "_p")


def few(df: DataFrame, known_small: bool) -> DataFrame:
    """Broadcast a side only when its caller knows the row bound from metadata."""
    return F.broadcast(df) if known_small else df


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], few_groups: bool = False,
              weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: rows (keys, prob, quantile).

    Radix selection on a 64-bit code that sorts as the value does. The first round counts rows by the top bits of the code, in
    the map-side combine; the bits that hold a wanted rank are kept, and the next rounds count the rows below them by their next bits. No value is
    ever sorted with all others: a round sees one row for each pattern of its bits, however many rows a group has. Rows are joined on
    group and bits, so a large group is dealt out by its bits. ``few_groups`` says that the number of groups is bounded by metadata (one group per
    column, say), so the kept bits may be broadcast. ``weight`` names a count column when the input holds distinct values with counts.
    """
    probs = [float(p) for p in probs]
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"), w.alias("_w")).where("_v IS NOT NULL AND NOT isnan(_v)")
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    rows = with_order_code(rows, "_v", "_c")
    ask = lambda prob, high, rank, part: F.struct(prob.alias("prob"), high.alias("high"), rank.alias("rank"), part.alias("part"))
    asks = None
    for turn, low in enumerate(RADIX):
        bits, above = F.shiftright("_c", low).alias("_b"), F.shiftright("_c", RADIX[max(0, turn - 1)]).alias("_a")
        if asks is None:
            per = rows.select(*keys, "_v", "_w", bits).groupBy(*keys, "_b").agg(F.sum("_w").alias("_n"), F.max("_v").alias("_v"))
            across = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
        else:
            met = rows.select(*keys, "_v", "_w", bits, above).join(few(asks.select(*keys, "_a"), few_groups or not keys), [*keys, "_a"], "left_semi")
            per = met.groupBy(*keys, "_a", "_b").agg(F.sum("_w").alias("_n"), F.max("_v").alias("_v")).join(few(asks, few_groups or not keys), [*keys, "_a"])
            across = W.partitionBy(*keys, "_a")
        per = per.withColumn("_before", F.coalesce(F.sum("_n").over(across.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        if asks is None:
            top = F.sum("_n").over(across.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - 1
            per = per.withColumn("_top", top).withColumn("asks", F.array(*[
                ask(F.lit(p), F.lit(high), (F.ceil if high else F.floor)(F.col("_top") * p), F.col("_top") * p - F.floor(F.col("_top") * p)) for p in probs for high in (False, True)]))
        mine = F.filter("asks", lambda a: (a["rank"] >= F.col("_before")) & (a["rank"] < F.col("_before") + F.col("_n")))
        mine = F.transform(mine, lambda a: ask(a["prob"], a["high"], a["rank"] - F.col("_before"), a["part"]))
        asks = per.select(*keys, F.col("_b").alias("_a"), "_v", mine.alias("asks")).where(F.size("asks") > 0)
        if turn + 1 < len(RADIX):
            asks = asks.drop("_v")
    found = asks.select(*keys, "_v", F.inline("asks"))
    low, high = F.max(F.when(~F.col("high"), F.col("_v"))), F.max(F.when(F.col("high"), F.col("_v")))
    return found.groupBy(*keys, "prob").agg((low + (high - low) * F.max("part")).alias("quantile"))


def quantiles_wide(df: DataFrame, keys: list[str], value: str, named: dict[str, float],
                   few_groups: bool = False, weight: str | None = None) -> DataFrame:
    """As :func:`quantiles`, one row per group with one column per name."""
    long = quantiles(df, keys, value, sorted(set(named.values())), few_groups, weight)
    return long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(n)
        for n, p in named.items()])


def running_by_time(df: DataFrame, keys: list[str], ts: str, tie: list[str], sums: dict,
                    slot: str = "hour", inclusive: bool = True, carry_last: dict | None = None, peers: str = "after") -> DataFrame:
    """Per-key running sums in time order, split by time slot.

    Each (key, slot) is summed first; the totals of earlier slots are carried in
    and only the rows of one slot are sorted together, so a key that holds a
    large part of the table is spread over as many tasks as it has slots.

    ``sums``: output name -> numeric column expression.
    ``carry_last``: output name -> expression; last non-NULL value at an earlier
    time. ``peers`` says what rows of the same time are: "after" (not seen),
    "before" (seen, the row itself included) or "by tie" (seen if their tie key is
    smaller). Among equal times the larger tie key is later. NULL keys are keys
    like any other; rows without a time neither see nor are seen, and come first in the sums.
    """
    carry_last = carry_last or {}
    base = df.withColumn("_slot", F.date_trunc(slot, F.col(ts)))
    for n, c in {**sums, **carry_last}.items():
        base = base.withColumn(f"_x_{n}", c)
    order = F.struct(F.col(ts), *[F.col(t) for t in tie])
    aggs = [F.sum(f"_x_{n}").alias(f"_p_{n}") for n in sums]
    aggs += [F.max_by(F.col(f"_x_{n}"), F.when(F.col(f"_x_{n}").isNotNull() & F.col(ts).isNotNull(), order)).alias(f"_p_{n}")
             for n in carry_last]
    per = base.groupBy(*keys, "_slot").agg(*aggs)
    earlier = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(
        *keys, "_slot",
        *[F.coalesce(F.sum(f"_p_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_p_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in carry_last])
    joined = join_null_safe(base.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))), per, [*keys, "_slot"])
    frame = W.partitionBy(*keys, "_slot").orderBy(ts, *tie)
    upto = frame.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    by_time = W.partitionBy(*keys, "_slot").orderBy("_at")
    prior = {"after": by_time.rangeBetween(W.unboundedPreceding, -1), "before": by_time.rangeBetween(W.unboundedPreceding, 0),
             "by tie": frame.rowsBetween(W.unboundedPreceding, -1)}[peers]

    def latest(n):
        met = F.when(F.col(f"_x_{n}").isNotNull(), F.struct(F.col("_at"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)], F.col(f"_x_{n}").alias("_x")))
        return F.when(F.col("_at").isNotNull(), F.max(met).over(prior)["_x"])

    out = joined.select(
        *df.columns,
        *[(F.col(f"_c_{n}") + F.coalesce(F.sum(f"_x_{n}").over(upto), F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(latest(n), F.col(f"_c_{n}")).alias(n)
          for n in carry_last])
    return out
