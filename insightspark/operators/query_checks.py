"""Sanity checks on query results, with PASS / WARN / FAIL status."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insightspark.functions.checks import check_row, emit, stack_rows, static_rows
from insightspark.functions.columns import dates_between, ratio
from insightspark.functions.ranks import quantiles_wide
from insightspark.operators.profile import missing
from insightspark.operators.windows import by_period

N = lambda: F.count(F.lit(1))


def pct_sum_band(df: DataFrame, pct: str, expected: float = 100.0, tolerance: float = 1.0) -> DataFrame:
    """Within the tolerance PASS, within twice of it WARN, else FAIL."""
    one = df.agg(F.sum(pct).alias("s"))
    gap = F.abs(F.col("s") - expected)
    st = F.when(gap <= tolerance, "PASS").when(gap <= 2 * tolerance, "WARN").otherwise("FAIL")
    return emit(one, [check_row("pct_sum_band", pct, st != "FAIL", st, F.col("s"), f"{expected:g}")])


def date_bounds(df: DataFrame, day: str, low: str | None, high: str | None) -> DataFrame:
    """Dates outside the bounds as a share of all rows."""
    d = F.to_date(day)
    out = F.lit(False)
    if low:
        out = out | (d < F.lit(low).cast("date"))
    if high:
        out = out | (d > F.lit(high).cast("date"))
    one = df.agg(F.count_if(out).alias("n_out"), N().alias("n"))
    st = F.when(F.col("n_out") == 0, "PASS").otherwise("FAIL")
    return emit(one, [check_row("date_bounds", day, st == "PASS", st, F.round(100.0 * ratio("n_out", "n"), 4), f"{low}..{high}", F.col("n_out"))])


def no_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in duplicated keys and the number of such keys."""
    per = df.groupBy(*keys).agg(N().alias("_n"))
    one = per.agg(F.count_if(F.col("_n") > 1).alias("k"), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("r"))
    st = F.when(F.col("k") == 0, "PASS").otherwise("FAIL")
    return emit(one, [check_row("no_duplicates", ",".join(keys), st == "PASS", st, F.col("r"), "0", F.col("k"))])


def temporal_coverage(df: DataFrame, ts: str, unit: str = "day", max_gap: int = 1) -> DataFrame:
    """Coverage of the period spine; gaps count when longer than ``max_gap`` periods."""
    p = df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc(unit, F.col(ts)).alias("p")).agg(N().alias("_n"))
    spine = p.agg(F.min("p").alias("a"), F.max("p").alias("b")).select(F.explode(dates_between("a", "b", unit)).alias("p"))
    marked = spine.join(p, "p", "left").withColumn("i", F.row_number().over(by_period([], "p")))
    gone = marked.where("_n IS NULL").withColumn("g", F.col("i") - F.row_number().over(by_period([], "p")))
    gaps = gone.groupBy("g").agg(N().alias("len")).agg(F.count_if(F.col("len") > max_gap).alias("n_gaps"))
    one = marked.agg(N().alias("expected"), F.count("_n").alias("actual")).withColumn("n_gaps", gaps.scalar())
    cov = 100.0 * ratio("actual", "expected")
    st = F.when(cov >= 100, "PASS").when(cov >= 95, "WARN").otherwise("FAIL")
    return emit(one, [check_row("temporal_coverage", ts, st != "FAIL", st, F.round(cov, 4), unit, F.col("n_gaps"))])


def value_domain_3way(df: DataFrame, column: str, expected: list, allow_null: bool = True) -> DataFrame:
    """Unexpected values FAIL, missing expected ones WARN."""
    have = df.select(F.col(column).cast("string").alias("v")).distinct()
    want = df.sparkSession.createDataFrame([(str(v),) for v in expected], "v string")
    state = have.where("v IS NOT NULL").withColumn("h", F.lit(1)).join(want.withColumn("w", F.lit(1)), "v", "full_outer")
    one = state.agg(F.count_if(F.col("w").isNull()).alias("unexpected"), F.count_if(F.col("h").isNull()).alias("absent"))
    nulls = F.lit(False) if allow_null else F.lit(True)
    one = one.withColumn("has_null", have.where("v IS NULL").agg(N() > 0).scalar())
    st = F.when((F.col("unexpected") > 0) | (nulls & F.col("has_null")), "FAIL").when(F.col("absent") > 0, "WARN").otherwise("PASS")
    return emit(one, [check_row("value_domain", column, st != "FAIL", st, F.col("unexpected"), str(len(expected)), F.col("absent"))])


def monotonic_status(series: DataFrame, order: str, value: str, direction="increasing", strict=False) -> DataFrame:
    from insightspark.operators.logical import monotonic
    out = monotonic(series, order, value, direction, strict)
    return out.withColumn("severity", F.when(F.col("ok"), "PASS").otherwise("FAIL"))


def null_concentration(df: DataFrame, warn: float = 0.5, fail: float = 0.95) -> DataFrame:
    """Share of NULLs per column."""
    aggs = [N().alias("n")] + [F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]
    rows = []
    for i, c in enumerate(df.columns):
        rate = F.coalesce(ratio(f"m{i}", "n"), F.lit(0.0))
        st = F.when(rate >= fail, "FAIL").when(rate >= warn, "WARN").otherwise("PASS")
        rows.append(check_row("null_concentration", c, st == "PASS", st, F.round(rate, 6), str(warn)))
    return emit(df.agg(*aggs), rows)


def outliers(df: DataFrame, column: str, method: str = "iqr", multiplier: float = 1.5, z: float = 3.0) -> DataFrame:
    """Outlier share: below 5 % PASS, below 15 % WARN, else FAIL; fewer than 4 rows WARN, constant PASS."""
    v = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    if method == "iqr":
        q = quantiles_wide(v, [], "v", {"q1": 0.25, "q3": 0.75})
        band = q.select(F.struct((F.col("q1") - multiplier * (F.col("q3") - F.col("q1"))).alias("lo"),
                                 (F.col("q3") + multiplier * (F.col("q3") - F.col("q1"))).alias("hi"),
                                 (F.col("q3") == F.col("q1")).alias("flat")))
    else:
        s = v.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
        band = s.select(F.struct((F.col("m") - z * F.col("s")).alias("lo"), (F.col("m") + z * F.col("s")).alias("hi"), (F.col("s") == 0).alias("flat")))
    one = v.withColumn("b", band.scalar()).agg(
        N().alias("n"), F.count_if((F.col("v") < F.col("b.lo")) | (F.col("v") > F.col("b.hi"))).alias("k"), F.max("b.flat").alias("flat"))
    share = F.coalesce(ratio("k", "n"), F.lit(0.0))
    st = (F.when(F.col("n") < 4, "WARN").when(F.coalesce(F.col("flat"), F.lit(False)), "PASS")
           .when(share < 0.05, "PASS").when(share < 0.15, "WARN").otherwise("FAIL"))
    return emit(one, [check_row(f"outliers_{method}", column, st != "FAIL", st, F.round(share, 6), "0.05", F.col("k"))])


def empty_result(df: DataFrame, label: str = "result") -> DataFrame:
    """WARN when there are no rows (reads at most one)."""
    one = df.limit(1).agg(N().alias("n"))
    st = F.when(F.col("n") == 0, "WARN").otherwise("PASS")
    return emit(one, [check_row("empty_result", label, st == "PASS", st, None, ">0")])


def safe(check):
    """Turn a failing check into an ERROR row so that the others still run.

    The plan is analysed here; run-time data errors surface with the job.
    """
    @functools.wraps(check)
    def wrapped(df, *args, **kwargs):
        try:
            out = check(df, *args, **kwargs)
            out.schema
            return out
        except Exception as exc:  # noqa: BLE001
            text = f"{type(exc).__name__}: {exc}"
            return static_rows(df.sparkSession, [(check.__name__, "*", False, "ERROR", None, None, text)])
    return wrapped


def tier_gate(df: DataFrame, keys: list[str], denominator: str, day: str, start: str, end: str, domain: tuple[str, list]) -> DataFrame:
    """HALT on no rows, zero denominators or no date overlap; FLAG on NULLs above 20 %, duplicate keys or domain misses."""
    any_null = F.greatest(*[F.when(missing(df, c), 1).otherwise(0) for c in df.columns]) == 1 if len(df.columns) > 1 else missing(df, df.columns[0])
    col, values = domain
    per = df.groupBy(*keys).agg(
        N().alias("_n"), F.count_if(F.col(denominator) == 0).alias("_z"), F.count_if(any_null).alias("_m"),
        F.count_if(F.to_date(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("_in"),
        F.count_if(F.col(col).isNotNull() & ~F.col(col).isin(values)).alias("_d"))
    one = per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.sum("_z").alias("z"), F.sum("_m").alias("m"), F.sum("_in").alias("inside"),
                  F.sum("_d").alias("d"), F.count_if(F.col("_n") > 1).alias("k"))
    gate = lambda bad, level: F.when(F.coalesce(bad, F.lit(True)), level).otherwise("PASS")
    null_rate = ratio("m", "n")
    rows = [("rows", F.col("n") == 0, "HALT", F.col("n")), ("zero_division", F.col("z") > 0, "HALT", F.col("z")),
            ("date_overlap", F.col("inside") == 0, "HALT", F.col("inside")), ("null_rate", null_rate > 0.2, "FLAG", F.round(null_rate, 6)),
            ("duplicate_keys", F.col("k") > 0, "FLAG", F.col("k")), ("domain", F.col("d") > 0, "FLAG", F.col("d"))]
    return emit(one, [check_row("tier_gate", n, gate(bad, lv) == "PASS", gate(bad, lv), v) for n, bad, lv, v in rows])


def gate_status(checks: DataFrame) -> DataFrame:
    """HALT beats FLAG beats PASS."""
    return checks.agg(F.when(F.count_if(F.col("severity") == "HALT") > 0, "HALT").when(F.count_if(F.col("severity") == "FLAG") > 0, "FLAG")
                      .otherwise("PASS").alias("gate"), F.count_if(~F.col("ok")).alias("n_failed"))


def all_checks(frames: list[DataFrame]) -> DataFrame:
    return stack_rows(frames)
