"""Cross-verification of claims, tie-out of two tables, reproducibility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insightspark.functions.columns import ratio

N = lambda: F.count(F.lit(1))

# Relative tolerances by check and their additions by source type.
BASE_TOLERANCES = {
    "boundary": 0.0, "row_count": 0.0, "numeric_sum": 0.0001, "distinct_count": 0.0, "parts_to_whole": 0.01,
    "ratio_consistency": 0.001, "algebraic_identity": 0.0001, "date_range": 0.0, "null_count": 0.0,
}
SOURCE_ADJUSTMENTS = {
    "snowflake": {"distinct_count": 0.02},
    "bigquery": {"distinct_count": 0.02, "row_count": 0.001, "numeric_sum": 0.001, "null_count": 0.001},
    "postgres": {}, "duckdb": {}, "csv": {}, "motherduck": {},
}


def tolerance(check: str, source: str | None = None) -> float:
    """Base tolerance plus what the source type adds."""
    return BASE_TOLERANCES.get(check, 0.0) + SOURCE_ADJUSTMENTS.get((source or "").lower(), {}).get(check, 0.0)


def tolerance_table(spark: SparkSession) -> DataFrame:
    """(source, check, tolerance) for joins; at most a few dozen rows."""
    rows = [(s, c, tolerance(c, s)) for s in SOURCE_ADJUSTMENTS for c in BASE_TOLERANCES]
    return spark.createDataFrame(rows, "source string, check_name string, tolerance double")


def boundary_checks(claims: DataFrame, as_of: str) -> DataFrame:
    """Hard bounds (tier 1a) and source citation (tier 1b) per claim."""
    kind, v = F.col("metric_type"), F.col("value")
    verdict = lambda bad: F.when(bad, "FAIL").otherwise("PASS")
    rows = [
        ("monetary_sign", "1a", F.when(kind.isin("revenue", "monetary"), verdict(v < 0))),
        ("percentage_bounds", "1a", F.when(kind.isin("percentage", "rate", "pct", "share"), verdict((v < 0) | (v > 100)))),
        ("no_future_dates", "1a", F.when(kind.isin("date", "timestamp"), verdict(F.col("date_value") > F.lit(as_of).cast("date")))),
        ("zero_denominator", "1a", F.when(kind.isin("ratio", "rate") & F.col("denominator").isNotNull(), verdict(F.col("denominator") == 0))),
        ("source_citation", "1b", F.when(F.coalesce(F.col("source_table"), F.lit("")) == "", "FLAG")),
    ]
    out = claims.select("claim_id", F.inline(F.array(*[
        F.struct(F.lit(n).alias("check_name"), F.lit(t).alias("tier"), s.alias("status")) for n, t, s in rows])))
    return out.where("status IS NOT NULL")


def relative_diff(stated, found):
    s, f = F.col(stated).cast("double"), F.col(found).cast("double")
    return F.coalesce(ratio(F.abs(s - f), F.when(s != 0, F.abs(s)).otherwise(F.abs(f))), F.lit(0.0))


def banded_status(diff, tol: float):
    """PASS within the tolerance, WARN within ten times of it, else FAIL."""
    return F.when(diff <= tol, "PASS").when(diff <= 10 * tol, "WARN").otherwise("FAIL")


def parts_to_whole(totals: DataFrame, parts: DataFrame, keys: list[str], total: str, part: str, source: str | None = None) -> DataFrame:
    """Stated totals against the sum of their parts."""
    p = parts.groupBy(*keys).agg(F.sum(part).alias("from_parts"))
    out = totals.select(*keys, F.col(total).alias("stated")).join(p, keys, "left").withColumn("from_parts", F.coalesce("from_parts", F.lit(0.0)))
    diff = relative_diff("stated", "from_parts")
    return out.withColumn("diff_pct", diff).withColumn("status", banded_status(diff, tolerance("parts_to_whole", source)))


def ratio_recompute(stated: DataFrame, facts: DataFrame, keys: list[str], ratio_col: str, num: str, den: str, source: str | None = None) -> DataFrame:
    """Stated ratios against Σnum / Σden; a zero denominator FAILs."""
    r = facts.groupBy(*keys).agg(F.sum(num).alias("_n"), F.sum(den).alias("_d"))
    out = stated.select(*keys, F.col(ratio_col).alias("stated")).join(r, keys, "left").withColumn("recomputed", ratio("_n", "_d"))
    diff = relative_diff("stated", "recomputed")
    st = F.when(F.coalesce(F.col("_d"), F.lit(0)) == 0, "FAIL").otherwise(banded_status(diff, tolerance("ratio_consistency", source)))
    return out.withColumn("diff_pct", diff).withColumn("status", st).drop("_n", "_d")


def algebraic_identity(left: DataFrame, right: DataFrame, keys: list[str], lv: str, rv: str, source: str | None = None) -> DataFrame:
    """Left and right side of an identity per key."""
    out = left.select(*keys, F.col(lv).alias("left_value")).join(right.select(*keys, F.col(rv).alias("right_value")), keys)
    diff = relative_diff("left_value", "right_value")
    return out.withColumn("diff_pct", diff).withColumn("status", banded_status(diff, tolerance("algebraic_identity", source)))


def cv_score(results: DataFrame, keys: list[str] = ()) -> DataFrame:
    """0-10 ladder over (type A-D, status) rows, worst first; 5 when there are no rows."""
    hit = lambda t, s: F.count_if(F.col("type").isin(*t) & (F.col("status") == s)) > 0
    g = (results.groupBy(*keys) if keys else results.groupBy())
    score = (F.when(N() == 0, 5).when(hit(["A"], "FAIL"), 0).when(hit(["B"], "FAIL"), 2).when(hit(["C", "D"], "FAIL"), 4)
              .when(hit(["B"], "WARN"), 6).when(hit(["C", "D"], "WARN"), 8).otherwise(10))
    status = (F.when(F.count_if(F.col("status") == "FAIL") > 0, "FAIL").when(F.count_if(F.col("status").isin("WARN", "FLAG")) > 0, "WARN").otherwise("PASS"))
    return g.agg(score.alias("score"), status.alias("overall_status"), N().alias("n_checks"))


def compare_profiles(source: DataFrame, target: DataFrame) -> DataFrame:
    """Outer join of two fingerprints: exact metrics, sums within 0.01 % (0.01 absolute floor)."""
    s = source.select("metric", "column_name", F.col("value").alias("source_value"), F.col("text").alias("source_text"), F.lit(True).alias("_s"))
    d = target.select("metric", "column_name", F.col("value").alias("target_value"), F.col("text").alias("target_text"), F.lit(True).alias("_d"))
    both = s.join(d, ["metric", "column_name"], "full_outer")
    gap = F.abs(F.col("source_value") - F.col("target_value"))
    near = (gap <= 0.01) | (F.coalesce(ratio(gap, F.abs("source_value")), F.lit(1.0)) <= tolerance("numeric_sum"))
    same = F.when(F.col("metric") == "numeric_sum", near).when(F.col("metric").startswith("date"), F.col("source_text").eqNullSafe(F.col("target_text"))).otherwise(gap == 0)
    status = F.when(F.col("_s").isNull(), "EXTRA").when(F.col("_d").isNull(), "MISSING").when(F.coalesce(same, F.lit(False)), "PASS").otherwise("FAIL")
    return both.withColumn("status", status).drop("_s", "_d")


def table_checksum(df: DataFrame) -> DataFrame:
    """Row count and an order-free content hash.

    Row hashes are split into 32-bit halves before summing, so neither sum can
    overflow below 2^31 rows per group of equal hashes and order never matters.
    """
    h = F.xxhash64(*[x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])  # a bare hash skips NULLs
    return df.select(h.bitwiseAND(0xFFFFFFFF).alias("lo"), F.shiftrightunsigned(h, 32).alias("hi")).agg(
        N().alias("row_count"), F.coalesce(F.sum(F.col("lo").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum_lo"),
        F.coalesce(F.sum(F.col("hi").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum_hi"))


def reproducibility(runs: list[DataFrame]) -> DataFrame:
    """Same result in every run: PASS, changed row counts WARN, changed values FAIL."""
    frames = [table_checksum(r).withColumn("run", F.lit(i)) for i, r in enumerate(runs)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    one = out.agg(N().alias("n_runs"), F.count_distinct("row_count").alias("counts"), F.count_distinct("sum_lo", "sum_hi").alias("contents"))
    st = F.when(F.col("contents") == 1, "PASS").when(F.col("counts") > 1, "WARN").otherwise("FAIL")
    return one.select("n_runs", "counts", "contents", st.alias("status"))


def reproducibility_bands(runs: list[DataFrame | None], tolerance: float = 0.0, static: bool = False) -> DataFrame:
    """Repeated runs judged by how far their row counts lie apart; ``None`` stands for a run that failed.

    One row: ``n_runs, n_succeeded, variance, status``. SKIPPED for a static source checked without tolerance, FAIL with
    fewer than two runs that succeeded, PASS when all contents are equal (order never counts). Else the relative spread of the
    row counts decides: PASS up to ``tolerance``, WARN up to ten times it, FAIL beyond; contents that differ at
    equal row counts are a changed result and FAIL.
    """
    done = [r for r in runs if r is not None]
    spark = next(iter(done)).sparkSession if done else None
    if spark is None:
        raise ValueError("no run to judge")
    head = [F.lit(len(runs)).alias("n_runs"), F.lit(len(done)).alias("n_succeeded")]
    sums = reduce(DataFrame.unionByName, [table_checksum(r) for r in done]).agg(
        F.min("row_count").alias("lo"), F.max("row_count").alias("hi"), F.count_distinct("row_count", "sum_lo", "sum_hi").alias("contents"))
    spread = F.coalesce(ratio(F.col("hi") - F.col("lo"), F.col("hi")), F.lit(0.0))
    band = F.when(spread <= tolerance, "PASS").when(spread <= 10 * tolerance, "WARN").otherwise("FAIL")
    status = F.when(F.col("contents") == 1, "PASS").when(F.col("lo") == F.col("hi"), "FAIL").otherwise(band)
    if static and tolerance == 0.0:
        status = F.lit("SKIPPED")
    elif len(done) < 2:
        spread, status = F.lit(1.0), F.lit("FAIL")
    return sums.select(*head, F.round(spread, 6).alias("variance"), status.alias("status"))


def variance_diagnosis(runs: DataFrame) -> DataFrame:
    """Why runs of one query differ: (query_id, row_count, sql_text, source) rows."""
    g = runs.groupBy("query_id").agg(
        F.max(F.upper("sql_text").rlike("APPROX_COUNT_DISTINCT|APPROX_TOP_COUNT|APPROX_QUANTILES|HLL_COUNT|APPROX_PERCENTILE")).alias("approx"),
        F.count_distinct("row_count").alias("counts"), F.max("source").alias("source"))
    why = (F.when(F.col("approx"), "APPROX_FUNCTION").when(F.col("counts") > 1, "LIVE_INGESTION").when(F.col("source") == "bigquery", "STREAMING_BUFFER")
            .when(F.col("source") == "postgres", "MVCC_SNAPSHOT").otherwise("UNKNOWN"))
    return g.select("query_id", why.alias("cause"))


def two_way_metric(a: DataFrame, b: DataFrame, keys: list[str], va: str, vb: str) -> DataFrame:
    """The same metric computed two ways, banded at 0.1 %, 1 % and 5 %."""
    out = a.select(*keys, F.col(va).alias("way_a")).join(b.select(*keys, F.col(vb).alias("way_b")), keys, "full_outer")
    diff = ratio(F.abs(F.col("way_a") - F.col("way_b")), F.abs("way_a"))
    band = F.when(diff <= 0.001, "exact").when(diff <= 0.01, "close").when(diff <= 0.05, "acceptable").otherwise("mismatch")
    return out.withColumn("diff_pct", diff).withColumn("band", band)
