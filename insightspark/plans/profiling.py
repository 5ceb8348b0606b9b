"""Profiling queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insightspark.operators import profile as P
from insightspark.plans.registry import query
from insightspark.plans.windows import DAILY_SQL, daily

N = lambda: F.count(F.lit(1))

# Column lists of the standard tables, used to write the SQL counterparts.
TABLE_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}


def holed_orders(t):
    """Orders with NULLs planted by key, the same way in Spark and SQL."""
    return t.orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 17 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(" ")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.lit("x").alias("marker"), "o_orderdate")


HOLED_SQL = """h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey END AS o_custkey,
 CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderstatus END AS o_orderstatus,
 'x' AS marker, o_orderdate FROM orders)"""


def _numeric_profile(col):
    return (f"SELECT '{col}' AS column_name, count(*) AS row_count, count(*) - count({col}) AS null_count, "
            f"round(100.0*(count(*)-count({col}))/count(*), 2) AS null_pct, count(DISTINCT {col}) AS n_unique, CAST(min({col}) AS DOUBLE) AS min_value, "
            f"CAST(max({col}) AS DOUBLE) AS max_value, round(avg({col}), 4) AS mean_value, round(stddev_samp({col}), 4) AS std_value, NULL::DOUBLE AS avg_len FROM h")


def _text_profile(col):
    return (f"SELECT '{col}', count(*), count(*) - count({col}), round(100.0*(count(*)-count({col}))/count(*), 2), count(DISTINCT {col}), "
            f"NULL, NULL, NULL, NULL, round(avg(length({col})), 1) FROM h")


@query("i1_profile_columns", f"WITH {HOLED_SQL} " + " UNION ALL ".join(
    [_numeric_profile(c) for c in ("o_orderkey", "o_custkey", "o_totalprice")] + [_text_profile(c) for c in ("o_orderstatus", "marker")]), digits=4)
def i1(t):
    return P.profile_columns(holed_orders(t).drop("o_orderdate")).select(
        "column_name", "row_count", "null_count", "null_pct", "n_unique", "min_value", "max_value", "mean_value", "std_value", "avg_len")


_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]


@query("i1_profile_columns_sketch", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS exact, true AS close FROM lineitem" for c in _KEYS))
def i1b(t):
    """The sketched profile next to exact distinct counts: within 10 %."""
    profile = P.profile_columns(t.lineitem, exact_distinct=False, samples=True)
    exact = reduce(DataFrame.unionByName, [t.lineitem.select(c).distinct().where(F.col(c).isNotNull()).agg(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("exact")) for c in _KEYS])
    return profile.join(exact, "column_name").select("column_name", "row_count", "exact", (F.abs(F.col("n_unique") - F.col("exact")) <= 0.1 * F.col("exact")).alias("close"))


@query("i2_profile_source", " UNION ALL ".join(
    f"SELECT '{tab}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS n_unique FROM {tab}"
    for tab, cols in TABLE_COLUMNS.items() for c in cols))
def i2(t):
    return P.profile_source({n: getattr(t, n) for n in TABLE_COLUMNS}).select(
        "table_name", "column_name", "row_count", "null_count", "n_unique")


@query("i2_date_span", """
SELECT 'orders' AS table_name, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_day FROM orders
UNION ALL SELECT 'events', CAST(CAST(min(ts) AS DATE) AS VARCHAR), CAST(CAST(max(ts) AS DATE) AS VARCHAR) FROM events""")
def i2b(t):
    a = P.date_span(t.orders, ["o_orderdate"]).withColumn("table_name", F.lit("orders"))
    return a.unionByName(P.date_span(t.events, ["ts"]).withColumn("table_name", F.lit("events")))


@query("i3_detect_date_columns", """
WITH x AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS ordered, o_orderpriority AS updated_by, o_orderstatus AS flag FROM orders)
SELECT 'ordered' AS column_name, round(count(TRY_CAST(ordered AS TIMESTAMP)) / count(ordered), 6) AS parse_rate, true AS is_date, 'parses' AS reason FROM x
UNION ALL SELECT 'updated_by', round(count(TRY_CAST(updated_by AS TIMESTAMP)) / count(updated_by), 6), true, 'name' FROM x
UNION ALL SELECT 'flag', round(count(TRY_CAST(flag AS TIMESTAMP)) / count(flag), 6), false, NULL FROM x
UNION ALL SELECT 'raw', NULL, true, 'type'""")
def i3(t):
    df = t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered"), F.col("o_orderpriority").alias("updated_by"),
                         F.col("o_orderstatus").alias("flag"), F.col("o_orderdate").alias("raw"))
    return P.detect_date_columns(df)


@query("i4_compare_snapshots", """
WITH n AS (SELECT count(*) AS a, (SELECT count(*) FROM orders WHERE o_orderdate < DATE '2000-01-01') AS b FROM orders)
SELECT 'orders' AS table_name, 'o_orderpriority' AS column_name, 'column_removed' AS change, NULL::DOUBLE AS row_change_pct, true AS breaking
UNION ALL SELECT 'orders', 'note', 'column_added', NULL, false UNION ALL SELECT 'orders', 'o_custkey', 'type_changed', NULL, false
UNION ALL SELECT 'orders', NULL, 'row_count', round(100.0*(b-a)/a, 2), false FROM n
UNION ALL SELECT 'part', NULL, 'table_removed', NULL, true UNION ALL SELECT 'region', NULL, 'table_added', NULL, false""")
def i4(t):
    later = (t.orders.where("o_orderdate < '2000-01-01'").drop("o_orderpriority").withColumn("note", F.lit("n"))
              .withColumn("o_custkey", F.col("o_custkey").cast("string")))
    old = P.profile_source({"orders": t.orders, "part": t.part})
    new = P.profile_source({"orders": later, "region": t.region})
    return P.compare_snapshots(old, new)


def id_tables(t):
    """Standard tables under ``<entity>_id`` column names."""
    return {
        "orders": t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id")),
        "customer": t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("nation_id")),
        "lineitem": t.lineitem.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id")),
        "part": t.part.select(F.col("p_partkey").alias("part_id")),
        "supplier": t.supplier.select(F.col("s_suppkey").alias("supplier_id"), F.col("s_nationkey").alias("nation_id")),
        "nation": t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region_id")),
        "region": t.region.select(F.col("r_regionkey").alias("id")),
    }


def _containment(a, ac, asql, b, bc, bsql):
    return (f"SELECT '{a}' AS from_table, '{ac}' AS from_column, '{b}' AS to_table, '{bc}' AS to_column, nf, nt, nb FROM (SELECT count(f.v) AS nf, count(x.v) AS nt, "
            f"count(CASE WHEN f.v = x.v THEN 1 END) AS nb FROM (SELECT DISTINCT {asql} AS v FROM {a}) f FULL JOIN (SELECT DISTINCT {bsql} AS v FROM {b}) x ON f.v = x.v)")


@query("i5_discover_relationships", "WITH r AS (" + " UNION ALL ".join([
    _containment("orders", "customer_id", "o_custkey", "customer", "customer_id", "c_custkey"),
    _containment("customer", "nation_id", "c_nationkey", "nation", "id", "n_nationkey"),
    _containment("lineitem", "order_id", "l_orderkey", "orders", "order_id", "o_orderkey"),
    _containment("lineitem", "part_id", "l_partkey", "part", "part_id", "p_partkey"),
    _containment("lineitem", "supplier_id", "l_suppkey", "supplier", "supplier_id", "s_suppkey"),
    _containment("supplier", "nation_id", "s_nationkey", "nation", "id", "n_nationkey"),
    _containment("nation", "region_id", "n_regionkey", "region", "id", "r_regionkey")]) + """)
SELECT from_table, from_column, to_table, to_column, round(nb/nf, 2) AS containment,
 round(CASE WHEN nb > 0 THEN least(1.0::DOUBLE, (0.8::DOUBLE + round(nb/nf, 2))/2 + 0.1) ELSE 0.8 END, 2) AS confidence,
 CASE WHEN nb > 0 THEN 'both' ELSE 'name_match' END AS method, CASE WHEN nf > 0.9*nt THEN 'one-to-one' ELSE 'many-to-one' END AS cardinality FROM r""")
def i5(t):
    return P.discover_relationships(id_tables(t))


_NUM = ["l_quantity", "l_extendedprice", "l_discount"]


def _dist(c):
    return f"""SELECT '{c}' AS column_name, count(*) AS n, count(DISTINCT {c}) AS n_unique, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
 min({c}) AS lo, max({c}) AS hi, round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis, round(quantile_cont({c}, 0.01), 4) AS p1,
 round(quantile_cont({c}, 0.05), 4) AS p5, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS median,
 round(quantile_cont({c}, 0.75), 4) AS p75, round(quantile_cont({c}, 0.95), 4) AS p95, round(quantile_cont({c}, 0.99), 4) AS p99,
 round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr,
 (SELECT count(*) FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem) WHERE {c} < q1 - 1.5*(q3-q1) OR {c} > q3 + 1.5*(q3-q1)) AS n_outliers
 FROM lineitem"""


@query("i6_profile_distributions", " UNION ALL ".join(_dist(c) for c in _NUM), digits=4)
def i6(t):
    return P.distribution_stats(t.lineitem, _NUM)


@query("i7_classify_shape")
def i7(t):
    return P.profile_distributions(t.lineitem, _NUM).select("column_name", "skewness", "kurtosis", "shape", "transform")


@query("i8_recommend_transform", """
SELECT name, round(s, 4) AS skew, CASE WHEN s > 1 AND lo > 0 THEN 'log' WHEN s > 1 AND lo >= 0 THEN 'sqrt' END AS transform FROM (
 SELECT 'value' AS name, skewness(value) AS s, min(value) AS lo FROM events UNION ALL SELECT 'n_chars', skewness(n_chars), min(n_chars) FROM documents
 UNION ALL SELECT 'turn', skewness(turn), min(turn) FROM conversations)""", digits=4)
def i8(t):
    def one(df, c):
        g = df.agg(F.skewness(c).alias("g"), N().alias("n"), F.min(c).alias("lo"))
        s = P.corrected_skew("g", "n")
        return g.select(F.lit(c).alias("name"), s.alias("skew"), P.transform_hint(s, "lo").alias("transform"))
    return one(t.events, "value").unionByName(one(t.documents, "n_chars")).unionByName(one(t.conversations, "turn"))


@query("i9_histogram", """
WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, least(50, count(DISTINCT o_totalprice)) AS k FROM orders),
c AS (SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / k)), k - 1) AS INT) AS bin, count(*) AS n FROM orders, b GROUP BY 1)
SELECT CAST(s.bin AS INT) AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(k)) AS bin FROM b) s LEFT JOIN c ON c.bin = s.bin""")
def i9(t):
    long = P.melt(t.orders, ["o_totalprice"])
    b = long.groupBy("column_name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_distinct("value").alias("u"))
    return P.histogram(long, ["column_name"], "value", F.least(F.lit(50), F.col("u")), b, few_groups=True).select("bin", "n")


@query("i10_temporal_patterns", """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), b AS (SELECT min(day) AS a, max(day) AS z FROM d),
m AS (SELECT day FROM (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM b) ANTI JOIN d USING (day)),
g AS (SELECT day - CAST(row_number() OVER (ORDER BY day) AS INT) AS k, count(*) AS c FROM (SELECT day FROM m) GROUP BY day)
SELECT CAST(a AS VARCHAR) AS first_day, CAST(z AS VARCHAR) AS last_day, (SELECT count(*) FROM d) AS actual, z - a + 1 AS expected,
 round(100.0 * (SELECT count(*) FROM d) / (z - a + 1), 2) AS coverage_pct, (SELECT count(DISTINCT k) FROM g) AS n_gaps, (SELECT count(*) FROM m) AS missing_days FROM b""")
def i10(t):
    out = P.temporal_patterns(t.orders, "o_orderdate")
    return out.withColumn("expected", F.col("expected").cast("long"))


@query("i10_calendar_means", f"""
WITH {DAILY_SQL}
SELECT 'weekday' AS part, dayname(day) AS label, round(avg(events), 6) AS mean, count(*) AS n FROM d GROUP BY 2
UNION ALL SELECT 'month', monthname(day), round(avg(events), 6), count(*) FROM d GROUP BY 2""")
def i10b(t):
    return P.calendar_means(daily(t), "day", "events")


_BASE_TREND = """WITH m AS (SELECT o_orderpriority AS prio, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS amount FROM orders GROUP BY 1, 2)"""


def prio_months(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("prio"), F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("amount"))


@query("i11_detect_trend", _BASE_TREND + """,
x AS (SELECT *, row_number() OVER (PARTITION BY prio ORDER BY month) - 1 AS i FROM m),
f AS (SELECT prio, count(*) AS n, regr_slope(amount, i) AS slope, regr_intercept(amount, i) AS b, avg(amount) AS mean FROM x GROUP BY 1),
r AS (SELECT f.prio, max(n) AS n, max(slope) AS slope, max(mean) AS mean, stddev_pop(amount - (b + slope*i)) / abs(max(mean)) AS cv FROM x JOIN f USING (prio) GROUP BY 1)
SELECT prio, n, round(slope, 2) AS slope, round(cv, 4) AS residual_cv, CASE WHEN n < 5 THEN 'unknown' WHEN cv > 0.5 THEN 'volatile' WHEN slope/abs(mean) > 0.01 THEN 'increasing'
 WHEN slope/abs(mean) < -0.01 THEN 'decreasing' ELSE 'stable' END AS trend FROM r""", digits=4)
def i11(t):
    out = P.detect_trend(prio_months(t), ["prio"], "month", "amount")
    return out.select("prio", "n", F.round("slope", 2).alias("slope"), "residual_cv", "trend")


@query("i12_monthly_seasonality", _BASE_TREND + """,
k AS (SELECT prio, month(month) AS mo, avg(amount) AS v FROM m GROUP BY 1, 2)
SELECT prio, count(*) AS n_months, round(stddev_pop(v)/abs(avg(v)), 6) AS cv, count(*) >= 3 AND stddev_pop(v)/abs(avg(v)) > 0.2 AS seasonal FROM k GROUP BY 1""")
def i12(t):
    return P.monthly_seasonality(prio_months(t), ["prio"], "month", "amount")


@query("i13_correlations", """
WITH l AS (SELECT l_quantity AS a, l_extendedprice AS b, l_quantity * l_discount AS c, CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice * (1 - l_discount) END AS d FROM lineitem),
p AS (SELECT 'a' AS column_a, 'b' AS column_b, round(corr(a, b), 4) AS r FROM l UNION ALL SELECT 'a', 'c', round(corr(a, c), 4) FROM l
 UNION ALL SELECT 'a', 'd', round(corr(a, d), 4) FROM l UNION ALL SELECT 'b', 'c', round(corr(b, c), 4) FROM l
 UNION ALL SELECT 'b', 'd', round(corr(b, d), 4) FROM l UNION ALL SELECT 'c', 'd', round(corr(c, d), 4) FROM l)
SELECT *, CASE WHEN abs(r) >= 0.9 THEN 'very strong' WHEN abs(r) >= 0.7 THEN 'strong' ELSE 'moderate' END AS strength FROM p WHERE abs(r) >= 0.5""")
def i13(t):
    df = t.lineitem.select(
        F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), (F.col("l_quantity") * F.col("l_discount")).alias("c"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("d"))
    return P.correlations(df, ["a", "b", "c", "d"])


def _compl(c, num):
    zero = f"count(CASE WHEN {c} = 0 THEN 1 END)" if num else "0"
    blank = "0" if num else f"count(CASE WHEN trim({c}) = '' THEN 1 END)"
    return f"""SELECT '{c}' AS column_name, count(*) AS total_rows, count({c}) AS non_null, count(*) - count({c}) AS null_count, round(100.0*(count(*)-count({c}))/count(*), 2) AS null_pct,
 CAST({zero} AS BIGINT) AS zero_count, CAST({blank} AS BIGINT) AS empty_string_count, count(DISTINCT {c}) <= 1 AS constant FROM h"""


@query("i14_completeness_profile", f"WITH {HOLED_SQL}, r AS (" + " UNION ALL ".join(
    _compl(c, n) for c, n in [("o_orderkey", True), ("o_custkey", True), ("o_totalprice", True), ("o_orderstatus", False), ("marker", False)]) + """)
SELECT *, CASE WHEN null_pct = 0 THEN 'COMPLETE' WHEN null_pct < 5 THEN 'GOOD' WHEN null_pct < 50 THEN 'WARNING' ELSE 'CRITICAL' END AS status FROM r""")
def i14(t):
    return P.completeness_profile(holed_orders(t).drop("o_orderdate"))


@query("i15_anomaly_bands", f"""
WITH {DAILY_SQL}, u AS (SELECT day, 'events' AS metric, CAST(events AS DOUBLE) AS value FROM d UNION ALL SELECT day, 'revenue', revenue FROM d),
b AS (SELECT *, count(value) OVER w AS c, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM u WINDOW w AS (PARTITION BY metric ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT CAST(day AS VARCHAR) AS day, metric, round(value, 2) AS value, CASE WHEN value > m + 1.5*s THEN 'spike' ELSE 'drop' END AS kind, round(100.0*abs(value-m)/abs(m), 1) AS pct
FROM b WHERE c >= 3 AND m <> 0 AND (value > m + 1.5*s OR value < m - 1.5*s)""", digits=2)
def i15(t):
    return P.anomaly_bands(daily(t), "day", ["events", "revenue"], k=1.5)


@query("i16_frame_fingerprint", f"""
WITH {HOLED_SQL} SELECT 'src' AS label, metric, column_name, value, text FROM (
SELECT 'row_count' AS metric, '*' AS column_name, CAST(count(*) AS DOUBLE) AS value, NULL AS text FROM h
UNION ALL SELECT 'column_count', '*', 3.0, NULL
UNION ALL SELECT 'null_count', 'o_custkey', count(*) - count(o_custkey), NULL FROM h UNION ALL SELECT 'distinct_count', 'o_custkey', count(DISTINCT o_custkey), NULL FROM h
UNION ALL SELECT 'numeric_sum', 'o_custkey', sum(o_custkey), NULL FROM h
UNION ALL SELECT 'null_count', 'o_totalprice', count(*) - count(o_totalprice), NULL FROM h UNION ALL SELECT 'distinct_count', 'o_totalprice', count(DISTINCT o_totalprice), NULL FROM h
UNION ALL SELECT 'numeric_sum', 'o_totalprice', round(sum(o_totalprice), 2), NULL FROM h
UNION ALL SELECT 'null_count', 'o_orderdate', count(*) - count(o_orderdate), NULL FROM h UNION ALL SELECT 'distinct_count', 'o_orderdate', count(DISTINCT o_orderdate), NULL FROM h
UNION ALL SELECT 'date_min', 'o_orderdate', NULL, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) FROM h
UNION ALL SELECT 'date_max', 'o_orderdate', NULL, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) FROM h)""", digits=2)
def i16(t):
    return P.frame_fingerprint(holed_orders(t).select("o_custkey", "o_totalprice", "o_orderdate"), "src")


def _char(c):
    return f"""SELECT '{c}' AS column_name, count(*) AS n, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median,
 round(quantile_cont({c}, 0.05), 4) AS p5, round(quantile_cont({c}, 0.95), 4) AS p95, round(kurtosis_pop({c}), 4) AS kurtosis,
 round(sum(pow({c} - m, 3)) / count(*) / pow(max(sd), 3), 4) AS skewness FROM lineitem, (SELECT avg({c}) AS m, stddev_pop({c}) AS sd FROM lineitem)"""


@query("i17_characterize", " UNION ALL ".join(_char(c) for c in _NUM), digits=4)
def i17(t):
    return P.characterize(t.lineitem, _NUM).select("column_name", "n", "mean", "median", "p5", "p95", "kurtosis", "skewness")


@query("i17_modality")
def i17b(t):
    return P.characterize(t.lineitem, _NUM).select("column_name", "n_peaks", "modality", "shape")


@query("i18_dominant_value", """
WITH c AS (SELECT 'l_linestatus' AS column_name, l_linestatus AS value, count(*) AS n FROM lineitem GROUP BY 2
 UNION ALL SELECT 'big', CAST(l_quantity > 10 AS VARCHAR), count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_returnflag', l_returnflag, count(*) FROM lineitem GROUP BY 2)
SELECT * FROM (SELECT *, round(n / sum(n) OVER (PARTITION BY column_name), 6) AS share FROM c) WHERE share > 0.5""")
def i18(t):
    df = t.lineitem.select("l_linestatus", (F.col("l_quantity") > 10).alias("big"), "l_returnflag")
    return P.dominant_values(df, ["l_linestatus", "big", "l_returnflag"])


@query("i18_sigma_outliers", """
WITH b AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events), c AS (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS s FROM documents)
SELECT 'value' AS column_name, count(CASE WHEN abs(value - m) > 3*s THEN 1 END) AS n_outliers, count(*) AS n FROM events, b
UNION ALL SELECT 'n_chars', count(CASE WHEN abs(n_chars - m) > 3*s THEN 1 END), count(*) FROM documents, c""")
def i18b(t):
    return P.sigma_outliers(t.events, ["value"]).unionByName(P.sigma_outliers(t.documents, ["n_chars"]))


@query("i19_tracking_gap_map", f"""
WITH {HOLED_SQL}, p AS (SELECT 'o_custkey' AS column_name, 100.0*(count(*)-count(o_custkey))/count(*) AS np FROM h UNION ALL SELECT 'o_totalprice', 100.0*(count(*)-count(o_totalprice))/count(*) FROM h
 UNION ALL SELECT 'o_orderdate', 100.0*(count(*)-count(o_orderdate))/count(*) FROM h)
SELECT analysis, column_name, CASE WHEN np IS NULL THEN 'missing' WHEN np > 5 THEN 'partial' ELSE 'available' END AS status
FROM (VALUES ('cohorts', 'o_custkey'), ('cohorts', 'o_orderdate'), ('spend', 'o_totalprice'), ('funnel', 'step')) r(analysis, column_name) LEFT JOIN p USING (column_name)""")
def i19(t):
    req = t.spark.createDataFrame([("cohorts", "orders", "o_custkey"), ("cohorts", "orders", "o_orderdate"), ("spend", "orders", "o_totalprice"),
                                   ("funnel", "orders", "step")], "analysis string, table_name string, column_name string")
    return P.tracking_gaps(req, P.profile_source({"orders": holed_orders(t)})).select("analysis", "column_name", "status")
