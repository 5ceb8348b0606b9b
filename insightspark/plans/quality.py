"""Data quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from insightspark.functions.columns import ratio
from insightspark.operators import business as B
from insightspark.operators import logical as L
from insightspark.operators import query_checks as Q
from insightspark.operators import structural as S
from insightspark.operators.profile import detect_trend  # noqa: F401
from insightspark.plans.profiling import HOLED_SQL, holed_orders, prio_months
from insightspark.plans.registry import query
from insightspark.plans.windows import DAILY_SQL, daily

N = lambda: F.count(F.lit(1))


def chk(check, subject, ok, sev, value="NULL", expected="NULL", detail="NULL", source="", digits=6):
    """One check row in SQL."""
    return (f"SELECT '{check}' AS check_name, '{subject}' AS subject, ({ok}) AS ok, {sev} AS severity, "
            f"round(CAST({value} AS DOUBLE), {digits}) AS value, CAST({expected} AS VARCHAR) AS expected, CAST({detail} AS VARCHAR) AS detail {source}")


def sev(cond, bad="WARNING"):
    return f"CASE WHEN {cond} THEN 'PASS' ELSE '{bad}' END"


# -- L structural ----------------------------------------------------------

@query("l1_schema", "SELECT *, (SELECT count(*) FROM orders) AS n_rows FROM (" + " UNION ALL ".join([
    chk("schema", c, "true", "'PASS'", expected="'present'") for c in ("o_orderkey", "o_custkey")] + [
    chk("schema", "o_channel", "false", "'BLOCKER'", expected="'present'", detail="'missing'"),
    chk("schema_type", "o_orderdate", "true", "'PASS'", expected="'datetime'", detail="'datetime'"),
    chk("schema_type", "o_custkey", "false", "'WARNING'", expected="'string'", detail="'numeric'")] + [
    chk("schema_extra", c, "true", "'PASS'", detail="'extra column'") for c in ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")]) + ")")
def l1(t):
    checks = S.schema_check(t.orders, ["o_orderkey", "o_custkey", "o_channel"], {"o_orderdate": "datetime", "o_custkey": "string"})
    return checks.withColumn("n_rows", t.orders.agg(F.count(F.lit(1))).scalar())


_PK = "FROM (SELECT count(CASE WHEN l_orderkey IS NULL OR l_linenumber IS NULL THEN 1 END) AS nulls, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS dups FROM lineitem)"


@query("l2_primary_key", chk("primary_key_nulls", "l_orderkey,l_linenumber", "nulls = 0", sev("nulls = 0", "BLOCKER"), "nulls", "'0'", source=_PK) + " UNION ALL " +
       chk("primary_key_duplicates", "l_orderkey,l_linenumber", "dups = 0", sev("dups = 0", "BLOCKER"), "dups", "'0'", source=_PK))
def l2(t):
    return S.primary_key(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("l2_duplicate_samples", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, 1, 2 LIMIT 5""")
def l2b(t):
    return S.duplicated_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


def _compl(c):
    r = f"((count(*) - count({c})) / count(*))"
    return chk("completeness", c, f"{r} <= 0.05", f"CASE WHEN {r} > 0.2 THEN 'BLOCKER' WHEN {r} > 0.05 THEN 'WARNING' ELSE 'PASS' END", r, "'0.95'", source="FROM h")


@query("l3_completeness", f"WITH {HOLED_SQL} " + " UNION ALL ".join([_compl(c) for c in ("o_orderkey", "o_custkey", "o_totalprice")] + [
    chk("completeness", "o_channel", "false", "'BLOCKER'", expected="'0.95'", detail="'missing column'")]))
def l3(t):
    return S.completeness(holed_orders(t), ["o_orderkey", "o_custkey", "o_totalprice", "o_channel"])


_DR = "FROM (SELECT min(d) AS a, max(d) AS b, max(g) AS worst, count(CASE WHEN g > 7 THEN 1 END) AS k FROM (SELECT d, d - lag(d) OVER (ORDER BY d) AS g FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)))"


@query("l4_date_range", " UNION ALL ".join([
    chk("date_start", "o_orderdate", "a = DATE '1995-01-01'", sev("a = DATE '1995-01-01'"), expected="'1995-01-01'", detail="a", source=_DR),
    chk("date_end", "o_orderdate", "b = DATE '2001-12-31'", sev("b = DATE '2001-12-31'"), expected="'2001-12-31'", detail="b", source=_DR),
    chk("date_gaps", "o_orderdate", "k = 0", sev("k = 0"), "k", "'7'", "worst", source=_DR)]))
def l4(t):
    return S.date_range(t.orders, "o_orderdate", "1995-01-01", "2001-12-31", 7)


@query("l5_referential_integrity", chk(
    "referential_integrity", "l_orderkey", "o = 0", "CASE WHEN o/n > 0.05 THEN 'BLOCKER' WHEN o > 0 THEN 'WARNING' ELSE 'PASS' END", "o/n", "'0'", "o",
    source="FROM (SELECT count(*) AS n, count(CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-01-01') THEN 1 END) AS o FROM lineitem)"))
def l5(t):
    return S.referential_integrity(t.lineitem, "l_orderkey", t.orders.where("o_orderdate >= '1996-01-01'"), "o_orderkey")


_VD = "FROM (SELECT count(CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 1 END) AS u, count(CASE WHEN o_totalprice < 2000 THEN 1 END) AS lo, count(CASE WHEN o_totalprice > 490000 THEN 1 END) AS hi FROM orders)"


@query("l6_value_domain", " UNION ALL ".join([
    chk("domain_values", "o_orderstatus", "u = 0", sev("u = 0"), "u", "'2'", source=_VD),
    chk("domain_low", "o_totalprice", "lo = 0", sev("lo = 0"), "lo", "'2000'", source=_VD),
    chk("domain_high", "o_totalprice", "hi = 0", sev("hi = 0"), "hi", "'490000'", source=_VD)]))
def l6(t):
    from insightspark.functions.checks import run_probes
    return run_probes(t.orders, [S.domain_probe("o_orderstatus", ["F", "O"]), S.domain_probe("o_totalprice", low=2000, high=490000)])


@query("l6_unexpected_values", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1")
def l6b(t):
    return S.unexpected_values(t.orders, "o_orderstatus", ["F", "O"])


@query("l7_row_count", chk("row_count", "*", "n BETWEEN 1 AND 1000000000", sev("n BETWEEN 1 AND 1000000000", "BLOCKER"), "n", "'1..1000000000'",
                           source="FROM (SELECT count(*) AS n FROM events)"))
def l7(t):
    return S.row_count(t.events, 1, 1000000000)


_L8 = "FROM (SELECT count(*) AS n, count(CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer) THEN 1 END) AS o, count(*) - count(DISTINCT o_orderkey) AS d FROM orders)"


@query("l8_run_structural", " UNION ALL ".join(
    [chk("schema", c, "true", "'PASS'", expected="'present'") for c in ("o_orderkey", "o_custkey", "o_totalprice")]
    + [chk("schema_extra", c, "true", "'PASS'", detail="'extra column'") for c in ("o_orderstatus", "o_orderdate", "o_orderpriority")]
    + [chk("completeness", c, "true", "'PASS'", "0", "'0.95'") for c in ("o_orderkey", "o_custkey", "o_totalprice")]
    + [chk("row_count", "*", "n >= 1", sev("n >= 1", "BLOCKER"), "n", "'1..'", source=_L8),
       chk("primary_key_nulls", "o_orderkey", "true", "'PASS'", "0", "'0'"),
       chk("primary_key_duplicates", "o_orderkey", "d = 0", sev("d = 0", "BLOCKER"), "d", "'0'", source=_L8),
       chk("referential_integrity", "o_custkey", "o = 0", sev("o = 0"), "o/n", "'0'", "o", source=_L8)]))
def l8(t):
    return S.run_structural(t.orders, {"columns": ["o_orderkey", "o_custkey", "o_totalprice"], "primary_key": ["o_orderkey"],
                                       "references": [("o_custkey", t.customer, "c_custkey")]})


# -- M logical -------------------------------------------------------------

@query("m1_aggregation_total", chk("aggregation_total", "amount", "g <= 0.01", sev("g <= 0.01", "BLOCKER"), "g", "'0.01'",
       source="FROM (SELECT abs(e - a)/abs(e) AS g FROM (SELECT sum(l_extendedprice) AS e, (SELECT sum(o_totalprice) FROM orders) AS a FROM lineitem))"))
def m1(t):
    return L.aggregation_total(t.lineitem.withColumnRenamed("l_extendedprice", "amount"), t.orders.withColumnRenamed("o_totalprice", "amount"), "amount")


@query("m2_aggregation_by_group", """
WITH d AS (SELECT o_custkey, sum(o_totalprice) AS expected FROM orders GROUP BY 1),
s AS (SELECT o_custkey, sum(o_totalprice) * CASE WHEN o_custkey % 50 = 0 THEN 1.1 WHEN o_custkey % 50 = 1 THEN 1.03 ELSE 1 END AS actual FROM orders WHERE o_custkey % 100 <> 7 GROUP BY 1),
j AS (SELECT o_custkey, expected, actual, abs(expected - actual)/abs(expected) AS g FROM d LEFT JOIN s USING (o_custkey))
SELECT o_custkey, round(expected, 2) AS expected, round(actual, 2) AS actual, round(g, 6) AS diff_pct, CASE WHEN g IS NULL OR g > 0.05 THEN 'BLOCKER' ELSE 'WARNING' END AS severity FROM j WHERE g IS NULL OR g > 0.01""")
def m2(t):
    f = F.when(F.col("o_custkey") % 50 == 0, 1.1).when(F.col("o_custkey") % 50 == 1, 1.03).otherwise(1.0)
    summary = t.orders.where("o_custkey % 100 <> 7").groupBy("o_custkey").agg((F.sum("o_totalprice") * f).alias("o_totalprice"))
    out = L.aggregation_by_group(t.orders, summary, ["o_custkey"], "o_totalprice")
    return out.withColumn("expected", F.round("expected", 2)).withColumn("actual", F.round("actual", 2))


@query("m3_pct_sum", """
WITH p AS (SELECT o_orderpriority, o_orderstatus, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 0) AS pct FROM orders GROUP BY 1, 2),
g AS (SELECT o_orderpriority, sum(pct) AS s FROM p GROUP BY 1)
SELECT 'pct_sum' AS check_name, 'pct' AS subject, max(abs(s - 100)) <= 1 AS ok, CASE WHEN max(abs(s-100)) <= 1 THEN 'PASS' ELSE 'BLOCKER' END AS severity, 100.0 + max(abs(s-100)) AS value, '100' AS expected, NULL::VARCHAR AS detail FROM g""")
def m3(t):
    from insightspark.operators.windows import share_of_total
    p = share_of_total(t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(N().alias("n")), ["o_orderpriority"], "n")
    p = p.withColumn("pct", F.round(100.0 * F.col("share"), 0))
    out = L.pct_sum(p, "pct", ["o_orderpriority"])
    # several groups can share the worst distance on either side of 100; report the distance above it
    return out.withColumn("value", 100.0 + F.abs(F.col("value") - 100.0))


@query("m4_monotonic", f"""WITH {DAILY_SQL}, x AS (SELECT day, users < lag(users) OVER (ORDER BY day) AS bad FROM d)
""" + chk("monotonic", "users", "n = 0", sev("n = 0"), "n", "'increasing'", "f", source="FROM (SELECT count(CASE WHEN bad THEN 1 END) AS n, min(CASE WHEN bad THEN day END) AS f FROM x)"))
def m4(t):
    return L.monotonic(daily(t), "day", "users")


@query("m5_trend_zscore", f"""WITH {DAILY_SQL},
r AS (SELECT day, events, count(events) OVER w AS c, avg(events) OVER w AS roll_mean, stddev_samp(events) OVER w AS roll_std FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT CAST(day AS VARCHAR) AS day, events, round(roll_mean, 6) AS roll_mean, round(roll_std, 6) AS roll_std, round(abs(events - roll_mean)/roll_std, 6) AS z FROM r WHERE c >= 3 AND roll_std > 0 AND abs(events - roll_mean)/roll_std > 2""")
def m5(t):
    return L.trend_zscore(daily(t), "day", "events", max_z=2.0)


@query("m6_segment_exhaustive", f"WITH {HOLED_SQL} " + chk(
    "segment_exhaustive", "o_custkey", "g <= 0.001 AND m = 0", "CASE WHEN g > 0.01 OR m > 0 THEN 'BLOCKER' WHEN g > 0.001 THEN 'WARNING' ELSE 'PASS' END", "g", "'0.001'", "m",
    source="FROM (SELECT abs(sum(o_totalprice) - sum(CASE WHEN o_custkey IS NOT NULL THEN o_totalprice END))/abs(sum(o_totalprice)) AS g, count(*) - count(o_custkey) AS m FROM h)"))
def m6(t):
    return L.segment_exhaustive(holed_orders(t), "o_custkey", "o_totalprice")


@query("m7_ratio_bounds", chk("ratio_bounds", "l_tax/l_discount", "k = 0", sev("k = 0"), "k", "'0..1'", "n",
       source="FROM (SELECT count(CASE WHEN l_discount <> 0 AND l_tax/l_discount > 1 THEN 1 END) AS k, count(CASE WHEN l_discount <> 0 THEN 1 END) AS n FROM lineitem)"))
def m7(t):
    return L.ratio_bounds(t.lineitem, "l_tax", "l_discount")


@query("m8_group_balance", chk("group_balance", "event_type", "lo >= 10 AND hi/lo <= 4", sev("lo >= 10 AND hi/lo <= 4"), "hi/lo", "'4'", "lo", digits=4,
       source="FROM (SELECT min(n) AS lo, max(n) AS hi FROM (SELECT count(*) AS n FROM events GROUP BY event_type))"))
def m8(t):
    return L.group_balance(t.events, "event_type", 10, 4.0)


@query("m9_future_dates", chk("future_dates", "l_shipdate", "k = 0", sev("k = 0"), "k", "'2001-01-01'",
       source="FROM (SELECT count(CASE WHEN CAST(l_shipdate AS DATE) > DATE '2001-01-01' THEN 1 END) AS k FROM lineitem)"))
def m9(t):
    return L.future_dates(t.lineitem, "l_shipdate", "2001-01-01")


@query("m10_trend_continuity", f"WITH {DAILY_SQL}, s AS (SELECT revenue, lag(revenue) OVER (ORDER BY day) AS p FROM d) " + chk(
    "trend_continuity", "revenue", "n = 0", "CASE WHEN n > 2 THEN 'BLOCKER' WHEN n > 0 THEN 'WARNING' ELSE 'PASS' END", "n", "'0.2'",
    source="FROM (SELECT count(CASE WHEN p <> 0 AND abs(revenue - p)/abs(p) > 0.2 THEN 1 END) AS n FROM s)"))
def m10(t):
    return L.trend_continuity(daily(t), "day", "revenue", 0.2)


_M11 = """WITH r AS (SELECT CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS v FROM orders),
p AS (SELECT d, count(*) AS n, count(CASE WHEN v IS NULL OR v = 0 THEN 1 END) AS z FROM r GROUP BY 1), e AS (SELECT min(d) AS a, max(d) AS b FROM p),
k AS (SELECT max(b - a + 1) AS expected, max(b - a + 1) - count(*) AS miss, count(CASE WHEN n > 1 THEN 1 END) AS dups, coalesce(sum(CASE WHEN d <> a AND d <> b THEN z END), 0) AS zeros FROM p, e),
s AS (SELECT *, CASE WHEN dups > 0 OR (miss + dups + zeros)/expected > 0.1 THEN 'BLOCKER' WHEN miss + dups + zeros > 0 THEN 'WARNING' ELSE 'PASS' END AS sv FROM k) """


@query("m11_temporal_consistency", _M11 + " UNION ALL ".join(
    chk(f"temporal_{n}", "o_orderdate", "sv = 'PASS'", "sv", c, "'0'", source="FROM s") for n, c in (("missing", "miss"), ("duplicates", "dups"), ("zeros", "zeros"))))
def m11(t):
    df = t.orders.withColumn("v", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")))
    return L.temporal_consistency(df, "o_orderdate", "v")


@query("m12_run_logical", f"WITH {HOLED_SQL} " + " UNION ALL ".join([
    chk("segment_exhaustive", "o_custkey", "g <= 0.001 AND m = 0", "CASE WHEN g > 0.01 OR m > 0 THEN 'BLOCKER' WHEN g > 0.001 THEN 'WARNING' ELSE 'PASS' END", "g", "'0.001'", "m",
        source="FROM (SELECT abs(sum(o_totalprice) - sum(CASE WHEN o_custkey IS NOT NULL THEN o_totalprice END))/abs(sum(o_totalprice)) AS g, count(*) - count(o_custkey) AS m FROM h)"),
    chk("future_dates", "o_orderdate", "k = 0", sev("k = 0"), "k", "'2001-08-01'", source="FROM (SELECT count(CASE WHEN o_orderdate > DATE '2001-08-01' THEN 1 END) AS k FROM h)"),
    chk("group_balance", "o_orderstatus", "lo >= 10 AND hi/lo <= 100", sev("lo >= 10 AND hi/lo <= 100"), "hi/lo", "'100'", "lo", digits=4,
        source="FROM (SELECT min(n) AS lo, max(n) AS hi FROM (SELECT count(*) AS n FROM h GROUP BY o_orderstatus))")]))
def m12(t):
    return L.run_logical(holed_orders(t), {"segment": ("o_custkey", "o_totalprice"), "future": ("o_orderdate", "2001-08-01"), "balance": "o_orderstatus"})


# -- N business ------------------------------------------------------------

def _rng(label, cond, want):
    return chk("range", label, "b = 0", "CASE WHEN b/n > 0.05 THEN 'BLOCKER' WHEN b > 0 THEN 'WARNING' ELSE 'PASS' END", "b/n", f"'{want}'", "b",
               source=f"FROM (SELECT count(*) AS n, count(CASE WHEN {cond} THEN 1 END) AS b FROM lineitem)")


@query("n1_ranges", " UNION ALL ".join([
    _rng("Quantity", "l_quantity < 1 OR l_quantity > 45", "1..45"), _rng("Discount", "l_discount < 0 OR l_discount > 1", "0..1"),
    _rng("Tax", "l_tax < 0.01", "0.01..None"), chk("range", "Channel", "false", "'WARNING'", "0", "'0..1'", "'missing column'")]))
def n1(t):
    return B.ranges(t.lineitem, [
        {"column": "l_quantity", "min": 1, "max": 45, "label": "Quantity"}, {"column": "l_discount", "min": 0, "max": 1, "label": "Discount"},
        {"column": "l_tax", "min": 0.01, "max": None, "label": "Tax"}, {"column": "channel", "min": 0, "max": 1, "label": "Channel"}])


@query("n2_metric_relationship", """
WITH m AS (SELECT o_orderpriority, sum(o_totalprice) AS revenue, count(*) AS orders, avg(o_totalprice) AS aov, count(DISTINCT o_custkey) AS users FROM orders GROUP BY 1)
SELECT o_orderpriority, 'revenue' AS check_name, 'aov identity' AS subject, true AS ok, 'PASS' AS severity, 0.0 AS value, 'orders * aov = revenue' AS expected, NULL::VARCHAR AS detail FROM m
UNION ALL SELECT o_orderpriority, 'x', 'orders per user', abs(orders/users - 1) <= 0.05, CASE WHEN abs(orders/users - 1) <= 0.05 THEN 'PASS' ELSE 'WARNING' END, round(abs(orders/users - 1), 6), 'orders / users = 1', NULL FROM m""".replace("'revenue' AS check_name", "'metric_relationship' AS check_name").replace("'x'", "'metric_relationship'"))
def n2(t):
    m = t.orders.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("revenue"), N().alias("orders"), F.avg("o_totalprice").alias("aov"),
                                                F.count_distinct("o_custkey").alias("users"))
    return B.metric_relationships(m, [("aov identity", "orders * aov", "revenue"), ("orders per user", "orders / users", "1"),
                                      ("skipped", "clicks / views", "1")], ["o_orderpriority"])


@query("n3_period_change", f"""WITH {DAILY_SQL}, s AS (SELECT day, revenue, lag(revenue) OVER (ORDER BY day) AS previous FROM d)
SELECT CAST(day AS VARCHAR) AS day, round(revenue, 2) AS revenue, round(previous, 2) AS previous, round(100*abs(revenue - previous)/abs(previous), 2) AS change_pct FROM s WHERE abs(revenue-previous)/abs(previous) > 0.15""", digits=2)
def n3(t):
    return B.period_change_limit(daily(t), "day", "revenue", 15.0).select("day", "revenue", "previous", "change_pct")


@query("n4_segment_coverage", """
WITH h AS (SELECT DISTINCT c_mktsegment AS v FROM customer), w AS (SELECT * FROM (VALUES ('BUILDING'), ('MACHINERY'), ('SPACE')) x(v)),
s AS (SELECT coalesce(h.v, w.v) AS v, CASE WHEN h.v IS NULL THEN 'missing' WHEN w.v IS NULL THEN 'unexpected' ELSE 'expected' END AS st FROM h FULL JOIN w ON h.v = w.v)
SELECT 'segment_coverage' AS check_name, v AS subject, st <> 'missing' AS ok, CASE WHEN st <> 'missing' THEN 'PASS' ELSE 'WARNING' END AS severity, NULL::DOUBLE AS value, NULL::VARCHAR AS expected, st AS detail FROM s""")
def n4(t):
    return B.segment_coverage(t.customer, "c_mktsegment", ["BUILDING", "MACHINERY", "SPACE"])


_NEG = "FROM (SELECT count(CASE WHEN c_acctbal < 0 THEN 1 END) AS k, min(c_acctbal) AS lo, count(CASE WHEN c_nationkey < 0 THEN 1 END) AS k2, min(c_nationkey) AS lo2 FROM customer)"


@query("n5_no_negative", chk("no_negative", "c_acctbal", "k = 0", sev("k = 0"), "k", "'0'", "lo", source=_NEG) + " UNION ALL " +
       chk("no_negative", "c_nationkey", "k2 = 0", sev("k2 = 0"), "k2", "'0'", "lo2", source=_NEG))
def n5(t):
    return B.no_negative(t.customer, ["c_acctbal", "c_nationkey"])


@query("n6_cardinality", chk("cardinality", "c_mktsegment", "n BETWEEN 2 AND 10", sev("n BETWEEN 2 AND 10"), "n", "'2..10'", source="FROM (SELECT count(DISTINCT c_mktsegment) AS n FROM customer)") + " UNION ALL " +
       chk("cardinality", "c_nationkey", "n <= 5", sev("n <= 5"), "n", "'None..5'", source="FROM (SELECT count(DISTINCT c_nationkey) AS n FROM customer)"))
def n6(t):
    return B.cardinality(t.customer, [{"column": "c_mktsegment", "min": 2, "max": 10}, {"column": "c_nationkey", "max": 5}])


@query("n7_rates", """
WITH r AS (SELECT l_tax/nullif(l_discount, 0) AS r, l_discount = 0 AS z FROM lineitem),
g AS (SELECT count(CASE WHEN z THEN 1 END) AS zd, count(CASE WHEN r > 1 OR r < 0 THEN 1 END) AS oor, count(r) AS n, avg(r) AS mean, median(r) AS med, min(r) AS mn, max(r) AS mx FROM r)
SELECT 'tax over discount' AS rate_name, zd AS zero_denominators, oor AS out_of_range, round(mean, 6) AS mean, round(med, 6) AS median, round(mn, 6) AS "min", round(mx, 6) AS "max",
 CASE WHEN zd > 0 AND oor/n > 0.05 THEN 'BLOCKER' WHEN zd > 0 OR oor > 0 THEN 'WARNING' ELSE 'PASS' END AS severity FROM g""")
def n7(t):
    return B.rates(t.lineitem, "l_tax", "l_discount", "tax over discount")


_YEARLY = "y AS (SELECT c_mktsegment AS seg, CAST(year(o_orderdate) AS BIGINT) AS yr, round(sum(o_totalprice), 2) AS amount FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


@query("n8_yoy", f"""WITH {_YEARLY}, p AS (SELECT *, lag(amount) OVER (PARTITION BY seg ORDER BY yr) AS prior FROM y), c AS (SELECT *, (amount - prior)/abs(prior) AS ch FROM p WHERE prior IS NOT NULL)
SELECT seg, yr, amount, prior, round(ch, 6) AS change, CASE WHEN ch > 0 THEN 'up' WHEN ch < 0 THEN 'down' ELSE 'flat' END AS direction,
 CASE WHEN abs(ch) > 0.3 THEN 'BLOCKER' WHEN abs(ch) > 0.15 THEN 'WARNING' ELSE 'PASS' END AS severity FROM c""")
def n8(t):
    y = (t.orders.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
          .groupBy(F.col("c_mktsegment").alias("seg"), F.year("o_orderdate").cast("long").alias("yr")).agg(F.round(F.sum("o_totalprice"), 2).alias("amount")))
    return B.yoy(y, ["seg"], "yr", "amount", 0.3)


@query("n9_run_business", " UNION ALL ".join([
    _rng("Conversion Rate", "l_discount < 0 OR l_discount > 1", "0..1"),
    *[chk("range", lb, "false", "'WARNING'", "0", f"'{w}'", "'missing column'") for lb, w in (
        ("Bounce Rate", "0..1"), ("Click-Through Rate", "0..1"), ("Retention Rate", "0..1"), ("Churn Rate", "0..1"), ("NPS Score", "-100..100"))],
    chk("no_negative", "revenue", "k = 0", sev("k = 0"), "k", "'0'", "lo", source="FROM (SELECT count(CASE WHEN l_extendedprice < 0 THEN 1 END) AS k, min(l_extendedprice) AS lo FROM lineitem)"),
    chk("no_negative", "quantity", "k = 0", sev("k = 0"), "k", "'0'", "lo", source="FROM (SELECT count(CASE WHEN l_quantity < 0 THEN 1 END) AS k, min(l_quantity) AS lo FROM lineitem)"),
    chk("cardinality", "device", "n BETWEEN 2 AND 10", sev("n BETWEEN 2 AND 10"), "n", "'2..10'", source="FROM (SELECT count(DISTINCT l_returnflag) AS n FROM lineitem)")]))
def n9(t):
    df = t.lineitem.select(F.col("l_discount").alias("conversion_rate"), F.col("l_extendedprice").alias("revenue"), F.col("l_quantity").alias("quantity"),
                           F.col("l_returnflag").alias("device"))
    return B.run_business(df)


def metric_definitions(t):
    """Definitions table for the daily metrics."""
    return t.spark.createDataFrame(
        [("events", "Events", "all events", "active", "day", "growth", 100.0, 400.0, 300.0), ("users", "", "active users", "live", "day", None, 0.0, 120.0, 1000.0),
         ("revenue", "Revenue", "purchase value", "draft", None, "finance", 9000.0, 10.0, None)],
        "name string, display_name string, definition string, status string, grain string, owner string, min_value double, max_value double, target double")


_DEFS = "f AS (SELECT * FROM (VALUES ('events', 100.0, 400.0, 300.0), ('users', 0.0, 120.0, 1000.0), ('revenue', 9000.0, 10.0, NULL)) v(metric, min_value, max_value, target))"
_LONG = f"{DAILY_SQL}, v AS (SELECT 'events' AS metric, CAST(events AS DOUBLE) AS value FROM d UNION ALL SELECT 'users', users FROM d UNION ALL SELECT 'revenue', revenue FROM d)"


def daily_long(t):
    return daily(t).select("day", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("events", "users", "revenue")])))


@query("n10_knowledge_rules", f"""WITH {_LONG}, {_DEFS}, g AS (SELECT metric, count(value) AS n, count(CASE WHEN value < min_value OR value > max_value THEN 1 END) AS n_out FROM v JOIN f USING (metric) GROUP BY 1)
SELECT *, CASE WHEN n_out/n > 0.05 THEN 'BLOCKER' WHEN n_out > 0 THEN 'WARNING' ELSE 'PASS' END AS severity FROM g""")
def n10(t):
    return B.knowledge_rules(daily_long(t), metric_definitions(t))


@query("n11_metric_plausibility", f"""WITH {_LONG}, {_DEFS}, a AS (SELECT metric, round(avg(value), 2) AS value FROM v GROUP BY 1)
SELECT metric, value, CAST(min_value AS DOUBLE) AS min_value, CAST(max_value AS DOUBLE) AS max_value, CAST(target AS DOUBLE) AS target,
 NOT (coalesce(value < min_value, false) OR coalesce(value > max_value, false)) AS ok,
 CASE WHEN value < min_value THEN 'below min' WHEN value > max_value THEN 'above max' WHEN 100*abs(value-target)/target > 50 THEN 'far from target' END AS warning FROM a LEFT JOIN f USING (metric)""")
def n11(t):
    a = daily_long(t).groupBy("metric").agg(F.round(F.avg("value"), 2).alias("value"))
    return B.metric_plausibility(a, metric_definitions(t))


@query("n12_metric_definition_lint", """
WITH g AS (SELECT c_mktsegment AS seg, round(min(c_acctbal), 2) AS lo, round(max(c_acctbal), 2) AS hi, count(*) AS n FROM customer GROUP BY 1),
m AS (SELECT lower(seg) AS name, CASE WHEN n % 2 = 0 THEN seg ELSE '' END AS display_name, 'balance of ' || seg AS definition, CASE WHEN n % 3 = 0 THEN 'live' ELSE 'active' END AS status,
 CASE WHEN n % 2 = 0 THEN hi ELSE lo END AS min_value, CASE WHEN n % 2 = 0 THEN lo ELSE hi END AS max_value FROM g),
e AS (SELECT name, concat_ws('; ', CASE WHEN length(trim(display_name)) = 0 THEN 'missing display_name' END, CASE WHEN status NOT IN ('active','deprecated','draft') THEN 'invalid status' END,
 CASE WHEN min_value > max_value THEN 'min above max' END) AS err FROM m)
SELECT name, err = '' AS ok, nullif(err, '') AS errors, 'no grain; no owner' AS warnings FROM e""")
def n12(t):
    g = t.customer.groupBy(F.col("c_mktsegment").alias("seg")).agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), N().alias("n"))
    even = F.col("n") % 2 == 0
    m = g.select(F.lower("seg").alias("name"), F.when(even, F.col("seg")).otherwise("").alias("display_name"), F.concat(F.lit("balance of "), "seg").alias("definition"),
                 F.when(F.col("n") % 3 == 0, "live").otherwise("active").alias("status"), F.lit(None).cast("string").alias("grain"), F.lit(None).cast("string").alias("owner"),
                 F.when(even, F.col("hi")).otherwise(F.col("lo")).alias("min_value"), F.when(even, F.col("lo")).otherwise(F.col("hi")).alias("max_value"))
    return B.metric_definition_lint(m)


# -- Q query results -------------------------------------------------------

@query("q1_pct_sum_band", "WITH p AS (SELECT round(100.0 * count(*) / (SELECT count(*) FROM events), 0) AS pct FROM events GROUP BY event_type) " + chk(
    "pct_sum_band", "pct", "abs(s-100) <= 2", "CASE WHEN abs(s-100) <= 1 THEN 'PASS' WHEN abs(s-100) <= 2 THEN 'WARN' ELSE 'FAIL' END", "s", "'100'", source="FROM (SELECT sum(pct) AS s FROM p)"))
def q1(t):
    from insightspark.operators.windows import share_of_total
    p = share_of_total(t.events.groupBy("event_type").agg(N().alias("n")), [], "n").withColumn("pct", F.round(100.0 * F.col("share"), 0))
    return Q.pct_sum_band(p, "pct")


@query("q2_date_bounds", chk("date_bounds", "o_orderdate", "k = 0", sev("k = 0", "FAIL"), "round(100.0*k/n, 4)", "'1995-06-01..2001-06-30'", "k",
       source="FROM (SELECT count(*) AS n, count(CASE WHEN o_orderdate < DATE '1995-06-01' OR CAST(o_orderdate AS DATE) > DATE '2001-06-30' THEN 1 END) AS k FROM orders)"))
def q2(t):
    return Q.date_bounds(t.orders, "o_orderdate", "1995-06-01", "2001-06-30")


@query("q3_no_duplicates", chk("no_duplicates", "l_orderkey,l_linenumber", "k = 0", sev("k = 0", "FAIL"), "r", "'0'", "k",
       source="FROM (SELECT count(*) AS k, coalesce(sum(n), 0) AS r FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))"))
def q3(t):
    return Q.no_duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


_Q4 = """WITH p AS (SELECT date_trunc('hour', ts) AS p FROM events WHERE event_type = 'error' GROUP BY 1), b AS (SELECT min(p) AS a, max(p) AS b FROM p),
s AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS p FROM b), m AS (SELECT s.p, p.p IS NULL AS gone, row_number() OVER (ORDER BY s.p) AS i FROM s LEFT JOIN p USING (p)),
g AS (SELECT count(*) AS len FROM (SELECT i - row_number() OVER (ORDER BY p) AS k FROM m WHERE gone) GROUP BY k),
c AS (SELECT count(*) AS e, count(CASE WHEN NOT gone THEN 1 END) AS n, (SELECT count(CASE WHEN len > 1 THEN 1 END) FROM g) AS gaps FROM m) """


@query("q4_temporal_coverage", _Q4 + chk("temporal_coverage", "ts", "100.0*n/e >= 95", "CASE WHEN n = e THEN 'PASS' WHEN 100.0*n/e >= 95 THEN 'WARN' ELSE 'FAIL' END", "round(100.0*n/e, 4)", "'hour'", "gaps", source="FROM c"))
def q4(t):
    return Q.temporal_coverage(t.events.where("event_type = 'error'"), "ts", "hour")


@query("q5_value_domain_3way", """WITH h AS (SELECT DISTINCT event_type AS v FROM events), w AS (SELECT * FROM (VALUES ('view'), ('click'), ('refund')) x(v)),
c AS (SELECT count(CASE WHEN w.v IS NULL THEN 1 END) AS u, count(CASE WHEN h.v IS NULL THEN 1 END) AS a FROM h FULL JOIN w ON h.v = w.v) """ + chk(
    "value_domain", "event_type", "u = 0", "CASE WHEN u > 0 THEN 'FAIL' WHEN a > 0 THEN 'WARN' ELSE 'PASS' END", "u", "'3'", "a", source="FROM c"))
def q5(t):
    return Q.value_domain_3way(t.events, "event_type", ["view", "click", "refund"])


@query("q6_monotonic", f"""WITH {DAILY_SQL}, x AS (SELECT day, users <= lag(users) OVER (ORDER BY day) AS bad FROM d)
""" + chk("monotonic", "users", "n = 0", sev("n = 0", "FAIL"), "n", "'increasing'", "f", source="FROM (SELECT count(CASE WHEN bad THEN 1 END) AS n, min(CASE WHEN bad THEN day END) AS f FROM x)"))
def q6(t):
    return Q.monotonic_status(daily(t), "day", "users", strict=True)


def _nc(c):
    r = f"((count(*) - count({c})) / count(*))"
    return chk("null_concentration", c, f"{r} < 0.3", f"CASE WHEN {r} >= 0.95 THEN 'FAIL' WHEN {r} >= 0.3 THEN 'WARN' ELSE 'PASS' END", r, "'0.3'", source="FROM h")


@query("q7_null_concentration", f"WITH {HOLED_SQL} " + " UNION ALL ".join(_nc(c) for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "marker", "o_orderdate")))
def q7(t):
    return Q.null_concentration(holed_orders(t), warn=0.3)


@query("q8_outliers_iqr", "WITH b AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents), c AS (SELECT count(*) AS n, count(CASE WHEN n_chars < q1 - 1.5*(q3-q1) OR n_chars > q3 + 1.5*(q3-q1) THEN 1 END) AS k FROM documents, b) " +
       chk("outliers_iqr", "n_chars", "k/n < 0.15", "CASE WHEN k/n < 0.05 THEN 'PASS' WHEN k/n < 0.15 THEN 'WARN' ELSE 'FAIL' END", "k/n", "'0.05'", "k", source="FROM c"))
def q8(t):
    return Q.outliers(t.documents, "n_chars")


@query("q8_outliers_z", "WITH b AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events), c AS (SELECT count(*) AS n, count(CASE WHEN abs(value - m) > 3*s THEN 1 END) AS k FROM events, b) " +
       chk("outliers_z", "value", "k/n < 0.15", "CASE WHEN k/n < 0.05 THEN 'PASS' WHEN k/n < 0.15 THEN 'WARN' ELSE 'FAIL' END", "k/n", "'0.05'", "k", source="FROM c"))
def q8b(t):
    return Q.outliers(t.events, "value", "z")


@query("q9_empty_result", chk("empty_result", "huge orders", "n > 0", sev("n > 0", "WARN"), expected="'>0'", source="FROM (SELECT count(*) AS n FROM orders WHERE o_totalprice > 1e9)"))
def q9(t):
    return Q.empty_result(t.orders.where("o_totalprice > 1e9"), "huge orders")


@query("q10_safe_checks")
def q10(t):
    a = Q.safe(S.primary_key)(t.orders, ["o_orderkey"])
    b = Q.safe(S.primary_key)(t.orders, ["no_such_column"])
    c = Q.safe(Q.null_concentration)(t.customer)
    return a.unionByName(b).unionByName(c)


_Q11 = """WITH p AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count(CASE WHEN l_discount = 0 THEN 1 END) AS z, count(CASE WHEN l_shipdate BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' THEN 1 END) AS i,
 count(CASE WHEN l_returnflag NOT IN ('A','N') THEN 1 END) AS d FROM lineitem GROUP BY 1, 2), g AS (SELECT sum(n) AS n, sum(z) AS z, sum(i) AS i, sum(d) AS d, count(CASE WHEN n > 1 THEN 1 END) AS k FROM p) """


@query("q11_tier_gate", _Q11 + " UNION ALL ".join(
    chk("tier_gate", n, f"NOT ({bad})", f"CASE WHEN {bad} THEN '{lv}' ELSE 'PASS' END", v, source="FROM g") for n, bad, lv, v in (
        ("rows", "n = 0", "HALT", "n"), ("zero_division", "z > 0", "HALT", "z"), ("date_overlap", "i = 0", "HALT", "i"),
        ("null_rate", "false", "FLAG", "0"), ("duplicate_keys", "k > 0", "FLAG", "k"), ("domain", "d > 0", "FLAG", "d"))))
def q11(t):
    return Q.tier_gate(t.lineitem, ["l_orderkey", "l_linenumber"], "l_discount", "l_shipdate", "1997-01-01", "1997-12-31", ("l_returnflag", ["A", "N"]))


@query("q11_gate_status", _Q11 + "SELECT CASE WHEN n = 0 OR z > 0 OR i = 0 THEN 'HALT' WHEN k > 0 OR d > 0 THEN 'FLAG' ELSE 'PASS' END AS gate, CAST((n=0) AS INT)::BIGINT + (z>0)::BIGINT + (i=0)::BIGINT + (k>0)::BIGINT + (d>0)::BIGINT AS n_failed FROM g")
def q11b(t):
    return Q.gate_status(q11(t))
