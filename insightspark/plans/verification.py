"""Verification, tie-out and reproducibility queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insightspark.operators import verification as V
from insightspark.operators.profile import frame_fingerprint
from insightspark.plans.registry import query
from insightspark.session import work_path
from insightspark.sources.tables import read_source, write_table

N = lambda: F.count(F.lit(1))

_CLAIMS = """c AS (SELECT o_orderkey AS claim_id, CASE o_orderkey % 4 WHEN 0 THEN 'revenue' WHEN 1 THEN 'percentage' WHEN 2 THEN 'date' ELSE 'ratio' END AS metric_type,
 CASE WHEN o_orderkey % 4 = 1 THEN o_totalprice / 4500 ELSE o_totalprice - 20000 END AS value, CAST(o_orderdate AS DATE) AS date_value, CAST(o_custkey % 9 AS DOUBLE) AS denominator,
 CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'orders' END AS source_table FROM orders)"""


def claims(t):
    """A claims table derived from orders."""
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("claim_id"), F.when(k % 4 == 0, "revenue").when(k % 4 == 1, "percentage").when(k % 4 == 2, "date").otherwise("ratio").alias("metric_type"),
        F.when(k % 4 == 1, F.col("o_totalprice") / 4500).otherwise(F.col("o_totalprice") - 20000).alias("value"), F.to_date("o_orderdate").alias("date_value"),
        (F.col("o_custkey") % 9).cast("double").alias("denominator"), F.when(k % 7 == 0, "").otherwise("orders").alias("source_table"))


_BOUNDARY = _CLAIMS + """, r AS (SELECT claim_id, 'monetary_sign' AS check_name, '1a' AS tier, CASE WHEN value < 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM c WHERE metric_type = 'revenue'
 UNION ALL SELECT claim_id, 'percentage_bounds', '1a', CASE WHEN value < 0 OR value > 100 THEN 'FAIL' ELSE 'PASS' END FROM c WHERE metric_type = 'percentage'
 UNION ALL SELECT claim_id, 'no_future_dates', '1a', CASE WHEN date_value > DATE '2001-01-01' THEN 'FAIL' ELSE 'PASS' END FROM c WHERE metric_type = 'date'
 UNION ALL SELECT claim_id, 'zero_denominator', '1a', CASE WHEN denominator = 0 THEN 'FAIL' ELSE 'PASS' END FROM c WHERE metric_type = 'ratio'
 UNION ALL SELECT claim_id, 'source_citation', '1b', 'FLAG' FROM c WHERE source_table = '')"""


@query("u1_boundary_checks", f"WITH {_BOUNDARY} SELECT * FROM r")
def u1(t):
    return V.boundary_checks(claims(t), "2001-01-01")


def _rel(a, b):
    return f"coalesce(abs({a} - {b}) / nullif(CASE WHEN {a} <> 0 THEN abs({a}) ELSE abs({b}) END, 0), 0)"


def _band(d, tol):
    return f"CASE WHEN {d} <= {tol} THEN 'PASS' WHEN {d} <= {tol} * 10 THEN 'WARN' ELSE 'FAIL' END"


@query("u2_parts_to_whole", f"""
WITH j AS (SELECT o_custkey, sum(o_totalprice) AS stated FROM orders GROUP BY 1), p AS (SELECT o_custkey, sum(o_totalprice) AS fp FROM orders WHERE o_orderpriority <> '5-LOW' OR o_totalprice < 60000 GROUP BY 1),
x AS (SELECT j.o_custkey, stated, coalesce(fp, 0) AS from_parts FROM j LEFT JOIN p USING (o_custkey)), y AS (SELECT *, {_rel('stated', 'from_parts')} AS d FROM x)
SELECT o_custkey, round(stated, 2) AS stated, round(from_parts, 2) AS from_parts, round(d, 6) AS diff_pct, {_band('round(d, 12)', '0.01')} AS status FROM y""")
def u2(t):
    totals = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    out = V.parts_to_whole(totals, t.orders.where("o_orderpriority <> '5-LOW' OR o_totalprice < 60000"), ["o_custkey"], "total", "o_totalprice")
    return out.withColumn("stated", F.round("stated", 2)).withColumn("from_parts", F.round("from_parts", 2))


@query("u3_ratio_recompute", f"""
WITH f AS (SELECT l_suppkey, sum(l_quantity * l_discount) AS n, sum(l_quantity) AS d FROM lineitem GROUP BY 1), s AS (SELECT l_suppkey, round(avg(l_discount), 4) AS stated FROM lineitem GROUP BY 1),
x AS (SELECT s.l_suppkey, stated, n/d AS recomputed, {_rel('stated', '(n/d)')} AS diff FROM s JOIN f USING (l_suppkey))
SELECT l_suppkey, stated, round(recomputed, 6) AS recomputed, round(diff, 6) AS diff_pct, {_band('diff', '0.001')} AS status FROM x""")
def u3(t):
    stated = t.lineitem.groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 4).alias("rate"))
    facts = t.lineitem.select("l_suppkey", (F.col("l_quantity") * F.col("l_discount")).alias("num"), "l_quantity")
    return V.ratio_recompute(stated, facts, ["l_suppkey"], "rate", "num", "l_quantity")


@query("u4_algebraic_identity", f"""
WITH l AS (SELECT l_orderkey AS k, sum(l_extendedprice * (1 + l_tax) * (1 - l_discount)) AS lines FROM lineitem GROUP BY 1), x AS (SELECT o_orderkey AS k, o_totalprice AS lv, lines AS rv FROM orders JOIN l ON o_orderkey = k)
SELECT k, lv AS left_value, round(rv, 2) AS right_value, round({_rel('lv', 'rv')}, 6) AS diff_pct, {_band(_rel('lv', 'rv'), '0.0001')} AS status FROM x""")
def u4(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount"))).alias("lines"))
    out = V.algebraic_identity(t.orders.select(F.col("o_orderkey").alias("k"), "o_totalprice"), lines, ["k"], "o_totalprice", "lines")
    return out.withColumn("right_value", F.round("right_value", 2))


@query("u5_tolerance_lookup", """
WITH t AS (SELECT CAST(CASE WHEN s IN ('snowflake', 'bigquery') THEN 0.02 ELSE 0 END AS DOUBLE) AS tol, s FROM (VALUES ('snowflake'), ('bigquery'), ('postgres'), ('duckdb'), ('csv'), ('motherduck')) v(s)),
d AS (SELECT count(DISTINCT l_partkey) AS n FROM lineitem), a AS (SELECT s AS source, n AS exact, CAST(n * 1.015 AS DOUBLE) AS reported, tol FROM d, t)
SELECT source, exact, round(reported, 2) AS reported, tol AS tolerance, abs(reported - exact)/exact <= tol AS within FROM a""")
def u5(t):
    n = t.lineitem.agg(F.count_distinct("l_partkey")).scalar()
    tol = V.tolerance_table(t.spark).where("check_name = 'distinct_count'").withColumn("exact", n).withColumn("reported", F.round(F.col("exact") * 1.015, 2))
    return tol.select("source", "exact", "reported", "tolerance", (F.abs(F.col("exact") * 1.015 - F.col("exact")) / F.col("exact") <= F.col("tolerance")).alias("within"))


@query("u6_cv_score", f"""WITH {_BOUNDARY}, k AS (SELECT claim_id % 5 AS grp, CASE WHEN tier = '1a' AND check_name IN ('monetary_sign', 'zero_denominator') THEN 'C' WHEN tier = '1a' THEN 'B' ELSE 'D' END AS type, CASE WHEN claim_id % 5 IN (1, 2) AND status = 'FAIL' THEN 'WARN' ELSE status END AS status FROM r)
SELECT grp, CASE WHEN count(CASE WHEN type='B' AND status='FAIL' THEN 1 END) > 0 THEN 2 WHEN count(CASE WHEN type IN ('C','D') AND status='FAIL' THEN 1 END) > 0 THEN 4
 WHEN count(CASE WHEN type='B' AND status='WARN' THEN 1 END) > 0 THEN 6 WHEN count(CASE WHEN type IN ('C','D') AND status='WARN' THEN 1 END) > 0 THEN 8 ELSE 10 END AS score,
 CASE WHEN count(CASE WHEN status='FAIL' THEN 1 END) > 0 THEN 'FAIL' WHEN count(CASE WHEN status IN ('WARN','FLAG') THEN 1 END) > 0 THEN 'WARN' ELSE 'PASS' END AS overall_status, count(*) AS n_checks FROM k GROUP BY 1""")
def u6(t):
    r = V.boundary_checks(claims(t), "2001-01-01")
    kind = F.when((F.col("tier") == "1a") & F.col("check_name").isin("monetary_sign", "zero_denominator"), "C").when(F.col("tier") == "1a", "B").otherwise("D")
    r = r.select((F.col("claim_id") % 5).alias("grp"), kind.alias("type"),
                 F.when((F.col("claim_id") % 5).isin(1, 2) & (F.col("status") == "FAIL"), "WARN").otherwise(F.col("status")).alias("status"))
    return V.cv_score(r, ["grp"])


@query("u7_compare_profiles", """
WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 3 THEN NULL ELSE o_custkey END AS o_custkey, o_totalprice FROM orders),
f(metric, column_name, s, d) AS (SELECT 'row_count', '*', (SELECT count(*) FROM orders), (SELECT count(*) FROM b)
 UNION ALL SELECT 'column_count', '*', 4, 3
 UNION ALL SELECT 'null_count', c, 0, CASE WHEN c = 'o_custkey' THEN (SELECT count(*) - count(o_custkey) FROM b) ELSE 0 END FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_totalprice')) v(c)
 UNION ALL SELECT 'distinct_count', 'o_orderkey', (SELECT count(DISTINCT o_orderkey) FROM orders), (SELECT count(DISTINCT o_orderkey) FROM b)
 UNION ALL SELECT 'distinct_count', 'o_custkey', (SELECT count(DISTINCT o_custkey) FROM orders), (SELECT count(DISTINCT o_custkey) FROM b)
 UNION ALL SELECT 'distinct_count', 'o_totalprice', (SELECT count(DISTINCT o_totalprice) FROM orders), (SELECT count(DISTINCT o_totalprice) FROM b)
 UNION ALL SELECT 'numeric_sum', 'o_orderkey', (SELECT sum(o_orderkey) FROM orders), (SELECT sum(o_orderkey) FROM b)
 UNION ALL SELECT 'numeric_sum', 'o_custkey', (SELECT sum(o_custkey) FROM orders), (SELECT sum(o_custkey) FROM b)
 UNION ALL SELECT 'numeric_sum', 'o_totalprice', (SELECT sum(o_totalprice) FROM orders), (SELECT sum(o_totalprice) FROM b)
 UNION ALL SELECT 'null_count', 'o_orderstatus', 0, NULL UNION ALL SELECT 'distinct_count', 'o_orderstatus', 3, NULL)
SELECT metric, column_name, CASE WHEN d IS NULL THEN 'MISSING' WHEN metric = 'numeric_sum' THEN CASE WHEN abs(s-d) <= 0.01 OR abs(s-d)/abs(s) <= 0.0001 THEN 'PASS' ELSE 'FAIL' END WHEN s = d THEN 'PASS' ELSE 'FAIL' END AS status FROM f""")
def u7(t):
    path = work_path(t.spark, "tieout") + ".parquet"
    src = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    write_table(src.drop("o_orderstatus").withColumn("o_custkey", F.when(F.col("o_orderkey") % 100 != 3, F.col("o_custkey"))), path)
    loaded = read_source(t.spark, path)
    return V.compare_profiles(frame_fingerprint(src, "source"), frame_fingerprint(loaded, "loaded")).select("metric", "column_name", "status")


@query("u9_reproducibility", """
SELECT 'order' AS kind, 3 AS n_runs, 1 AS counts, 1 AS contents, 'PASS' AS status UNION ALL SELECT 'value', 2, 1, 2, 'FAIL' UNION ALL SELECT 'rows', 2, 2, 2, 'WARN'""")
def u9(t):
    a = t.orders.select("o_orderkey", "o_totalprice")
    moved = V.reproducibility([a, a.repartition(5), a.orderBy("o_totalprice")]).withColumn("kind", F.lit("order"))
    changed = V.reproducibility([a, a.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") == 1, 0.01).otherwise(0.0))]).withColumn("kind", F.lit("value"))
    fewer = V.reproducibility([a, a.where("o_orderkey <> 1")]).withColumn("kind", F.lit("rows"))
    out = moved.unionByName(changed).unionByName(fewer)
    return out.select("kind", F.col("n_runs").cast("int").alias("n_runs"), F.col("counts").cast("int").alias("counts"), F.col("contents").cast("int").alias("contents"), "status")


_U9 = """WITH c AS (SELECT count(*) AS n, count(CASE WHEN o_orderkey % 1000 <> 0 THEN 1 END) AS a, count(CASE WHEN o_orderkey % 10 <> 0 THEN 1 END) AS b FROM orders),
v AS (SELECT 'few' AS kind, 2 AS n_runs, 2 AS n_succeeded, (n - a) / n AS variance FROM c UNION ALL SELECT 'many', 2, 2, (n - b) / n FROM c UNION ALL SELECT 'same', 3, 2, 0.0 FROM c UNION ALL SELECT 'failed', 2, 1, 1.0 FROM c)
SELECT kind, n_runs, n_succeeded, round(variance, 6) AS variance, CASE WHEN kind = 'failed' THEN 'FAIL' WHEN variance <= 0.0005 THEN 'PASS' WHEN variance <= 0.005 THEN 'WARN' ELSE 'FAIL' END AS status FROM v
UNION ALL SELECT 'static', 2, 2, 0.0, 'SKIPPED' FROM c"""


@query("u9_reproducibility_bands", _U9)
def u9b(t):
    a = t.orders.select("o_orderkey", "o_totalprice")
    judged = {"few": ([a, a.where("o_orderkey % 1000 <> 0")], {}), "many": ([a, a.where("o_orderkey % 10 <> 0")], {}), "same": ([a, None, a.repartition(3)], {}), "failed": ([a, None], {})}
    rows = [V.reproducibility_bands(runs, 0.0005, **kw).withColumn("kind", F.lit(k)) for k, (runs, kw) in judged.items()]
    rows.append(V.reproducibility_bands([a, a], static=True).withColumn("kind", F.lit("static")))
    return reduce(DataFrame.unionByName, rows)


@query("u10_variance_diagnosis", """
WITH r AS (SELECT o_custkey AS query_id, o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'SELECT approx_count_distinct(x)' ELSE 'SELECT count(*)' END AS q, CASE WHEN o_custkey % 4 = 1 THEN o_orderkey % 5 ELSE 7 END AS row_count,
 CASE o_custkey % 5 WHEN 0 THEN 'bigquery' WHEN 1 THEN 'postgres' ELSE 'csv' END AS source FROM orders)
SELECT query_id, CASE WHEN bool_or(q LIKE '%approx_count%') THEN 'APPROX_FUNCTION' WHEN count(DISTINCT row_count) > 1 THEN 'LIVE_INGESTION' WHEN max(source) = 'bigquery' THEN 'STREAMING_BUFFER' WHEN max(source) = 'postgres' THEN 'MVCC_SNAPSHOT' ELSE 'UNKNOWN' END AS cause FROM r GROUP BY 1""")
def u10(t):
    c = F.col("o_custkey")
    runs = t.orders.select(
        c.alias("query_id"), F.when(c % 3 == 0, "SELECT approx_count_distinct(x)").otherwise("SELECT count(*)").alias("sql_text"),
        F.when(c % 4 == 1, F.col("o_orderkey") % 5).otherwise(7).alias("row_count"), F.when(c % 5 == 0, "bigquery").when(c % 5 == 1, "postgres").otherwise("csv").alias("source"))
    return V.variance_diagnosis(runs)


@query("u11_two_way_metric", """
WITH a AS (SELECT l_suppkey, avg(l_discount) AS x, sum(l_quantity * l_discount)/sum(l_quantity) AS y FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(x, 6) AS way_a, round(y, 6) AS way_b, round(abs(x-y)/abs(x), 6) AS diff_pct, CASE WHEN abs(x-y)/abs(x) <= 0.001 THEN 'exact' WHEN abs(x-y)/abs(x) <= 0.01 THEN 'close' WHEN abs(x-y)/abs(x) <= 0.05 THEN 'acceptable' ELSE 'mismatch' END AS band FROM a""")
def u11(t):
    a = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_discount").alias("x"))
    b = t.lineitem.groupBy("l_suppkey").agg((F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity")).alias("y"))
    return V.two_way_metric(a, b, ["l_suppkey"], "x", "y")
