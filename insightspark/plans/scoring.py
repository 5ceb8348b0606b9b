"""Confidence and findings queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from insightspark.functions.checks import as_checks, stack_rows
from insightspark.operators import business as B
from insightspark.operators import logical as L
from insightspark.operators import paradox as P
from insightspark.operators import scoring as S
from insightspark.operators import structural as ST
from insightspark.operators import verification as V
from insightspark.plans.paradox import _OC, _paradox_sql, oc
from insightspark.plans.registry import query

N = lambda: F.count(F.lit(1))


def confidence_inputs(t):
    """One run per (market segment, priority), measured on the orders themselves."""
    df = oc(t).withColumn("gone", (F.col("o_orderkey") % 29 == 0) & (F.col("o_orderpriority") != "1-URGENT"))
    g = df.groupBy("c_mktsegment", "o_orderpriority").agg(
        N().alias("row_count"), F.avg(F.when(F.col("gone"), 1.0).otherwise(0.0)).alias("null_rate"), F.count_distinct("o_custkey").alias("cust"),
        F.sum("o_totalprice").alias("total"), F.sum(F.when(~F.col("gone"), F.col("o_totalprice"))).alias("known"),
        F.count_distinct(F.trunc("o_orderdate", "month")).alias("months"), F.count_if(F.col("o_totalprice") > 490000).alias("high"))
    p = F.substring("o_orderpriority", 1, 1)
    return g.select(
        "c_mktsegment", "o_orderpriority", "row_count", "null_rate",
        F.when(F.col("cust") * 3 > F.col("row_count") * 2, "WARNING").otherwise("PASS").alias("structural_severity"),
        F.when(p == "5", None).otherwise("PASS").alias("agg_severity"), (1 - F.col("known") / F.col("total")).alias("agg_diff"),
        F.when(p == "5", None).otherwise(80 - F.col("months")).alias("missing_dates"), F.when(p == "5", None).otherwise(0).alias("break_count"), F.lit(False).alias("trend_blocker"),
        F.when(F.col("high") / F.col("row_count") > 0.05, "BLOCKER").when(F.col("high") > 0, "WARNING").otherwise("PASS").alias("business_severity"),
        F.when(p == "2", 1).otherwise(0).alias("paradox_count"), F.lit(False).alias("paradox_core"), F.when(p == "3", 6).otherwise(10).alias("cv_score"),
        F.when(p == "4", "WARN").otherwise("PASS").alias("repro_status"))


_INPUTS = f"""WITH {_OC}, b AS (SELECT *, o_orderkey % 29 = 0 AND o_orderpriority <> '1-URGENT' AS gone, substr(o_orderpriority, 1, 1) AS p FROM oc),
g AS (SELECT c_mktsegment, o_orderpriority, p, count(*) AS row_count, avg(CASE WHEN gone THEN 1.0 ELSE 0.0 END) AS null_rate, count(DISTINCT o_custkey) AS cust, sum(o_totalprice) AS total,
 sum(CASE WHEN NOT gone THEN o_totalprice END) AS known, count(DISTINCT date_trunc('month', o_orderdate)) AS months, count(CASE WHEN o_totalprice > 490000 THEN 1 END) AS high FROM b GROUP BY 1, 2, 3),
i AS (SELECT *, 1 - known/total AS diff, 80 - months AS miss FROM g),
f AS (SELECT c_mktsegment, o_orderpriority, p, CASE WHEN null_rate < 0.01 THEN 15 WHEN null_rate < 0.05 THEN 12 WHEN null_rate < 0.1 THEN 9 WHEN null_rate < 0.2 THEN 5 ELSE 2 END AS data_completeness,
 CASE WHEN cust*3 > row_count*2 THEN 10 ELSE 15 END AS structural_integrity, CASE WHEN p = '5' THEN NULL WHEN diff > 0.05 THEN 3 WHEN diff > 0.01 THEN 8 ELSE 15 END AS aggregation_consistency,
 CASE WHEN p = '5' THEN NULL WHEN miss > 5 THEN 5 WHEN miss > 0 THEN 10 ELSE 15 END AS temporal_consistency, CASE WHEN high/row_count > 0.05 THEN 5 WHEN high > 0 THEN 10 ELSE 15 END AS business_plausibility,
 CASE WHEN p = '2' THEN 8 ELSE 15 END AS simpsons_paradox_risk, CASE WHEN row_count > 10000 THEN 10 WHEN row_count > 1000 THEN 8 WHEN row_count > 100 THEN 5 WHEN row_count > 30 THEN 3 ELSE 1 END AS sample_size,
 CASE WHEN p = '3' THEN 6 ELSE 10 END AS cross_verification, CASE WHEN p = '4' THEN 3 ELSE 5 END AS reproducibility FROM i),
s AS (SELECT *, data_completeness + structural_integrity + coalesce(aggregation_consistency, 0) + coalesce(temporal_consistency, 0) + business_plausibility + simpsons_paradox_risk + sample_size + cross_verification + reproducibility AS got,
 CASE WHEN p = '5' THEN 85 ELSE 115 END AS possible,
 CAST(data_completeness = 2 AS INT) + CAST(coalesce(aggregation_consistency, 15) = 3 AS INT) + CAST(business_plausibility = 5 AS INT) + CAST(sample_size = 1 AS INT) AS nb FROM f),
r AS (SELECT c_mktsegment, o_orderpriority, CAST(round_even(100.0*got/possible, 0) AS INT) AS score, p = '5' AS partial, CASE WHEN p = '5' THEN 7 ELSE 9 END AS n_factors, nb AS n_blockers FROM s),
q AS (SELECT *, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS g0 FROM r),
z AS (SELECT c_mktsegment, o_orderpriority, score, CASE WHEN partial AND g0 IN ('A', 'B') THEN 'C' ELSE g0 END AS grade, CAST(n_blockers AS BIGINT) AS n_blockers, CAST(n_factors AS BIGINT) AS n_factors, partial FROM q)"""


@query("v1_confidence_score", _INPUTS + " SELECT * FROM z")
def v1(t):
    return S.confidence_score(confidence_inputs(t), ["c_mktsegment", "o_orderpriority"])


def _status_sql(n):
    """Status of the factor whose score is the column ``n``."""
    return f"CASE WHEN {n} IS NULL THEN 'MISSING' WHEN {n} >= {S.BANDS[n][0]} THEN 'PASS' WHEN {n} >= {S.BANDS[n][1]} THEN 'WARNING' ELSE 'BLOCKER' END AS status"


_FACTORS = ["data_completeness", "structural_integrity", "aggregation_consistency", "temporal_consistency", "business_plausibility", "simpsons_paradox_risk",
            "sample_size", "cross_verification", "reproducibility"]


@query("v1_confidence_factors", _INPUTS + " " + " UNION ALL ".join(
    f"SELECT c_mktsegment, o_orderpriority, '{n}' AS factor, CAST(coalesce({n}, 0) AS INT) AS score, {S.FACTOR_MAX[n]} AS max_score, {_status_sql(n)} FROM f" for n in _FACTORS))
def v1b(t):
    return S.confidence_factors(confidence_inputs(t), ["c_mktsegment", "o_orderpriority"])


@query("v2_merge_scores", _INPUTS + """, m AS (SELECT c_mktsegment, CAST(round_even(avg(score), 0) AS INT) AS score, count(*) AS n_runs, CAST(sum(n_blockers) AS BIGINT) AS n_blockers, bool_or(grade IN ('D','F')) AS low FROM z GROUP BY 1)
SELECT c_mktsegment, score, n_runs, n_blockers, CASE WHEN low AND score >= 70 THEN 'C' WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM m""")
def v2(t):
    return S.merge_scores(S.confidence_score(confidence_inputs(t), ["c_mktsegment", "o_orderpriority"]), ["c_mktsegment"])


@query("v2_merge_factors", _INPUTS + " SELECT factor, CAST(min(score) AS INT) AS score, CAST(max(max_score) AS INT) AS max_score, min_by(status, CASE status WHEN 'BLOCKER' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'MISSING' THEN 2 ELSE 3 END) AS status FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS factor, coalesce({n}, 0) AS score, {S.FACTOR_MAX[n]} AS max_score, {_status_sql(n)} FROM f" for n in _FACTORS) + ") GROUP BY 1")
def v2b(t):
    return S.merge_factors(S.confidence_factors(confidence_inputs(t), ["c_mktsegment", "o_orderpriority"]))


_COLUMNS = {"orders": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"], "customer": ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"],
            "lineitem": ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"]}


def validator_rows(t):
    """Check rows of three runs, one for each table: orders by all layers, lineitem without paradox and reproducibility, customer by structure and ranges."""
    run = lambda name, *frames: stack_rows(list(frames)).withColumn("run", F.lit(name))
    placed, bought, buyers = t.orders, t.lineitem, t.customer
    tables = {"orders": placed, "lineitem": bought, "customer": buyers}
    structure = lambda name, key, child, parent, parent_key: ST.run_structural(
        tables[name], {"columns": _COLUMNS[name], "primary_key": key, "references": [(child, parent, parent_key)]})
    monthly = placed.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("revenue"))
    yearly = bought.groupBy(F.lit("all").alias("scope"), F.year("l_shipdate").alias("year")).agg(F.sum("l_extendedprice").alias("revenue"))
    paradox = P.simpsons(oc(t), "o_totalprice", ["c_mktsegment", "o_orderpriority"], "o_orderstatus")
    stated = placed.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("stated"))
    whole = V.parts_to_whole(stated, placed, ["o_orderpriority"], "stated", "o_totalprice").select(F.lit("A").alias("type"), "status")
    lines = bought.select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    parts = V.parts_to_whole(placed, lines, ["o_orderkey"], "o_totalprice", "l_extendedprice").select(F.lit("B").alias("type"), "status")
    crossed = lambda rows: as_checks(V.cv_score(rows), "cross_verification", "totals", F.when(F.col("overall_status") == "PASS", "PASS").otherwise("WARNING"), F.col("score"))
    again = V.reproducibility([placed, placed.repartition(5)])
    orders = run("orders", structure("orders", ["o_orderkey"], "o_custkey", buyers, "c_custkey"),
                 L.run_logical(placed, {"segment": ("o_orderpriority", "o_totalprice"), "total": "o_totalprice"}, stated.withColumnRenamed("stated", "o_totalprice")),
                 L.temporal_consistency(monthly, "month", "revenue", "month"), L.trend_continuity(monthly, "month", "revenue"),
                 B.run_business(placed, {"ranges": [{"column": "o_totalprice", "min": 0, "max": 490000, "label": "order value"}]}),
                 as_checks(paradox, "simpsons", F.col("segment_column"), F.when(F.col("paradox_detected"), "BLOCKER").otherwise("PASS"), F.col("paradox_detected").cast("int")),
                 crossed(whole), as_checks(again, "reproducibility", "orders", F.col("status")))
    lineitem = run("lineitem", structure("lineitem", ["l_orderkey", "l_linenumber"], "l_orderkey", placed, "o_orderkey"),
                   L.run_logical(bought, {"segment": ("l_returnflag", "l_extendedprice")}), L.aggregation_total(bought, bought.where("l_quantity >= 2"), "l_extendedprice", 0.05),
                   B.run_business(bought, {"ranges": [{"column": "l_discount", "min": 0, "max": 0.1, "label": "discount"}]}),
                   as_checks(B.yoy(yearly, ["scope"], "year", "revenue"), "yoy", F.col("year"), F.col("severity"), F.col("change")), crossed(parts))
    customer = run("customer", structure("customer", ["c_custkey"], "c_nationkey", t.nation, "n_nationkey"),
                   B.run_business(buyers, {"ranges": [{"column": "c_acctbal", "min": 0, "max": None, "label": "balance"}]}))
    return stack_rows([orders, lineitem, customer])


def _structure_sql(table, keys, child, parent, parent_key):
    nulls = "(" + " + ".join(f"count(CASE WHEN {c} IS NULL THEN 1 END)" for c in _COLUMNS[table]) + f") / (count(*) * {float(len(_COLUMNS[table]))}) "
    any_null = " OR ".join(f"{k} IS NULL" for k in keys)
    return (f"SELECT '{table}' AS run, {nulls} AS null_rate, count(*) AS row_count, (SELECT count(*) FROM (SELECT {', '.join(keys)} FROM {table} GROUP BY {', '.join(keys)} HAVING count(*) > 1 OR {any_null})) AS bad_keys, "
            f"(SELECT count(*) FROM {table} x LEFT JOIN {parent} y ON x.{child} = y.{parent_key} WHERE x.{child} IS NOT NULL AND y.{parent_key} IS NULL) / count(*) AS orphans FROM {table}")


_BAND = "CASE WHEN {x} > 0.05 THEN 5 WHEN {x} > 0 THEN 10 ELSE 15 END"
_LADDER = "CASE WHEN min(CASE WHEN {d} > {tol} * 10 THEN 2 WHEN {d} > {tol} THEN 1 ELSE 0 END) IS NULL THEN 5 WHEN max(CASE WHEN {d} > {tol} * 10 THEN 2 WHEN {d} > {tol} THEN 1 ELSE 0 END) = 2 THEN {bad} WHEN max(CASE WHEN {d} > {tol} THEN 1 ELSE 0 END) = 1 THEN {warn} ELSE 10 END"
_FROM_CHECKS = f"""WITH {_OC}, st AS ({_structure_sql("orders", ["o_orderkey"], "o_custkey", "customer", "c_custkey")} UNION ALL {_structure_sql("lineitem", ["l_orderkey", "l_linenumber"], "l_orderkey", "orders", "o_orderkey")}
 UNION ALL {_structure_sql("customer", ["c_custkey"], "c_nationkey", "nation", "n_nationkey")}),
mo AS (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1), sp AS (SELECT m, v, lag(v) OVER (ORDER BY m) AS p FROM mo),
tm AS (SELECT date_diff('month', min(m), max(m)) + 1 - count(*) AS miss, count(CASE WHEN abs(v - p)/abs(p) > 0.5 THEN 1 END) AS breaks FROM sp),
yr AS (SELECT year(l_shipdate) AS y, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1), yc AS (SELECT abs(v - lag(v) OVER (ORDER BY y)) / lag(v) OVER (ORDER BY y) AS ch FROM yr),
ys AS (SELECT CASE WHEN max(ch) > 2 THEN 5 WHEN max(ch) > 1 THEN 10 ELSE 15 END AS score FROM yc),
px AS (SELECT count(CASE WHEN paradox_detected THEN 1 END) AS n FROM ({_paradox_sql(["c_mktsegment", "o_orderpriority"], "o_orderstatus")})),
gap AS (SELECT sum(CASE WHEN l_quantity < 2 THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice) AS g FROM lineitem),
pt AS (SELECT abs(o_totalprice - coalesce(p, 0)) / o_totalprice AS d FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
ro AS (SELECT count(CASE WHEN o_totalprice < 0 OR o_totalprice > 490000 THEN 1 END) / count(o_totalprice) AS o FROM orders), rl AS (SELECT count(CASE WHEN l_discount < 0 OR l_discount > 0.1 THEN 1 END) / count(l_discount) AS o FROM lineitem),
rc AS (SELECT count(CASE WHEN c_acctbal < 0 THEN 1 END) / count(c_acctbal) AS o FROM customer),
f AS (SELECT run, CASE WHEN null_rate < 0.01 THEN 15 WHEN null_rate < 0.05 THEN 12 WHEN null_rate < 0.1 THEN 9 WHEN null_rate < 0.2 THEN 5 ELSE 2 END AS data_completeness,
 CASE WHEN bad_keys > 0 OR orphans > 0.05 THEN 3 WHEN orphans > 0 THEN 10 ELSE 15 END AS structural_integrity,
 CASE run WHEN 'orders' THEN 15 WHEN 'lineitem' THEN (SELECT CASE WHEN g > 0.05 THEN 3 WHEN g > 0.01 THEN 8 ELSE 15 END FROM gap) END AS aggregation_consistency,
 CASE run WHEN 'orders' THEN (SELECT CASE WHEN breaks > 2 THEN 3 WHEN breaks > 0 OR miss > 5 THEN 5 WHEN miss > 0 THEN 10 ELSE 15 END FROM tm) END AS temporal_consistency,
 CASE run WHEN 'orders' THEN (SELECT {_BAND.format(x="o")} FROM ro) WHEN 'lineitem' THEN (SELECT least({_BAND.format(x="o")}, score) FROM rl, ys) ELSE (SELECT {_BAND.format(x="o")} FROM rc) END AS business_plausibility,
 CASE run WHEN 'orders' THEN (SELECT CASE WHEN n > 0 THEN 2 ELSE 15 END FROM px) END AS simpsons_paradox_risk,
 CASE WHEN row_count > 10000 THEN 10 WHEN row_count > 1000 THEN 8 WHEN row_count > 100 THEN 5 WHEN row_count > 30 THEN 3 ELSE 1 END AS sample_size,
 CASE run WHEN 'orders' THEN 10 WHEN 'lineitem' THEN (SELECT {_LADDER.format(d="d", tol=V.tolerance("parts_to_whole"), bad=2, warn=6)} FROM pt) END AS cross_verification, CASE run WHEN 'orders' THEN 5 END AS reproducibility FROM st),
l AS ({" UNION ALL ".join(f"SELECT run, '{n}' AS factor, CAST(coalesce({n}, 0) AS INT) AS score, {S.FACTOR_MAX[n]} AS max_score, {_status_sql(n)} FROM f" for n in _FACTORS)})"""


@query("v1_checks_to_factors", _FROM_CHECKS + " SELECT * FROM l")
def v1c(t):
    return S.factors_from_checks(validator_rows(t), ["run"])


@query("v1_checks_to_score", _FROM_CHECKS + """, s AS (SELECT run, CAST(round_even(100.0 * sum(CASE WHEN status <> 'MISSING' THEN score END) / sum(CASE WHEN status <> 'MISSING' THEN max_score END), 0) AS INT) AS score,
 count(CASE WHEN status = 'BLOCKER' THEN 1 END) AS n_blockers, count(CASE WHEN status <> 'MISSING' THEN 1 END) AS n_factors, run <> 'orders' AS partial FROM l GROUP BY 1)
SELECT run, score, CASE WHEN score >= 85 AND NOT partial THEN 'A' WHEN score >= 70 AND NOT partial THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade, n_blockers, n_factors, partial FROM s""")
def v1d(t):
    return S.score_from_checks(validator_rows(t), ["run"])


_DIMS = ["o_orderpriority", "c_mktsegment", "c_nationkey"]
_METRICS = {"aov": "o_totalprice", "status_f": "is_f"}


def findings(t):
    df = oc(t).withColumn("is_f", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))
    return S.insight_scan(df, _DIMS, _METRICS, "period", {"aov": "revenue", "status_f": "fulfilment"})


_SIDES = """SELECT dimension, segment, n_curr, n_prev, 'aov' AS metric_name, c1 AS metric_value, p1 AS baseline_value, v1, w1 AS v0, 'Revenue' AS theme FROM g
 UNION ALL SELECT dimension, segment, n_curr, n_prev, 'status_f', c2, p2, v2, w2, 'Fulfilment' FROM g"""

_FINDINGS = f"""WITH {_OC}, b AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_f FROM oc),
l AS ({" UNION ALL ".join(f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS segment, period, o_totalprice, is_f FROM b" for d in _DIMS)}),
g AS (SELECT dimension, segment, count(CASE WHEN period='curr' THEN 1 END) AS n_curr, avg(CASE WHEN period='curr' THEN o_totalprice END) AS c1, avg(CASE WHEN period='prev' THEN o_totalprice END) AS p1,
 avg(CASE WHEN period='curr' THEN is_f END) AS c2, avg(CASE WHEN period='prev' THEN is_f END) AS p2,
 var_samp(CASE WHEN period='curr' THEN o_totalprice END) AS v1, var_samp(CASE WHEN period='prev' THEN o_totalprice END) AS w1, var_samp(CASE WHEN period='curr' THEN is_f END) AS v2, var_samp(CASE WHEN period='prev' THEN is_f END) AS w2,
 count(CASE WHEN period='prev' THEN 1 END) AS n_prev FROM l GROUP BY 1, 2),
r AS ({S.welch_p_sql(_SIDES, m1='metric_value', m0='baseline_value', v1='v1', v0='v0', n1='n_curr', n0='n_prev')}),
 x AS (SELECT concat_ws('|', dimension, segment, metric_name) AS finding_id, *, n_curr / (SELECT count(*) FROM b WHERE period='curr') AS affected_pct, (metric_value - baseline_value)/nullif(abs(baseline_value), 0) AS ch FROM r WHERE metric_value IS NOT NULL AND baseline_value IS NOT NULL),
y AS (SELECT *, abs(ch) > 0.2 AS actionable, coalesce(1 - p_value, 0) AS confidence, CASE WHEN ch > 0 THEN 'up' WHEN ch < 0 THEN 'down' ELSE '' END AS direction FROM x),
s AS (SELECT *, CASE WHEN baseline_value = 0 THEN CASE WHEN metric_value <> 0 THEN 15 ELSE 5 END WHEN abs(ch) > 0.5 THEN 25 WHEN abs(ch) > 0.2 THEN 20 WHEN abs(ch) > 0.1 THEN 15 WHEN abs(ch) > 0.05 THEN 10 ELSE 5 END AS magnitude,
 CASE WHEN affected_pct > 0.5 THEN 25 WHEN affected_pct > 0.3 THEN 20 WHEN affected_pct > 0.1 THEN 15 WHEN affected_pct > 0.05 THEN 10 ELSE 5 END AS breadth,
 CASE WHEN actionable THEN 25 WHEN coalesce(abs(ch) > 0.5, false) THEN 10 ELSE 5 END AS actionability, least(25, CAST(round_even(25 * confidence, 0) AS INT) + CASE WHEN p_value < 0.05 THEN 5 ELSE 0 END) AS confidence_points FROM y),
t AS (SELECT *, magnitude + breadth + actionability + confidence_points AS score FROM s)"""


@query("v3_score_findings", _FINDINGS + " SELECT finding_id, magnitude, breadth, actionability, confidence_points, score, row_number() OVER (ORDER BY score DESC, finding_id) AS rank FROM t")
def v3(t):
    ranked = S.rank_findings(S.score_findings(findings(t)), "finding_id")
    return ranked.select("finding_id", "magnitude", "breadth", "actionability", "confidence_points", "score", "rank")


@query("v4_theme_group", _FINDINGS + " SELECT theme, count(*) AS n_findings, count(CASE WHEN actionable THEN 1 END) AS n_actionable, max(score) AS max_score, max_by(finding_id, (score, -CAST(rn AS BIGINT))) AS top_finding FROM (SELECT *, row_number() OVER (ORDER BY finding_id) AS rn FROM t) GROUP BY 1")
def v4(t):
    return S.theme_groups(S.score_findings(findings(t)), "finding_id").withColumnRenamed("top_id", "top_finding")


@query("v5_contradictions", _FINDINGS + """, f AS (SELECT *, metric_name AS m FROM t WHERE direction <> ''),
p AS (SELECT u.m AS mu, d.m AS md, u.confidence AS cu, d.confidence AS cd, d.affected_pct AS ad FROM f u JOIN f d ON u.direction = 'up' AND d.direction = 'down'),
k AS (SELECT CASE WHEN mu = md THEN 'opposite_direction' WHEN ad > 0.2 THEN 'segment_decline' WHEN cu >= 0.8 AND cd >= 0.8 THEN 'confident_opposites' END AS kind, CASE WHEN mu = md THEN mu END AS metric_name FROM p)
SELECT kind, metric_name, count(*) AS n_pairs FROM k WHERE kind IS NOT NULL GROUP BY 1, 2""")
def v5(t):
    return S.contradictions(findings(t).withColumn("k", F.xxhash64("finding_id")), "k").select("kind", "metric_name", "n_pairs")


@query("v6_action_items", _FINDINGS + """ SELECT finding_id, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS priority,
 CASE WHEN direction = 'down' THEN 'Investigate and address' WHEN direction = 'up' THEN 'Capitalize on momentum' ELSE 'Act on finding' END AS action, metric_name AS metric FROM t WHERE actionable""")
def v6(t):
    return S.action_items(S.score_findings(findings(t))).select("finding_id", "priority", "action", "metric")


@query("v7_meta_patterns", _FINDINGS + """, d AS (SELECT count(CASE WHEN direction='up' THEN 1 END) AS u, count(CASE WHEN direction='down' THEN 1 END) AS w, count(*) AS n FROM t WHERE direction <> ''),
h AS (SELECT theme, count(*) AS n FROM t WHERE score >= 60 GROUP BY 1)
SELECT 'direction' AS pattern, CASE WHEN u = n AND n >= 2 THEN 'all up' WHEN w = n AND n >= 2 THEN 'all down' ELSE 'mixed' END AS subject, n FROM d WHERE (u = n AND n >= 2) OR (w = n AND n >= 2) OR (u >= 2 AND w >= 2)
UNION ALL SELECT 'theme_cluster', theme, n FROM h WHERE n >= 2
UNION ALL SELECT 'dimension_word', 'mobile', count(*) FROM t WHERE lower(segment) LIKE '%mobile%' HAVING count(*) >= 2""")
def v7(t):
    return S.meta_patterns(S.score_findings(findings(t)))


@query("v8_insight_scan", _FINDINGS + " SELECT finding_id, n_curr < 100 AS small_sample, round(metric_value, 6) AS metric_value, round(baseline_value, 6) AS baseline_value, round(affected_pct, 6) AS affected_pct, actionable, round(confidence, 6) AS confidence, direction FROM t")
def v8(t):
    return findings(t).select("finding_id", "small_sample", "metric_value", "baseline_value", "affected_pct", "actionable", "confidence", "direction")


@query("v9_scorecard_status", """
WITH g AS (SELECT l_suppkey, avg(l_quantity) AS v FROM lineitem GROUP BY 1), x AS (SELECT l_suppkey, v, (26.5 - v)/26.5 AS shortfall FROM g)
SELECT l_suppkey, round(v, 6) AS v, round(shortfall, 6) AS shortfall, CASE WHEN shortfall <= 0.05 THEN 'green' WHEN shortfall <= 0.15 THEN 'yellow' ELSE 'red' END AS status FROM x""")
def v9(t):
    g = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("v")).withColumn("benchmark", F.lit(26.5))
    return S.scorecard_status(g, "v", "benchmark").drop("benchmark")


@query("v10_rank_and_outlier", """
WITH m AS (SELECT o_orderpriority AS kpi, CAST(date_trunc('month', o_orderdate) AS DATE) AS it, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1, 2),
q AS (SELECT kpi, quantile_cont(v, 0.25) AS q1, median(v) AS med, quantile_cont(v, 0.75) AS q3 FROM m GROUP BY 1),
s AS (SELECT m.*, med, rank() OVER (PARTITION BY kpi ORDER BY v DESC) AS rank, abs(v - med) > 1.5*(q3-q1) AS outlier, sign(v - lag(v) OVER (PARTITION BY kpi ORDER BY it)) AS st FROM m JOIN q USING (kpi)),
r AS (SELECT *, sum(CASE WHEN st IS NOT DISTINCT FROM ps THEN 0 ELSE 1 END) OVER (PARTITION BY kpi ORDER BY it) AS rid FROM (SELECT *, lag(st) OVER (PARTITION BY kpi ORDER BY it) AS ps FROM s))
SELECT kpi, CAST(it AS VARCHAR) AS it, v, rank, outlier, CASE WHEN st IS NULL OR st = 0 THEN 0 ELSE row_number() OVER (PARTITION BY kpi, rid ORDER BY it) END AS run_length,
 CASE WHEN st IS NULL OR st = 0 THEN 0 ELSE row_number() OVER (PARTITION BY kpi, rid ORDER BY it) END >= 3 AS trend_flag FROM r""")
def v10(t):
    m = t.orders.groupBy(F.col("o_orderpriority").alias("kpi"), F.trunc("o_orderdate", "month").alias("it")).agg(N().cast("double").alias("v"))
    out = S.rank_and_outlier(m, "kpi", "it", "v")
    return out.withColumn("rank", F.col("rank").cast("long")).withColumn("run_length", F.col("run_length").cast("long"))
