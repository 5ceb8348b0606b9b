"""Paradox and mix-effect queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from insightspark.operators import paradox as P
from insightspark.plans.registry import query

N = lambda: F.count(F.lit(1))

_OC = """oc AS (SELECT o.*, c_mktsegment, c_nationkey, n_regionkey, CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS arm,
 CASE WHEN o_orderdate < DATE '1998-01-01' THEN 'prev' ELSE 'curr' END AS period FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def oc(t):
    """Orders with customer attributes, an arm and a period."""
    return (t.orders.join(t.customer.select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
             .join(t.nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
             .withColumn("arm", F.when(F.col("o_custkey") % 2 == 0, "even").otherwise("odd"))
             .withColumn("period", F.when(F.col("o_orderdate") < "1998-01-01", "prev").otherwise("curr")))


def _paradox_sql(segments, comparison):
    longs = " UNION ALL ".join(f"SELECT '{s}' AS segment_column, CAST({s} AS VARCHAR) AS segment, side, o_totalprice AS m FROM s" for s in segments)
    return f"""WITH {_OC}, top AS (SELECT {comparison} AS v, row_number() OVER (ORDER BY count(*) DESC, {comparison}) AS r FROM oc GROUP BY 1),
s AS (SELECT oc.*, CASE WHEN r = 1 THEN 'A' ELSE 'B' END AS side FROM oc JOIN top ON {comparison} = v AND r <= 2), l AS ({longs}),
g AS (SELECT segment_column, segment, avg(CASE WHEN side='A' THEN m END) AS a, avg(CASE WHEN side='B' THEN m END) AS b FROM l GROUP BY 1, 2),
o AS (SELECT segment_column, avg(CASE WHEN side='A' THEN m END) AS a, avg(CASE WHEN side='B' THEN m END) AS b FROM l GROUP BY 1),
v AS (SELECT g.segment_column, o.a AS oa, o.b AS ob, count(CASE WHEN g.a IS NOT NULL AND g.b IS NOT NULL AND g.a <> g.b AND o.a <> o.b THEN 1 END) AS ns,
 count(CASE WHEN g.a IS NOT NULL AND g.b IS NOT NULL AND g.a <> g.b AND o.a <> o.b AND (g.a > g.b) <> (o.a > o.b) THEN 1 END) AS nr FROM g JOIN o USING (segment_column) GROUP BY 1, 2, 3)
SELECT segment_column, CASE WHEN oa > ob THEN 'positive' WHEN oa < ob THEN 'negative' ELSE 'neutral' END AS aggregate_direction, round(oa, 4) AS value_a, round(ob, 4) AS value_b,
 ns AS n_segments, nr AS n_reversals, nr > ns - nr AS paradox_detected, CASE WHEN ns = 0 OR nr = 0 THEN 'none' WHEN nr/ns <= 0.25 THEN 'low' WHEN nr/ns <= 0.5 THEN 'medium' ELSE 'high' END AS severity FROM v"""


@query("r1_simpsons", _paradox_sql(["c_mktsegment"], "o_orderstatus"), digits=4)
def r1(t):
    return P.simpsons(oc(t), "o_totalprice", ["c_mktsegment"], "o_orderstatus")


@query("r2_simpsons_scan", _paradox_sql(["c_mktsegment", "n_regionkey", "o_orderpriority", "c_nationkey"], "arm"), digits=4)
def r2(t):
    return P.simpsons(oc(t), "o_totalprice", ["c_mktsegment", "n_regionkey", "o_orderpriority", "c_nationkey"], "arm")


@query("r2_segment_directions", f"""WITH {_OC}, g AS (SELECT o_orderpriority AS segment, sum(CASE WHEN o_custkey <= mid THEN 1 ELSE 0 END) AS n_a, sum(CASE WHEN o_custkey > mid THEN 1 ELSE 0 END) AS n_b,
 avg(CASE WHEN o_custkey <= mid THEN o_totalprice END) AS a, avg(CASE WHEN o_custkey > mid THEN o_totalprice END) AS b FROM oc, (SELECT median(o_custkey) AS mid FROM oc) GROUP BY 1)
SELECT segment, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, round(a, 4) AS value_a, round(b, 4) AS value_b, CASE WHEN a > b THEN 'positive' WHEN a < b THEN 'negative' ELSE 'neutral' END AS direction FROM g""", digits=4)
def r2b(t):
    return P.segment_directions(oc(t), "o_totalprice", ["o_orderpriority"], "o_custkey").select("segment", "n_a", "n_b", "value_a", "value_b", "direction")


@query("r3_weighted_vs_unweighted", """
WITH s AS (SELECT l_shipdate, l_suppkey, avg(l_discount) AS m, sum(l_discount * l_quantity) AS wx, sum(l_quantity) AS w FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2),
g AS (SELECT l_suppkey, avg(l_discount) AS m, sum(l_discount * l_quantity) AS wx, sum(l_quantity) AS w FROM lineitem WHERE l_quantity > 0 GROUP BY 1),
o AS (SELECT sum(wx)/sum(w) AS weighted, avg(m) AS unweighted, count(*) AS n_segments FROM g)
SELECT round(weighted, 6) AS weighted, round(unweighted, 6) AS unweighted, n_segments, round(weighted - unweighted, 6) AS difference, abs(weighted - unweighted)/abs(unweighted) > 0.001 AS flagged FROM o""")
def r3(t):
    return P.weighted_vs_unweighted(t.lineitem, "l_discount", "l_quantity", "l_suppkey", flag=0.001)


@query("r4_suggest_segments", """
WITH l AS (SELECT 'p_brand' AS column_name, p_brand AS v FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_name', p_name FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part),
s AS (SELECT column_name, count(*) AS n FROM l GROUP BY 1, v), g AS (SELECT column_name, count(*) AS n_values, stddev_pop(n)/avg(n) AS cv FROM s GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50)
SELECT column_name, n_values, round(cv, 6) AS cv, round(cv / (1 + 0.1 * greatest(0, n_values - 10)), 6) AS score FROM g ORDER BY 4 DESC, 1 LIMIT 5""")
def r4(t):
    return P.suggest_segments(t.part, ["p_brand", "p_type", "p_name", "p_size"])


@query("r5_trend_reversal_screen", f"""WITH {_OC}, q AS (SELECT * FROM oc WHERE year(o_orderdate) IN (1997, 1998)),
l AS (SELECT 'c_nationkey' AS dimension, CAST(c_nationkey AS VARCHAR) AS segment, period, o_totalprice AS v FROM q UNION ALL SELECT 'o_orderpriority', o_orderpriority, period, o_totalprice FROM q),
t AS (SELECT sum(CASE WHEN period='curr' THEN o_totalprice ELSE -o_totalprice END) AS total_change FROM q),
g AS (SELECT dimension, segment, sum(CASE WHEN period='prev' THEN v END) AS prev, sum(CASE WHEN period='curr' THEN v END) AS curr FROM l GROUP BY 1, 2)
SELECT dimension, segment, round(prev, 2) AS prev, round(curr, 2) AS curr, round(coalesce(curr,0) - coalesce(prev,0), 2) AS change, round(total_change, 2) AS total_change FROM g, t WHERE sign(coalesce(curr,0) - coalesce(prev,0)) * sign(total_change) < 0""", digits=2)
def r5(t):
    df = oc(t).where(F.year("o_orderdate").isin(1997, 1998))
    return P.trend_reversal_screen(df, ["c_nationkey", "o_orderpriority"], "period", "o_totalprice")


@query("r6_mix_vs_rate", f"""WITH {_OC}, g AS (SELECT c_mktsegment, sum(CASE WHEN period='prev' AND o_orderstatus='F' THEN 1.0 ELSE 0 END) AS n0, sum(CASE WHEN period='prev' THEN 1.0 ELSE 0 END) AS d0,
 sum(CASE WHEN period='curr' AND o_orderstatus='F' THEN 1.0 ELSE 0 END) AS n1, sum(CASE WHEN period='curr' THEN 1.0 ELSE 0 END) AS d1 FROM oc GROUP BY 1),
x AS (SELECT c_mktsegment, CAST(d0 AS DOUBLE)/sum(d0) OVER () AS s0, CAST(d1 AS DOUBLE)/sum(d1) OVER () AS s1, CAST(n0 AS DOUBLE)/d0 AS r0, CAST(n1 AS DOUBLE)/d1 AS r1 FROM g)
SELECT c_mktsegment, round(s0, 6) AS share_prev, round(s1, 6) AS share_curr, round(r0, 6) AS rate_prev, round(r1, 6) AS rate_curr, round((s1-s0)*r0, 6) + 0.0 AS mix_effect, round(s1*(r1-r0), 6) + 0.0 AS rate_effect FROM x""")
def r6(t):
    df = oc(t).select("c_mktsegment", "period", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("num"), F.lit(1.0).alias("den"))
    return P.mix_vs_rate(df, "c_mktsegment", "period", "num", "den")


@query("r7_engagement_controlled_lift", """
WITH u AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'treated' ELSE 'control' END AS arm, CAST(count(*) / 20 AS BIGINT) AS k, count(*) AS n,
 sum(CASE WHEN event_type='purchase' THEN value ELSE 0 END) AS rev FROM events GROUP BY 1),
v AS (SELECT *, CAST(floor(n / 20.0) AS BIGINT) AS stratum FROM u),
s AS (SELECT stratum, avg(CASE WHEN arm='treated' THEN rev END) - avg(CASE WHEN arm='control' THEN rev END) AS d FROM v GROUP BY 1)
SELECT round((SELECT avg(CASE WHEN arm='treated' THEN rev END) - avg(CASE WHEN arm='control' THEN rev END) FROM v), 4) AS raw_lift, round(avg(d), 4) AS controlled_lift, count(d) AS n_strata FROM s""", digits=4)
def r7(t):
    u = t.events.groupBy("user_id").agg(N().alias("n"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)).alias("rev"))
    u = u.withColumn("arm", F.when(F.col("user_id") % 2 == 0, "treated").otherwise("control")).withColumn("stratum", F.floor(F.col("n") / 20))
    return P.controlled_lift(u, "stratum", "arm", "rev")
