"""Customer value queries."""

from __future__ import annotations

from insightspark.operators import customers as C
from insightspark.plans.registry import query

_RFM = """r AS (SELECT o_custkey, (SELECT max(CAST(o_orderdate AS DATE)) + 1 FROM orders) - max(CAST(o_orderdate AS DATE)) AS recency, count(o_orderdate) AS frequency, sum(o_totalprice) AS monetary FROM orders GROUP BY 1),
q AS (SELECT quantile_cont(recency, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS r5, quantile_cont(frequency, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS f5, quantile_cont(monetary, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS m5 FROM r),
s AS (SELECT r.*, 5 - (CAST(recency > r5[2] AS INT) + CAST(recency > r5[3] AS INT) + CAST(recency > r5[4] AS INT) + CAST(recency > r5[5] AS INT)) AS rs, 1 + CAST(frequency > f5[2] AS INT) + CAST(frequency > f5[3] AS INT) + CAST(frequency > f5[4] AS INT) + CAST(frequency > f5[5] AS INT) AS fs,
 1 + CAST(monetary > m5[2] AS INT) + CAST(monetary > m5[3] AS INT) + CAST(monetary > m5[4] AS INT) + CAST(monetary > m5[5] AS INT) AS ms FROM r, q),
z AS (SELECT *, CASE WHEN rs >= 4 AND fs >= 4 AND ms >= 4 THEN 'Champions' WHEN fs >= 3 AND ms >= 3 THEN 'Loyal' WHEN rs <= 2 AND fs >= 3 THEN 'At Risk' WHEN rs <= 2 AND fs <= 2 AND ms <= 2 THEN 'Lost' ELSE 'Other' END AS segment FROM s)"""


@query("y1_rfm", f"WITH {_RFM} SELECT o_custkey, recency, frequency, round(monetary, 2) AS monetary, CAST(rs AS INT) AS r, CAST(fs AS INT) AS f, CAST(ms AS INT) AS m, CAST(rs AS VARCHAR) || CAST(fs AS VARCHAR) || CAST(ms AS VARCHAR) AS rfm_score, segment FROM z", digits=2)
def y1(t):
    return C.rfm(t.orders, "o_custkey", "o_orderdate", "o_totalprice")


@query("y1_rfm_summary", f"WITH {_RFM} SELECT segment, count(*) AS customers, round(avg(monetary), 2) AS avg_monetary, round(avg(frequency), 2) AS avg_frequency, round(100.0*count(*)/(SELECT count(*) FROM z), 1) AS pct FROM z GROUP BY 1")
def y1b(t):
    return C.rfm_summary(C.rfm(t.orders, "o_custkey", "o_orderdate", "o_totalprice"))


_CONC = """v AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1), a AS (SELECT v, row_number() OVER (ORDER BY v) AS i, row_number() OVER (ORDER BY v DESC) AS j, count(*) OVER () AS n, sum(v) OVER () AS t, sum(v) OVER (ORDER BY v DESC ROWS UNBOUNDED PRECEDING) AS cd, sum(v) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS ca FROM v)"""


@query("y2_concentration", f"""WITH {_CONC}
SELECT max(n) AS n_entities, round(max(t), 2) AS total, round(greatest(0, 2*sum(i*v)/(max(n)*max(t)) - (max(n)+1)/max(n)), 6) AS gini, round(sum(CASE WHEN j <= ceil(n*0.1) THEN v END)/max(t), 6) AS top_10_share, round(sum(CASE WHEN j <= ceil(n*0.2) THEN v END)/max(t), 6) AS top_20_share,
 round(sum(CASE WHEN j <= ceil(n*0.5) THEN v END)/max(t), 6) AS top_50_share, round(100*min(CASE WHEN cd >= 0.8*t THEN j END)/max(n), 6) AS pareto_pct FROM a""")
def y2(t):
    from pyspark.sql import functions as F
    return C.concentration(t.orders, "o_totalprice", "o_custkey").withColumn("total", F.round("total", 2))


@query("y2_lorenz_curve", f"""WITH {_CONC} SELECT p/10 AS entity_share, round(coalesce(max(CASE WHEN i <= floor(n*p/10) THEN ca/t END), 0), 6) AS value_share FROM a, (SELECT unnest(range(1, 11)) AS p) GROUP BY p""")
def y2b(t):
    return C.lorenz_curve(t.orders, "o_totalprice", "o_custkey")
